"""Windows of up to 31 bases as numbers of two bits a base, made by vectorised kernels inside tasks.

A code's order is that of its string (A 0, C 1, G 2, T 3), so the smaller of both strands' codes is
the canonical one. Windows with other characters than ACGT have no code."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Longest window, bases that are worked on at once, and bases of a batch of reads that are looked up together.
MOST, PIECE, LOOKUP = 31, 1 << 20, 1 << 21
#: Bits of a table of codes: 8 MiB however many there are.
TABLE_BITS = 26

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def codes_of(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every k-window and of its reverse complement, by doubling: a window of m + n bases is joined of both."""
    one = bases.astype(np.int64)
    size, fwd, rev = 1, one, 3 - one
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []
    rest = k
    while True:
        if rest & 1:
            parts.append((size, fwd, rev))
        rest >>= 1
        if not rest:
            break
        fwd, rev = (fwd[:-size] << 2 * size) | fwd[size:], (rev[size:] << 2 * size) | rev[:-size]
        size *= 2
    n, done = len(bases) - k + 1, 0
    f, r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for m, a, b in parts:
        f = (f << 2 * m) | a[done : done + n]
        r |= b[done : done + n] << 2 * done
        done += m
    return f, r


def _pieces(seqs: list[str | None], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, rows, places): some texts laid end to end with a mark between, long ones cut in overlapping pieces,
    and for each byte its row and place."""
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def laid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = np.frombuffer(b"\0".join(b for b, _, _ in held), np.uint8)
        lengths = np.array([len(b) + 1 for b, _, _ in held])
        lengths[-1] -= 1
        starts = np.cumsum(lengths) - lengths
        rows = np.repeat([r for _, r, _ in held], lengths)
        places = np.arange(len(text)) - np.repeat(starts - np.array([p for _, _, p in held]), lengths)
        return text, rows, places

    for row, seq in enumerate(seqs):
        raw = seq.encode("latin-1", "replace") if seq else b""
        for at in range(0, max(len(raw) - k + 1, 0), PIECE):
            held.append((raw[at : at + PIECE + k - 1], row, at))
            size += len(held[-1][0])
            if size >= PIECE:
                yield laid()
                held, size = [], 0
    if held:
        yield laid()


def _whole(marked: np.ndarray, k: int) -> np.ndarray:
    """For each k-window how many of its places are marked."""
    run = np.concatenate([[0], np.cumsum(marked)])
    return run[k:] - run[:-k]


def _mixed(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def code_table(codes: DataFrame) -> np.ndarray:
    """A table of 2 ** TABLE_BITS bits in which those of codes (code) are set; others may share a bit. Its words are set in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            bit = np.unique(_mixed(x["code"].to_numpy()) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            word, first = np.unique(bit >> 6, return_index=True)
            if len(word):
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(np.int64(1) << (bit & 63), first))], ["word", "bits"])

    table = np.zeros(1 << TABLE_BITS - 6, np.int64)
    for word, bits in codes.select("code").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        table[word] = bits
    return table


def packed_least(df: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """key, at, code, forward: one valid k-window of each row, the first of least mixed code, so what many rows begin with is seldom it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            best: dict[int, tuple[int, int, int, bool]] = {}
            for text, rows, places in _pieces(x[seq].to_pylist(), k):
                bases = _CODE[text]
                at = np.flatnonzero(_whole(bases == 4, k) == 0)
                f, r = codes_of(bases & 3, k)
                f, r = f[at], r[at]
                code = np.minimum(f, r)
                mixed = _mixed(code)
                order = np.lexsort((places[at], mixed, rows[at]))
                row, first = np.unique(rows[at][order], return_index=True)
                for i, o in zip(row.tolist(), order[first].tolist()):
                    found = int(mixed[o]), int(places[at[o]]), int(code[o]), bool(f[o] <= r[o])
                    best[i] = min(best.get(i, found), found)
            row = sorted(best)
            cells = [pa.array([best[i][c] for i in row], t) for c, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([x[key].take(pa.array(row, pa.int64())), *cells], [key, "at", "code", "forward"])

    return df.select(key, seq).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, at long, code long, forward boolean")


def packed_windows(df: DataFrame, k: int, key: str, seq: str = "seq", table: np.ndarray | None = None) -> DataFrame:
    """key, pos, code, forward: every valid k-window's canonical code, and whether it is the window's own strand's; with a code_table()
    of those that have a bit there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for text, rows, places in _pieces(x[seq].to_pylist(), k):
                bases = _CODE[text]
                at = np.flatnonzero(_whole(bases == 4, k) == 0)
                f, r = codes_of(bases & 3, k)
                f, r = f[at], r[at]
                if table is not None:
                    bit = (_mixed(np.minimum(f, r)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                    kept = np.flatnonzero(table[bit >> 6] >> (bit & 63) & 1)
                    at, f, r = at[kept], f[kept], r[kept]
                yield pa.RecordBatch.from_arrays([x[key].take(pa.array(rows[at])), pa.array(places[at]), pa.array(np.minimum(f, r)), pa.array(f <= r)], [key, "pos", "code", "forward"])

    return df.select(key, seq).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, pos long, code long, forward boolean")


def packed_counts(df: DataFrame, k: int, stranded: bool = False, seq: str = "seq") -> DataFrame:
    """code, f, r: how often each canonical k-window (or each as it stands, if stranded) occurs on either strand, counted in
    the tasks before the shuffle; windows with a soft-masked base count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for text, _, _ in _pieces(x[seq].to_pylist(), k):
                bases = _CODE[text]
                at = np.flatnonzero(_whole(bases == 4, k) == 0)
                f, r = codes_of(bases & 3, k)
                f, r = f[at], r[at]
                counts = (_whole(text >= 97, k)[at] == 0).astype(np.int64)
                forward = np.ones(len(at), bool) if stranded else f <= r
                code, back = np.unique(f if stranded else np.minimum(f, r), return_inverse=True)
                n = [np.bincount(back, counts * s, len(code)).astype(np.int64) for s in (forward, ~forward)]
                yield pa.RecordBatch.from_arrays([pa.array(code), *map(pa.array, n)], ["code", "f", "r"])

    counted = df.select(seq).mapInArrow(run, "code long, f long, r long")
    return counted.groupBy("code").agg(F.sum("f").alias("f"), F.sum("r").alias("r"))


def _canonical(text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the valid k-windows of some bytes, and their canonical codes."""
    bases = _CODE[text]
    at = np.flatnonzero(_whole(bases == 4, k) == 0)
    f, r = codes_of(bases & 3, k)
    return at, np.minimum(f, r)[at]


def _squeezed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as the steps between them, in the least width that holds them all, which is the first byte."""
    steps = np.diff(numbers, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or steps.max() < 1 << 8 * w)
    return bytes([width]) + steps.astype(f"<u{width}").tobytes()


def _spread(squeezed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(squeezed, f"<u{squeezed[0]}", offset=1).astype(np.int64))


def packed_runs(df: DataFrame, codes: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """key, seq, hits, start, run: for each row how many of its windows are among codes (code), and the place and windows of its longest
    run of them, the first of equals (null without any).

    No row is made for a window. Reads are written in batches of LOOKUP bases; the different codes of a batch are dealt into
    buckets of the code space, as the steps between them, and meet the set there; what is found goes back to the batch,
    whose windows are made once more. The more bases there are, the more buckets, so one has as many codes at any size.

    Cases: rows of one key are looked at one by one; null sequences and those under k have no hits."""
    from skein.plans.iterate import materialize

    fields = f"{key} {df.schema[key].dataType.simpleString()}, {seq} string"

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, room = 0, 0
        for x in batches:
            ids, sizes = [], []
            for s in x[seq].to_pylist():
                if room <= 0:
                    batch, room = uuid.uuid4().int >> 65, LOOKUP
                ids.append(batch)
                sizes.append(len(s or ""))
                room -= sizes[-1] + 1
            yield pa.RecordBatch.from_arrays([x[key], x[seq], pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], [key, seq, "batch", "size"])

    reads = materialize(df.select(key, seq).mapInArrow(batched, f"{fields}, batch long, size long"))
    buckets = int(reads.agg(F.sum("size")).first()[0] or 0) // LOOKUP * 2 + 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = x["batch"].to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for a, b in zip([0, *ends], ends):
                some = [np.unique(_canonical(text, k)[1]) for text, _, _ in _pieces(x[seq].slice(a, b - a).to_pylist(), k)]
                own = np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)
                if not len(own):
                    continue
                bucket = own % buckets
                order = np.argsort(bucket, kind="stable")
                bucket, own = bucket[order], own[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                held = [_squeezed(c // buckets) for c in np.split(own, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[[0, *cuts]]), pa.array(np.full(len(held), ids[a], np.int64)), pa.array(held, pa.binary())], ["bucket", "batch", "held"])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.sort(right["code"].to_numpy()) // buckets
        found = [_spread(h) for h in left["held"].to_pylist()] if len(known) else []
        found = [h[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h] for h in found]
        some = [i for i, h in enumerate(found) if len(h)]
        return pa.table({"batch": left["batch"].take(pa.array(some, pa.int64())), "bucket": left["bucket"].take(pa.array(some, pa.int64())), "held": pa.array([_squeezed(found[i]) for i in some], pa.binary())})

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        known = [_spread(h) * buckets + b for h, b in zip(right["held"].to_pylist(), right["bucket"].to_pylist())]
        known = np.sort(np.concatenate(known)) if known else np.array([-1])
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for text, row, place in _pieces(left[seq].to_pylist(), k):
            at, code = _canonical(text, k)
            at = at[known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code]
            rows.append(row[at])
            places.append(place[at])
        row, place, n = np.concatenate(rows), np.concatenate(places), left.num_rows
        begin = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 1))
        run = np.diff([*begin, len(row)])
        order = np.lexsort((place[begin], -run, row[begin]))
        of, first = np.unique(row[begin][order], return_index=True)
        best = order[first]
        start, longest = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        start[of], longest[of] = place[begin][best], run[best]
        none = longest == 0
        return pa.table({key: left[key], seq: left[seq], "hits": np.bincount(row, minlength=n).astype(np.int64), "start": pa.array(start, mask=none), "run": pa.array(longest, mask=none)})

    asked = reads.select(seq, "batch").mapInArrow(dealt, "bucket long, batch long, held binary")
    given = codes.select("code", (F.col("code") % buckets).alias("bucket"))
    answers = asked.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(met, "batch long, bucket long, held binary")
    return reads.drop("size").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(judged, f"{fields}, hits long, start long, run long")


def packed_places(df: DataFrame, mask: str, seq: str = "seq") -> DataFrame:
    """code, n: how often the bases at a mask's used places (1) occur together, counted in the tasks before the shuffle."""
    used = [i for i, c in enumerate(mask) if c == "1"]
    k = len(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for text, _, _ in _pieces(x[seq].to_pylist(), k):
                bases = _CODE[text]
                at = np.flatnonzero(_whole(bases == 4, k) == 0)
                code = np.zeros(len(at), np.int64)
                for i in used:
                    code = (code << 2) | bases[at + i]
                values, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["code", "n"])

    return df.select(seq).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _flipped(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements."""
    x = codes.astype(np.uint64)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = (x >> np.uint64(shift)) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(shift)
    return ((x.byteswap() >> np.uint64(64 - 2 * k)) ^ np.uint64((1 << 2 * k) - 1)).astype(np.int64)


def oriented_codes(codes: DataFrame, k: int) -> DataFrame:
    """canon, w and the other columns: both orientations of each code (canon, ...), one of a palindrome."""
    others = [f for f in codes.schema.fields if f.name != "canon"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            own = x["canon"].to_numpy()
            other = _flipped(own, k)
            at = np.concatenate([np.arange(len(own)), np.flatnonzero(other != own)])
            w = np.concatenate([own, other[other != own]])
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(w), *[x[f.name].take(pa.array(at)) for f in others]], ["canon", "w", *[f.name for f in others]])

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in others)
    return codes.select("canon", *[f.name for f in others]).mapInArrow(run, f"canon long, w long{kinds}")


def unpacked(code: Column, k: int) -> Column:
    """A code's bases as a string."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def packed(kmer: Column) -> Column:
    """The code of a string of bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")

"""Operator 2: documents that hold passages of benchmark items, by a prefix-filtered set join."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.plans.iterate import discard, materialize

WINDOW = 10
#: Words in a shingle, the token of the set join.
SHINGLE = 5
#: Bits of the tables that tell tasks which shingles to look up; of fixed size, they let too many through at worst.
BITS = 1 << 24
#: Shingles that a task counts before it hands on what it has.
COUNTED = 500_000

#: Lower-cases A-Z and blanks every other ASCII character that is no letter or digit.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text after A-Z are lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class _Hashes(dict):
    """Word -> 64-bit hash, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words, from the words' hashes."""
    n = len(ids) - width + 1
    if n <= 0:
        return ids[:0]
    h = ids[:n].copy()
    for j in range(1, width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += ids[j : j + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _ids(words: list[bytes], cache: _Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


_WINDOWS = "item string, size int, words binary, k int, at int, h long"


def _windows(window: int, shingle: int):
    """A row for each shingle of each different window of an item: the shingle's width k, its place and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for x in batches:
            for item, text in zip(x["item_id"].to_pylist(), x["text"].to_pylist(), strict=True):
                w = words_of(text)
                if not w:
                    continue
                size = min(window, len(w))
                k = min(shingle, size)
                h = shingle_hashes(_ids(w, cache), k).view(np.int64)
                begins = list({tuple(w[i : i + size]): i for i in range(len(w) - size + 1)}.values())
                for at in range(0, len(begins), 10_000):  # very long items in parts
                    part, n = np.array(begins[at : at + 10_000]), size - k + 1
                    windows = pa.array([b" ".join(w[i : i + size]) for i in part.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([item] * (len(part) * n), pa.string()),
                            pa.array(np.full(len(part) * n, size, np.int32)),
                            windows.take(pa.array(np.repeat(np.arange(len(part)), n))),
                            pa.array(np.full(len(part) * n, k, np.int32)),
                            pa.array(np.tile(np.arange(n, dtype=np.int32), len(part))),
                            pa.array(h[(part[:, None] + np.arange(n)).ravel()]),
                        ],
                        [c.split(" ")[0] for c in _WINDOWS.split(", ")],
                    )

    return run


def _table(shingles: DataFrame) -> dict[int, np.ndarray]:
    """For each width of shingles (k, h) a table of BITS bits in which those of the hashes are set.

    A window has no more shingle widths than words in a shingle, so there are few tables."""
    bit = F.shiftrightunsigned("h", 64 - (BITS.bit_length() - 1))
    packed = shingles.select("k", bit.alias("b")).distinct().groupBy("k", F.floor(F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    out: dict[int, np.ndarray] = {}
    for k, w, v in packed.toLocalIterator():  # at most BITS / 64 rows a width
        out.setdefault(k, np.zeros(BITS // 64, np.int64))[w] = v
    return {k: t.view(np.uint8) for k, t in sorted(out.items())}


def _positions(ids: np.ndarray, width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the shingles that a table has a bit of."""
    h = shingle_hashes(ids, width)
    bit = (h >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)
    at = np.flatnonzero(table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
    return at, h[at]


def _count(tables):
    """(k, h, n): how often each text, counted once, has the shingles that the tables have a bit of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = _Hashes(), Counter()

        def told() -> pa.RecordBatch:
            keys = list(seen)
            out = [pa.array([k for k, _ in keys], pa.int32()), pa.array(np.array([h for _, h in keys], np.uint64).view(np.int64)), pa.array([seen[x] for x in keys], pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(out, ["k", "h", "n"])

        for x in batches:
            for text in x["text"].to_pylist():
                ids = _ids(words_of(text), cache)
                for k, table in tables.value.items():
                    _, h = _positions(ids, k, table)
                    if len(h):
                        seen.update((k, y) for y in set(h.tolist()))
            if len(seen) > COUNTED:
                yield told()
        yield told()

    return run


_FOUND = "n_words long, found array<struct<k:int,h:long,p:int,before:array<binary>,after:array<binary>>>"


def _look(tables, window: int, kept: list[str]):
    """The columns `kept`, the number of words and the places where a prefix may stand, with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for x in batches:
            n_words, found = [], []
            for text in x["text"].to_pylist():
                w = words_of(text)
                ids, here = _ids(w, cache), []
                for k, table in tables.value.items():
                    at, h = _positions(ids, k, table)
                    here += [{"k": k, "h": y, "p": p, "before": w[max(p - window, 0) : p], "after": w[p : p + window]} for p, y in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)]
                n_words.append(len(w)), found.append(here)
            kind = pa.list_(pa.struct([("k", pa.int32()), ("h", pa.int64()), ("p", pa.int32()), ("before", pa.list_(pa.binary())), ("after", pa.list_(pa.binary()))]))
            yield pa.RecordBatch.from_arrays([*(x[c] for c in kept), pa.array(n_words, pa.int64()), pa.array(found, kind)], [*kept, "n_words", "found"])

    return run


def _prefixes(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(k, h, at, size, words, items): every different window under its prefix, its rarest shingle in documents.

    Shingles are ordered by rarity, by hash and by place. The containment asked for is that of all of a
    window's shingles, so the first in that order is what a document cannot do without."""
    each = materialize(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").mapInArrow(_windows(window, shingle), _WINDOWS))
    shared = docs.sparkSession.sparkContext.broadcast(_table(each))
    often = docs.select("text").where("text is not null").mapInArrow(_count(shared), "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    places = each.select("size", "words", "k", "at", "h").distinct().join(often, ["k", "h"], "left")
    first = places.groupBy("size", "words", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")).alias("first"))
    items = each.where("at = 0").groupBy("size", "words").agg(F.collect_set("item").alias("items"))  # without null ids
    found = materialize(first.join(items, ["size", "words"]).select("k", "first.h", "first.at", "size", "words", "items"))
    discard(each)
    return found


def _hits(places: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row, spans, item_ids) of the rows of places (row, found) in which a window occurs; spans are sorted (begin, end).

    A prefix that stands at p, at places from its window's begin, fixes where the window must begin; it must
    begin in the text and end in it (positional and length bounds), and its words are then compared."""
    at = places.select("row", F.explode("found").alias("f")).select("row", "f.*")
    met = at.join(prefixes, ["k", "h"])
    begins = F.size("before") - F.col("at")
    inside = (begins >= 0) & (F.size("after") >= F.col("size") - F.col("at"))
    words = F.concat(F.slice("before", F.size("before") - F.col("at") + 1, F.col("at")), F.slice("after", F.lit(1), F.col("size") - F.col("at")))
    same = F.when(inside, F.array_join(F.transform(words, lambda w: F.hex(w)), "20") == F.hex("words"))
    hits = met.where(same).select("row", (F.col("p") - F.col("at")).alias("begin"), (F.col("p") - F.col("at") + F.col("size")).alias("end"), "items").distinct()
    return hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, kept: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A written table of docs' columns `kept` and n_words by row, its hits, and the prefixes that they were found by."""
    prefixes = _prefixes(docs, benchmark, window, shingle)
    tables = docs.sparkSession.sparkContext.broadcast(_table(prefixes))
    told = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    looked = docs.select(*kept, "text").mapInArrow(_look(tables, window, kept), f"{told}, {_FOUND}")
    rows = materialize(looked.withColumn("row", F.monotonically_increasing_id()))
    return rows, _hits(rows.select("row", "found"), prefixes), prefixes


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) and contaminated of each row.

    A window is `window` consecutive words of an item, or all words of a shorter one; a
    document word inside any occurrence of a window is hit. Windows are sets of word
    shingles; they are joined to documents in two passes over the texts:

    1. documents' shingles that may occur in the benchmark are counted (documents each,
       combined in every task before the shuffle), which orders shingles by rarity;
    2. each window stands under its rarest shingle, the prefix that a document holding the whole
       window must share. Documents' places of such shingles, with the words around them, are joined
       to the windows by it; positional and length bounds and the words themselves decide.

    Tasks know the shingles to look for by bit tables of fixed size. Texts are not shuffled, only
    places are; a small table of windows is broadcast by its size, and a large one is joined
    by shuffles in which adaptive execution splits a frequent passage.

    Cases: null texts have no words; an item without words has no windows; items of the
    same id count once; an item with a null id hits words but is not listed; no items
    mean no hits; other columns of docs are left aside.
    """
    rows, hits, _ = _marked(docs.select("doc_id", "text"), benchmark, window, shingle, ["doc_id"])
    n_hit = F.expr(
        "aggregate(spans, struct(0L as n, -1 as last), (a, x) -> struct(a.n + greatest(x.end - greatest(x.begin, a.last), 0) as n, greatest(a.last, x.end) as last), a -> a.n)"
    )
    met = rows.select("row", "doc_id", "n_words").join(hits, "row", "left")
    none = F.array().cast("array<string>")
    return met.select("doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.col("spans").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs.

    The texts that go are told by 128 bits of their content, which meet the rows in one join."""
    key = F.unhex(F.md5("text"))
    rows, hits, prefixes = _marked(docs.select("text", key.alias("text_key")), benchmark, window, shingle, ["text_key"])
    gone = materialize(rows.select("row", "text_key").join(hits, "row", "left_semi").select(F.col("text_key").alias("__text_key")).distinct())
    discard(rows, prefixes)
    return docs.withColumn("__text_key", key).join(gone, "__text_key", "left_anti").drop("__text_key")

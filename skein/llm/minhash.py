"""Operator 6: near-duplicate groups by circulant MinHash, banding and exact Jaccard similarity."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.plans.iterate import connected_components, discard, materialize

#: Most bands, and rows of a band, that a signature is cut into; see banding().
BANDS, ROWS = 40, 5
#: A pair of just the least similarity shares no band with at most about this probability.
MISS = 2e-7
#: Signature coordinates of which a bit is kept; 0.5 + 0.5 * similarity of them agree on average.
BITS = 192
#: Rounds of further pivots before the rest is joined by rare shingles.
PIVOT_ROUNDS = 2
#: Parts that the pairs of one pivot are dealt to.
SALTS = 256


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) for a least similarity: the most rows, of ROWS at most, with which BANDS bands
    miss a pair with probability MISS at most; with one row, as many bands as that takes."""
    s = percent / 100
    if s >= 1:
        return 1, ROWS
    need = {r: math.ceil(math.log(MISS) / math.log1p(-(s**r))) for r in range(1, ROWS + 1)}
    rows = max((r for r, b in need.items() if b <= BANDS), default=1)
    return need[rows], rows


def most_differing(percent: int) -> int:
    """Signature bits in which a pair of that similarity differs at most, six standard deviations out."""
    agree = (1 + percent / 100) / 2
    return BITS - int(BITS * (agree - 6 * (agree * (1 - agree) / BITS) ** 0.5))


class _Words(dict):
    """Word -> 64-bit hash, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_set(text: str | None, width: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+; fewer words than `width`, but not
    none, make one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(ids) - width + 1
    h = ids[:n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(width)
    for j in range(1, width):
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += ids[j : j + n]
    h ^= h >> np.uint64(32)
    return np.unique(h * np.uint64(0xD6E8FEB86659FD93))


#: Odd multipliers of the two permutations.
_SIGMA, _PI = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)


def signature(shingles: np.ndarray, size: int = max(BANDS * ROWS, BITS)) -> np.ndarray:
    """Circulant MinHash (Li and Li, "C-MinHash", 2022): a first permutation sigma breaks up the
    set's structure; coordinate k is the least value of a second one, pi, shifted circularly by k.

    Both permute 2**32 values: shifts into lower bits and odd multiplications can be undone."""
    sigma = (shingles >> np.uint64(32)).astype(np.uint32)
    sigma ^= sigma >> np.uint32(16)
    sigma *= _SIGMA
    sigma ^= sigma >> np.uint32(15)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    for at in range(0, len(sigma), 4096):  # many coordinates at once, in blocks that stay in the processor's cache
        part = sigma[None, at : at + 4096]
        step = max(1, 32768 // part.shape[1])
        for k in range(0, size, step):
            x = part - shifts[k : k + step]
            x ^= x >> np.uint32(16)
            x *= _PI
            np.minimum(out[k : k + step], x.min(axis=1), out=out[k : k + step])
    return out


_SKETCH = "doc_id long, row_key binary, n long, set_key binary, bands array<long>, " + ", ".join(f"low{i} long" for i in range(BITS // 64))


def _sketch(width: int, percent: int):
    count, depth = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for x in batches:
            sizes, keys, bands, low = [], [], [], []
            for text in x["text"].to_pylist():
                s = shingle_set(text, width, cache)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), low.append((None,) * (BITS // 64))
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig = signature(s, max(count * depth, BITS))
                bands.append([xxhash.xxh3_64_intdigest(sig[b * depth : (b + 1) * depth].tobytes(), seed=b) - (1 << 63) for b in range(count)])
                odd = (sig[:BITS] >> np.uint32(9) & np.uint32(1)).astype(np.uint64).reshape(-1, 64)
                low.append((odd * bits).sum(axis=1, dtype=np.uint64).view(np.int64).tolist())
            columns = [x["doc_id"], x["row_key"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *[pa.array([r[i] for r in low], pa.int64()) for i in range(BITS // 64)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n", "set_key", "bands", *[f"low{i}" for i in range(BITS // 64)]])

    return run


def _marked(row_keys: pa.Array, table: np.ndarray) -> np.ndarray:
    """Which row keys are marked in a table of _marks()."""
    at = np.frombuffer(b"".join(k[4:8] for k in row_keys.to_pylist()), ">u4") % _MARKS
    return table[at >> 3] >> (at & 7).astype(np.uint8) & 1


def _sets(width: int, wanted):
    """set_key and shingles of the rows whose key is marked in the bit table `wanted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, table = _Words(), wanted.value
        for x in batches:
            keys, sets = [], []
            marked = _marked(x["row_key"], table)
            for text, m in zip(x["text"].to_pylist(), marked.tolist(), strict=True):
                if m and len(s := shingle_set(text, width, cache)):
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["set_key", "shingles"])

    return run


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, s, rest: the rarest shingles of each of these sets, as many as make any similar pair share one.

    Two sets of similarity percent share at least that part of either, so they cannot do without the
    first size - ceil(percent * size) + 1 shingles of each in one order; rare ones come first. Shingles
    that only one of the sets has take their places in the order but pair nothing. rest counts a set's
    shingles from this one on: what two sets can share at most if this is the first that they do."""
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("m")).where("m > 1")
    alone = each.groupBy("s").agg(F.count("*").alias("m"), F.min("node").alias("node")).where("m = 1").groupBy("node").agg(F.count("*").alias("own"))
    room = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - F.coalesce("own", F.lit(0))
    met = each.join(alone, "node", "left").withColumn("room", room).where("room > 0").join(often, "s")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("m", "s"))
    return met.withColumn("r", rank).where(F.col("r") <= F.col("room")).select("node", "s", (F.col("n") - F.coalesce("own", F.lit(0)) - F.col("r") + 1).alias("rest"))


#: Bits of the filter that chooses the texts whose sets are made again.
_MARKS = 1 << 26


def _marks(keys: DataFrame) -> np.ndarray:
    """A table of _MARKS bits in which those of all row_keys are set: a filter of fixed size that lets too much through at worst."""
    bit = F.pmod(F.conv(F.hex(F.substring("row_key", 5, 4)), 16, 10).cast("long"), F.lit(_MARKS))
    packed = keys.select(bit.alias("k")).distinct().groupBy(F.floor(F.col("k") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("b"))
    table = np.zeros(_MARKS // 64, np.int64)
    for w, b in packed.toLocalIterator():  # at most _MARKS / 64 rows
        table[w] = b
    return table.view(np.uint8)


def _row_key() -> Column:
    """128 bits that tell a row from others by doc_id and text."""
    told = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(told(F.col("doc_id")), F.lit(":"), told(F.length("text")), F.lit(":"), F.coalesce("text", F.lit("")))))


def _beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs (a, b ...) with b's columns of table (b ...), which goes once to each of b's parts that has pairs.

    A pivot of very many pairs is spread over SALTS parts."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    parts = dealt.select("b", "salt").distinct().join(table, "b")
    return dealt.join(parts, ["b", "salt"]).drop("salt")


class _Rows:
    """What the stages of near_duplicates() have in common: the rows' sketches, classes of equal sets, and the tests of a pair."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        self.keyed = docs.select("doc_id", "text", _row_key().alias("row_key"))
        sketched = materialize(self.keyed.mapInArrow(_sketch(width, percent), _SKETCH))
        self.rows = sketched
        low = [f"low{i}" for i in range(BITS // 64)]
        # exact copies are one class, pre-combined before the shuffle; only its smallest doc_id goes on
        classes = sketched.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("row_key").alias("row_key"), *[F.first(c).alias(c) for c in ("n", "bands", *low)])
        self.classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
        self.facts = self.classes.select("node", "n", *low)

    def members(self) -> DataFrame:
        """(bucket, node, pivot) of all buckets that several classes share; the pivot is the smallest node."""
        entries = self.classes.select("node", F.explode("bands").alias("bucket"))
        shared = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("pivot")).where("m > 1")
        return entries.join(shared.select("bucket", "pivot"), "bucket")

    def full_sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of some classes, made again from the texts."""
        known = self.classes.join(nodes, "node", "left_semi").select("set_key", "node", "row_key")
        wanted = self.keyed.sparkSession.sparkContext.broadcast(_marks(known))
        found = self.keyed.mapInArrow(_sets(self.width, wanted), "set_key binary, shingles array<long>")
        return found.join(known.select("set_key", "node"), "set_key").groupBy("node").agg(F.first("shingles").alias("shingles"))

    def likely(self, x: str, y: str) -> Column:
        """By sizes and signature bits, whether two classes may be similar; their columns are named after x and y."""
        apart = sum((F.bit_count(F.col(f"{x}low{i}").bitwiseXOR(F.col(f"{y}low{i}"))) for i in range(BITS // 64)), F.lit(0))
        return (100 * F.least(f"{x}n", f"{y}n") >= self.percent * F.greatest(f"{x}n", f"{y}n")) & (apart <= most_differing(self.percent))

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """The likely ones of distinct pairs (a, b)."""
        named = lambda x: self.facts.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in self.facts.columns[1:]])
        return _beside(pairs.join(named("a"), "a"), named("b")).where(self.likely("a_", "b_")).select("a", "b")

    def similar(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of distinct pairs (a, b) whose full sets are similar enough."""
        both = _beside(pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a"), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")))
        inter = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * inter >= self.percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, c) after more links (a, b) between nodes: components of components."""
    ends = links.join(label.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(label.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    moved = connected_components(ends.select("ca", "cb"), "ca", "cb").select(F.col("node").alias("c"), "comp")
    return label.join(moved, "c", "left").select("node", F.coalesce("comp", "c").alias("c"))


def _grouped(docs: DataFrame, width: int, percent: int, pivot_rounds: int) -> DataFrame:
    """row_key, doc_id, n, comp, component_id of every row; see near_duplicates()."""
    of = _Rows(docs, width, percent)
    met = materialize(of.members())
    nodes = met.select("node").distinct()
    sets = materialize(of.full_sets(nodes))
    pairs = materialize(of.plausible(met.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()))
    label = materialize(_joined(nodes.select("node", F.col("node").alias("c")), of.similar(pairs, sets)))
    discard(pairs)
    met, old = materialize(_mixed(met, label, 0)), met
    discard(old)
    for turn in range(1, pivot_rounds + 1):
        # another member of each such bucket, one of its own, is compared with those of other components
        pairs = materialize(of.plausible(met.where("c <> pc").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()))
        label, old = materialize(_joined(label, of.similar(pairs, sets))), label
        discard(pairs, old)
        met, old = materialize(_mixed(met, label, turn)), met
        discard(old)
    # what is left, mostly chance meetings: those of different components that share a rare shingle
    left = materialize(met.select("node", "c").distinct())
    low = of.facts.columns[1:]
    rare = materialize(_prefixes(sets.join(left, "node", "left_semi"), percent).join(left, "node").join(of.facts, "node"))
    x, y = (rare.select("s", *[F.col(c).alias(f"{v}_{c}") for c in ("node", "c", "rest", *low)]) for v in "xy")
    common = F.least("x_rest", "y_rest")
    met_again = x.join(y, "s").where((F.col("x_c") < F.col("y_c")) & of.likely("x_", "y_") & (100 * common >= percent * (F.col("x_n") + F.col("y_n") - common)))
    pairs = materialize(met_again.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct())
    label, old = materialize(_joined(label, of.similar(pairs, sets))), label
    discard(old, pairs, rare, left, met, sets)

    named = of.classes.join(label, "node", "left").select("set_key", "rep", F.coalesce("c", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = materialize(named.join(least, "comp").select("set_key", "comp", "component_id"))
    discard(of.classes, label)
    return of.rows.select("row_key", "doc_id", "n", "set_key").join(of_class, "set_key", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def _mixed(met: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """(bucket, node, c, pivot, pc): members of the buckets that still hold several components, with a pivot chosen anew."""
    labelled = met.select("bucket", "node").join(label, "node")
    picked = F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("h"), "node", "c"))
    mixed = labelled.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), picked.alias("p")).where("c0 <> c1")
    return labelled.join(mixed.select("bucket", F.col("p.node").alias("pivot"), F.col("p.c").alias("pc")), "bucket")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Rows are linked if 100 * |A and B| >= percent * |A or B| for their sets of word
    shingles; component_id is the smallest doc_id reachable over links, kept says that it is
    the row's own.

    1. Equal sets are one class (a min-aggregate), so copies cost nothing further on.
    2. Classes' circulant MinHash signatures are cut into bands; classes that share a band's
       bucket may be similar (see banding() for what that misses). A bucket's members are compared
       with one member, its pivot, not with each other: a star keeps groups of thousands
       linear. Buckets left with several components are compared with other pivots, and
       at last, the members of buckets that still are mixed by a prefix-filtered join: sets
       of different components are compared if they share one of their rarest shingles, which
       similar sets must.
       Sizes and the agreement of signature bits rule pairs out before that (see
       most_differing()); links are confirmed on full sets.
    3. Components are labelled by iterated joins; nothing is collected but a bit table
       of fixed size.

    Cases: null, empty and blank texts have empty sets, n_shingles 0, and are their own
    component; repeated rows are linked and share kept; a null doc_id is never kept (kept is
    false) and counts in no minimum; other columns are left aside; no rows give no rows.
    """
    grouped = _grouped(docs, shingle, percent, pivot_rounds)
    return grouped.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group of near duplicates, with all of its columns.

    The row of the smallest doc_id stays; of repeated rows one; of groups without any doc_id
    one row; rows without words all stay, repeated ones too. Rows are told apart by 128 bits of
    doc_id and text; their keys and fates meet the texts in one join."""
    grouped = materialize(_grouped(docs, shingle, percent, PIVOT_ROUNDS).select("row_key", "doc_id", "n", "comp"))
    linked = grouped.where("n > 0")
    best = linked.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))["row_key"].alias("best"))
    gone = linked.join(best, "comp").where("row_key <> best").select(F.col("row_key").alias("__row_key")).distinct()
    again = linked.groupBy("row_key").agg(F.count("*").alias("m")).where("m > 1").join(best, F.col("row_key") == F.col("best"), "left_semi")
    gone, again = materialize(gone), materialize(again.select(F.col("row_key").alias("__row_key")))
    discard(grouped)
    keyed = docs.withColumn("__row_key", _row_key())
    kept = keyed.join(gone.union(again), "__row_key", "left_anti")
    if not again.isEmpty():  # repeated rows are rare among those that stay, and looked for only if there are any
        once = keyed.join(again, "__row_key", "left_semi").dropDuplicates(["__row_key"])
        kept = kept.union(once.select(*[F.col(f"`{c}`") for c in kept.columns]))
    return kept.drop("__row_key")

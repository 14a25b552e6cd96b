"""K-mer counting, thresholds, membership and set algebra.

Where the assembler this mirrors keeps hash tables and Bloom filters, these operators keep exact tables of
k-mers; a bit array's false positives have no counterpart here. All counts combine in their
tasks before the shuffle, so a very common k-mer is no hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from skein.functions.packed import MOST as MOST_PACKED, packed, packed_counts, packed_places, packed_runs, packed_windows, unpacked
from skein.functions.sequence import canonical, masked_key, reverse_complement, windows

#: Fixed value: the largest multiplicity of a strand.
MOST = 32767


def count_kmers(reads: DataFrame, k: int, stranded: bool = False, seq: str = "seq", most: int | None = MOST) -> DataFrame:
    """A1: kmer, cov_fwd, cov_rev: multiplicities on each strand of the canonical k-mer, at most `most` each; all are counted to the end with None.

    Soft-masked windows are loaded with multiplicity 0 (F9). With stranded, k-mers keep their
    orientation and cov_rev is 0. Windows of up to 31 bases are counted as numbers; longer ones as strings."""
    bounded = lambda c: F.col(c) if most is None else F.least(c, F.lit(most))
    if k <= MOST_PACKED:
        n = packed_counts(reads, k, stranded, seq)
        return n.select(unpacked(F.col("code"), k).alias("kmer"), bounded("f").alias("cov_fwd"), bounded("r").alias("cov_rev"))
    raw = windows(reads.select(seq), k, seq)
    masked = F.col("kmer").rlike("[acgt]")
    upper = raw.select(F.upper("kmer").alias("w"), F.when(masked, 0).otherwise(1).alias("one"))
    kmer = F.col("w") if stranded else canonical(F.col("w"))
    forward = F.lit(True) if stranded else F.col("w") == F.col("kmer")
    counted = upper.withColumn("kmer", kmer).groupBy("kmer").agg(F.sum(F.when(forward, F.col("one")).otherwise(0)).alias("f"), F.sum(F.when(forward, 0).otherwise(F.col("one"))).alias("r"))
    return counted.select("kmer", bounded("f").cast("long").alias("cov_fwd"), bounded("r").cast("long").alias("cov_rev"))


def coverage(kmers: DataFrame) -> DataFrame:
    """kmer, n: multiplicity over both strands."""
    return kmers.select("kmer", (F.col("cov_fwd") + F.col("cov_rev")).alias("n"))


def apply_threshold(kmers: DataFrame, kc: int) -> DataFrame:
    """A2: k-mers of multiplicity kc or more."""
    return kmers.where(F.col("cov_fwd") + F.col("cov_rev") >= kc)


def coverage_histogram(kmers: DataFrame) -> DataFrame:
    """A3: value, n: number of k-mers of each multiplicity."""
    return coverage(kmers).groupBy(F.col("n").alias("value")).agg(F.count("*").alias("n"))


def first_local_minimum(counts: dict[int, int], smoothing: int = 4) -> int:
    """A4: the first multiplicity that has the least count so far when `smoothing` multiplicities in turn have had more,
    or when there are no more; 0 if that is the largest one or there is none. counts has
    the number of k-mers of each multiplicity that occurs, which alone are walked."""
    best, since = None, 0
    for v in sorted(counts):
        if best is None or counts[v] <= counts[best]:
            best, since = v, 0
        else:
            since += 1
            if since >= smoothing:
                break
    return 0 if best is None or best == max(counts) else best


def coverage_parameters(histogram: DataFrame) -> dict[str, float]:
    """A4, A5: thresholds from a coverage histogram (value, n).

    A coverage that starts at the first local minimum is replaced by the square root of the
    median multiplicity at or above it until it stands still, 100 times at most. The histogram
    has a row for each multiplicity, at most 2 * MOST."""
    h = {r["value"]: r["n"] for r in histogram.where("value > 0").collect()}
    cov = float(first_local_minimum(h))
    for _ in range(100 if cov else 0):
        left = {v: n for v, n in h.items() if v >= math.floor(cov + 0.5)}
        need, run, median = math.ceil(sum(left.values()) / 2), 0, 0
        for v in sorted(left):
            run += left[v]
            if run >= need:
                median = v
                break
        new = math.sqrt(median)
        if new == cov:
            break
        cov = new
    else:
        cov = 0.0
    least = max(2.0, cov)
    e = math.floor(least + 0.5)
    return {"coverage": cov, "e": e, "E": 0 if e <= 2 else 1, "c": least}


def kmer_set(reads: DataFrame, k: int, least: int = 1, seq: str = "seq") -> DataFrame:
    """Distinct canonical k-mers seen `least` times or more: what a (cascading) Bloom filter approximates."""
    counted = coverage(count_kmers(reads.select(F.upper(seq).alias("seq")), k))
    return counted.where(F.col("n") >= least).select("kmer")


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: both_sets, only_a, only_b and the Jaccard, Czekanowski and Forbes similarities of two k-mer sets.

    Forbes takes the four-fold table over the k-mers of either set."""
    both = a.select("kmer", F.lit(1).alias("in_a")).join(b.select("kmer", F.lit(1).alias("in_b")), "kmer", "full_outer")
    n = both.agg(
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both_sets"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b")
    )
    x, p, q = F.col("both_sets").cast("double"), F.col("only_a"), F.col("only_b")
    return n.select("both_sets", "only_a", "only_b", (x / (x + p + q)).alias("jaccard"), (2 * x / (2 * x + p + q)).alias("czekanowski"), (x * (x + p + q) / ((x + p) * (x + q))).alias("forbes"))


def union_sets(*sets: DataFrame) -> DataFrame:
    """The union of k-mer sets."""
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def intersect_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """The exact intersection of two k-mer sets."""
    return a.intersect(b)


def bloom_rate(n: int, bits: int, hashes: int = 1, levels: int = 1) -> float:
    """False-positive rate of a (cascading) Bloom filter of so many bits with n k-mers in it."""
    return (1 - (1 - 1 / bits) ** (n * hashes)) ** (hashes * levels)


def member_windows(seqs: DataFrame, kmers: DataFrame, k: int, key: str, inverse: bool = False, seq: str = "seq") -> DataFrame:
    """Key, pos, end, kmer of the windows that are (or, inverse, are not) in a canonical k-mer set; end is exclusive."""
    if k <= MOST_PACKED:
        met = packed_windows(seqs, k, key, seq).join(kmers.select(packed(F.col("kmer")).alias("code")), "code", "left_anti" if inverse else "left_semi")
        own = unpacked(F.col("code"), k)
        return met.select(key, "pos", (F.col("pos") + k).alias("end"), F.when(F.col("forward"), own).otherwise(reverse_complement(own)).alias("kmer"))
    w = windows(seqs.select(key, F.upper(seq).alias("seq")), k, pos="pos")
    met = w.withColumn("canon", canonical(F.col("kmer"))).join(kmers.select(F.col("kmer").alias("canon")), "canon", "left_anti" if inverse else "left_semi")
    return met.select(key, "pos", (F.col("pos") + k).alias("end"), "kmer")


def substitutions(kmers: DataFrame, solid: DataFrame) -> DataFrame:
    """Kmer, other: the canonical k-mers that are not in the set `solid` (kmer), with each one of it that differs in one base.

    Each different k-mer is asked for once, under its three other bases at every place, so a common one is no hot
    key; a k-mer with a base other than ACGT has no neighbours. Both strands of `other` are one k-mer."""
    missing = kmers.select("kmer").distinct().join(solid, "kmer", "left_anti")
    places = missing.where(~F.col("kmer").rlike("[^ACGT]")).select("kmer", F.posexplode(F.split("kmer", "")).alias("at", "own"))
    each = places.where("own <> ''").select("kmer", "at", "own", F.explode(F.array(*map(F.lit, "ACGT"))).alias("base")).where("base <> own")
    near = each.select("kmer", canonical(F.overlay("kmer", "base", F.col("at") + 1, F.lit(1))).alias("other")).distinct()
    return near.join(solid.select(F.col("kmer").alias("other")), "other", "left_semi").select("kmer", "other")


def solid_runs(reads: DataFrame, kmers: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """Maximal runs of windows in a k-mer set, by gaps and islands: key, start, n (windows)."""
    hits = member_windows(reads, kmers, k, key, seq=seq)
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return hits.withColumn("island", island).groupBy(key, "island").agg(F.min("pos").alias("start"), F.count("*").alias("n")).drop("island")


def solidity(reads: DataFrame, kmers: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """Each read's class: SHORTER_THAN_K, NON_ACGT, NOT_SOLID or SOLID, with its numbers of windows and of those in the set."""
    total = F.greatest(F.length(seq) - k + 1, F.lit(0)).cast("long")
    short = F.when(F.length(seq) < k, "SHORTER_THAN_K").when(~F.col(seq).rlike("^[ACGTacgt]*$"), "NON_ACGT")
    if k <= MOST_PACKED:
        each = packed_runs(reads, kmers.select(packed(F.col("kmer")).alias("code")), k, key, seq).select(key, total.alias("n_windows"), short.alias("state"), "hits")
        met = each.withColumn("n_solid", F.sum("hits").over(Window.partitionBy(key)))  # of rows of one key together
    else:
        hits = member_windows(reads, kmers, k, key, seq=seq).groupBy(key).agg(F.count("*").alias("n_solid"))
        met = reads.select(key, total.alias("n_windows"), short.alias("state")).join(hits, key, "left").withColumn("n_solid", F.coalesce("n_solid", F.lit(0)))
    state = F.coalesce("state", F.when(F.col("n_solid") < F.col("n_windows"), "NOT_SOLID").otherwise("SOLID"))
    return met.select(key, "n_windows", "n_solid", state.alias("state"))


def trim_to_solid(reads: DataFrame, kmers: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """The longest run of solid k-mers of each read (the first of equal ones): key, start, seq; reads without any are dropped."""
    if k <= MOST_PACKED:
        met = packed_runs(reads, kmers.select(packed(F.col("kmer")).alias("code")), k, key, seq).where("run is not null")
        n = F.col("run")
    else:
        best = solid_runs(reads, kmers, k, key, seq).groupBy(key).agg(F.max(F.struct("n", (-F.col("start")).alias("back"))).alias("best"))
        met = reads.join(best, key).withColumn("start", -F.col("best.back"))
        n = F.col("best.n")
    return met.select(key, "start", F.substr(F.col(seq), (F.col("start") + 1).cast("int"), (n + k - 1).cast("int")).alias("seq"))


def coverage_track(reference: DataFrame, kmers: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """K7: blocks of consecutive windows of a reference that are all in the set (1) or all not (0): key, start, length, value.

    Blocks are true to positions: a window with other characters ends a block."""
    if k <= MOST_PACKED:
        met = packed_windows(reference, k, key, seq).join(kmers.select(packed(F.col("kmer")).alias("code"), F.lit(1).alias("hit")), "code", "left")
    else:
        w = windows(reference.select(key, F.upper(seq).alias("seq")), k, pos="pos").withColumn("canon", canonical(F.col("kmer")))
        met = w.join(kmers.select(F.col("kmer").alias("canon"), F.lit(1).alias("hit")), "canon", "left")
    met = met.select(key, "pos", F.coalesce("hit", F.lit(0)).alias("value"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key, "value").orderBy("pos"))
    return met.withColumn("island", island).groupBy(key, "value", "island").agg(F.min("pos").alias("start"), F.count("*").alias("length")).select(key, "start", "length", "value")


def log_counts(reads: DataFrame, k: int) -> DataFrame:
    """Number of k-mers for each power of two of their whole multiplicity: log2, n."""
    n = coverage(count_kmers(reads, k, most=None)).where("n > 0")
    return n.groupBy(F.floor(F.log2("n") + 1e-9).cast("long").alias("log2")).agg(F.count("*").alias("n"))


def kmer_pairs(reads: DataFrame, k: int, span: int) -> DataFrame:
    """Paired k-mers: the first and last k bases of each window of `span`, canonical as a pair: a, b, n."""
    w = windows(reads.select(F.upper("seq").alias("seq")), span, name="w")
    a, b = F.left("w", F.lit(k)), F.right("w", F.lit(k))
    mirrored = F.struct(reverse_complement(b).alias("a"), reverse_complement(a).alias("b"))
    pair = F.least(F.struct(a.alias("a"), b.alias("b")), mirrored)
    return w.select(pair.alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def spaced_counts(reads: DataFrame, mask: str) -> DataFrame:
    """multiplicities of the bases at a spaced seed's places: key, n."""
    if len(mask) <= MOST_PACKED:
        return packed_places(reads, mask).select(unpacked(F.col("code"), mask.count("1")).alias("key"), "n")
    w = windows(reads.select(F.upper("seq").alias("seq")), len(mask))
    return w.select(masked_key(F.col("kmer"), mask).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def neighbourhood(kmers: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """K-mers within `depth` steps of the roots in the graph of a canonical set: kmer, depth.

    A breadth-first search by joins; a step takes both directions of both strands."""
    from skein.operators.debruijn import edges
    from skein.plans.iterate import materialize

    e = edges(kmers)
    step = e.select(canonical(F.col("u")).alias("a"), canonical(F.col("v")).alias("b"))
    step = materialize(step.union(step.select("b", "a")).distinct())
    seen = materialize(roots.select(F.col("kmer")).join(kmers, "kmer", "left_semi").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        front = materialize(front.join(step, front["kmer"] == step["a"]).select(F.col("b").alias("kmer")).distinct().join(seen.select("kmer"), "kmer", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen

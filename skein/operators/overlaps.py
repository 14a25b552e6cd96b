"""Overlaps between contigs: of every length, guided by distance estimates, and links by shared barcodes.

A vertex is 2 * contig_id + strand, its complement the vertex xor 1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from skein.functions.sequence import allowed_error
from skein.operators.contigs import _oriented, complement, reduce_transitive
from skein.plans.iterate import discard, materialize


def all_overlaps(contigs: DataFrame, least: int, below: int, reduced: bool = True) -> DataFrame:
    """U, v, distance: the longest overlap of `least` to below - 1 bases, and of less than either contig, of the last bases of u
    with the first of v, as minus its length; without transitive edges if reduced.

    An overlap begins in u with the first `least` bases of v: those of each contig, one row, meet the windows of the last below - 1
    bases of the others, and the rest is compared in the join. No row is made for a length that does not match so far.

    Cases: a contig overlaps itself and its complement where its ends do; null, empty and short sequences have no overlaps; other
    columns are left aside; of a repeated contig_id each sequence counts."""
    w = _oriented(contigs).where(F.length("seq") >= least).select("w", F.length("seq").alias("n"), F.right("seq", F.lit(below - 1)).alias("tail"), F.left("seq", F.lit(below - 1)).alias("front"))
    starts = F.sequence(F.lit(0), F.length("tail") - least)
    ends = w.select(F.col("w").alias("u"), F.col("n").alias("un"), "tail", F.explode(starts).alias("at")).select("u", "un", F.substr("tail", F.col("at") + 1, F.lit(below)).alias("rest"))
    ends = ends.withColumn("seed", F.left("rest", F.lit(least))).withColumn("size", F.length("rest")).where("size < un")
    heads = w.select(F.col("w").alias("v"), F.col("n").alias("vn"), "front", F.left("front", F.lit(least)).alias("seed"))
    met = ends.join(heads, "seed").where((F.col("size") < F.col("vn")) & F.col("front").startswith(F.col("rest")))
    e = met.groupBy("u", "v").agg((-F.max("size")).cast("long").alias("distance"))
    return reduce_transitive(e) if reduced else e


def _borders(tail: str, head: str) -> list[int]:
    """The three longest lengths at which the end of tail is the beginning of head, longest first, in time linear in their lengths."""
    n = min(len(tail), len(head))
    if not n:
        return []
    text = head[:n] + "\0" + tail[len(tail) - n :]
    back = [0] * len(text)
    for i in range(1, len(text)):
        j = back[i - 1]
        while j and text[i] != text[j]:
            j = back[j - 1]
        back[i] = j + (text[i] == text[j])
    out, j = [], back[-1]
    while j and len(out) < 3:
        out.append(j)
        j = back[j - 1]
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _overlap_sizes(tail: pd.Series, head: pd.Series) -> pd.Series:
    return pd.Series([_borders(t, h) for t, h in zip(tail, head, strict=True)])


def _single(e: DataFrame) -> DataFrame:
    """Edges (u, v) that are their u's only out-edge and their v's only in-edge."""
    once = lambda c: e.groupBy(c).agg(F.count("*").alias("k")).where("k = 1").select(c)
    return e.join(once("u"), "u", "left_semi").join(once("v"), "v", "left_semi")


def guided_overlaps(estimates: DataFrame, e: DataFrame, contigs: DataFrame, least: int = 1, scaffold: bool = False, keep_repeats: bool = False) -> DataFrame:
    """U, v, distance, overlap: joins between blunt ends that an estimate (u, v, distance, sd) asks for.

    Ends are blunt where the graph e (u, v, closed under complement) has no edge. An estimate whose distance less its allowed
    error is not over 0 is looked into: the longest common part of the end of u and the beginning of v, whole contigs
    (contig_id, seq) at the most, is their overlap; one under `least` is none. If the three longest lengths are equally far apart, the ends repeat
    a base or a motif and the estimate is dropped, unless keep_repeats. Joins with an overlap come first: where no other overlap has the same
    end, they are taken (distance is minus the overlap). With scaffold, estimates of any distance count; of those without an overlap
    the ones are taken that have no rival at the ends that are left (overlap 0, distance as estimated).

    Of an estimate, its repeats and its complement the one of the least distance, then sd, speaks for all, and each join comes with its
    complement. Cases: null distances, estimates between a contig and itself, and contigs that are not in contigs, have no
    join; a null sd is 0; other columns are left aside."""
    est = estimates.select("u", "v", F.col("distance").cast("long").alias("distance"), F.coalesce(F.col("sd").cast("double"), F.lit(0.0)).alias("sd"))
    est = est.where("u is not null and v is not null and distance is not null").where(F.shiftright("u", 1) != F.shiftright("v", 1))
    mirror = F.struct(complement(F.col("v")).alias("u"), complement(F.col("u")).alias("v"))
    named = est.withColumn("x", F.least(F.struct("u", "v"), mirror)).groupBy("x.u", "x.v").agg(F.min(F.struct("distance", "sd")).alias("d")).select("u", "v", "d.*")
    if not scaffold:
        named = named.where("distance < 0")
    blunt = named.join(e.select("u").distinct(), "u", "left_anti").join(e.select("v").distinct(), "v", "left_anti").select("u", "v", "distance", "sd")
    near = F.col("distance") - allowed_error(F.col("sd")) <= 0
    ids = contigs.select("contig_id", F.upper("seq").alias("seq")).where("seq is not null").dropDuplicates(["contig_id"])

    def with_seq(df: DataFrame, end: str) -> DataFrame:
        met = df.join(ids, F.shiftright(end, 1) == F.col("contig_id"))
        turned = F.reverse(F.translate("seq", "ACGT", "TGCA"))
        return met.withColumn(f"{end}_seq", F.when(F.col(end) % 2 == 1, turned).otherwise(F.col("seq"))).drop("contig_id", "seq")

    met = with_seq(with_seq(blunt, "u"), "v")
    looked = materialize(met.select("u", "v", "distance", _overlap_sizes(F.when(near, F.col("u_seq")).otherwise(""), "v_seq").alias("sizes")))
    first, second, third = (F.get("sizes", F.lit(i)) for i in range(3))
    overlap = F.when(first >= least, first).otherwise(0)
    repeats = F.coalesce((overlap > 0) & (first - second == second - third), F.lit(False))
    judged = looked.select("u", "v", "distance", F.coalesce(overlap, F.lit(0)).alias("overlap"), repeats.alias("repeats"))
    if not keep_repeats:
        judged = judged.where("not repeats")
    kept = judged.where("overlap > 0" if not scaffold else "true").drop("repeats")
    both = materialize(kept.union(kept.select(complement(F.col("v")), complement(F.col("u")), "distance", "overlap")).distinct())
    joined = _single(both.where("overlap > 0"))
    out = joined.select("u", "v", (-F.col("overlap")).cast("long").alias("distance"), F.col("overlap").cast("long").alias("overlap"))
    if scaffold:
        left = both.join(joined.select("u"), "u", "left_anti").join(joined.select("v"), "v", "left_anti")
        out = out.union(_single(left).where("overlap = 0").select("u", "v", "distance", "overlap"))
    out = materialize(out)
    discard(looked, both)
    return out


def barcode_links(ends: DataFrame, percent: int, least: int = 1) -> DataFrame:
    """A, b, shared, total: contig ends (ends: w, barcode) whose sets of barcodes have 100 * shared >= percent * total, shared
    being at least `least` and total the size of both together, with a < b.

    Sets are ordered by how rare their barcodes are. Two such sets share a barcode among the first n - ceil(percent * n / 100) + 1 of
    theirs, so only those are joined, and sets of sizes too unlike are left out there: an end is not paired with all others of a
    common barcode. Pairs are confirmed on the whole sets by a join and a count; no set is gathered.

    Cases: repeated rows count once; null ends and null barcodes are left out; ends without barcodes have no links; equal sets link."""
    rows = materialize(ends.select("w", "barcode").where("w is not null and barcode is not null").distinct())
    sizes = rows.groupBy("w").agg(F.count("*").alias("n"))
    met = rows.join(rows.groupBy("barcode").agg(F.count("*").alias("k")), "barcode").join(sizes, "w")
    rank = F.row_number().over(Window.partitionBy("w").orderBy("k", "barcode"))
    heads = materialize(met.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("w", "n", "barcode"))
    a = heads.select(F.col("w").alias("a"), F.col("n").alias("na"), "barcode")
    b = heads.select(F.col("w").alias("b"), F.col("n").alias("nb"), "barcode")
    alike = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    pairs = materialize(a.join(b, "barcode").where((F.col("a") < F.col("b")) & alike).select("a", "b", "na", "nb").distinct())
    mine = pairs.join(rows.withColumnRenamed("w", "a"), "a")
    both = mine.join(rows.withColumnRenamed("w", "b"), ["b", "barcode"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    found = both.select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("total"))
    out = materialize(found.where((F.col("shared") >= least) & (F.col("shared") * 100 >= F.col("total") * percent)))
    discard(rows, heads, pairs)
    return out

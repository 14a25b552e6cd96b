"""Repeats taken apart: a contig that several ways go through becomes a copy for each group of ways that reads bear out.

A vertex is 2 * contig_id + strand, its complement the vertex xor 1; graphs are closed under complement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.operators.contigs import complement
from skein.operators.paths import path_support, repeat_paths
from skein.plans.iterate import connected_components, discard, materialize


def split_repeats(e: DataFrame, support: DataFrame, least_share: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """The graph e (u, v, and other columns) with repeats split by the state of their ways (support: a, rep, b, state, as of
    path_support()), and the copies (contig_id, copy_of) that this makes.

    Good ways are those supported or unknown; of a way and its complement either may say so. In- and out-edges of a repeat
    that good ways link belong together and get a copy of it; edges in no good way are dropped. A repeat whose edges all belong together
    stays as it is, one without any good way too. Edges between two repeats join the copies that they belong to at both ends. The
    complement of a copy is what the complement's edges give. Copies have new ids above all of the graph; that of a repeat
    that is split is no longer used. Where under least_share of the known ways are supported, or none is known, the graph is returned
    unchanged, without copies.

    Groups are connected components of ends, so a repeat of many ways is no task of its own. Cases: repeated rows count once; ways
    whose edges are not in e are left out."""
    none = e.select((F.shiftright("u", 1)).alias("contig_id")).withColumn("copy_of", F.col("contig_id")).where("false")
    known = support.where("state <> 'unknown'").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "supported").alias("s")).first()
    if not known.n or known.s < least_share * known.n:
        return e, none
    # ends as seen by the forward contig of a repeat
    given = support.where("state in ('supported', 'unknown')").select("a", F.col("rep").alias("r"), "b")
    odd = F.col("r") % 2 == 1
    good = given.select(
        F.when(odd, complement(F.col("b"))).otherwise(F.col("a")).alias("a"),
        F.when(odd, complement(F.col("r"))).otherwise(F.col("r")).alias("r"),
        F.when(odd, complement(F.col("a"))).otherwise(F.col("b")).alias("b"),
    ).distinct()
    plain = e.select("u", "v").distinct()
    good = good.join(plain.select(F.col("u").alias("a"), F.col("v").alias("r")), ["a", "r"], "left_semi").join(plain.select(F.col("u").alias("r"), F.col("v").alias("b")), ["r", "b"], "left_semi")
    end = lambda way, x: F.struct(F.col("r"), F.lit(way).alias("way"), F.col(x).alias("x"))
    good = materialize(good.select("r", end("in", "a").alias("i"), end("out", "b").alias("o")))
    comp = materialize(connected_components(good, "i", "o"))
    # repeats that fall apart, or that lose an edge
    sides = plain.select(F.col("v").alias("r"), F.lit("in").alias("way"), F.col("u").alias("x")).union(plain.select(F.col("u"), F.lit("out"), F.col("v")))
    of = comp.select("node.*", "comp")
    all_ends = sides.join(good.select("r").distinct(), "r", "left_semi").join(of, ["r", "way", "x"], "left")
    split = all_ends.groupBy("r").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.count_if(F.col("comp").isNull()).alias("lost"))
    split = split.where((F.col("first") != F.col("last")) | (F.col("lost") > 0)).select("r")
    groups = of.join(split, "r", "left_semi").select("r", "comp").distinct()
    above = e.agg(F.max(F.greatest("u", "v"))).first()[0] // 2 + 1
    numbered = materialize(groups.orderBy("r", "comp").select("r", "comp", (F.monotonically_increasing_id() + above).alias("contig_id")))
    ids = of.join(numbered, ["r", "comp"], "left").select("r", "way", "x", "contig_id")
    ends = materialize(all_ends.join(split, "r", "left_semi").select("r", "way", "x").join(ids, ["r", "way", "x"], "left").withColumn("split", F.lit(True)))

    def rewired(edges: DataFrame, at: str, other: str, way: str) -> DataFrame:
        """Edges with the vertex `at` replaced by its copy; without those that belong to none."""
        turn = F.col(at) % 2 == 1
        seen = "in" if way == "out" else "out"
        key = edges.withColumn("__r", F.when(turn, complement(F.col(at))).otherwise(F.col(at))).withColumn("__way", F.when(turn, seen).otherwise(way)).withColumn("__x", F.when(turn, complement(F.col(f"__{other}"))).otherwise(F.col(f"__{other}")))
        met = key.join(ends.select(F.col("r").alias("__r"), F.col("way").alias("__way"), F.col("x").alias("__x"), F.col("contig_id").alias("__id"), "split"), ["__r", "__way", "__x"], "left")
        met = met.where("split is null or __id is not null")
        return met.withColumn(at, F.when(F.col("split").isNull(), F.col(at)).otherwise(F.col("__id") * 2 + F.col(at) % 2)).drop("__r", "__way", "__x", "__id", "split")

    both = e.withColumn("__u", F.col("u")).withColumn("__v", F.col("v"))
    out = materialize(rewired(rewired(both, "u", "v", "out"), "v", "u", "in").select(*e.columns))
    copies = materialize(numbered.select("contig_id", F.shiftright("r", 1).alias("copy_of")))
    discard(good, comp, numbered, ends)
    return out, copies


def resolve_repeats(e: DataFrame, contigs: DataFrame, reads: DataFrame, r: int, overlap: int, least: int = 4, least_share: float = 0.15, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Graph and contigs (contig_id, seq) after up to `rounds` rounds of splitting the repeats that windows of r bases of reads (seq)
    reach over, with a base of each neighbour: those of r - 2 bases or fewer. Ends before that when nothing is split."""
    contigs = contigs.select("contig_id", "seq")
    for _ in range(rounds):
        small = contigs.where(F.length("seq") + 2 <= r).select((F.col("contig_id") * 2).alias("r"))
        both = small.union(small.select(complement(F.col("r"))))
        ways = materialize(repeat_paths(e).join(both, "r", "left_semi").select("a", "r", "b"))
        support = materialize(path_support(ways, contigs, reads, r, overlap, least))
        e, copies = split_repeats(e, support, least_share)
        discard(ways, support)
        if copies.isEmpty():
            break
        made = copies.join(contigs.withColumnRenamed("contig_id", "copy_of"), "copy_of").select("contig_id", "seq")
        contigs = materialize(contigs.join(copies.select(F.col("copy_of").alias("contig_id")), "contig_id", "left_anti").union(made))
    return e, contigs

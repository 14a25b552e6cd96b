"""Scaffolds and their gaps: AGP tables, gap extraction and gap closing through the de Bruijn graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skein.functions.sequence import reverse_complement
from skein.plans.iterate import discard, materialize, together


def agp(scaffolds: DataFrame, least_piece: int = 0, least_scaffold: int = 0) -> DataFrame:
    """K9: rows of an AGP table: scaffold_id, begin, end (1-based, inclusive), part, kind (W or N), seq (of W rows).

    Pieces shorter than least_piece become part of the gaps; gaps at the ends are cut; scaffolds without a piece or
    with fewer than least_scaffold bases are left out."""
    runs = F.regexp_extract_all("seq", F.lit("([Nn]+|[^Nn]+)"), F.lit(1))
    short = lambda r: (~r.rlike("^[Nn]")) & (F.length(r) < least_piece)
    masked = F.array_join(F.transform(runs, lambda r: F.when(short(r), F.repeat(F.lit("N"), F.length(r))).otherwise(r)), "")
    cut = scaffolds.select("scaffold_id", F.regexp_replace(masked, "^[Nn]+|[Nn]+$", "").alias("seq"))
    kept = cut.where((F.length("seq") > 0) & (F.length(F.regexp_replace("seq", "[^ACGTacgt]", "")) >= least_scaffold))
    each = kept.select("scaffold_id", F.posexplode(runs).alias("i", "r"))
    end = F.sum(F.length("r")).over(Window.partitionBy("scaffold_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    gap = F.col("r").rlike("^[Nn]")
    return each.withColumn("end", end).select(
        "scaffold_id", (F.col("end") - F.length("r") + 1).alias("begin"), "end", (F.col("i") + 1).cast("long").alias("part"), F.when(gap, "N").otherwise("W").alias("kind"), F.when(~gap, F.col("r")).alias("seq")
    )


def gap_table(scaffolds: DataFrame, flank: int) -> DataFrame:
    """scaffold_id, gap, begin, length, left, right: each run of N with up to `flank` bases on both sides."""
    parts = agp(scaffolds)
    w = Window.partitionBy("scaffold_id").orderBy("part")
    met = parts.withColumn("l", F.lag("seq").over(w)).withColumn("r", F.lead("seq").over(w)).where("kind = 'N'")
    return met.select("scaffold_id", F.row_number().over(w).cast("long").alias("gap"), "begin", (F.col("end") - F.col("begin") + 1).alias("length"), F.right("l", F.lit(flank)).alias("left"), F.left("r", F.lit(flank)).alias("right"))


def connect(pairs: DataFrame, kmers: DataFrame, k: int, longest: int, most_paths: int = 2) -> DataFrame:
    """Pair, seq, n_paths: walks of the de Bruijn graph (canonical kmers) from the last k-mer of left to the first of right,
    of one to longest + k steps, that reach it once, for pairs (pair, left, right); n_paths counts them up to most_paths, and seq is the
    smallest of them in text order, the only one where n_paths is 1.

    Both ends search in step and meet in the middle; the front of right is that of its reverse complement, as the graph has both
    strands. A front has a row for each k-mer that a pair reaches in so many steps, with the number of walks to it and the smallest
    of them: it does not grow with the number of walks, no pair is given up and no walk is lost.

    Cases: pairs of one name, nulls included, have their walks together, equal ones once; pairs with a null or short flank or an
    end that is not in the graph have no row, nor have any where kmers is empty; other columns are left aside."""
    from skein.operators.debruijn import oriented_kmers

    most_steps = longest + k
    half = (most_steps + 1) // 2
    step = materialize(oriented_kmers(kmers).select("w", F.left("w", F.lit(k - 1)).alias("m"), F.right("w", F.lit(1)).alias("b")).distinct())
    ends = pairs.select("pair", F.upper(F.right("left", F.lit(k))).alias("from"), F.upper(F.left("right", F.lit(k))).alias("to")).distinct()
    for end in ("from", "to"):
        ends = ends.join(step.select(F.col("w").alias(end)), end, "left_semi")
    ends = materialize(ends)
    # bases: of the walk so far on the left, what is left of it after the node on the right; a front's goal is that of its pair
    left = ends.select("pair", F.lit(0).alias("side"), F.col("from").alias("node"), F.col("to").alias("goal"), F.col("from").alias("bases"))
    turned = reverse_complement(F.col("to"))
    right = ends.select("pair", F.lit(1).alias("side"), turned.alias("node"), turned.alias("goal"), F.lit("").alias("bases")).distinct()
    front = left.union(right).withColumn("n", F.lit(1).cast("long"))
    layers = []
    for steps in range(1, half + 1):
        met = front.where((F.col("side") == 0) | F.lit(steps <= most_steps - half)).join(step, F.substr("node", F.lit(2)) == F.col("m"))
        bases = F.when(F.col("side") == 0, F.concat("bases", "b")).otherwise(F.concat(F.translate(F.left("node", F.lit(1)), "ACGT", "TGCA"), "bases"))
        on = met.select("pair", "side", F.col("w").alias("node"), "goal", bases.alias("bases"), "n")
        layer = materialize(on.groupBy("pair", "side", "node", "goal").agg(F.min("bases").alias("bases"), F.least(F.sum("n"), F.lit(most_paths)).alias("n")).withColumn("steps", F.lit(steps)))
        layers.append(layer)
        front = layer.where("node <> goal").drop("steps")
        if front.isEmpty():
            break
    reached = together(layers)
    done = reached.where("side = 0 and node = goal").select("pair", "bases", "n")
    ahead = reached.where((F.col("side") == 0) & (F.col("steps") == half) & (F.col("node") != F.col("goal")))
    back = reached.where("side = 1 and node <> goal").select(F.col("pair").alias("p"), reverse_complement(F.col("node")).alias("x"), reverse_complement(F.col("goal")).alias("y"), F.col("bases").alias("rest"), F.col("n").alias("ways"))
    over = ahead.join(back, F.col("pair").eqNullSafe(F.col("p")) & (F.col("node") == F.col("x")) & (F.col("goal") == F.col("y")))
    found = done.union(over.select("pair", F.concat("bases", "rest"), F.col("n") * F.col("ways")))
    by = materialize(found.groupBy("pair").agg(F.min("bases").alias("seq"), F.least(F.sum("n"), F.lit(most_paths)).alias("n_paths")))
    discard(step, ends, *layers)
    return by


def close_gaps(scaffolds: DataFrame, reads: DataFrame, ks: list[int], longest: int, flank: int = 100, least: int = 2) -> DataFrame:
    """scaffold_id, seq, closed: scaffolds whose gaps are filled where one walk joins the flanks, for each k in turn
    with the gaps that are left."""
    from skein.operators.kmers import kmer_set

    gaps = materialize(gap_table(scaffolds, flank).withColumn("pair", F.struct("scaffold_id", "gap")))
    left, filled = gaps, None
    for k in ks:
        walks = connect(left.select("pair", "left", "right"), kmer_set(reads, k, least), k, longest).where("n_paths = 1")
        # what lies between the two flanking k-mers
        new = materialize(walks.select("pair", F.substr("seq", F.lit(k + 1), F.greatest(F.length("seq") - 2 * k, F.lit(0))).alias("fill"), (F.length("seq") >= 2 * k).alias("apart")).where("apart").drop("apart"))
        filled = new if filled is None else filled.union(new)
        left = left.join(new, "pair", "left_anti")
    parts = agp(scaffolds).withColumn("gap", F.sum(F.when(F.col("kind") == "N", 1).otherwise(0)).over(Window.partitionBy("scaffold_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    named = filled.select("pair.scaffold_id", "pair.gap", "fill")
    met = parts.join(named, ["scaffold_id", "gap"], "left")
    piece = F.when(F.col("kind") == "W", F.col("seq")).when(F.col("fill").isNotNull(), F.lower("fill")).otherwise(F.repeat(F.lit("N"), (F.col("end") - F.col("begin") + 1).cast("int")))
    built = met.groupBy("scaffold_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", piece.alias("s")))), lambda x: x["s"]), "").alias("seq"), F.count_if((F.col("kind") == "N") & F.col("fill").isNotNull()).alias("closed"))
    return built


def correct_reads(reads: DataFrame, kmers: DataFrame, k: int, least_hits: int = 3) -> DataFrame:
    """Id, seq: reads with the one substitution that puts most of their k-mers into the set, if that is more than
    least_hits more than before; reads are compared with all single substitutions in the windows around them."""
    from skein.functions.sequence import canonical, windows

    w = windows(reads.select("id", F.upper("seq").alias("seq")), k, pos="pos")
    known = kmers.select(F.col("kmer").alias("canon"), F.lit(1).alias("hit"))
    bad = w.withColumn("canon", canonical(F.col("kmer"))).join(known, "canon", "left").where("hit is null").select("id", "pos", "kmer")
    at = bad.select("id", "pos", "kmer", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    tried = at.select("id", (F.col("pos") + F.col("i")).alias("place"), F.explode(F.array(*map(F.lit, "ACGT"))).alias("b"), "kmer", "i").where(F.substr("kmer", F.col("i") + 1, F.lit(1)) != F.col("b"))
    changed = tried.select("id", "place", "b", canonical(F.concat(F.left("kmer", F.col("i")), "b", F.substr("kmer", F.col("i") + 2, F.lit(k)))).alias("canon"))
    score = changed.join(known, "canon").groupBy("id", "place", "b").agg(F.count("*").alias("hits")).where(F.col("hits") > least_hits)
    best = score.groupBy("id").agg(F.max(F.struct("hits", (-F.col("place")).alias("back"), "b")).alias("x"))
    place = (-F.col("x.back")).cast("int")
    met = reads.select("id", "seq").join(best, "id", "left")
    fixed = F.concat(F.left("seq", place), F.col("x.b"), F.substr("seq", place + 2, F.length("seq")))
    return met.select("id", F.when(F.col("x").isNotNull(), fixed).otherwise(F.col("seq")).alias("seq"))


def mask_new(seq, original):
    """Bases of seq that differ from the original in lower case; both of the same length."""
    return F.array_join(F.zip_with(F.split(seq, ""), F.split(original, ""), lambda a, b: F.when(F.upper(a) == F.upper(b), F.upper(a)).otherwise(F.lower(a))), "")


def merge_pairs(pairs: DataFrame, least_match: int = 10, identity: float = 0.9) -> DataFrame:
    """L4: id, seq of read pairs (id, seq1, seq2) that overlap without gaps: of the overlaps of least_match bases or more whose
    identity is enough, the one with most matches, and of such the shortest; the first read's base wins. Each pair is judged where
    it lies, without a shuffle. Null and too short reads are not merged."""
    first, mate = F.split("seq1", ""), F.split("mate", "")
    n = F.least(F.length("seq1"), F.length("mate"))

    def judged(o):
        agree = F.filter(F.zip_with(F.slice(first, F.length("seq1") - o + 1, o), F.slice(mate, 1, o), lambda a, b: a == b), lambda x: x)
        return F.struct(F.size(agree).alias("same"), (-o).alias("back"))

    turned = pairs.select("id", "seq1", reverse_complement(F.col("seq2")).alias("mate")).where(n >= least_match)
    tried = F.transform(F.sequence(F.lit(least_match), n), judged)
    best = turned.select("id", "seq1", "mate", F.array_max(F.filter(tried, lambda x: x["same"] >= F.lit(-identity) * x["back"])).alias("x"))
    return best.where("x is not null").select("id", F.concat("seq1", F.substr("mate", 1 - F.col("x.back"), F.length("mate"))).alias("seq"))

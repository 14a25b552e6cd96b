"""The de Bruijn graph as tables: adjacency, vertex classes, rewrites and compaction into unitigs.

A set of canonical k-mers stands for both strands. Its oriented edges (u, v) join k-mers that
overlap by k - 1 bases; with (u, v) there always is the edge between the reverse complements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.packed import MOST as MOST_PACKED, oriented_codes, packed, unpacked
from skein.functions.sequence import canonical, reverse_complement
from skein.operators.kmers import apply_threshold, count_kmers
from skein.plans.iterate import discard, materialize, together

BASES = "ACGT"


def oriented_kmers(kmers: DataFrame) -> DataFrame:
    """Both orientations of each k-mer: canon, w."""
    both = F.array_distinct(F.array("kmer", reverse_complement(F.col("kmer"))))
    return kmers.select(F.col("kmer").alias("canon"), F.explode(both).alias("w"))


def edges(kmers: DataFrame) -> DataFrame:
    """Oriented edges u, v by an equi-join of (k-1)-suffixes and (k-1)-prefixes."""
    w = oriented_kmers(kmers).select("w")
    out = w.select(F.col("w").alias("u"), F.substr("w", F.lit(2)).alias("m"))
    into = w.select(F.col("w").alias("v"), F.substr("w", F.lit(1), F.length("w") - 1).alias("m"))
    return out.join(into, "m").select("u", "v")


def adjacency(kmers: DataFrame) -> DataFrame:
    """Kmer, ext_out, ext_in: the bases that extend each canonical k-mer at its ends, as 4-bit sets."""
    e = edges(kmers)
    mask = F.create_map(*[x for i, b in enumerate(BASES) for x in (F.lit(b), F.lit(1 << i))])
    out = e.groupBy(F.col("u").alias("kmer")).agg(F.bit_or(mask[F.right("v", F.lit(1))]).alias("ext_out"))
    into = e.groupBy(F.col("v").alias("kmer")).agg(F.bit_or(mask[F.left("u", F.lit(1))]).alias("ext_in"))
    return kmers.select("kmer").join(out, "kmer", "left").join(into, "kmer", "left").select("kmer", F.coalesce("ext_out", F.lit(0)).alias("ext_out"), F.coalesce("ext_in", F.lit(0)).alias("ext_in"))


def contiguity_class(adjacent: DataFrame) -> DataFrame:
    """G1: with kind: ISLAND (no neighbour), ENDPOINT (none at one end), CONTIGUOUS."""
    kind = F.when((F.col("ext_out") == 0) & (F.col("ext_in") == 0), "ISLAND").when((F.col("ext_out") == 0) | (F.col("ext_in") == 0), "ENDPOINT").otherwise("CONTIGUOUS")
    return adjacent.withColumn("kind", kind)


def erode(kmers: DataFrame, e: int, both: int = 0, max_rounds: int = 10_000) -> DataFrame:
    """(kmer, cov_fwd, cov_rev) without non-contiguous k-mers of multiplicity under e or under `both` on a
    strand, until none is left. Removal only exposes more ends, so any order reaches the same fixpoint.

    A weak k-mer whose only predecessor goes is an end itself, so a round takes all that hang on an end by weak
    only predecessors, found by pointer jumping; rounds do not grow with the length of what is eroded."""
    kmers = materialize(kmers)
    low = (F.col("cov_fwd") + F.col("cov_rev") < e) | (F.least("cov_fwd", "cov_rev") < both)
    k, most, odd = kmers.agg(F.min(F.length("kmer")), F.max(F.length("kmer")), F.bool_or(F.col("kmer").rlike("[^ACGT]"))).first()
    if k is None:
        return kmers
    if k == most and not odd and k <= MOST_PACKED:
        return _eroded(kmers, low, k, max_rounds)
    for _ in range(max_rounds):
        weak = kmers.where(low)
        back = edges(kmers).groupBy(F.col("v").alias("w")).agg(F.count("*").alias("n"), F.min("u").alias("p"))
        w = materialize(oriented_kmers(weak).join(back, "w", "left"))
        ends = w.where("n is null").select(F.col("w").alias("head"))
        if ends.isEmpty():
            break
        links = w.where("n = 1").select(F.col("p").alias("u"), F.col("w").alias("v")).join(w.select(F.col("w").alias("u")), "u", "left_semi").select("u", "v")
        gone = chains(links, w.select("w")).join(ends, "head", "left_semi").join(w.select("w", "canon"), "w").select(F.col("canon").alias("kmer")).distinct()
        kmers = materialize(kmers.join(gone, "kmer", "left_anti"))
    return kmers


def _eroded(kmers: DataFrame, low: Column, k: int, max_rounds: int) -> DataFrame:
    """erode() of k-mers of up to 31 bases, as numbers. A strong k-mer never goes, so what follows one is no end on that side: only weak
    ones whose predecessors are all weak are kept, each with these, found once; a round takes what goes out of that table."""
    codes = kmers.select(packed(F.col("kmer")).alias("canon"), low.alias("weak"))
    both = oriented_codes(codes, k)
    before = both.groupBy(F.col("w").bitwiseAND(F.lit((1 << 2 * (k - 1)) - 1)).alias("m")).agg(F.bool_and("weak").alias("weak"), F.collect_list("w").alias("back"))
    mine = oriented_codes(codes.where("weak").select("canon"), k).withColumn("m", F.shiftright("w", 2))
    none = F.array().cast("array<bigint>")
    state = materialize(mine.join(before, "m", "left").where(F.coalesce("weak", F.lit(True))).select("w", "canon", F.coalesce("back", none).alias("back")))
    tables = []
    for _ in range(max_rounds):
        ends = state.where(F.size("back") == 0).select(F.col("w").alias("head"))
        if ends.isEmpty():
            break
        links = state.where(F.size("back") == 1).select(F.col("back")[0].alias("u"), F.col("w").alias("v")).join(state.select(F.col("w").alias("u")), "u", "left_semi").select("u", "v")
        gone = materialize(chains(links, state.select("w")).join(ends, "head", "left_semi").join(state.select("w", "canon"), "w").select("canon").distinct())
        tables.append(gone)
        left = state.join(gone, "canon", "left_anti")
        back = left.select("w", F.explode("back").alias("p")).join(oriented_codes(gone, k).select(F.col("w").alias("p")), "p", "left_anti")
        back = back.groupBy("w").agg(F.collect_list("p").alias("back"))
        last, state = state, materialize(left.select("w", "canon").join(back, "w", "left").select("w", "canon", F.coalesce("back", none).alias("back")))
        discard(last)
    if not tables:
        return kmers
    away = together(tables).select(unpacked(F.col("canon"), k).alias("kmer"))
    out = materialize(kmers.join(away, "kmer", "left_anti"))
    discard(kmers, state, *tables)
    return out


def unambiguous_edges(e: DataFrame) -> DataFrame:
    """Edges whose start has no other successor and whose end has no other predecessor, palindromic ones left out."""
    once_out = e.groupBy("u").agg(F.count("*").alias("n")).where("n = 1").select("u")
    once_in = e.groupBy("v").agg(F.count("*").alias("n")).where("n = 1").select("v")
    return e.join(once_out, "u", "left_semi").join(once_in, "v", "left_semi")


def chains(links: DataFrame, vertices: DataFrame, max_rounds: int = 40) -> DataFrame:
    """w, head, at: each vertex's chain (named by its first vertex) and its place on it, 0 for the head.

    links (u, v) give every vertex one successor and one predecessor at most. Pointer jumping:
    each round doubles the distance looked back, so rounds are logarithmic in the longest chain.
    Vertices of a circle have head null."""
    back = vertices.join(links.select(F.col("v").alias("w"), F.col("u").alias("p")), "w", "left")
    state = materialize(back.select("w", F.coalesce("p", "w").alias("p"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("at"), F.col("p").isNull().alias("done")))
    open_before = -1
    for _ in range(max_rounds):
        left = state.where("not done").count()
        if left == 0 or left == open_before:
            break
        open_before = left
        hop = state.select(F.col("w").alias("p"), F.col("p").alias("p2"), F.col("at").alias("at2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(hop, "p").select("w", F.col("p2").alias("p"), (F.col("at") + F.col("at2")).alias("at"), F.col("done2").alias("done"))
        state = materialize(state.where("done").union(moved))
    return state.select("w", F.when(F.col("done"), F.col("p")).alias("head"), F.when(F.col("done"), F.col("at")).alias("at"))


def unitigs(kmers: DataFrame) -> DataFrame:
    """Seq, length, coverage, n_kmers, out_degree, in_degree of maximal unbranched paths of (kmer, cov_fwd, cov_rev).

    One orientation of each path and its mirror image is emitted, the smaller sequence.
    Circular paths are not assembled."""
    e = materialize(edges(kmers))
    w = oriented_kmers(kmers).join(kmers.select(F.col("kmer").alias("canon"), (F.col("cov_fwd") + F.col("cov_rev")).alias("n")), "canon")
    # a path may not turn around on itself through a palindrome
    links = unambiguous_edges(e).where(F.col("u") != reverse_complement(F.col("v")))
    on = chains(links, w.select("w")).where("head is not null")
    met = on.join(w.select("w", "n"), "w")
    order = F.array_sort(F.collect_list(F.struct("at", "w")))
    path = met.groupBy("head").agg(order.alias("steps"), F.sum("n").alias("coverage"), F.count("*").alias("n_kmers"))
    seq = F.concat(F.element_at("steps", 1)["w"], F.array_join(F.transform(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), lambda s: F.right(s["w"], F.lit(1))), ""))
    built = path.select(seq.alias("seq"), "coverage", "n_kmers", F.col("head").alias("first"), F.element_at("steps", -1)["w"].alias("last"))
    out = e.groupBy(F.col("u").alias("last")).agg(F.count("*").alias("out_degree"))
    into = e.groupBy(F.col("v").alias("first")).agg(F.count("*").alias("in_degree"))
    known = built.join(out, "last", "left").join(into, "first", "left").withColumn("mirror", reverse_complement(F.col("seq")))
    kept = known.where("seq <= mirror").dropDuplicates(["seq"])
    return kept.select("seq", F.length("seq").cast("long").alias("length"), "coverage", "n_kmers", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def _without(kmers: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """kmers that do not lie on the given unitigs."""
    from skein.functions.sequence import windows

    gone = windows(paths.select("seq"), k).select(canonical(F.col("kmer")).alias("kmer")).distinct()
    return materialize(kmers.join(gone, "kmer", "left_anti"))


def trim_tips(kmers: DataFrame, k: int, longest: int) -> DataFrame:
    """Without tips and islands of at most `longest` k-mers: rounds with limits 1, 2, 4 ... below it, then rounds
    with it until nothing changes. A round removes all at once."""
    kmers, limit = materialize(kmers), 1
    while True:
        at = min(limit, longest)
        u = unitigs(kmers)
        tips = materialize(u.where((F.col("n_kmers") <= at) & ((F.col("in_degree") == 0) | (F.col("out_degree") == 0))).select("seq"))
        empty = tips.isEmpty()
        if not empty:
            kmers = _without(kmers, tips, k)
        if limit >= longest and empty:
            return kmers
        limit *= 2


def drop_low_coverage(kmers: DataFrame, k: int, least: float) -> DataFrame:
    """Without unitigs of a mean k-mer multiplicity under `least`."""
    low = unitigs(kmers).where(F.col("coverage") / F.col("n_kmers") < least).select("seq")
    return _without(kmers, low, k)


def pop_bubbles(kmers: DataFrame, k: int, longest: int, branches: int = 3) -> tuple[DataFrame, DataFrame]:
    """K-mers without the weaker branches of simple bubbles, and the alleles (bubble, allele, seq, mean_coverage).

    A simple bubble is two or three unitigs of at most `longest` k-mers that leave the same
    vertex and meet at the same one; the branch of the highest mean multiplicity stays, the first by
    sequence of equals."""
    u = unitigs(kmers).where((F.col("in_degree") == 1) & (F.col("out_degree") == 1) & (F.col("n_kmers") <= longest))
    e = materialize(edges(kmers))
    both = u.select("seq", "coverage", "n_kmers", F.col("seq").alias("path")).union(u.select("seq", "coverage", "n_kmers", reverse_complement(F.col("seq")).alias("path")))
    ends = both.withColumn("first", F.left("path", F.lit(k))).withColumn("last", F.right("path", F.lit(k)))
    around = ends.join(e.select(F.col("u").alias("head"), F.col("v").alias("first")), "first").join(e.select(F.col("u").alias("last"), F.col("v").alias("tail")), "last")
    # a bubble and its mirror image are one
    around = around.where(F.col("head") <= reverse_complement(F.col("tail")))
    mean = (F.col("coverage") / F.col("n_kmers")).alias("mean_coverage")
    group = around.groupBy("head", "tail").agg(F.collect_set(F.struct((-mean).alias("rank"), "seq", mean)).alias("found")).where(F.size("found").between(2, branches))
    alleles = materialize(group.select(F.concat_ws(">", "head", "tail").alias("bubble"), F.posexplode(F.array_sort("found")).alias("i", "a")).select("bubble", F.chr(F.col("i") + 65).alias("allele"), "a.seq", "a.mean_coverage"))
    kept = alleles.where("allele = 'A'").select("seq")
    return _without(kmers, alleles.where("allele <> 'A'").join(kept, "seq", "left_anti").select("seq"), k), alleles


def assemble(reads: DataFrame, k: int, kc: int = 1, erosion: int = 0, both: int = 0, tips: int = 0, least_coverage: float = 0, bubbles: int = 0) -> DataFrame:
    """Unitigs of reads (seq): count, threshold, erode, trim, drop low coverage, erode and trim again, pop bubbles, compact."""
    kmers = materialize(apply_threshold(count_kmers(reads, k), kc))
    for again in (False, True):
        if again and not least_coverage:
            break
        if again:
            kmers = drop_low_coverage(kmers, k, least_coverage)
        if erosion:
            kmers = erode(kmers, erosion, both)
        if tips:
            kmers = trim_tips(kmers, k, tips)
    if bubbles:
        kmers, _ = pop_bubbles(kmers, k, bubbles)
    return unitigs(kmers)


def assemble_multi(reads: DataFrame, ks: list[int], **options) -> DataFrame:
    """The unitigs of each k are further reads of the next."""
    found = None
    for k in ks:
        given = reads.select("seq") if found is None else reads.select("seq").union(found.select("seq"))
        found = materialize(assemble(given, k, **options))
    return found


def oriented_pairs(pairs: DataFrame) -> DataFrame:
    """Both orientations of paired k-mers (a, b): a, b. The other one has the halves' complements in the other order."""
    return pairs.select("a", "b").union(pairs.select(reverse_complement(F.col("b")), reverse_complement(F.col("a")))).distinct()


def pair_edges(pairs: DataFrame) -> DataFrame:
    """Oriented edges ua, ub, va, vb of paired k-mers: both halves move on by a base, an equi-join on the two overlaps together."""
    o = oriented_pairs(pairs)
    tail, head = (lambda c: F.substr(c, F.lit(2))), (lambda c: F.substr(c, F.lit(1), F.length(c) - 1))
    out = o.select(F.col("a").alias("ua"), F.col("b").alias("ub"), tail("a").alias("x"), tail("b").alias("y"))
    into = o.select(F.col("a").alias("va"), F.col("b").alias("vb"), head("a").alias("x"), head("b").alias("y"))
    return out.join(into, ["x", "y"]).select("ua", "ub", "va", "vb")


def graph_statistics(e: DataFrame, vertices: DataFrame) -> DataFrame:
    """out_degree, n: how many vertices (column w) have how many successors in edges (u, v)."""
    degree = e.groupBy(F.col("u").alias("w")).agg(F.count("*").alias("d"))
    return vertices.join(degree, "w", "left").groupBy(F.coalesce("d", F.lit(0)).alias("out_degree")).agg(F.count("*").alias("n"))


def consistent_pair_edges(e: DataFrame) -> DataFrame:
    """Edges between paired k-mers (ua, ub, va, vb) of touching halves whose shared base agrees."""
    return e.where(F.left("ub", F.lit(1)) == F.right("va", F.lit(1)))


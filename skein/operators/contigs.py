"""Contig graphs as edge tables, and the scaffolder's rewrites of them.

A vertex is an oriented contig, 2 * contig + strand; its complement is the vertex xor 1. A graph is closed
under complement: (u, v) is there with (v ^ 1, u ^ 1). Rewrites find what goes on the graph as
it is and remove it together, so a pass does not depend on an order. Columns: u, v, and
for estimates distance, n, sd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.sequence import reverse_complement
from skein.operators.debruijn import chains, unambiguous_edges
from skein.plans.iterate import NotSettled, fixpoint, materialize


def complement(v: Column) -> Column:
    return v.bitwiseXOR(F.lit(1))


def add_complements(e: DataFrame) -> DataFrame:
    """The graph closed under complement."""
    rest = [c for c in e.columns if c not in ("u", "v")]
    return e.select("u", "v", *rest).union(e.select(complement(F.col("v")), complement(F.col("u")), *rest)).dropDuplicates(["u", "v"])


def degrees(e: DataFrame) -> DataFrame:
    """w, outs, ins of every vertex that has an edge."""
    ends = e.select(F.col("u").alias("w"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("w").agg(F.sum("o").alias("outs"), F.sum("i").alias("ins"))


def contiguous(e: DataFrame) -> DataFrame:
    """Edges that leave no choice at either end."""
    return unambiguous_edges(e)


def assemble_paths(e: DataFrame, least: int = 2) -> DataFrame:
    """Maximal unambiguous paths of `least` vertices or more: head, nodes; of a path and its mirror image
    the one with the smaller head. Edges from a vertex to its own complement are left out."""
    links = materialize(contiguous(e).where(F.col("v") != complement(F.col("u"))).select("u", "v"))
    vertices = links.select(F.explode(F.array("u", "v")).alias("w")).distinct()
    on = chains(links, vertices).where("head is not null")
    path = on.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("steps")).where(F.size("steps") >= least)
    path = path.select("head", F.transform("steps", lambda s: s["w"]).alias("nodes"))
    mirror = complement(F.element_at("nodes", -1))
    return path.where(F.col("head") < mirror)


def prune_tips(e: DataFrame, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the graph without tips, the tips w): v is one if it has no successor and its only predecessor has others.

    vertices (w), if given, restricts what may go; a vertex goes with its complement."""
    d = degrees(e)
    into = e.join(d.select(F.col("w").alias("v"), "outs", "ins"), "v").where("outs = 0 and ins = 1").select("u", "v")
    tips = into.join(d.select(F.col("w").alias("u"), "outs"), "u").where("outs > 1").select(F.col("v").alias("w"))
    if vertices is not None:
        tips = tips.join(vertices, "w", "left_semi")
    tips = tips.distinct()
    return drop_vertices(e, tips), tips


def drop_vertices(e: DataFrame, gone: DataFrame) -> DataFrame:
    """The graph without the contigs of the vertices (w) in either orientation. They may be many more than Spark expects, so
    they are never broadcast."""
    both = gone.select("w").union(gone.select(complement(F.col("w")))).distinct().hint("merge")
    return e.join(both.select(F.col("w").alias("u")), "u", "left_anti").join(both.select(F.col("w").alias("v")), "v", "left_anti").select(*e.columns)


def islands(e: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contigs (contig_id) without any edge."""
    used = e.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("w")).select((F.col("w") / 2).cast("long").alias("contig_id")).distinct()
    return contigs.join(used, "contig_id", "left_anti")


def transitive_edges(e: DataFrame) -> DataFrame:
    """Edges (u, w) for which there is a v with (u, v) and (v, w); loops do not count.

    Two-step walks are only made where they can end in an edge from the same u."""
    plain = e.where("u <> v").select("u", "v")
    walk = plain.select("u", F.col("v").alias("m")).join(plain.select(F.col("u").alias("m"), F.col("v").alias("w")), "m").where("u <> w").select("u", F.col("w").alias("v")).distinct()
    return e.join(walk, ["u", "v"], "left_semi").select(*e.columns)


def drop_edges(e: DataFrame, gone: DataFrame) -> DataFrame:
    """The graph without some edges and their complements."""
    both = gone.select("u", "v").union(gone.select(complement(F.col("v")), complement(F.col("u")))).distinct()
    return e.join(both, ["u", "v"], "left_anti").select(*e.columns)


def reduce_transitive(e: DataFrame) -> DataFrame:
    """The graph without transitive edges."""
    return drop_edges(e, transitive_edges(e))


def layout(e: DataFrame, vertices: DataFrame | None = None, reduce: bool = True) -> DataFrame:
    """Paths (head, nodes) of an overlap graph: of the vertices (w) that are given, or all, without transitive
    edges if they are to be reduced, assembled where no end leaves a choice."""
    if vertices is not None:
        both = vertices.select("w").union(vertices.select(complement(F.col("w")))).distinct()
        e = e.join(both.select(F.col("w").alias("u")), "u", "left_semi").join(both.select(F.col("w").alias("v")), "v", "left_semi").select(*e.columns)
    return assemble_paths(reduce_transitive(e) if reduce else e)


def junctions(e: DataFrame, scaffold: DataFrame) -> DataFrame:
    """U, v, w: a vertex v with one predecessor u and one successor w, where the scaffold graph (u, v) has the edge (u, w).

    A vertex has one such row at most, so nothing grows with a hot vertex's degree."""
    near = e.select("u", "v")
    before = near.groupBy("v").agg(F.count("*").alias("ins"), F.min("u").alias("u")).where("ins = 1").select(F.col("v").alias("m"), "u")
    after = near.groupBy("u").agg(F.count("*").alias("outs"), F.min("v").alias("w")).where("outs = 1").select(F.col("u").alias("m"), "w")
    through = before.join(after, "m").select("u", F.col("m").alias("v"), "w")
    return through.join(scaffold.select("u", F.col("v").alias("w")), ["u", "w"], "left_semi").select("u", "v", "w")


def junction_paths(e: DataFrame, scaffold: DataFrame) -> DataFrame:
    """Paths (head, nodes) along the edges of supported junctions, as far as no end leaves a choice."""
    found = junctions(e, scaffold)
    edges = found.select("u", "v").union(found.select("v", F.col("w").alias("v")))
    return assemble_paths(add_complements(edges))


def well_supported(e: DataFrame, n: int) -> DataFrame:
    """Edges of n pairs or more."""
    return e.where(F.col("n") >= n)


def long_contigs_only(e: DataFrame, contigs: DataFrame, s: int) -> DataFrame:
    """The graph of contigs (contig_id, length) of s bases or more."""
    short = contigs.where(F.col("length") < s).select((F.col("contig_id") * 2).alias("w"))
    return drop_vertices(e, short)


def two_cycles(e: DataFrame) -> DataFrame:
    """C17: edges whose reverse is an edge too."""
    return e.join(e.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_semi").select(*e.columns)


def fork_edges(e: DataFrame, full: DataFrame) -> DataFrame:
    """For successors v1, v2 of a vertex: the edge between them in the full graph, if just one of both is there and
    the graph does not have it yet."""
    plain = e.select("u", "v")
    forks = plain.select("u", F.col("v").alias("a")).join(plain.select("u", F.col("v").alias("b")), "u").where("a < b").select("a", "b").distinct()
    f = full.select("u", "v").distinct()
    ways = forks.join(f.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).alias("ab")), ["a", "b"], "left").join(f.select(F.col("u").alias("b"), F.col("v").alias("a"), F.lit(1).alias("ba")), ["a", "b"], "left")
    one = ways.where("(ab is null) <> (ba is null)").select(F.when(F.col("ab").isNotNull(), F.col("a")).otherwise(F.col("b")).alias("u"), F.when(F.col("ab").isNotNull(), F.col("b")).otherwise(F.col("a")).alias("v"))
    return one.join(plain, ["u", "v"], "left_anti").distinct()


def repeats(e: DataFrame) -> DataFrame:
    """Vertices v on a walk u, v, w1 with an edge (u, w1), that also have a successor w2 not joined to w1 either way."""
    p = e.select("u", "v").distinct()
    step = p.select("u", F.col("v").alias("m")).join(p.select(F.col("u").alias("m"), F.col("v").alias("w1")), "m")
    closed = step.join(p.select("u", F.col("v").alias("w1")), ["u", "w1"], "left_semi").select("m", "w1").distinct()
    other = closed.join(p.select(F.col("u").alias("m"), F.col("v").alias("w2")), "m").where("w1 <> w2")
    apart = other.join(p.select(F.col("u").alias("w1"), F.col("v").alias("w2")), ["w1", "w2"], "left_anti").join(p.select(F.col("u").alias("w2"), F.col("v").alias("w1")), ["w1", "w2"], "left_anti")
    return apart.select(F.col("m").alias("w")).distinct()


def drop_repeats(e: DataFrame) -> DataFrame:
    """Without the edges out of repeats; contigs whose both orientations are repeats go as a whole."""
    r = materialize(repeats(e))
    whole = r.join(r.select(complement(F.col("w")).alias("w")), "w", "left_semi")
    out = e.join(r.select(F.col("w").alias("u")), "u", "left_semi").select("u", "v")
    return drop_vertices(drop_edges(e, out), whole)


def weak_edges(e: DataFrame) -> DataFrame:
    """C20: the middle edge (u1, v2) of a crossing u1 -> v1, v2 and u2 -> v2, if v1 has no other predecessor, u2 no other
    successor, and fewer pairs support it than either of the others."""
    d = degrees(e)
    p = e.select("u", "v", "n")
    mid = p.join(d.select(F.col("w").alias("u"), F.col("outs").alias("du")), "u").join(d.select(F.col("w").alias("v"), F.col("ins").alias("dv")), "v").where("du = 2 and dv = 2")
    left = p.join(d.where("ins = 1").select(F.col("w").alias("v")), "v", "left_semi").select("u", F.col("v").alias("v1"), F.col("n").alias("n1"))
    right = p.join(d.where("outs = 1").select(F.col("w").alias("u")), "u", "left_semi").select(F.col("u").alias("u2"), "v", F.col("n").alias("n2"))
    met = mid.join(left, "u").where("v1 <> v").join(right, "v").where("u2 <> u and n < n1 and n < n2")
    return met.select("u", "v").distinct()


def drop_long(e: DataFrame, longest: int) -> DataFrame:
    """Without edges of a distance over `longest`."""
    return e.where(F.col("distance") <= longest)


def low_coverage_contigs(contigs: DataFrame, k: int, least: float) -> DataFrame:
    """Contigs (length, coverage) of a mean k-mer coverage under `least`."""
    return contigs.where(F.col("coverage") / (F.col("length") - k + 1) < least)


def merge_better(e: DataFrame) -> DataFrame:
    """Parallel estimates (u, v, distance, n, sd) as one: the distance of the least sd (the larger distance of equals), n added up."""
    best = F.max_by(F.struct("distance", "sd"), F.struct(-F.col("sd"), F.col("distance")))
    return e.groupBy("u", "v").agg(best.alias("b"), F.sum("n").alias("n")).select("u", "v", "b.distance", "n", "b.sd")


def merge_weighted(e: DataFrame) -> DataFrame:
    """Parallel estimates as their mean weighed by inverse variances."""
    w = 1 / (F.col("sd") * F.col("sd"))
    return e.groupBy("u", "v").agg(F.round(F.sum(F.col("distance") * w) / F.sum(w)).cast("long").alias("distance"), F.sum("n").alias("n"), (1 / F.sqrt(F.sum(w))).alias("sd"))


def merge_largest(e: DataFrame) -> DataFrame:
    """Parallel edges as the one of the largest distance."""
    return e.groupBy("u", "v").agg(F.max("distance").alias("distance"))


def exact_overlaps(contigs: DataFrame, overlap: int) -> DataFrame:
    """Edges between oriented contigs (contig_id, seq) whose last and first `overlap` bases are the same."""
    w = _oriented(contigs).where(F.length("seq") > overlap)
    out = w.select(F.col("w").alias("u"), F.right("seq", F.lit(overlap)).alias("m"))
    return out.join(w.select(F.col("w").alias("v"), F.left("seq", F.lit(overlap)).alias("m")), "m").select("u", "v", F.lit(-overlap).cast("long").alias("distance"))


def shorter_overlaps(contigs: DataFrame, e: DataFrame, least: int, most: int) -> DataFrame:
    """Edges of the longest overlap from `least` to `most` bases between blunt ends of the graph e."""
    w = _oriented(contigs)
    tails = w.join(e.select(F.col("u").alias("w")), "w", "left_anti")
    heads = w.join(e.select(F.col("v").alias("w")), "w", "left_anti")
    sizes = F.explode(F.sequence(F.lit(least), F.lit(most))).alias("size")
    a = tails.select(F.col("w").alias("u"), "seq", sizes).where(F.length("seq") > F.col("size")).select("u", "size", F.right("seq", F.col("size")).alias("m"))
    b = heads.select(F.col("w").alias("v"), "seq", sizes).where(F.length("seq") > F.col("size")).select("v", "size", F.left("seq", F.col("size")).alias("m"))
    return a.join(b, ["size", "m"]).where("u <> v").groupBy("u", "v").agg((-F.max("size")).cast("long").alias("distance"))


def _oriented(contigs: DataFrame) -> DataFrame:
    """Both orientations; a union has none of its parts' hints, so it is told anew that it is not to be broadcast."""
    return contigs.select((F.col("contig_id") * 2).alias("w"), "seq").union(contigs.select(F.col("contig_id") * 2 + 1, reverse_complement(F.col("seq")))).hint("merge")


def invalid_edges(e: DataFrame, contigs: DataFrame) -> DataFrame:
    """edges whose overlap is as long as one of its contigs (contig_id, length)."""
    size = contigs.select("contig_id", "length")
    met = e.withColumn("a", (F.col("u") / 2).cast("long")).withColumn("b", (F.col("v") / 2).cast("long")).join(size.withColumnRenamed("contig_id", "a").withColumnRenamed("length", "la"), "a").join(size.withColumnRenamed("contig_id", "b").withColumnRenamed("length", "lb"), "b")
    return met.where((F.col("distance") + F.col("la") <= 0) | (F.col("distance") + F.col("lb") <= 0)).select(*e.columns)


def remove_shims(e: DataFrame, contigs: DataFrame, longest: int, most_degree: int, least_overlap: int, max_rounds: int = 1000) -> DataFrame:
    """C14: without short contigs that only link others: each is replaced by edges between its neighbours.

    A shim is at most `longest` long, has 1 to most_degree edges at its smaller side, is not its own
    neighbour, and the best overlaps at both ends leave it no more than -least_overlap. In a round,
    those go that precede their neighbours by product of degrees, length and id."""
    size = contigs.select((F.col("contig_id") * 2).alias("w"), "length")
    for _ in range(max_rounds):
        e = materialize(e)
        d = degrees(e).join(size, "w").where((F.col("length") <= longest) & F.least("outs", "ins").between(1, most_degree))
        near = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select("v", "u")).select((F.col("a") / 2).cast("long").alias("a"), (F.col("b") / 2).cast("long").alias("b")).distinct()
        loops = near.where("a = b").select((F.col("a") * 2).alias("w"))
        into = e.groupBy(F.col("v").alias("w")).agg(F.min("distance").alias("din"))
        out = e.groupBy(F.col("u").alias("w")).agg(F.min("distance").alias("dout"))
        fit = d.join(loops, "w", "left_anti").join(into, "w").join(out, "w").where(F.col("din") + F.col("length") + F.col("dout") <= -least_overlap)
        ranked = materialize(fit.select((F.col("w") / 2).cast("long").alias("a"), F.struct(F.col("outs") * F.col("ins"), "length", "w").alias("rank")))
        beaten = near.join(ranked, "a").join(ranked.select(F.col("a").alias("b"), F.col("rank").alias("other")), "b").where("a <> b and other < rank").select("a").distinct()
        gone = materialize(ranked.join(beaten, "a", "left_anti").select((F.col("a") * 2).alias("w")))
        if gone.isEmpty():
            return e
        both = gone.union(gone.select(complement(F.col("w"))))
        a = e.join(both.withColumnRenamed("w", "v"), "v", "left_semi").select("u", F.col("v").alias("w"), F.col("distance").alias("d1"))
        b = e.join(both.withColumnRenamed("w", "u"), "u", "left_semi").select(F.col("u").alias("w"), "v", F.col("distance").alias("d2"))
        length = size.union(size.select(complement(F.col("w")), "length"))
        bridged = a.join(b, "w").join(length, "w").select("u", "v", (F.col("d1") + F.col("d2") + F.col("length")).cast("long").alias("distance")).where(F.col("distance") <= -least_overlap)
        e = drop_vertices(e, gone).select("u", "v", "distance").union(bridged).groupBy("u", "v").agg(F.min("distance").alias("distance"))
    raise NotSettled(f"shims still go after {max_rounds} rounds")


def filter_graph(e: DataFrame, contigs: DataFrame, k: int, least_length: int = 0, most_length: int = 0, least_coverage: float = 0, most_coverage: float = 0, drop_islands: bool = False, tip_length: int = 0) -> tuple[DataFrame, DataFrame]:
    """(edges, contigs) after islands, tips up to tip_length (to a fixpoint), and lengths and coverages out of bounds go, in that order."""
    if drop_islands:
        contigs = contigs.join(islands(e, contigs).select("contig_id"), "contig_id", "left_anti")
    if tip_length:
        short = contigs.where(F.col("length") <= tip_length).select(F.explode(F.array(F.col("contig_id") * 2, F.col("contig_id") * 2 + 1)).alias("w"))
        before = e
        e = fixpoint(e, lambda g: prune_tips(g, short)[0])
        lost = islands(e, contigs).join(before.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("w")).select((F.col("w") / 2).cast("long").alias("contig_id")).distinct(), "contig_id", "left_semi")
        contigs = contigs.join(lost.join(short.select((F.col("w") / 2).cast("long").alias("contig_id")).distinct(), "contig_id", "left_semi").select("contig_id"), "contig_id", "left_anti")
    mean = F.col("coverage") / (F.col("length") - k + 1)
    keep = F.col("length") >= least_length
    for bound, ok in ((most_length, F.col("length") <= most_length), (least_coverage, mean >= least_coverage), (most_coverage, mean <= most_coverage)):
        keep = keep & ok if bound else keep
    gone = contigs.where(~keep).select((F.col("contig_id") * 2).alias("w"))
    return drop_vertices(e, gone), contigs.where(keep)


def scaffold_graph(e: DataFrame, contigs: DataFrame, n: int, s: int, longest_gap: int | None = None) -> DataFrame:
    """A scaffold graph made simple: filter, 2-cycles, forks, tips, repeats, transitive edges, tips, bubbles, weak edges, long edges.

    An edge over a bubble has no pairs of its own: n is null, so it is never a weak edge."""
    from skein.operators.bubbles import scaffold_over_bubbles

    full = materialize(e)
    g = materialize(well_supported(long_contigs_only(full, contigs, s), n))
    g = materialize(drop_edges(g, two_cycles(g)))
    added = add_complements(full.join(fork_edges(g, full), ["u", "v"], "left_semi").select(*full.columns))
    g = materialize(g.unionByName(added).dropDuplicates(["u", "v"]))
    g = materialize(prune_tips(g)[0])
    g = materialize(drop_repeats(g))
    g = materialize(reduce_transitive(g))
    g = materialize(prune_tips(g)[0])
    g = materialize(scaffold_over_bubbles(g, contigs)[0])
    g = materialize(drop_edges(g, weak_edges(g)))
    return drop_long(g, longest_gap) if longest_gap is not None else g


def scaffold_paths(g: DataFrame, full: DataFrame, least_gap: int = 50) -> DataFrame:
    """Paths of a scaffold graph with the gap after each node (null for the last), `least_gap` at least: head, steps(w, gap)."""
    path = assemble_paths(g)
    each = path.select("head", F.posexplode("nodes").alias("at", "w"), F.col("nodes"))
    nxt = each.select("head", "at", "w", F.get("nodes", F.col("at") + 1).alias("v"))
    gap = full.groupBy("u", "v").agg(F.max("distance").alias("distance"))
    met = nxt.join(gap.withColumnRenamed("u", "w"), ["w", "v"], "left").withColumn("gap", F.when(F.col("v").isNotNull(), F.greatest("distance", F.lit(least_gap))))
    return met.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w", "gap"))), lambda x: F.struct(x["w"].alias("w"), x["gap"].alias("gap"))).alias("steps"))


def scaffold_lengths(paths: DataFrame, contigs: DataFrame) -> DataFrame:
    """Head, length: bases of a path's contigs without its gaps."""
    each = paths.select("head", F.explode("nodes").alias("w")).withColumn("contig_id", (F.col("w") / 2).cast("long"))
    return each.join(contigs.select("contig_id", "length"), "contig_id").groupBy("head").agg(F.sum("length").alias("length"))


def optimise(e: DataFrame, contigs: DataFrame, ns: list[int], ss: list[int]) -> tuple[int, int, int]:
    """The first (n, s) of the grid whose scaffolds have the largest N50: (n, s, n50)."""
    from skein.operators.histogram import contiguity

    full, best = materialize(e), None
    for s in ss:
        for n in ns:
            paths = materialize(assemble_paths(scaffold_graph(full, contigs, n, s)))
            lengths = scaffold_lengths(paths, contigs)
            used = paths.select(F.explode("nodes").alias("w")).select((F.col("w") / 2).cast("long").alias("contig_id")).distinct()
            alone = contigs.join(used, "contig_id", "left_anti").select("length")
            row = contiguity(lengths.select("length").union(alone).withColumn("g", F.lit(0)), ["g"], least=0).first()
            n50 = row["n50"] if row else 0
            if best is None or n50 > best[2]:
                best = (n, s, n50)
    return best


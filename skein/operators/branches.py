"""True branches of a directed graph, and how far an unambiguous path goes from each vertex.

Graphs are edges (u, v) of vertices of any one type. A branch of `trim` vertices or fewer is a tip and no choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.sequence import canonical
from skein.operators.debruijn import chains, edges as kmer_edges, oriented_kmers
from skein.plans.iterate import NotSettled, connected_components, discard, materialize


def _at_vertices(state: DataFrame) -> DataFrame:
    """x, and of the branches that leave x by its out-edges and by its in-edges: how many are open, the longest settled run, and the
    settled spans, longest first, with their counts. Spans are at most trim, so an array is no longer than that, whatever the degree."""
    out = state.select(F.col("u").alias("x"), F.lit("out").alias("way"), F.col("out_run").alias("run"), F.col("out_span").alias("span"))
    into = state.select(F.col("v").alias("x"), F.lit("in").alias("way"), F.col("in_run").alias("run"), F.col("in_span").alias("span"))
    by = out.union(into).groupBy("x", "way", "span").agg(F.count("*").alias("n"), F.max("run").alias("run"))

    def of(way: str) -> list[Column]:
        here = F.col("way") == way
        return [
            F.coalesce(F.sum(F.when(here & F.col("span").isNull(), F.col("n"))), F.lit(0)).alias(f"{way}_open"),
            F.coalesce(F.max(F.when(here, F.col("run"))), F.lit(0)).alias(f"{way}_longest"),
            F.sort_array(F.collect_list(F.when(here & F.col("span").isNotNull(), F.struct("span", "n"))), asc=False).alias(f"{way}_spans"),
        ]

    return by.groupBy("x").agg(*of("out"), *of("in"))


def _judged(at: str, way: str, back: str, weight: str, trim: int) -> tuple[Column, Column]:
    """The run and the span of the branch that comes to the vertex `at` (columns with this prefix) and goes on by `way`; null while
    one is open that it goes on into or turns to. It does not turn back to where it came from, whose span as seen from there is
    the column `back`."""
    other = "in" if way == "out" else "out"
    own = F.col(back)
    spans = F.col(f"{at}{other}_spans")
    first, second = F.get(spans, F.lit(0)), F.get(spans, F.lit(1))
    turned = F.when(own.isNotNull() & (own == first["span"]) & (first["n"] == 1), second["span"]).otherwise(first["span"])
    ahead = F.get(F.col(f"{at}{way}_spans"), F.lit(0))["span"]
    run = F.col(weight) + F.col(f"{at}{way}_longest")
    closed = (F.col(f"{at}{way}_open") == 0) & (F.col(f"{at}{other}_open") == F.when(own.isNull(), 1).otherwise(0))
    good = closed & (run <= trim)
    return F.when(good, run), F.when(good, F.greatest(run, ahead, turned))


def branch_spans(edges: DataFrame, trim: int, lengths: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """U, v, out_span, in_span: how much lies behind each edge, seen from u and seen from v; null where that is a true branch.

    From u, a branch begins with v and goes straight on along edges; at each of its vertices it may also turn and go on straight the
    other way, but not back to the vertex it came from. Its span is the number of vertices of its longest straight run. It is a
    true branch if a run has more than `trim` vertices or if it meets a vertex twice, so bubbles and circles are true branches.
    lengths (w, n) gives a vertex for n vertices in a row, 1 without it.

    Spans settle from the tips inwards: a branch is settled in the round after all that it goes on into or turns to. What never
    settles holds a long run or a circle. Rounds are the height of the highest tree of tips; a round is aggregates by vertex and
    two joins on vertices, with nothing gathered that grows with a vertex's degree.

    Cases: equal edges count once, edges with a null end are left out; no edges give no rows; other columns are left aside."""
    e = edges.select("u", "v").where("u is not null and v is not null").distinct()
    for end in ("u", "v"):
        if lengths is None:
            e = e.withColumn(f"{end}_n", F.lit(1).cast("long"))
        else:
            e = e.join(lengths.select(F.col("w").alias(end), F.col("n").cast("long").alias(f"{end}_n")), end)
    none = F.lit(None).cast("long")
    state = materialize(e.select("u", "v", "u_n", "v_n", *[none.alias(c) for c in ("out_run", "out_span", "in_run", "in_span")]))
    settled = 0
    for _ in range(max_rounds):
        at = _at_vertices(state)
        near = lambda p: at.select(*[F.col(c).alias(f"{p}{c}") for c in at.columns])
        met = state.join(near("v_"), F.col("v") == F.col("v_x")).join(near("u_"), F.col("u") == F.col("u_x"))
        out_run, out_span = _judged("v_", "out", "in_span", "v_n", trim)
        in_run, in_span = _judged("u_", "in", "out_span", "u_n", trim)
        new = [F.coalesce(old, c).alias(old) for old, c in (("out_run", out_run), ("out_span", out_span), ("in_run", in_run), ("in_span", in_span))]
        last, state = state, materialize(met.select("u", "v", "u_n", "v_n", *new))
        discard(last)
        n = state.agg(F.count("out_span") + F.count("in_span")).first()[0]
        if n == settled:
            return state.select("u", "v", "out_span", "in_span")
        settled = n
    raise NotSettled(f"branches still settling after {max_rounds} rounds")


def next_vertices(spans: DataFrame, vertices: DataFrame, trim: int) -> DataFrame:
    """W, out_code, out_next, in_code, in_next for each vertex (column w): its one successor and its one predecessor.

    Branches are judged with the limits 0, 1, 2, 4 ... trim in turn until one true branch or none is left: the code is NEXT and the
    vertex is named, or DEAD_END; AMBI_OUT where several are left at the last. Vertices without edges are dead ends."""
    limits = [0]
    while limits[-1] < trim:
        limits.append(min(trim, max(1, 2 * limits[-1])))

    def side(root: str, head: str, span: str, name: str) -> DataFrame:
        true = lambda i: F.col(span).isNull() | (F.col(span) > i)
        counts = [c for i in limits for c in (F.count_if(true(i)).alias(f"n{i}"), F.max(F.when(true(i), F.col(head))).alias(f"h{i}"))]
        code, at = F.lit("AMBI_OUT"), F.lit(None)
        for i in reversed(limits):
            n = F.col(f"n{i}")
            code = F.when(n == 0, "DEAD_END").when(n == 1, "NEXT").otherwise(code)
            at = F.when(n == 1, F.col(f"h{i}")).when(n > 1, at)
        return spans.groupBy(F.col(root).alias("w")).agg(*counts).select("w", code.alias(f"{name}_code"), at.alias(f"{name}_next"))

    known = vertices.select("w").distinct().join(side("u", "v", "out_span", "out"), "w", "left").join(side("v", "u", "in_span", "in"), "w", "left")
    return known.select("w", *[c for s in ("out", "in") for c in (F.coalesce(f"{s}_code", F.lit("DEAD_END")).alias(f"{s}_code"), f"{s}_next")])


def extensions(steps: DataFrame, most: int | None = None) -> DataFrame:
    """W, steps, code: how many vertices the path from each vertex w of next_vertices() takes forward, and why it ends there.

    AMBI_IN: several true branches lead into the vertex, or it is not the one successor's one predecessor that the path came from;
    AMBI_OUT: several lead out; DEAD_END: none does; CYCLE: the next vertex is on the path; LENGTH_LIMIT: the path has `most` vertices.
    Paths from all vertices at once: the links that both ends agree on make chains, whose places come by pointer jumping."""
    steps = materialize(steps)
    forward = steps.where("out_code = 'NEXT'").select(F.col("w").alias("u"), F.col("out_next").alias("v"))
    backward = steps.where("in_code = 'NEXT'").select(F.col("in_next").alias("u"), F.col("w").alias("v"))
    links = materialize(forward.join(backward, ["u", "v"]))
    on = materialize(chains(links, steps.select("w")))
    ends = on.where("head is not null").groupBy("head").agg(F.max("at").alias("last"), F.max_by("w", "at").alias("end"))
    after = ends.join(steps.select(F.col("w").alias("end"), F.col("out_code").alias("code"), F.col("out_next").alias("beyond")), "end")
    after = after.join(on.select(F.col("w").alias("beyond"), F.col("head").alias("head2"), F.col("at").alias("at2")), "beyond", "left")
    # circles: every vertex sees all the others
    round_ = on.where("head is null").select("w")
    comp = connected_components(links.join(round_.select(F.col("w").alias("u")), "u", "left_semi"), "u", "v")
    sizes = comp.join(comp.groupBy("comp").agg(F.count("*").alias("size")), "comp").select(F.col("node").alias("w"), "size")
    met = on.join(after, "head", "left").join(sizes, "w", "left").join(steps.select("w", "in_code"), "w")
    back_on_path = (F.col("head2") == F.col("head")) & (F.col("at2") >= F.col("at"))
    n = F.when(F.col("in_code") == "AMBI_OUT", 0).when(F.col("head").isNull(), F.coalesce("size", F.lit(1)) - 1)
    n = n.otherwise(F.col("last") - F.col("at") + F.when((F.col("code") == "NEXT") & ~F.coalesce(back_on_path, F.lit(False)), 1).otherwise(0)).cast("long")
    code = F.when(F.col("in_code") == "AMBI_OUT", "AMBI_IN").when(F.col("head").isNull() | ((F.col("code") == "NEXT") & F.coalesce(back_on_path, F.lit(False))), "CYCLE")
    code = code.when(F.col("code") == "NEXT", "AMBI_IN").otherwise(F.col("code"))
    if most is not None:
        code = F.when(n + 1 >= most, "LENGTH_LIMIT").otherwise(code)
        n = F.least(n, F.lit(most - 1))
    return met.select("w", n.alias("steps"), code.alias("code"))


def branch_contigs(kmers: DataFrame, k: int, trim: int) -> DataFrame:
    """Seq, n_kmers, begin_code, end_code: the paths of canonical k-mers (kmer) that no true branch interrupts.

    Tips of up to `trim` k-mers are no choice for the path they hang on and make contigs of their own. Of a contig and its reverse complement the smaller
    is given, once. A code says why the path does not go on: as in next_vertices(), or AMBI_IN where the next k-mer has another
    predecessor. Circles are left out, as in unitigs()."""
    w = materialize(oriented_kmers(kmers).select("w").distinct())
    spans = branch_spans(kmer_edges(kmers), trim)
    steps = materialize(next_vertices(spans, w, trim))
    forward = steps.where("out_code = 'NEXT'").select(F.col("w").alias("u"), F.col("out_next").alias("v"))
    backward = steps.where("in_code = 'NEXT'").select(F.col("in_next").alias("u"), F.col("w").alias("v"))
    mirror = F.reverse(F.translate("v", "ACGT", "TGCA"))
    on = chains(forward.join(backward, ["u", "v"]).where(F.col("u") != mirror), w).where("head is not null")
    path = on.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("at", F.right("w", F.lit(1)).alias("b")))).alias("bs"), F.max_by("w", "at").alias("end"), F.count("*").alias("n_kmers"))
    seq = F.concat(F.left("head", F.lit(k - 1)), F.array_join(F.transform("bs", lambda x: x["b"]), ""))
    stop = lambda c: F.when(F.col(c) == "NEXT", "AMBI_IN").otherwise(F.col(c))
    built = path.select("head", "end", "n_kmers", seq.alias("seq"))
    built = built.join(steps.select(F.col("w").alias("head"), stop("in_code").alias("begin_code")), "head").join(steps.select(F.col("w").alias("end"), stop("out_code").alias("end_code")), "end")
    return built.where(F.col("seq") == canonical(F.col("seq"))).dropDuplicates(["seq"]).select("seq", "n_kmers", "begin_code", "end_code")


def longest_branches(edges: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """W, next, depth, tied: of each root (column w) with successors the one behind which lies the farthest vertex, its distance
    from the root by that successor, and whether other successors go as far; of equals the smallest.

    The distance is that of breadth-first search, so circles end. A front has a row for each start and newly met vertex; starts are
    successors of the roots, each searched once. Cases: roots without successors have no row, null ends are left out."""
    e = materialize(edges.select("u", "v").where("u is not null and v is not null").distinct())
    first = materialize(roots.select(F.col("w").alias("u")).distinct().join(e, "u"))
    seen = front = materialize(first.select(F.col("v").alias("start"), F.col("v").alias("at"), F.lit(0).cast("long").alias("d")).distinct())
    for d in range(1, max_rounds):
        moved = front.join(e, F.col("at") == F.col("u")).select("start", F.col("v").alias("at")).distinct()
        new = materialize(moved.join(seen, ["start", "at"], "left_anti").withColumn("d", F.lit(d).cast("long")))
        if new.isEmpty():
            break
        last, seen, front = seen, materialize(seen.union(new)), new
        discard(last)
    else:
        raise NotSettled(f"depths still growing after {max_rounds} rounds")
    depth = seen.groupBy(F.col("start").alias("v")).agg((F.max("d") + 1).alias("depth"))
    best = first.join(depth, "v").groupBy(F.col("u").alias("w"), "depth").agg(F.min("v").alias("next"), F.count("*").alias("n"))
    top = best.groupBy("w").agg(F.max_by(F.struct("next", "depth", "n"), "depth").alias("x"))
    return top.select("w", "x.next", "x.depth", (F.col("x.n") > 1).alias("tied"))

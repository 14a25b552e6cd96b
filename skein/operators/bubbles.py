"""Bubbles of any shape in a contig graph: found by peeling from all entrances at once, and replaced by one edge.

Graphs and vertices are as in skein.operators.contigs, with a column distance; contigs are rows (contig_id, length).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skein.operators.contigs import complement, drop_vertices
from skein.operators.debruijn import chains, unambiguous_edges
from skein.plans.iterate import NotSettled, discard, materialize


def _contracted(e: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges a, b, distance between chains; chains c, first, last, add, least; members c, w): runs of vertices that leave no choice as one,
    named by their first vertex.

    A distance x at a chain's first vertex is max(least, x + add) at its last one: steps add up, and no distance is below 0."""
    links = materialize(unambiguous_edges(e).where(F.col("v") != complement(F.col("u"))).select("u", "v", "distance"))
    vertices = e.select(F.explode(F.array("u", "v")).alias("w")).distinct()
    on = materialize(chains(links.select("u", "v"), vertices).where("head is not null"))
    step = on.join(links.select(F.col("v").alias("w"), "distance"), "w", "left").join(lengths, "w", "left").select("head", "at", "w", F.when(F.col("at") > 0, F.coalesce("distance", F.lit(0)) + F.coalesce("length", F.lit(0))).otherwise(0).cast("long").alias("step"))
    so_far = step.withColumn("sum", F.sum("step").over(Window.partitionBy("head").orderBy("at")))
    all_ = so_far.groupBy("head").agg(F.max_by("w", "at").alias("last"), F.sum("step").alias("add"), F.min(F.when(F.col("at") > 0, F.col("sum"))).alias("low"))
    chain = materialize(all_.select(F.col("head").alias("c"), F.col("head").alias("first"), "last", "add", F.greatest(F.lit(0), F.coalesce(F.col("add") - F.col("low"), F.lit(0))).alias("least")))
    between = e.select("u", "v", "distance").join(links.select("u", "v"), ["u", "v"], "left_anti")
    head = on.select("w", "head")
    edge = between.join(head.select(F.col("w").alias("u"), F.col("head").alias("a")), "u").join(head.select(F.col("w").alias("v"), F.col("head").alias("b")), "v")
    edge = edge.join(lengths.select(F.col("w").alias("v"), "length"), "v", "left").select("a", "b", (F.col("distance") + F.coalesce("length", F.lit(0))).cast("long").alias("distance"))
    return materialize(edge), chain, on.select(F.col("head").alias("c"), "w")


def find_bubbles(e: DataFrame, contigs: DataFrame, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(bubbles u, v, distance; their inner vertices u, v, w).

    A bubble is the least set of vertices with an entrance u of two successors or more and an exit v, such that all successors of
    the others than v, and all predecessors of the others than u, are in the set, without a cycle, and v not the complement of u.
    Of nested ones the outermost counts. distance is the longest way from u to the begin of v: distances of edges and lengths of
    vertices between, never below 0 on the way.

    Runs of vertices without a choice are contracted first. Then a region grows from every entrance side by side: a vertex
    enters it when all of its predecessors have, which is a count of edges that came in. A region is a bubble when
    one vertex alone waits and is complete; it is given up when none that waits is complete, when a complete one has no
    successor, or when it comes back to its entrance. A round is two joins over the waiting vertices of all open regions,
    so a large region is spread over tasks.

    Cases: loops end a region, as a vertex that waits for itself; circles without an entrance have no bubble; contigs without
    a length count as 0; no edges give no rows; regions still open after max_rounds raise NotSettled."""
    lengths = contigs.select(F.explode(F.array((2 * F.col("contig_id")).cast("long"), (2 * F.col("contig_id") + 1).cast("long"))).alias("w"), "length")
    e = materialize(e)
    edge, chain, member = _contracted(e, lengths)
    ins = edge.groupBy(F.col("b").alias("c")).agg(F.count("*").alias("ins"))
    outs = edge.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("outs"))
    known = materialize(chain.join(ins, "c", "left").join(outs, "c", "left").select("c", "first", "last", "add", "least", F.coalesce("ins", F.lit(0)).alias("ins"), F.coalesce("outs", F.lit(0)).alias("outs")))
    facts = known.select(F.col("c").alias("b"), "ins", "outs", "add", "least")
    begin = known.where("outs > 1").select(F.col("c").alias("s"))
    arrive = lambda rows: rows.groupBy("s", "b").agg(F.sum("got").alias("got"), F.max("x").alias("x"))
    first = begin.join(edge.withColumnRenamed("a", "s"), "s").select("s", "b", F.lit(1).cast("long").alias("got"), F.greatest(F.lit(0), F.col("distance")).cast("long").alias("x"))
    waiting = materialize(arrive(first))
    found, inside, tables = None, None, []
    for _ in range(max_rounds):
        if waiting.isEmpty():
            break
        met = waiting.join(facts, "b").withColumn("full", F.col("got") == F.col("ins"))
        state = materialize(met)
        of = state.groupBy("s").agg(
            F.count("*").alias("n"), F.count_if("full").alias("n_full"), F.bool_or(F.col("full") & ((F.col("outs") == 0) | (F.col("b") == F.col("s")))).alias("dead")
        )
        of = materialize(of.withColumn("closed", (F.col("n") == 1) & (F.col("n_full") == 1)))
        closed = state.join(of.where("closed").select("s"), "s", "left_semi").select("s", F.col("b").alias("t"), "x")
        going = of.where("not closed and not dead and n_full > 0").select("s")
        live = state.join(going, "s", "left_semi")
        entered = live.where("full").select("s", "b", F.greatest("least", F.col("x") + F.col("add")).alias("y"))
        on = entered.join(edge.select(F.col("a").alias("b"), F.col("b").alias("next"), "distance"), "b").select("s", F.col("next").alias("b"), F.lit(1).cast("long").alias("got"), F.greatest(F.lit(0), F.col("y") + F.col("distance")).cast("long").alias("x"))
        last, waiting = waiting, materialize(arrive(live.where("not full").select("s", "b", "got", "x").union(on)))
        new, inner = materialize(closed), materialize(entered.select("s", F.col("b").alias("c")))
        found = new if found is None else found.union(new)
        inside = inner if inside is None else inside.union(inner)
        tables += [new, inner]
        discard(last, state, of)
    else:
        raise NotSettled(f"regions still grow after {max_rounds} rounds")
    if found is None:
        found, inside = begin.select("s", F.col("s").alias("t"), F.lit(0).cast("long").alias("x")).where("false"), begin.select("s", F.col("s").alias("c")).where("false")
    ends = found.join(known.select(F.col("c").alias("s"), F.col("last").alias("u")), "s").join(known.select(F.col("c").alias("t"), F.col("first").alias("v"), "ins"), "t")
    length = lengths.withColumnRenamed("w", "v")
    # a run may begin with an exit and end with the entrance of the same bubble, but a bubble has two different ends
    good = ends.where((F.col("u") != complement(F.col("v"))) & (F.col("u") != F.col("v"))).join(length, "v", "left").select("s", "u", "v", (F.col("x") - F.coalesce("length", F.lit(0))).cast("long").alias("distance"))
    # an entrance inside another bubble is of a nested one
    inner = inside.join(good.select("s"), "s", "left_semi")
    outer = materialize(good.join(inner.select(F.col("c").alias("s")).distinct(), "s", "left_anti"))
    vertices = materialize(inner.join(outer.select("s", "u", "v"), "s").join(member, "c").select("u", "v", "w"))
    discard(e, waiting, edge, chain, known, *tables)
    return outer.select("u", "v", "distance"), vertices


def scaffold_over_bubbles(e: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the graph with each bubble replaced by one edge, the vertices w that went). The edge has the distance of the longest way,
    at least 1; where there is one already, it stays. A bubble's mirror image has the same edge, the longer of both."""
    found, inner = find_bubbles(e, contigs)
    both = found.union(found.select(complement(F.col("v")), complement(F.col("u")), "distance"))
    over = both.groupBy("u", "v").agg(F.greatest(F.max("distance"), F.lit(1)).cast("long").alias("distance"))
    gone = inner.select("w").distinct()
    rest = drop_vertices(e, gone)
    new = over.join(e.select("u", "v"), ["u", "v"], "left_anti")
    kept = drop_vertices(new, gone)
    return rest.unionByName(kept, allowMissingColumns=True), gone

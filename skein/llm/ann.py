"""Operator 7: approximate nearest neighbours on a graph grown by NN-descent, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.plans.iterate import materialize

#: Neighbours a node keeps, and at most as many of those that keep it, a chance choice.
NEIGHBOURS = 24
#: Rounds of NN-descent at most, and the share of changed neighbours below which it ends.
ROUNDS, LEAST_CHANGE = 5, 0.01
#: Centres of the first cells: chosen by a hash, at most this many; each node joins so many nearest ones.
CENTRES, CELLS = 1024, 3
#: Rows of a cell that are compared with each other at once; larger cells are cut by chance.
CELL_ROWS = 512
#: Nodes the search keeps for each query, and those of them it goes on from in each step.
BEAM, STEP, STEPS = 160, 48, 16


def _packed(vectors: np.ndarray) -> np.ndarray:
    """Rows of a scale (4 bytes) and components rounded to a byte: for choosing candidates only."""
    scale = np.maximum(np.abs(vectors).max(axis=1), 1e-30).astype("<f4") / 127
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    return np.concatenate([scale[:, None].view(np.uint8), codes.view(np.uint8)], axis=1)


def _unpacked(rows: np.ndarray) -> np.ndarray:
    return rows[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(rows[:, :4]).view("<f4")


def _binary(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _rows(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names)


_UPDATE = "u long, w long, d float"


def _updates(u: list, w: list, d: list) -> pa.RecordBatch:
    joined = [np.concatenate(x) if x else np.empty(0) for x in (u, w, d)]
    return _rows([pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)), pa.array(joined[2].astype(np.float32))], ["u", "w", "d"])


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    k = min(k, d.shape[1])
    return np.argpartition(d, k - 1, axis=1)[:, :k]


def _first_graph(nodes: DataFrame, width: int, k: int) -> DataFrame:
    """(u, w, d): each node's nearest among the rows of its cells; a cell is what lies near one centre."""
    n = nodes.count()
    centres = [bytes(r[0]) for r in nodes.orderBy(F.xxhash64("node")).limit(int(min(CENTRES, max(1, 1.2 * n**0.5)))).select("code").collect()]
    shared = nodes.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(centres), np.uint8).reshape(-1, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _unpacked(shared.value)
        for x in batches:
            if x.num_rows:
                at = _nearest(_squared(_unpacked(_binary(x["code"], width)), c), CELLS)
                yield _rows([pa.array(np.repeat(x["node"].to_numpy(), at.shape[1])), pa.array(at.ravel().astype(np.int32)), x["code"].take(pa.array(np.repeat(np.arange(x.num_rows), at.shape[1])))], ["node", "cell", "code"])

    celled = nodes.select("node", "code").mapInArrow(assign, "node long, cell int, code binary")
    counts = dict(celled.groupBy("cell").count().collect())  # a row for each centre
    pieces = F.create_map(*[v for c, m in counts.items() for v in (F.lit(c), F.lit(-(-m // CELL_ROWS)))]) if counts else F.create_map(F.lit(-1), F.lit(1))
    cut = celled.withColumn("piece", F.pmod(F.xxhash64("node", "cell"), pieces[F.col("cell")].cast("long")))

    def compare(key, table):
        ids = table["node"].to_numpy()
        x = _unpacked(np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(-1, width))
        if len(ids) < 2:
            return pa.table({"u": pa.array([], pa.int64()), "w": pa.array([], pa.int64()), "d": pa.array([], pa.float32())})
        d = _squared(x, x)
        np.fill_diagonal(d, np.inf)
        at = _nearest(d, min(k, len(ids) - 1))
        return pa.table({"u": np.repeat(ids, at.shape[1]), "w": ids[at].ravel(), "d": np.take_along_axis(d, at, 1).ravel().astype(np.float32)})

    return cut.groupBy("cell", "piece").applyInArrow(compare, _UPDATE)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest w of each u; the limit is applied before the shuffle too."""
    once = found.groupBy("u", "w").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "w"))
    return once.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _around(graph: DataFrame, k: int, seed: int) -> DataFrame:
    """(v, w, fresh): each node's neighbours, and k at most of those whose neighbour it is."""
    back = graph.select(F.col("w").alias("v"), F.col("u").alias("w"), "fresh")
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("v", "w", F.lit(seed))))
    back = back.withColumn("r", rank).where(F.col("r") <= k).drop("r")
    return graph.select(F.col("u").alias("v"), "w", "fresh").union(back).groupBy("v", "w").agg(F.max("fresh").alias("fresh"))


def neighbour_graph(nodes: DataFrame, width: int, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """(u, w, d): for each node about its k nearest; d is squared and approximate.

    NN-descent (Dong, Moses and Li, 2011): a neighbour of a neighbour is likely a neighbour.
    In each round, every node's neighbours, in both directions, are joined with their
    vectors, gathered at the node and compared with each other; pairs closer than a node's
    present neighbours are proposed to it, and each node keeps its nearest. Only pairs with a
    neighbour new since the last round are compared. A node gathers at most 2k vectors.
    """
    graph = materialize(_best(_first_graph(nodes, width, k).withColumn("fresh", F.lit(1)), k))
    size = graph.count()
    codes = nodes.select(F.col("node").alias("w"), "code")
    for turn in range(rounds):
        worst = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("bound")).withColumnRenamed("u", "w")
        met = _around(graph, k, turn).join(codes.join(worst, "w", "left"), "w")
        gathered = met.groupBy("v").agg(F.collect_list(F.struct("w", "fresh", "bound", "code")).alias("near"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    near = whole.slice(at, 512)["near"]
                    cuts, flat = near.offsets.to_numpy(), near.values
                    ids, fresh = flat.field("w").to_numpy(), flat.field("fresh").to_numpy() > 0
                    bound = flat.field("bound").fill_null(float("inf")).to_numpy()
                    base = int(cuts[0])
                    x = _unpacked(_binary(flat.field("code").slice(base, int(cuts[-1]) - base), width))
                    out: tuple[list, list, list] = ([], [], [])
                    for b, e in zip(cuts[:-1], cuts[1:], strict=True):
                        if e - b < 2 or not fresh[b:e].any():
                            continue
                        d = _squared(x[b - base : e - base], x[b - base : e - base])
                        ok = (d < bound[b:e, None]) & (fresh[b:e, None] | fresh[None, b:e])
                        np.fill_diagonal(ok, False)
                        i, j = np.nonzero(ok)
                        out[0].append(ids[b:e][i]), out[1].append(ids[b:e][j]), out[2].append(d[i, j])
                    yield _updates(*out)

        proposed = gathered.select("near").mapInArrow(compare, _UPDATE).withColumn("fresh", F.lit(1))
        graph = materialize(_best(graph.withColumn("fresh", F.lit(0)).unionByName(proposed), k))
        if (graph.agg(F.sum("fresh")).first()[0] or 0) <= LEAST_CHANGE * size:
            break
    return graph.drop("fresh")


def _ranked(queries: DataFrame, found: DataFrame) -> DataFrame:
    """beam rows (q, w, d, open) cut to the nearest BEAM of each query."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "w"))
    return found.withColumn("r", rank).where(F.col("r") <= BEAM)


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, width: int) -> DataFrame:
    """(q, w): for each query node, the nodes that a greedy search of the graph ends with.

    All queries go in step: the nearest nodes not yet left are left along their edges,
    in both directions, nodes not met before are measured, and the nearest stay.
    """
    edges = materialize(_around(graph.withColumn("fresh", F.lit(0)), NEIGHBOURS, -1).select("v", "w").groupBy("v").agg(F.collect_list("w").alias("ws")))
    codes = nodes.select(F.col("node").alias("w"), "code")
    asked = queries.select(F.col("node").alias("q")).distinct().join(nodes.select(F.col("node").alias("q"), F.col("code").alias("q_code")), "q")
    asked = materialize(asked)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                a, b = _unpacked(_binary(x["q_code"], width)), _unpacked(_binary(x["code"], width))
                yield _rows([x["q"], x["w"], pa.array(((a - b) ** 2).sum(1))], ["q", "w", "d"])

    seen = asked.select("q", F.col("q").alias("w"), F.lit(0.0).cast("float").alias("d"))
    beam = seen.withColumn("open", F.lit(True))
    for _ in range(STEPS):
        rank = F.row_number().over(Window.partitionBy("q", "open").orderBy("d", "w"))
        beam = beam.withColumn("go", F.col("open") & (rank <= STEP))
        left = beam.where("go").select("q", F.col("w").alias("v")).join(edges, "v").select("q", F.explode("ws").alias("w")).distinct()
        fresh = left.join(seen.select("q", "w"), ["q", "w"], "left_anti")
        measured = materialize(fresh.join(codes, "w").join(asked, "q").mapInArrow(measure, "q long, w long, d float"))
        kept = beam.select("q", "w", "d", (F.col("open") & ~F.col("go")).alias("open"))
        seen = seen.union(measured)
        beam = materialize(_ranked(asked, kept.union(measured.withColumn("open", F.lit(True)))).select("q", "w", "d", "open"))
        if beam.where("open").isEmpty():
            break
    return beam.select("q", "w")


def _usable(column: Column) -> Column:
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return column.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(column, lambda c: c != 0)


def nearest_neighbours(vectors: DataFrame, every: int = 100, count: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the `count` nearest rows found for each row of vectors
    (vec_id, embedding) whose vec_id is divisible by `every`, by Euclidean distance.

    Equal vectors are one node of the graph; its smallest count + 1 ids stand for it, which is
    all that a list of `count` can show. The graph and its search only choose candidates; scores are
    computed in double precision from the original vectors. See neighbour_graph() and search().

    Cases: vectors that are null, empty, zero or hold null or non-finite components, or whose
    length is not the most frequent one, and rows without vec_id take no part; repeated rows
    count once; a row is not its own neighbour; ties go to smaller vec_ids; with fewer rows than
    `count` all are returned; no rows give no rows; other columns are left aside.
    """
    usable = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    lengths = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = lengths[0][0] if lengths else 0
    width = length + 4
    usable = usable.where(F.size("embedding") == length)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                v = x["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, length).astype(np.float64)
                yield pa.RecordBatch.from_arrays([x["node"], x["embedding"], pa.array([r.tobytes() for r in _packed(v)], pa.binary())], ["node", "embedding", "code"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    nodes = materialize(usable.select("embedding").distinct().withColumn("node", F.monotonically_increasing_id()).select("node", "embedding"))
    nodes = materialize(nodes.mapInArrow(pack, f"node long, embedding {kind}, code binary"))
    ids = usable.distinct().join(nodes.select("node", "embedding"), "embedding").select("node", "vec_id")
    ids = materialize(ids)
    least = ids.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= count + 1).drop("r")
    queries = ids.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "node")
    graph = neighbour_graph(nodes, width)
    found = search(queries, nodes, graph, width)
    exact = nodes.select("node", F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    pairs = found.join(exact.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q").join(exact.select(F.col("node").alias("w"), F.col("v").alias("wv")), "w")
    apart = F.sqrt(F.aggregate(F.zip_with("qv", "wv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    near = pairs.select("q", "w", apart.alias("score"))
    # a query's nearest nodes are enough, before ids and queries of equal vectors are put in; of equally near ones those of the least ids
    near = near.join(ids.groupBy(F.col("node").alias("w")).agg(F.min("vec_id").alias("least")), "w")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "least"))).where(F.col("r") <= count + 1).drop("r", "least")
    listed = near.join(queries.withColumnRenamed("node", "q"), "q").join(least.withColumnRenamed("node", "w"), "w").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")

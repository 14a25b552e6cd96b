"""Helpers for iterative DataFrame jobs: written lineage cuts, fixpoints, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one where none is named and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return sc.getCheckpointDir()


#: Has Spark delete an execution's shuffle files when it ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there: cuts the lineage, survives lost
    executors, and frees the disk of the shuffles that made it.

    A table is read by as many tasks as its size asks for, and only the columns that are used.
    Its rows keep no partitioning. discard() deletes it."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(folder)  # a frame has the setting of the time it is made
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(folder)
    table._skein_folder = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that nothing reads any more; other frames are let be."""
    for t in tables:
        folder = t.__dict__.pop("_skein_folder", None)
        if folder:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables of the same columns, made by materialize(), in one scan however many they are."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._skein_folder for t in tables])


class NotSettled(RuntimeError):
    """An iteration did not end within its rounds; its unfinished state is no result."""


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """Apply step, which only ever removes rows, until the row count stands still."""
    state = materialize(state)
    n = state.count()
    for _ in range(max_rounds):
        if n == 0:
            return state
        last, state = state, materialize(step(state))
        discard(last)
        m = state.count()
        if m == n:
            return state
        n = m
    raise NotSettled(f"still changing after {max_rounds} rounds")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Component labels of an undirected graph as (node, comp), comp being the smallest node reachable.

    Alternates large-star and small-star contractions (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014): the edge table never grows, and the
    number of rounds is logarithmic in practice. A round is one min-aggregate
    (pre-combined before its shuffle) and one join, which adaptive execution may split
    on a hot node. Self-loops are ignored; nodes without an edge are not returned.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # u sees its neighbours v; the smallest of them and itself becomes their hub
        both = e.select(F.col("u"), F.col("v")).union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(low, "u")
        if large:
            out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = materialize(e)
    for _ in range(max_rounds):
        # done once the edges are stars: nobody has two hubs, and no hub has a hub
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
        by = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if not by.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).limit(1).count():
            break
        last, e = e, materialize(star(star(e, large=True), large=False).distinct())
        discard(last)
    else:
        raise NotSettled(f"components still changing after {max_rounds} rounds")
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return pairs.union(pairs.select(F.col("comp").alias("node"), "comp").distinct())

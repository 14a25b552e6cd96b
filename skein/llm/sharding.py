"""Operator 1: contiguous shards of near equal byte size, cut on a global prefix sum."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skein.plans.iterate import shared_folder

SHARDS = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal documents, in order of doc_id, into `shards` contiguous runs of near equal size.

    docs needs doc_id and text; other columns are left aside. Returns doc_id, size (UTF-8
    bytes of the text plus 1), text_crc32, shard, slot (gapless from 0 in each shard) and
    start_byte (the global prefix sum before the row).

    A row belongs to the shard in whose target range [s*T/shards, (s+1)*T/shards) its
    first byte falls, T being the sum of all sizes, so a shard's size differs from T/shards
    by less than one row.

    Only (doc_id, size, crc) are shuffled, never texts. Rows are range-partitioned and
    sorted; each partition gives its totals, whose running sums (one row for each
    partition) are the partitions' offsets; a second pass adds them up row by row.

    Cases: a null text has size 1 and a null crc; null doc_ids come first; an empty
    text has size 1; equal doc_ids go by crc, size and place in the input, so repeated
    rows spread over partitions; no rows give no rows; a shard may stay empty when there
    are fewer rows than shards.
    """
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    ).withColumn("place", F.monotonically_increasing_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_crc32", "size", "place"]
    ordered = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("place").withColumn("pid", F.spark_partition_id())
    shared_folder(docs.sparkSession)
    ordered = ordered.checkpoint(eager=True)  # unlike a written table, it keeps partitions and their order
    totals = sorted(ordered.groupBy("pid").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())
    offsets, done, rows = {}, 0, 0
    for pid, b, n in totals:
        offsets[pid] = (done, rows)
        done, rows = done + b, rows + n
    total = max(done, 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for x in batches:
            if not len(x):
                continue
            if at is None:
                at = offsets[int(x["pid"].iloc[0])]
            run = x["size"].cumsum()
            x["start_byte"] = at[0] + run - x["size"]
            x["at_row"] = range(at[1], at[1] + len(x))
            at = (at[0] + int(run.iloc[-1]), at[1] + len(x))
            yield x.drop(columns="pid")

    placed = ordered.mapInPandas(place, "doc_id long, size long, text_crc32 long, start_byte long, at_row long")
    placed = placed.withColumn("shard", F.expr(f"start_byte * {shards} div {total}").cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("at_row").alias("first_row"))  # one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at_row") - F.col("first_row")).alias("slot"), "start_byte"
    )

"""K-mer counting as a stream: counts of windows add up, so reads may arrive in any number of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions.sequence import canonical, windows


def stream_reads(spark: SparkSession, path: str, schema: str = "id long, seq string", files_per_trigger: int = 1) -> DataFrame:
    """Reads of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_counts(reads: DataFrame, k: int) -> DataFrame:
    """kmer, n: running canonical counts; the state is one count for each k-mer."""
    w = windows(reads.select(F.upper("seq").alias("seq")), k)
    return w.groupBy(canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))


def stream_histogram_of_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window, value, n: a histogram (value, ts) for each time window; rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), F.floor("value").cast("long").alias("value")).agg(F.count("*").alias("n"))


def run_available(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Count what is there now into an in-memory table, and stop."""
    q = counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q

"""Histograms as tables (value, n): statistics, ranks, contiguity, filters, bins, probabilities.

A percentile is the smallest value whose cumulative count reaches ceil(p * size): a rank, no
interpolation. N50 and its kin accumulate bases from the shortest sequence on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def statistics(hist: DataFrame) -> DataFrame:
    """One row: size, total, mean, variance (of the population), sd, least, most."""
    size, total = F.sum("n"), F.sum(F.col("value") * F.col("n"))
    squares = F.sum(F.col("value") * F.col("value") * F.col("n"))
    s = hist.agg(size.alias("size"), total.alias("total"), squares.alias("sq"), F.min("value").alias("least"), F.max("value").alias("most"))
    mean = F.col("total") / F.col("size")
    variance = F.greatest((F.col("sq") - F.col("total") * F.col("total") / F.col("size")) / F.col("size"), F.lit(0.0))
    return s.select("size", "total", mean.alias("mean"), variance.alias("variance"), F.sqrt(variance).alias("sd"), "least", "most")


def _ranked(hist: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """Running and total weight of each value; groups are histograms, which are small."""
    up = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("run", F.sum(weight).over(up)).withColumn("all", F.sum(weight).over(Window.partitionBy(*by)))


def percentiles(hist: DataFrame, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """p50-like columns, one for each share in ps, for each group (or one row)."""
    by = by or []
    grouped = hist.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    ranked = _ranked(grouped, by, F.col("n"))
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("run") >= F.ceil(F.lit(p) * F.col("all")), F.col("value"))).alias(f"p{round(p * 100)}") for p in ps])


def weighted_percentiles(hist: DataFrame, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """As percentiles(), with values weighed by themselves: N50 is w50, N75 is w25."""
    by = by or []
    grouped = hist.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    ranked = _ranked(grouped, by, F.col("n") * F.col("value"))
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("run") >= F.ceil(F.lit(p) * F.col("all")), F.col("value"))).alias(f"w{round(p * 100)}") for p in ps])


def contiguity(lengths: DataFrame, by: list[str], least: int = 500, genome_size: int | None = None) -> DataFrame:
    """Contiguity of sequences (length) of each group: n_all, n, l50, lg50 and ng50 (with genome_size), least,
    n75, n50, n25, e_size, most, total. Sequences shorter than `least` count in n_all only.

    Lengths are counted before anything is ordered, so what is ranked is a histogram of lengths."""
    hist = lengths.groupBy(*by, F.col("length").cast("long").alias("value")).agg(F.count("*").alias("n"))
    long = _ranked(hist.where(F.col("value") >= least), by, F.col("n") * F.col("value"))
    at = lambda need: F.min(F.when(F.col("run") >= need, F.col("value")))
    goal = F.lit(genome_size or 0)
    stats = long.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.min("value").alias("least"),
        *[at(F.ceil(F.lit(p) * F.col("all"))).alias(name) for name, p in (("n75", 0.25), ("n50", 0.5), ("n25", 0.75))],
        (F.sum(F.col("value") * F.col("value") * F.col("n")) / F.sum(F.col("value") * F.col("n"))).alias("e_size"),
        F.max("value").alias("most"),
        F.sum(F.col("value") * F.col("n")).alias("total"),
        *([F.when(F.max("all") < goal / 2, F.min("value")).otherwise(at(F.col("all") - F.floor(goal / 2))).alias("ng50")] if genome_size else []),
    )
    marks = [("l50", "n50"), *([("lg50", "ng50")] if genome_size else [])]
    counted = hist.join(stats.select(*by, *[m for _, m in marks]), by).groupBy(*by).agg(F.sum("n").alias("n_all"), *[F.sum(F.when(F.col("value") >= F.col(m), F.col("n")).otherwise(0)).alias(c) for c, m in marks])
    order = ["n_all", "n", "l50", *(["lg50", "ng50"] if genome_size else []), "least", "n75", "n50", "n25", "e_size", "most", "total"]
    return counted.join(stats, by).select(*by, *order)


def remove_noise(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Without bins that have no bin beside them; if all are such, the largest stays."""
    w = Window.partitionBy(*(by or [])).orderBy("value")
    marked = hist.withColumn("alone", F.coalesce(F.lag("value").over(w) < F.col("value") - 1, F.lit(True)) & F.coalesce(F.lead("value").over(w) > F.col("value") + 1, F.lit(True)))
    every = Window.partitionBy(*(by or []))
    marked = marked.withColumn("all_alone", F.min("alone").over(every)).withColumn("top", F.max("value").over(every))
    return marked.where(~F.col("alone") | (F.col("all_alone") & (F.col("value") == F.col("top")))).select(*(by or []), "value", "n")


def remove_outliers(hist: DataFrame, spread: int = 20) -> DataFrame:
    """Within `spread` interquartile ranges of the quartiles."""
    low, high = percentiles(hist, [0.25, 0.75]).first() or (0, 0)
    if low is None:
        return hist.select("value", "n")
    far = spread * (high - low)
    return hist.where(F.col("value").between(low - far, high + far)).select("value", "n")


def trim_fraction(hist: DataFrame, fraction: float) -> DataFrame:
    """Without the fraction's half of the counts at either end."""
    up = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("run", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    half = F.lit(fraction / 2)
    return ranked.where((F.col("run") / F.col("all") > half) & ((F.col("run") - F.col("n")) / F.col("all") < 1 - half)).select("value", "n")


def bins(hist: DataFrame, count: int) -> DataFrame:
    """Counts in bins of equal width from the least value on: bin, n."""
    low, high = hist.agg(F.min("value"), F.max("value")).first()
    width = max(-(-((high or 0) - (low or 0) + 1) // count), 1)
    return hist.groupBy(F.floor((F.col("value") - F.lit(low or 0)) / width).cast("long").alias("bin")).agg(F.sum("n").alias("n"))


def bars(hist: DataFrame, count: int = 12) -> DataFrame:
    """Bins with a bar of block characters in proportion to the largest."""
    b = bins(hist, count)
    top = b.agg(F.max("n")).first()[0] or 1
    return b.select("bin", "n", F.repeat(F.lit("█"), F.ceil(F.col("n") * 20 / top).cast("int")).alias("bar"))


def probabilities(hist: DataFrame) -> DataFrame:
    """Value, p for each value from 0 to the largest; values not seen get 1 / size."""
    size = hist.agg(F.sum("n").alias("size"), F.max("value").alias("most"))
    every = size.select("size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))).alias("value"))
    return every.join(hist, "value", "left").select("value", (F.coalesce("n", F.lit(1)) / F.col("size")).alias("p"))


def trim_low(hist: DataFrame, least: int) -> DataFrame:
    """Values of `least` or more."""
    return hist.where(F.col("value") >= least)


def negate(hist: DataFrame) -> DataFrame:
    """The histogram of the negated values."""
    return hist.select((-F.col("value")).alias("value"), "n")


def drop_negative(hist: DataFrame) -> DataFrame:
    """Values of 0 or more."""
    return hist.where("value >= 0")

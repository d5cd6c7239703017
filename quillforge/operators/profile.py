"""Measures of units: long form, nearest-rank percentiles, outliers and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.sources.scratch import materialise

PERCENTS = (50, 90, 95, 99)


def to_long(wide: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, metric, value) with a row for each measure that is not null."""
    narrow = wide.select(*keys, *(F.col(m).cast("long").alias(m) for m in measures))
    return narrow.unpivot(keys, measures, "metric", "value").filter(F.col("value").isNotNull())


def percentiles(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """count, p50, p90, p95, p99 and max by nearest rank: the element at round((n - 1) * p / 100).

    Equal values are counted before the shuffle, so a frequent value is one row. The counts are dealt
    by range of (group, value) and written once; each part of a group is then ranked by itself, behind
    the counts of the parts before it, so no task takes a whole group. Groups without a value have no row."""
    return percentiles_of_counts(counts(long, by, value), by, value)


def counts(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, value, _n): an exact distribution of each group. Counts of parts of a table, kept or not, make
    those of the whole by `merged`."""
    return long.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))


def merged(kept: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return kept.groupBy(*by, value).agg(F.sum("_n").alias("_n"))


def percentiles_of_counts(counted: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """`percentiles` of what has been counted already, by `counts` or `merged`."""
    held = materialise(counted.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "counts")
    keys = [F.col(c).alias(f"_k{k}") for k, c in enumerate(by)]
    parts = held.groupBy(*keys, F.col("_part").alias("_p")).agg(F.sum("_n").alias("_in"), F.max(value).alias("_most"))
    group = Window.partitionBy(*(f"_k{k}" for k in range(len(by))))
    ahead = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("*", F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_in").over(group).alias("count"), F.max("_most").over(group).alias("max"))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    inside = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = held.withColumn("_here", F.sum("_n").over(inside)).join(parts, same)
    upto = F.col("_here") + F.col("_ahead")
    at = lambda p: F.round((F.col("count") - 1) * p / F.lit(100.0)).cast("long")
    picks = [F.min(F.when(upto > at(p), F.col(value))).alias(f"p{p}") for p in PERCENTS]
    return joined.groupBy(*by, "count", "max").agg(*picks).select(*by, "count", *(f"p{p}" for p in PERCENTS), "max")


def top_n(long: DataFrame, n: int, ties: list[str], by: str = "metric", value: str = "value") -> DataFrame:
    """The n largest values of each metric; equal values go by `ties`."""
    order = Window.partitionBy(by).orderBy(F.desc(value), *ties)
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def maxima(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Learned thresholds: the largest value of each group."""
    return long.groupBy(*by).agg(F.max(value).alias("threshold"))


def inverse_coverage(percent: Column) -> Column:
    return F.greatest(F.lit(100) - percent, F.lit(0)).cast("long")

"""Ranges inside a group: overlaps, containment and edits.

Containment meets in bins: a range of a length up to 2^k lies in at most two bins of that width, and
what it holds begins in one of them. So ranges meet by group, width and bin; a group of any size is split,
and ranges that lie far apart never meet. There are at most 64 widths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(ranges: DataFrame, group: str, start: str, end: str, *ties: str) -> DataFrame:
    """Ranges that reach into the next one of their group, in order of start."""
    order = Window.partitionBy(group).orderBy(start, end, *ties)
    return ranges.withColumn("next_start", F.lead(start).over(order)).filter(F.col("next_start") < F.col(end))


def _number(df: DataFrame, name: str) -> Column:
    return F.unix_micros(F.col(name)) if df.schema[name].dataType.typeName().startswith("timestamp") else F.col(name).cast("long")


def _width(length: Column) -> Column:
    """The least k with length < 2^k."""
    return F.length(F.conv(length.cast("string"), 10, 2)).cast("int")


def _bin(at: Column, width: Column) -> Column:
    return F.call_function("shiftright", at, width)


def _widths(ranges: DataFrame, start: str, end: str) -> list[int]:
    """The widths that occur, 64 at most."""
    found = ranges.select(_width(_number(ranges, end) - _number(ranges, start)).alias("w")).filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    return sorted(r.w for r in found.distinct().collect())


def _holders(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Ranges with (_w, _bin) of the one or two bins that they lie in."""
    a, b = _number(ranges, start), _number(ranges, end)
    wide = ranges.filter(F.col(start) <= F.col(end)).withColumn("_w", _width(b - a))
    return wide.withColumn("_bin", F.explode(F.array_distinct(F.array(_bin(a, F.col("_w")), _bin(b, F.col("_w"))))))


def _held(rows: DataFrame, at: str, widths: list[int]) -> DataFrame:
    """Rows with (_w, _bin) of the bin of each width that `at` lies in."""
    each = F.explode(F.array([F.lit(w) for w in widths]).cast("array<int>"))
    return rows.withColumn("_w", each).withColumn("_bin", _bin(_number(rows, at), F.col("_w")))


def smallest_enclosing(points: DataFrame, ranges: DataFrame, group: str, at: str, start: str, end: str, *ties: str) -> DataFrame:
    """For each point (group, at, ...) the shortest range of its group that holds it; equal points once."""
    names = [c for c in ranges.columns if c != group]
    met = _held(points, at, _widths(ranges, start, end)).join(_holders(ranges, start, end), [group, "_w", "_bin"]).filter((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    best = F.min(F.struct((_number(ranges, end) - _number(ranges, start)).alias("_length"), *(F.col(t).alias(f"_t{k}") for k, t in enumerate(ties)), *names)).alias("_x")
    return met.groupBy(*points.columns).agg(best).select(*points.columns, *(f"_x.{c}" for c in names))


def nested(ranges: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """(outer, inner): pairs of a group's ranges of which one holds the other (equal ranges: by key)."""
    rows = ranges.select(group, key, start, end)
    one = _holders(rows, start, end).select(group, "_w", "_bin", F.col(key).alias("outer"), F.col(start).alias("_a"), F.col(end).alias("_b"))
    two = _held(rows.filter(F.col(start) <= F.col(end)), start, _widths(rows, start, end)).select(group, "_w", "_bin", F.col(key).alias("inner"), F.col(start).alias("_c"), F.col(end).alias("_d"))
    held = (F.col("_a") <= F.col("_c")) & (F.col("_d") <= F.col("_b")) & (((F.col("_a") < F.col("_c")) | (F.col("_d") < F.col("_b"))) | (F.col("outer") < F.col("inner")))
    return one.join(two, [group, "_w", "_bin"]).filter(held & (F.col("outer") != F.col("inner"))).select(group, "outer", "inner")

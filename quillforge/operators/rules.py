"""Threshold violations, focus, gates and the checks of a shrink target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(long: DataFrame, thresholds: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose value is over the threshold (equal is allowed).

    thresholds is a parameter table of one row for each metric and language; Spark broadcasts it where
    its size allows."""
    return long.join(thresholds, on).filter(F.col("threshold").isNotNull() & (F.col("value") > F.col("threshold")))


def exempt_methods(rows: DataFrame, metric: str = "positional_args", inside: str = "inside_class") -> DataFrame:
    """Methods are not held to the limit on positional arguments."""
    return rows.filter(~((F.col("metric") == metric) & F.col(inside)))


def focus(rows: DataFrame, files: DataFrame | None, file_col: str = "file") -> DataFrame:
    """Rows of the focus files; without a focus or with an empty one, all. Applied to reports, never
    below what a report counts."""
    return rows if files is None or files.isEmpty() else rows.join(files.select(F.col(files.columns[0]).alias(file_col)).distinct(), file_col, "left_semi")


def focus_clusters(members: DataFrame, files: DataFrame, cluster: str = "cluster_id", file_col: str = "file") -> DataFrame:
    """Clusters with a member in the focus, whole."""
    return members.join(focus(members, files, file_col).select(cluster).distinct(), cluster, "left_semi")


def violation_line(metric: str | Column, file: Column, line: Column, unit: Column, message: Column, suggestion: Column) -> Column:
    return F.format_string("VIOLATION:%s:%s:%d:%s: %s %s", F.lit(metric) if isinstance(metric, str) else metric, file, line, unit, message, suggestion)


def shrink(current: DataFrame, baseline: DataFrame, target: str, target_value: int) -> DataFrame:
    """(metric, value, limit, is_target) of global metrics over their limits: the target's own value for
    the target, the baseline for the others. Both tables have (metric, value)."""
    held = current.join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
    limit = F.when(F.col("metric") == target, F.lit(target_value)).otherwise(F.col("baseline"))
    return held.select("metric", "value", limit.cast("long").alias("limit"), (F.col("metric") == target).alias("is_target")).filter("value > limit")


def shrink_start(current_value: int, target_value: int) -> None:
    """A shrink may only be started towards a value that is not above the present one."""
    if target_value > current_value:
        raise ValueError(f"the target {target_value} is above the present value {current_value}")


def coverage_by_file(definitions: DataFrame, uncovered: DataFrame, file_col: str = "file", name_col: str = "name") -> DataFrame:
    """(file, definitions, covered, percent): percent rounds half up."""
    missing = uncovered.groupBy(file_col).agg(F.count("*").alias("_missing"))
    found = definitions.groupBy(file_col).agg(F.count("*").alias("definitions"))
    return found.join(missing, file_col, "left").select(file_col, "definitions", (F.col("definitions") - F.coalesce("_missing", F.lit(0))).alias("covered")).withColumn("percent", F.round(F.col("covered") / F.col("definitions") * 100).cast("long"))


def overall_coverage(by_file: DataFrame) -> DataFrame:
    """One row: percent over all files (100 without definitions) and the smallest of a file."""
    return by_file.agg(F.coalesce(F.round(F.sum("covered") / F.sum("definitions") * 100), F.lit(100)).cast("long").alias("percent"), F.coalesce(F.min("percent"), F.lit(100)).cast("long").alias("min_percent"), F.coalesce(F.sum("definitions"), F.lit(0)).cast("long").alias("definitions"))


def gate(overall: DataFrame, threshold: int) -> DataFrame:
    return overall.withColumn("threshold", F.lit(threshold).cast("long")).withColumn("passed", F.col("percent") >= threshold)


def status(violations: DataFrame, orphans: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: how many there are of each, and whether and how a check ends."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    both = count(violations, "violations").join(count(orphans, "orphans")).join(count(clusters, "duplicate_clusters"))  # one row each
    failed = F.col("violations") + F.col("orphans") + F.col("duplicate_clusters") > 0
    return both.select("*", failed.alias("failed"), failed.cast("int").alias("exit_code"))

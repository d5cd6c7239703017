"""Rows that pass a set of rules and rows that do not, told apart in one pass and counted on the way."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillforge.sources import scratch


class Sorted(NamedTuple):
    """good: the rows' own columns; rejects: these and `reason`; counts: rows by name, `good` and each reason."""

    good: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


def reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row breaks, or null; a rule without an answer is broken."""
    found = F.lit(None).cast("string")
    for name, holds in reversed(rules.items()):
        found = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(found)
    return found


def told_apart(rows: DataFrame, rules: dict[str, Column]) -> Sorted:
    """Rows are read once: they are written in two parts to the shared folder, and counted while they are."""
    seen = Observation()
    judged = rows.withColumn("reason", reason(rules)).withColumn("_good", F.col("reason").isNull())
    counted = judged.observe(seen, F.count_if("_good").alias("good"), *(F.count_if(F.col("reason") == name).alias(name) for name in rules))
    path = f"{scratch.shared_dir(rows.sparkSession)}/told-{uuid.uuid4().hex}"
    counted.write.partitionBy("_good").parquet(path)
    written = rows.sparkSession.read.schema(judged.schema).parquet(path)
    scratch.remember(path, rows.sparkSession)
    return Sorted(written.filter("_good").select(rows.columns), written.filter("not _good").select(*rows.columns, "reason"), dict(seen.get))

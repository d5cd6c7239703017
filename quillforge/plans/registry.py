"""Named queries, each with the SQL that gives the same rows (or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows a core under which a table may be one file's one row group, and so one task.
FEW_ROWS = 50_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows of a small table dealt to all cores by a key, for work on each row that costs more than
    moving it; a large table has parts enough and stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.count() < cores * FEW_ROWS else rows

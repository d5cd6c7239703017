"""Results of whole analyses kept as Parquet under the fingerprint of what they were made from."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.plans.analysis import Settings
from quillforge.sources import files as source_files

VERSION = 1


def key(files: DataFrame, settings: Settings, name: str) -> str:
    """Changes with any path, size or time, with the settings, and with the layout of what is kept."""
    limits = sorted([*pair, limit] for pair, limit in settings.limits.items())
    held = json.dumps([VERSION, limits, settings.gate, settings.duplicates], sort_keys=True)
    return f"{name}-{source_files.fingerprint(files, held)}"


def kept(folder: str, files: DataFrame, settings: Settings, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` of a tree: read if the folder has it for the same files and settings, else made and written."""
    spark, path = files.sparkSession, f"{folder.rstrip('/')}/{key(files, settings, name)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # there is none, or its writer was cut short
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def still_there(before: DataFrame, now: DataFrame) -> DataFrame:
    """Kept violations of units that are still in the tree, by (file, unit, line)."""
    keys = now.select("file", F.col("name").alias("unit_name"), F.col("line").cast("int").alias("line")).distinct()
    return before.join(keys, ["file", "unit_name", "line"], "left_semi").select(*before.columns)

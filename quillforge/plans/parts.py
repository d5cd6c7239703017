"""Results kept part by part: only parts whose rows have changed are made again.

A folder holds tables of results (`run-...`, each with the parts that one refresh made) and numbered
manifests: (part, fingerprint, run). A part's fingerprint is a sum of its rows' hashes, so it does not
depend on their order. A refresh compares the parts of the input with the last manifest, makes what is new or has
changed, writes it aside, and commits by renaming its manifest to the next number; a second writer of that
number fails and has changed nothing. Parts that the input no longer has leave the manifest, and runs that
no manifest names are deleted. The manifest is a table as large as there are parts; the driver sees none of it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_NUMBERED = re.compile(r"manifest-(\d+)$")


def fingerprints(rows: DataFrame, part: str) -> DataFrame:
    """(part, fingerprint) over all columns of the rows."""
    each = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(rows.columns)))
    two = F.xxhash64(F.lit(7), *(F.col(f"`{c}`") for c in sorted(rows.columns)))
    total = lambda x: F.sum(x.cast("decimal(38,0)")).cast("string")
    return rows.groupBy(F.col(part).alias("part")).agg(F.concat_ws(":", F.count("*").cast("string"), total(each), total(two)).alias("fingerprint"))


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.place = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.files.listStatus(self.place(self.path))] if self.files.exists(self.place(self.path)) else []

    def last(self) -> int:
        """The number of the last manifest, 0 without any."""
        return max((int(m[1]) for m in map(_NUMBERED.search, self.names()) if m), default=0)

    def manifest(self, number: int, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/manifest-{number}")

    def commit(self, manifest: DataFrame, number: int) -> None:
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        manifest.write.parquet(aside)
        target = self.place(f"{self.path}/manifest-{number}")
        if self.files.exists(target) or not self.files.rename(self.place(aside), target) or self.files.exists(self.place(f"{target}/{aside.rpartition('/')[2]}")):
            self.files.delete(self.place(aside), True)
            raise RuntimeError(f"another writer has committed {target}")

    def evict(self, number: int) -> None:
        """Delete earlier manifests, and runs that this one does not name."""
        used = {r.run for r in self.manifest(number, StructType().add("run", "string")).distinct().collect()}  # a refresh each
        for name in self.names():
            m = _NUMBERED.search(name)
            if (m and int(m[1]) < number) or (name.startswith("run-") and name not in used):
                self.files.delete(self.place(f"{self.path}/{name}"), True)

    def read(self, manifest: DataFrame, schema: StructType) -> DataFrame:
        """The results of all parts, with `run`."""
        held = manifest.select("part", "run")
        runs = [name for name in self.names() if name.startswith("run-")]
        if not runs:
            return self.spark.createDataFrame([], StructType([*schema, StructField("run", StringType())]))
        whole = self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}" for name in runs))
        named = whole.withColumn("run", F.regexp_extract("_metadata.file_path", "/(run-[0-9a-f]+)/", 1))
        return named.join(held, (named["part"].eqNullSafe(held["part"])) & (named["run"] == held["run"]), "left_semi")


def refreshed(folder: str, rows: DataFrame, part: str, make: Callable[[DataFrame], DataFrame], version: str = "1") -> tuple[DataFrame, DataFrame]:
    """(results, parts made now): make(rows of some parts) gives results that have the column `part`.

    version names what `make` does; with another one every part is made anew."""
    spark = rows.sparkSession
    kept = Folder(spark, folder)
    number, run = kept.last(), f"run-{uuid.uuid4().hex}"
    now = fingerprints(rows, part).withColumn("fingerprint", F.concat_ws("|", F.lit(version), "fingerprint"))
    schema = StructType([*now.schema, StructField("run", StringType())])
    before = kept.manifest(number, schema) if number else spark.createDataFrame([], schema)
    same = now["part"].eqNullSafe(before["part"]) & (now["fingerprint"] == before["fingerprint"])
    next_ = now.join(before, same, "left").select(now["part"], now["fingerprint"], F.coalesce(before["run"], F.lit(run)).alias("run"))
    aside = kept.path + f"/aside-{uuid.uuid4().hex}"
    next_.write.parquet(aside)
    planned = spark.read.schema(schema).parquet(aside)
    stale = planned.filter(F.col("run") == run).select(F.col("part").alias("_part"))
    made = make(rows.join(stale, rows[part].eqNullSafe(F.col("_part")), "left_semi"))
    made.write.parquet(f"{kept.path}/{run}")
    kept.commit(planned, number + 1)
    kept.files.delete(kept.place(aside), True)
    kept.evict(number + 1)
    manifest = kept.manifest(number + 1, schema)
    return kept.read(manifest, made.schema), manifest.filter(F.col("run") == run).select("part")

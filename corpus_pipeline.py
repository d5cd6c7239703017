"""A corpus pipeline of five stages over `documents`; each is written and read again by the next.

Language ID learns from the labels of its own rows, drops texts in none of their languages (without a
letter, or next to nothing like any profile) and sets the language of rows without one; MinHash
near-dedup keeps one document of each group (five-word shingles, 0.8); substring dedup cuts passages
of 50 words and more that an earlier document also has; the secret scan replaces secrets; packing
places what is left into sequences. No stage is expressible in SQL as a whole, so ORACLE_SQL is None
and tests hold every stage against brute force.

Cases: null and empty texts have no language and go; rows with a null id are kept by near-dedup and
come last where substring dedup orders documents; rows that repeat an id are one document to
near-dedup and rows of their own elsewhere; of equal documents the smallest id stays; very long texts
are taken whole; extra columns, whatever their names, pass through to packing; an empty table packs to
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillforge.llm import langid, neardup, packing, secrets, substrings
from quillforge.llm.common import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cut_texts(docs, 50)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scan", secret_scan), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

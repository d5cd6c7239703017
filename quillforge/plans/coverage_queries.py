"""Mention coverage: benchmark items define words, documents mention them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import profile, resolve, rules
from quillforge.plans.registry import dealt, query, table

WORDS_SQL = "list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda t: t <> '')"
DEFS_SQL = f"defs AS (SELECT DISTINCT 'item' || item_id AS file, unnest({WORDS_SQL}) AS name FROM benchmark), refs AS (SELECT DISTINCT unnest({WORDS_SQL}) AS ref FROM documents), many AS (SELECT name, count(*) AS files FROM defs GROUP BY name HAVING count(*) > 1)"
UNCOVERED_SQL = f"{DEFS_SQL}, unc AS (SELECT file, name FROM defs WHERE NOT (name IN (SELECT ref FROM refs) AND name NOT IN (SELECT name FROM many)))"
BY_FILE_SQL = f"{UNCOVERED_SQL}, byfile AS (SELECT file, count(*) AS definitions, count(*) - count(*) FILTER ((file, name) IN (SELECT (file, name) FROM unc)) AS covered FROM defs GROUP BY file), pct AS (SELECT file, definitions, covered, CAST(round(covered / definitions * 100) AS BIGINT) AS percent FROM byfile)"


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("file"), F.explode(T.words(F.col("text"))).alias("name")).distinct().withColumn("owner", F.lit(None).cast("string"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("ref")).distinct()


def unmentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.uncovered(definitions(spark, sf_dir), references(spark, sf_dir)).select("file", "name")


@query(f"WITH {UNCOVERED_SQL} SELECT file, name FROM unc")
def coverage_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmentioned(spark, sf_dir)


@query(f"WITH {BY_FILE_SQL} SELECT file, definitions, covered, percent FROM pct")
def coverage_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.coverage_by_file(definitions(spark, sf_dir), unmentioned(spark, sf_dir))


@query(f"WITH {BY_FILE_SQL} SELECT CAST(coalesce(round(sum(covered) / sum(definitions) * 100), 100) AS BIGINT) AS percent, coalesce(min(percent), 100) AS min_percent, CAST(coalesce(sum(definitions), 0) AS BIGINT) AS definitions, CAST(90 AS BIGINT) AS threshold, coalesce(round(sum(covered) / sum(definitions) * 100), 100) >= 90 AS passed FROM pct")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.gate(rules.overall_coverage(rules.coverage_by_file(definitions(spark, sf_dir), unmentioned(spark, sf_dir))), 90)


@query(f"WITH {DEFS_SQL} SELECT name, files FROM many")
def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.ambiguous(definitions(spark, sf_dir))


@query(f"WITH {DEFS_SQL}, own AS (SELECT name, min(file) AS file FROM defs GROUP BY name HAVING count(*) = 1), used AS (SELECT DISTINCT source AS test_file, CAST(doc_id AS VARCHAR) AS test_id, unnest({WORDS_SQL}) AS ref FROM documents) SELECT DISTINCT file, name, test_file, test_id FROM own JOIN used ON ref = name")
def covering_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    defs = definitions(spark, sf_dir)
    own = defs.join(resolve.ambiguous(defs).select("name"), "name", "left_anti").select(defs.columns)
    return resolve.covering_tests(own, document_uses(spark, sf_dir))


IDENT_SQL = "ident AS (SELECT file, name AS ident FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY length(name) DESC, name) AS k FROM defs) WHERE k = 1)"
WON_SQL = "own AS (SELECT d.name, d.file, i.ident FROM defs d JOIN many ON many.name = d.name JOIN ident i ON i.file = d.file JOIN refs ON refs.ref = i.ident), alone AS (SELECT name, ident, min(file) AS file FROM own GROUP BY name, ident HAVING count(*) = 1), won AS (SELECT name, min(file) AS file FROM alone GROUP BY name HAVING count(DISTINCT file) = 1)"


def identifiers(defs: DataFrame) -> DataFrame:
    """(file, ident): an item goes by its longest word, the first of equal ones."""
    return defs.groupBy("file").agg(F.min(F.struct((-F.length("name")).alias("n"), "name")).alias("x")).select("file", F.col("x.name").alias("ident"))


def document_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.select(F.col("source").alias("test_file"), F.col("doc_id").cast("string").alias("test_id"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("ref"))


@query(f"""WITH {DEFS_SQL}, {IDENT_SQL}, {WON_SQL}, used AS (SELECT DISTINCT source AS test_file, CAST(doc_id AS VARCHAR) AS test_id, unnest({WORDS_SQL}) AS name FROM documents),
near AS (SELECT test_id, test_file, u.name, min(d.file) AS file FROM used u JOIN defs d ON d.name = u.name JOIN ident i ON i.file = d.file WHERE EXISTS (SELECT 1 FROM used o WHERE o.test_id = u.test_id AND o.test_file = u.test_file AND o.name = i.ident) GROUP BY ALL),
lone AS (SELECT name, min(file) AS file, count(*) AS n FROM defs GROUP BY name)
SELECT coalesce(near.file, won.file, lone.file) AS file, u.name, u.test_file, u.test_id, CAST(CASE WHEN near.file IS NOT NULL THEN 2 WHEN n = 1 OR won.file IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS evidence
FROM used u JOIN lone ON lone.name = u.name LEFT JOIN won ON won.name = u.name LEFT JOIN near ON near.name = u.name AND near.test_id = u.test_id AND near.test_file = u.test_file""")
def covering_tests_all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every name, resolved to one item."""
    defs = definitions(spark, sf_dir)
    known = identifiers(defs)
    return resolve.resolved_uses(defs, document_uses(spark, sf_dir), known, resolve.disambiguate(defs, known, references(spark, sf_dir)))


@query(f"WITH {DEFS_SQL}, ident AS (SELECT file, name AS ident FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY length(name) DESC, name) AS k FROM defs) WHERE k = 1), own AS (SELECT d.name, d.file, i.ident FROM defs d JOIN many ON many.name = d.name JOIN ident i ON i.file = d.file JOIN refs ON refs.ref = i.ident), alone AS (SELECT name, ident, min(file) AS file FROM own GROUP BY name, ident HAVING count(*) = 1) SELECT name, min(file) AS file FROM alone GROUP BY name HAVING count(DISTINCT file) = 1")
def disambiguated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item goes by its longest word, the first of equal ones."""
    defs = definitions(spark, sf_dir)
    identifiers = defs.groupBy("file").agg(F.min(F.struct((-F.length("name")).alias("n"), "name")).alias("x")).select("file", F.col("x.name").alias("ident"))
    return resolve.disambiguate(defs, identifiers, references(spark, sf_dir))


@query(f"WITH {UNCOVERED_SQL}, f AS (SELECT file, count(*) AS definitions, count(*) FILTER ((file, name) IN (SELECT (file, name) FROM unc)) AS missing FROM defs GROUP BY file) SELECT file, CAST(100 - round((definitions - missing) / definitions * 100) AS BIGINT) AS inv_test_coverage FROM f")
def inverse_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_file = rules.coverage_by_file(definitions(spark, sf_dir), unmentioned(spark, sf_dir))
    return by_file.select("file", profile.inverse_coverage(F.col("percent")).alias("inv_test_coverage"))

"""Measures, thresholds, totals and near-duplicates over the document and order tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import dedup, profile, render, rules
from quillforge.plans import parts
from quillforge.plans.registry import dealt, query, table
from quillforge.sources import rejects
from quillforge.sources.scratch import materialise, remember, shared_dir

MEASURES = ["lines", "tokens", "chars", "distinct_words"]
LIMITS = {"lines": 20, "tokens": 700, "chars": 5000, "distinct_words": 400}

# The code points of Unicode white space.
WHITE = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
NORMAL_SQL = f"trim(regexp_replace(regexp_replace(translate(text, '{T.UPPER}', '{T.LOWER}'), '[0-9]+', 'N', 'g'), '{WHITE}', ' ', 'g'))"
TOKENS_SQL = f"list_filter(string_split({NORMAL_SQL}, ' '), lambda t: t <> '')"
LINES_SQL = "CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT)"
WIDE_SQL = f"SELECT doc_id, lang, source, {LINES_SQL} AS lines, CAST(len({TOKENS_SQL}) AS BIGINT) AS tokens, CAST(length(text) AS BIGINT) AS chars, CAST(len(list_distinct({TOKENS_SQL})) AS BIGINT) AS distinct_words FROM documents"
LONG_SQL = f"WITH wide AS ({WIDE_SQL}), m AS (UNPIVOT (SELECT doc_id, lang, source, lines, tokens, chars, distinct_words FROM wide) ON lines, tokens, chars, distinct_words INTO NAME metric VALUE value)"
LIMIT_SQL = "CASE metric " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in LIMITS.items()) + " END"


def measured(docs: DataFrame) -> DataFrame:
    tokens = T.tokens(T.normalize_code(F.col("text")))
    return docs.select("doc_id", "lang", "source", T.line_count(F.col("text")).alias("lines"), F.length("text").cast("long").alias("chars"), tokens.alias("_t")).select(
        "doc_id", "lang", "source", "lines", F.size("_t").cast("long").alias("tokens"), "chars", F.size(F.array_distinct("_t")).cast("long").alias("distinct_words")
    )


def unit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id"))


def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.to_long(unit_metrics(spark, sf_dir), ["doc_id", "lang", "source"], MEASURES)


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LIMITS.items()), "metric string, threshold bigint")


def percent_sql(by: str, source: str, value: str = "value") -> str:
    at = lambda p: f"list_sort(list({value}))[CAST(round((count(*) - 1) * {p} / 100.0) AS BIGINT) + 1] AS p{p}"
    return f"SELECT {by}, count(*) AS count, {', '.join(map(at, profile.PERCENTS))}, max({value}) AS max FROM {source} GROUP BY {by}"


@query(WIDE_SQL)
def doc_unit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_metrics(spark, sf_dir)


@query(f"{LONG_SQL} SELECT doc_id, lang, source, metric, value FROM m")
def doc_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_metrics(spark, sf_dir)


@query(f"{LONG_SQL} {percent_sql('metric', 'm')}")
def metric_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.percentiles(long_metrics(spark, sf_dir), ["metric"])


@query(f"{LONG_SQL} {percent_sql('lang, metric', 'm')}")
def metric_percentiles_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.percentiles(long_metrics(spark, sf_dir), ["lang", "metric"])


@query(percent_sql("l_returnflag", "lineitem", "l_quantity"))
def lineitem_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query(percent_sql("o_orderpriority", "orders", "o_totalprice"))
def order_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.percentiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


@query(f"{LONG_SQL} SELECT metric, value, doc_id, rank FROM (SELECT metric, value, doc_id, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, doc_id) AS INTEGER) AS rank FROM m) WHERE rank <= 10")
def top_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_n(long_metrics(spark, sf_dir), 10, ["doc_id"]).select("metric", "value", "doc_id", "rank")


@query("SELECT * FROM (SELECT o_orderstatus, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 10")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.top_n(table(spark, sf_dir, "orders"), 10, ["o_orderkey"], "o_orderstatus", "o_totalprice")
    return found.select("o_orderstatus", "o_orderkey", "o_totalprice", "rank")


VIOLATION_SQL = f"""{LONG_SQL}, v AS (SELECT *, CAST({LIMIT_SQL} AS BIGINT) AS threshold FROM m)
SELECT doc_id, source AS file, metric, value, threshold,
  'VIOLATION:' || metric || ':' || source || ':' || doc_id || ':' || lang || ': has ' || value || ' (over ' || threshold || ') Split it.' AS line
FROM v WHERE value > threshold"""


def doc_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.violations(long_metrics(spark, sf_dir), limits(spark), ["metric"])
    message = F.format_string("has %d (over %d)", "value", "threshold")
    line = rules.violation_line(F.col("metric"), F.col("source"), F.col("doc_id"), F.col("lang"), message, F.lit("Split it."))
    return found.select("doc_id", F.col("source").alias("file"), "metric", "value", "threshold", line.alias("line"))


@query(VIOLATION_SQL)
def threshold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_violations(spark, sf_dir)


@query(VIOLATION_SQL + " AND source IN ('src0', 'src1')")
def focus_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("src0",), ("src1",)], "file string")
    return rules.focus(doc_violations(spark, sf_dir), files).select("doc_id", "file", "metric", "value", "threshold", "line")


@query("""SELECT l_orderkey, l_linenumber, metric, CAST(value AS BIGINT) AS value, CAST(threshold AS BIGINT) AS threshold FROM (
  SELECT l_orderkey, l_linenumber, l_returnflag, 'positional_args' AS metric, CAST(l_quantity AS BIGINT) AS value, 45 AS threshold FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, 'calls_per_function', CAST(floor(l_extendedprice) AS BIGINT), 50000 FROM lineitem)
WHERE value > threshold AND NOT (metric = 'positional_args' AND l_returnflag = 'R')""")
def method_exempt_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("inside_class"), F.col("l_quantity").cast("long").alias("positional_args"), F.floor("l_extendedprice").alias("calls_per_function"))
    long = profile.to_long(items, ["l_orderkey", "l_linenumber", "inside_class"], ["positional_args", "calls_per_function"])
    held = spark.createDataFrame([("positional_args", 45), ("calls_per_function", 50000)], "metric string, threshold bigint")
    return rules.violations(rules.exempt_methods(long), held, ["metric"]).select("l_orderkey", "l_linenumber", "metric", "value", "threshold")


@query(f"""WITH wide AS ({WIDE_SQL})
SELECT 'files' AS metric, count(*) AS value FROM wide UNION ALL SELECT 'units', CAST(sum(lines) AS BIGINT) FROM wide
UNION ALL SELECT 'statements', CAST(sum(tokens) AS BIGINT) FROM wide UNION ALL SELECT 'graph_nodes', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)
UNION ALL SELECT 'graph_edges', count(*) FROM customer""")
def global_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = unit_metrics(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("lines").alias("units"), F.sum("tokens").alias("statements"))
    nodes = table(spark, sf_dir, "customer").select(F.lit(1).alias("e")).unionAll(table(spark, sf_dir, "nation").select(F.lit(0).alias("e"))).agg(F.count("*").alias("graph_nodes"), F.sum("e").cast("long").alias("graph_edges"))
    long = lambda df: df.unpivot([], df.columns, "metric", "value")
    return long(docs).unionByName(long(nodes))


SHRINK_PART = "SELECT 'rows' AS metric, count(*) AS value FROM {t} UNION ALL SELECT 'orders', count(DISTINCT l_orderkey) FROM {t} UNION ALL SELECT 'parts', count(DISTINCT l_partkey) FROM {t} UNION ALL SELECT 'suppliers', count(DISTINCT l_suppkey) FROM {t}"


@query(f"""WITH old AS (SELECT * FROM lineitem WHERE l_linenumber <= 3), b AS ({SHRINK_PART.format(t="old")}), c AS ({SHRINK_PART.format(t="lineitem")})
SELECT metric, value, "limit", is_target FROM (SELECT c.metric, c.value, CASE WHEN c.metric = 'rows' THEN CAST(1000 AS BIGINT) ELSE b.value END AS "limit", c.metric = 'rows' AS is_target FROM c JOIN b ON c.metric = b.metric) WHERE value > "limit" """)
def shrink_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")

    def totals(rows: DataFrame) -> DataFrame:
        each = rows.agg(F.count("*").alias("rows"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))
        return each.unpivot([], each.columns, "metric", "value")

    return rules.shrink(totals(items), totals(items.filter("l_linenumber <= 3")), "rows", 1000)


@query(f"{LONG_SQL} SELECT lang, metric, max(value) AS threshold FROM m GROUP BY lang, metric")
def mimic_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.maxima(long_metrics(spark, sf_dir), ["lang", "metric"])


@query(f"{LONG_SQL}, p AS ({percent_sql('metric', 'm')}) SELECT printf('%-28s %5d %5d %5d %5d %5d %5d', metric, count, p50, p90, p95, p99, max) AS line FROM p")
def stats_table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.percentiles(long_metrics(spark, sf_dir), ["metric"]).select(render.stats_line().alias("line"))


@query(f"SELECT doc_id, md5({NORMAL_SQL}) AS normal_md5 FROM documents")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_code(F.col("text"))).alias("normal_md5"))


def shingles_sql(k: int) -> str:
    return f"t AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM t))"


@query(f"WITH {shingles_sql(3)} SELECT doc_id, count(*) AS shingles FROM s GROUP BY doc_id")
def doc_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.shingle_rows(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("shingles"))


#: Words of a shingle, hashes, bands and the least similarity of near-duplicate documents.
WORDS, HASHES, BANDS, ALIKE = 5, 100, 20, 0.8
_LEAST = ", ".join(f"coalesce(min((x * {a} + {b}) % {dedup.PRIME}), {dedup.PRIME})" for a, b in dedup.coefficients(HASHES))
SIGNED_SQL = f"""{shingles_sql(WORDS)}, x AS (SELECT d.doc_id, ('0x' || substr(md5(shingle), 1, 15))::BIGINT % {dedup.PRIME} AS x FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id),
sig AS (SELECT doc_id, [{_LEAST}] AS g FROM x GROUP BY doc_id)"""
PAIRS_SQL = f"""{SIGNED_SQL}, cls AS (SELECT min(doc_id) AS doc_id, g FROM sig GROUP BY g),
rows AS (SELECT doc_id, b, md5(array_to_string(g[b * {HASHES // BANDS} + 1:(b + 1) * {HASHES // BANDS}], ':')) AS k FROM cls, range({BANDS}) r(b)),
cand AS (SELECT x.doc_id AS id1, y.doc_id AS id2 FROM rows x JOIN rows y ON x.b = y.b AND x.k = y.k AND x.doc_id < y.doc_id
UNION SELECT cls.doc_id, sig.doc_id FROM cls JOIN sig ON sig.g = cls.g AND cls.doc_id < sig.doc_id),
pairs AS (SELECT id1, id2, similarity FROM (SELECT id1, id2, len(list_filter(list_zip(a.g, c.g), lambda p: p[1] = p[2])) / {HASHES}.0 AS similarity FROM cand JOIN sig a ON a.doc_id = id1 JOIN sig c ON c.doc_id = id2) WHERE similarity >= {ALIKE})"""


def doc_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.signatures(dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", WORDS, HASHES)


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = materialise(doc_signatures(spark, sf_dir), "signatures")
    return dedup.alike_pairs(signed, "doc_id", BANDS, ALIKE)


@query(f"WITH {SIGNED_SQL} SELECT doc_id, array_to_string(g, ',') AS signature FROM sig")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_signatures(spark, sf_dir).select("doc_id", F.array_join("signature", ",").alias("signature"))


@query(f"WITH {PAIRS_SQL} SELECT id1, id2 FROM cand")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.candidates(materialise(doc_signatures(spark, sf_dir), "signatures"), "doc_id", BANDS, exact=True)


@query(f"""WITH {shingles_sql(WORDS)}, nxt AS (SELECT d.doc_id, d.doc_id + 1 AS other FROM documents d JOIN documents o ON o.doc_id = d.doc_id + 1), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT p.doc_id, count(*) AS c FROM nxt p JOIN s a ON a.doc_id = p.doc_id JOIN s b ON b.doc_id = p.other AND b.shingle = a.shingle GROUP BY p.doc_id)
SELECT p.doc_id AS id1, p.other AS id2, coalesce(c, 0) AS both, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 0.0 ELSE coalesce(c, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(c, 0)) END AS jaccard
FROM nxt p LEFT JOIN n x ON x.doc_id = p.doc_id LEFT JOIN n y ON y.doc_id = p.other LEFT JOIN both_have h ON h.doc_id = p.doc_id""")
def shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact similarity of the shingle sets of each document and the next one."""
    docs = table(spark, sf_dir, "documents")
    held = dedup.shingle_sets(docs, "doc_id", "text", WORDS)
    pairs = held.alias("a").join(held.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t")), "doc_id")
    both = F.size(F.array_intersect("s", "t")).cast("long")
    whole = F.size("s") + F.size("t") - both
    return pairs.select(F.col("doc_id").alias("id1"), (F.col("doc_id") + 1).alias("id2"), both.alias("both"), F.when(whole == 0, 0.0).otherwise(both / whole).alias("jaccard"))


@query(f"WITH {PAIRS_SQL} SELECT id1, id2, CAST(similarity AS DOUBLE) AS similarity FROM pairs")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pairs(spark, sf_dir)


CLUSTER_SQL = f"{PAIRS_SQL}, both_ways AS (SELECT id1 AS a, id2 AS b FROM pairs UNION SELECT id2, id1 FROM pairs), walk(id, other) AS (SELECT a, a FROM both_ways UNION SELECT w.id, e.b FROM walk w JOIN both_ways e ON w.other = e.a), member AS (SELECT id, min(other) AS cluster_id FROM walk GROUP BY id)"


@query(f"WITH RECURSIVE {CLUSTER_SQL} SELECT id, cluster_id FROM member")
def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = materialise(doc_signatures(spark, sf_dir), "signatures")
    return dedup.clusters(dedup.alike_links(signed, "doc_id", BANDS, ALIKE))


@query(f"WITH RECURSIVE {CLUSTER_SQL} SELECT cluster_id, count(DISTINCT id) AS size, (SELECT round(avg(similarity), 9) FROM pairs p JOIN member q ON q.id = p.id1 WHERE q.cluster_id = m.cluster_id) AS avg_similarity FROM member m GROUP BY cluster_id")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = materialise(doc_pairs(spark, sf_dir), "pairs")
    return dedup.cluster_summary(pairs, dedup.clusters(pairs)).withColumn("avg_similarity", F.round("avg_similarity", 9))


@query("SELECT md5(text) AS text_md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


FINGERPRINT_BITS = "('0x' || substr(md5(doc_id || ':' || n_chars || ':' || md5(text)), 1, 15))::BIGINT"


@query(f"SELECT CAST(sum({FINGERPRINT_BITS}::HUGEINT) AS VARCHAR) AS fingerprint, count(*) AS files FROM documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of all inputs that does not depend on their order, so it is summed before the shuffle."""
    each = T.md5_prefix(F.concat_ws(":", "doc_id", "n_chars", F.md5("text")))
    return table(spark, sf_dir, "documents").agg(F.sum(each.cast("decimal(38,0)")).cast("string").alias("fingerprint"), F.count("*").alias("files"))


_FNV_KEY = "concat_ws(':', doc_id, lang, source, n_chars, md5(text))"


@query(f"SELECT doc_id, lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(regexp_extract_all(hex(encode({_FNV_KEY})), '..'), lambda p: ('0x' || p)::UBIGINT)), lambda h, b: (xor(h, b)::UHUGEINT * 1099511628211 % 18446744073709551616)::UBIGINT))), 16, '0') AS fnv FROM documents")
def document_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of what a document is known by; the text itself goes in as its MD5."""
    key = F.concat_ws(":", "doc_id", "lang", "source", "n_chars", F.md5("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.fnv1a64(key).alias("fnv"))


def page_rules() -> dict:
    """What a page must have; the first that is broken is the reason."""
    balanced = lambda tag: F.regexp_count("html", F.lit(f"<{tag}>")) == F.regexp_count("html", F.lit(f"</{tag}>"))
    return {"no text": F.length("html") > 0, "no address": F.col("url").rlike("^https?://[^/]+/"), "cut short": F.col("html").endswith("</html>"), "open bold": balanced("b"), "open paragraph": balanced("p")}


_REASON_SQL = """CASE WHEN coalesce(length(html), 0) = 0 THEN 'no text' WHEN url IS NULL OR NOT regexp_matches(url, '^https?://[^/]+/') THEN 'no address' WHEN NOT ends_with(html, '</html>') THEN 'cut short'
WHEN len(regexp_extract_all(html, '<b>')) <> len(regexp_extract_all(html, '</b>')) THEN 'open bold' WHEN len(regexp_extract_all(html, '<p>')) <> len(regexp_extract_all(html, '</p>')) THEN 'open paragraph' END"""


@query(f"WITH r AS (SELECT page_id, md5(html) AS html_md5, {_REASON_SQL} AS reason FROM pages) SELECT page_id, html_md5, reason FROM r")
def page_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that keep all rules (without a reason), and those that do not with the first that they break."""
    found = rejects.told_apart(table(spark, sf_dir, "pages"), page_rules())
    return found.good.withColumn("reason", F.lit(None).cast("string")).unionByName(found.rejects).select("page_id", F.md5("html").alias("html_md5"), "reason")


@query("""WITH r AS (SELECT CASE WHEN NOT coalesce(json_valid(props) AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT'), FALSE) THEN 'no number k' WHEN (props ->> '$.k')::BIGINT > 94 THEN 'k over 94' WHEN event_type = 'error' AND value > 90 THEN 'large error' ELSE 'good' END AS name FROM events)
SELECT w.name, count(r.name) AS rows FROM (VALUES ('good'), ('no number k'), ('k over 94'), ('large error')) w(name) LEFT JOIN r ON r.name = w.name GROUP BY w.name""")
def event_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events keep the rules on their properties and how many break which, counted while they are told apart."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    rules_ = {"no number k": k.isNotNull(), "k over 94": k <= 94, "large error": (F.col("event_type") != "error") | (F.col("value") <= 90)}
    found = rejects.told_apart(table(spark, sf_dir, "events"), rules_)
    return spark.createDataFrame(list(found.counts.items()), "name string, rows long")


def _kept_folder(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    remember(folder, spark)
    return folder


def _source_totals(docs: DataFrame) -> DataFrame:
    words = F.size(T.words(F.col("text"))).cast("long")
    return docs.groupBy(F.col("source").alias("part")).agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"), F.sum(words).alias("words"))


@query("WITH w AS (SELECT source, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda t: t <> '')) AS words FROM documents) SELECT source, count(*) AS docs, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(words) AS BIGINT) AS words, source = (SELECT min(source) FROM documents) AS made_again FROM w GROUP BY source")
def source_totals_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, kept for a table whose first source was another, then brought up to date: one part is made again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    folder = _kept_folder(spark)
    first = docs.agg(F.min("source")).first()[0]
    parts.refreshed(folder, docs.withColumn("text", F.when(F.col("source") == first, F.lit("other")).otherwise(F.col("text"))), "source", _source_totals)
    found, again = parts.refreshed(folder, docs, "source", _source_totals)
    flags = again.select(F.col("part"), F.lit(True).alias("made_again"))
    return found.join(flags, "part", "left").select(F.col("part").alias("source"), "docs", "chars", "words", F.coalesce("made_again", F.lit(False)).alias("made_again"))


@query(f"{LONG_SQL} {percent_sql('metric', 'm')}")
def percentiles_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of all documents from the distributions kept of each source."""

    def distributions(docs: DataFrame) -> DataFrame:
        return profile.counts(profile.to_long(measured(docs), ["doc_id", "lang", "source"], MEASURES), ["source", "metric"]).withColumnRenamed("source", "part")

    found, _ = parts.refreshed(_kept_folder(spark), table(spark, sf_dir, "documents"), "source", distributions)
    return profile.percentiles_of_counts(profile.merged(found, ["metric"]), ["metric"])

"""Reports and resolutions over the given tables: lines, status, paths, imports and graph metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import communities, dedup, graph, profile, render, resolve, rules
from quillforge.plans import coverage_queries as cov
from quillforge.plans import graph_queries as gq
from quillforge.plans import text_queries as tq
from quillforge.plans.registry import query, table
from quillforge.sources.scratch import materialise

# Places of a made-up source tree, one for each document: what its id is left over picks the parts.
PLACES = ("src", "tests", "lib", "node_modules", "env", "tha")
STEMS = ("main", "test_x", "x_test", "mod", "conftest", "__init__", "1 bad")


def _pick(values: tuple[str, ...], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], key: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{key} % {len(values)} + 1]"


PATH_SQL = f"{_pick_sql(PLACES, 'doc_id')} || '/' || lang || '/' || source || '/' || {_pick_sql(STEMS, 'doc_id')} || {_pick_sql(('.py', '.rs'), 'doc_id')}"


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path): documents as files of a tree."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.select("doc_id", F.concat(F.concat_ws("/", _pick(PLACES, "doc_id"), "lang", "source", _pick(STEMS, "doc_id")), _pick((".py", ".rs"), "doc_id")).alias("path"))


@query(f"""WITH p AS (SELECT doc_id, {PATH_SQL} AS path FROM documents), d AS (SELECT *, string_split(path, '/') AS parts FROM p),
s AS (SELECT *, parts[1:len(parts) - 1] AS dirs, parts[len(parts)] AS name, regexp_replace(parts[len(parts)], '(.)\\.[^.]*$', '\\1') AS stem FROM d),
m AS (SELECT *, CASE WHEN dirs[1] IN ('src', 'tests') THEN dirs[2:] ELSE dirs END AS near, CASE WHEN dirs[1] = 'src' THEN dirs[2:] ELSE dirs END AS inner_dirs, list_has_any(parts, ['tests', 'test']) AS in_tests FROM s),
r AS (SELECT *, array_to_string(CASE WHEN stem = 'mod' AND len(near) > 0 THEN near ELSE list_append(near, stem) END, '.') AS rust_module FROM m)
SELECT doc_id, path, rust_module, array_to_string(inner_dirs[1:2], '/') AS prefix,
  coalesce(regexp_matches(name, '^test_.*\\.py$') OR (ends_with(name, '_test.py') AND length(name) > 8) OR name = 'conftest.py' OR in_tests, FALSE) AS test_py,
  ends_with(path, '.rs') AND (ends_with(stem, '_test') OR starts_with(stem, 'test_') OR ends_with(stem, '_integration') OR in_tests) AS test_rs,
  list_has_any(dirs, ['__pycache__', 'node_modules', '.venv', 'venv', 'env']) OR len(list_filter(dirs, lambda x: starts_with(x, 'th'))) > 0 AS ignored,
  regexp_matches(stem, '^[A-Za-z_][A-Za-z0-9_]*$') AS identifier,
  regexp_matches(rust_module, '(^|\\.)tests(\\.|$)|(^|\\.)bin\\.') OR rust_module = 'bin' OR regexp_extract(rust_module, '[^.]*$') IN ('main', 'lib', 'build', '__main__', '__init__', 'tests', 'conftest', 'setup') OR regexp_matches(regexp_extract(rust_module, '[^.]*$'), '^test_|_test$|_integration|_bench') AS entry,
  CASE WHEN length(path) <= 18 THEN path ELSE '...' || right(path, 15) END AS short, CASE WHEN regexp_matches(path, '^[A-Za-z0-9_./:=,][A-Za-z0-9_./:=,-]*$') THEN path ELSE '''' || path || '''' END AS quoted
FROM r""")
def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a path says: module, prefix, test or not, left out or not, entry point or not."""
    p = F.col("path")
    rust = T.module_name_rs(p)
    return document_files(spark, sf_dir).select(
        "doc_id", "path", rust.alias("rust_module"), T.path_prefix(p, 2).alias("prefix"), T.is_test_path(p).alias("test_py"), T.is_test_path_rs(p).alias("test_rs"), T.ignored(p, ["th"]).alias("ignored"),
        T.is_identifier(T.stem(p)).alias("identifier"), T.is_entry_point(rust).alias("entry"), T.truncate_left(p, 18).alias("short"), T.shell_quoted(p).alias("quoted"),
    )


@query(f"""WITH v AS ({tq.VIOLATION_SQL}), o AS (SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), c AS (SELECT count(*) AS n FROM (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1))
SELECT (SELECT count(*) FROM v) AS violations, (SELECT n FROM o) AS orphans, (SELECT n FROM c) AS duplicate_clusters, (SELECT count(*) FROM v) + (SELECT n FROM o) + (SELECT n FROM c) > 0 AS failed, CAST((SELECT count(*) FROM v) + (SELECT n FROM o) + (SELECT n FROM c) > 0 AS INTEGER) AS exit_code""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a check of all documents ends: limits, documents that no label points at, and groups of copies."""
    return rules.status(tq.doc_violations(spark, sf_dir), gq.entity_graph_orphans(spark, sf_dir), tq.exact_dup_groups(spark, sf_dir))


@query(f"WITH {cov.BY_FILE_SQL} SELECT file, definitions, covered, percent FROM pct WHERE percent < 90 ORDER BY file")
def failing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items covered by less than the gate asks for, by name."""
    rows = rules.coverage_by_file(cov.definitions(spark, sf_dir), cov.unmentioned(spark, sf_dir))
    return rows.filter("percent < 90").orderBy("file")


@query(f"""WITH {tq.PAIRS_SQL}, d AS (SELECT doc_id, source, {tq.LINES_SQL} AS n FROM documents)
SELECT id1, id2, printf('%.3f  %s:%d-%d  %s:%d-%d', similarity::DOUBLE, a.source, 1, a.n, b.source, 1, b.n) AS line FROM pairs JOIN d a ON a.doc_id = id1 JOIN d b ON b.doc_id = id2""")
def dry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each pair of near-duplicate documents, alike ones first, then by id."""
    docs = table(spark, sf_dir, "documents")
    side = lambda k: docs.select(F.col("doc_id").alias(f"id{k}"), F.col("source").alias(f"file{k}"), F.lit(1).alias(f"start{k}"), T.line_count(F.col("text")).alias(f"end{k}"))
    pairs = tq.doc_pairs(spark, sf_dir).join(side(1), "id1").join(side(2), "id2")
    return pairs.orderBy(F.desc("similarity"), "id1", "id2").select("id1", "id2", render.dry_line().alias("line"))


@query(f"WITH {tq.PAIRS_SQL} SELECT id1, id2, CAST(similarity AS DOUBLE) AS similarity FROM pairs WHERE id1 IN (SELECT doc_id FROM documents WHERE source = 'src0') OR id2 IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def focus_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near-duplicates that touch a source in the focus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"))
    return dedup.touching(materialise(tq.doc_pairs(spark, sf_dir), "pairs"), docs, "doc_id", spark.createDataFrame([("src0",)], "path string"))


@query(f"{tq.LONG_SQL} SELECT 'STAT:' || metric || ':' || value || ':' || source || ':' || doc_id || ':' || lang AS line FROM m")
def stat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each measure of each document."""
    rows = tq.long_metrics(spark, sf_dir)
    return rows.select("metric", "value", F.col("source").alias("file"), F.col("doc_id").alias("line"), F.col("lang").alias("name")).select(render.stat_line().alias("line"))


@query(f"WITH w AS ({tq.WIDE_SQL}) SELECT printf('Analyzed: %d files, %d code_units, %d statements, %d graph_nodes, %d graph_edges', count(*), sum(lines)::BIGINT, sum(tokens)::BIGINT, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation), (SELECT count(*) FROM customer)) AS line FROM w")
def summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tq.global_metrics(spark, sf_dir).replace({"units": "code_units"}, subset="metric")
    return found.groupBy().pivot("metric", ["files", "code_units", "statements", "graph_nodes", "graph_edges"]).agg(F.first("value")).select(render.summary_line().alias("line"))


_WIDE = {"statements": "tokens", "lines": "lines"}
_LEFT_SQL = lambda c, n: f"{c} || repeat(' ', greatest({n} - length({c}), 0))"
_RIGHT_SQL = lambda c, n: f"repeat(' ', greatest({n} - length({c}), 0)) || {c}"


@query(
    f"WITH w AS ({tq.WIDE_SQL}) SELECT doc_id, concat_ws(' ', {_LEFT_SQL('source', 40)}, {_LEFT_SQL('doc_id::VARCHAR', 20)}, {_LEFT_SQL('lang', 10)}, "
    + ", ".join(_RIGHT_SQL(f"{_WIDE[c]}::VARCHAR" if c in _WIDE else "'-'", n) for c, n in render.WIDE_NUMBERS)
    + ") AS line FROM w"
)
def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A padded line of all measures for each document; what documents do not have is a dash."""
    rows = tq.unit_metrics(spark, sf_dir).select("doc_id", F.col("source").alias("file"), F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("kind"), *(F.col(_WIDE[c]).alias(c) if c in _WIDE else F.lit(None).cast("long").alias(c) for c, _ in render.WIDE_NUMBERS))
    return rows.select("doc_id", render.wide_line().alias("line"))


# documents import from the item that their id, left over by the number of items, points at
_ITEM_SQL = "'item' || (doc_id % (SELECT count(*) FROM benchmark))"


def _item(spark: SparkSession, sf_dir: str) -> Column:
    return F.concat(F.lit("item"), F.pmod(F.col("doc_id"), F.lit(table(spark, sf_dir, "benchmark").count())).cast("string"))


@query(f"""WITH {cov.UNCOVERED_SQL}, bound AS (SELECT DISTINCT {_ITEM_SQL} AS module, unnest({cov.WORDS_SQL}) AS name FROM documents)
SELECT file, name FROM unc WHERE (file, name) NOT IN (SELECT (module, name) FROM bound)""")
def uncovered_by_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of items that no document mentions, nor imports from the item itself."""
    docs = table(spark, sf_dir, "documents")
    bindings = docs.select(_item(spark, sf_dir).alias("module"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("name"))
    defs = cov.definitions(spark, sf_dir)
    suffixes = defs.select("file", F.concat(F.lit("pkg."), "file").alias("suffix")).distinct()
    return resolve.uncovered(defs, cov.references(spark, sf_dir), bindings, suffixes).select("file", "name")


@query(f"""WITH {cov.DEFS_SQL}, used AS (SELECT DISTINCT source, unnest({cov.WORDS_SQL}) AS name FROM documents), edge AS (SELECT DISTINCT source, {_ITEM_SQL} AS file FROM documents),
met AS (SELECT DISTINCT d.name, d.file FROM defs d JOIN many ON many.name = d.name JOIN used ON used.name = d.name JOIN edge ON edge.source = used.source AND edge.file = d.file)
SELECT name, min(file) AS file FROM met GROUP BY name HAVING count(*) = 1""")
def names_by_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of several items that go to the one item which a source that uses them imports."""
    docs = table(spark, sf_dir, "documents")
    defs = cov.definitions(spark, sf_dir)
    edges = docs.select(F.col("source").alias("src"), _item(spark, sf_dir).alias("dst")).distinct()
    places = defs.select("file", F.col("file").alias("module")).distinct().unionByName(docs.select(F.col("source").alias("file"), F.col("source").alias("module")).distinct())
    return resolve.chosen_by_import(defs, cov.document_uses(spark, sf_dir).select("test_file", "ref"), places, edges)


@query(f"""WITH {gq.MODULE_SQL}, m AS (SELECT DISTINCT module, bare FROM mods), imp AS (SELECT DISTINCT a.module, regexp_replace(a.module, '\\.[^.]*$', '') AS parent, b.bare AS import, CASE WHEN a.page_id % 2 = 0 THEN 'mod' ELSE 'use' END AS kind FROM mods a JOIN mods b ON b.page_id = a.page_id + 1),
u AS (SELECT module, import, CASE WHEN kind = 'mod' AND parent <> '' THEN parent || '.' || import ELSE import END AS full FROM imp), exact AS (SELECT u.module, u.import, m.module AS dst FROM u JOIN m ON m.module = u.full),
loose AS (SELECT u.module, u.import, m.module AS dst FROM u JOIN m ON m.bare = u.import WHERE (u.module, u.import) NOT IN (SELECT (module, import) FROM exact))
SELECT DISTINCT module AS src, dst FROM (FROM exact UNION ALL FROM loose) WHERE module <> dst""")
def rust_use_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages name the next page, every other one as a child of its own parent."""
    pages = gq.page_modules(spark, sf_dir)
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("bare").alias("import"))
    kind = F.when(F.col("page_id") % 2 == 0, "mod").otherwise("use")
    uses = pages.select("page_id", "module", F.regexp_replace("module", "\\.[^.]*$", "").alias("parent"), kind.alias("kind")).join(after, "page_id").select("module", "parent", "import", "kind").distinct()
    return resolve.resolve_rust(uses, pages.select("module", "bare").distinct())


@query(f"WITH {gq.TRADE_SQL} SELECT DISTINCT dst AS node, src AS importer FROM edges JOIN customer ON src = 'c:' || c_custkey WHERE c_mktsegment = 'BUILDING'")
def segment_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of one market segment that buy from each supplier."""
    edges, _ = gq.trade_graph(spark, sf_dir)
    tests = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.importers(edges, tests)


METRIC_SQL = f"""{gq.SCC_SQL}, reach AS (SELECT n.node, count(DISTINCT w.dst) FILTER (w.dst <> n.node) AS reachable FROM nodes n LEFT JOIN walk w ON w.node = n.node GROUP BY n.node),
wide AS (SELECT n.node, (SELECT count(*) FROM edges WHERE dst = n.node) AS fan_in, (SELECT count(*) FROM edges WHERE src = n.node) AS fan_out, scc.size AS cycle_size, reachable - (SELECT count(*) FROM edges WHERE src = n.node) AS indirect_dependencies, scc.scc FROM nodes n JOIN scc ON scc.node = n.node JOIN reach ON reach.node = n.node),
long AS (UNPIVOT wide ON fan_in, fan_out, cycle_size, indirect_dependencies INTO NAME metric VALUE value)"""


def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, scc, metric, value) of the graph of event types."""
    nodes, edges = gq.event_graph(spark, sf_dir)
    edges = materialise(edges, "edges")
    found = graph.degrees(nodes, edges).join(graph.strong_components(nodes, edges), "node").join(graph.reach(nodes, edges), "node")
    return profile.to_long(found.withColumnsRenamed({"size": "cycle_size", "indirect": "indirect_dependencies"}), ["node", "scc"], ["fan_in", "fan_out", "cycle_size", "indirect_dependencies"])


@query(f"WITH RECURSIVE {METRIC_SQL} SELECT node, metric, value FROM long")
def event_graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_metrics(spark, sf_dir).select("node", "metric", "value")


@query(f"WITH RECURSIVE {METRIC_SQL}, held AS (SELECT * FROM (VALUES ('fan_in', 3), ('fan_out', 3), ('cycle_size', 1), ('indirect_dependencies', 0)) h(metric, threshold)) SELECT node, long.metric, value, CAST(threshold AS BIGINT) AS threshold FROM long JOIN held ON held.metric = long.metric WHERE value > threshold AND (long.metric <> 'cycle_size' OR node = scc)")
def event_graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types over limits of the graph; a cycle counts once, at its least node."""
    held = spark.createDataFrame([("fan_in", 3), ("fan_out", 3), ("cycle_size", 1), ("indirect_dependencies", 0)], "metric string, threshold bigint")
    over = rules.violations(event_metrics(spark, sf_dir), held, ["metric"])
    return over.filter("metric <> 'cycle_size' or node = scc").select("node", "metric", "value", "threshold")


@query(f"""WITH {gq.ENTITY_SQL}, e2 AS (SELECT DISTINCT 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
every AS (SELECT 'key:' || src AS src, 'key:' || dst AS dst FROM edges UNION ALL SELECT 'buy:' || src, 'buy:' || dst FROM e2), n AS (SELECT 'key:' || node AS node FROM nodes UNION ALL SELECT DISTINCT 'buy:' || unnest([src, dst]) FROM e2),
i AS (SELECT dst AS node, count(*) AS n FROM every GROUP BY 1), o AS (SELECT src AS node, count(*) AS n FROM every GROUP BY 1)
SELECT n.node, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM n LEFT JOIN i ON i.node = n.node LEFT JOIN o ON o.node = n.node""")
def merged_graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys and purchases as one graph, whose nodes are named by where they come from."""
    buys, _ = gq.trade_graph(spark, sf_dir)
    one = graph.with_prefix(*gq.entity_graph(spark, sf_dir), "key")
    two = graph.with_prefix(buys.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), buys, "buy")
    return graph.degrees(one[0].unionByName(two[0]), one[1].unionByName(two[1]))


@query()
def trade_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of customers and suppliers that trade, larger ones first. No SQL: the method is iterative, and
    tests hold it against planted groups, plain modularity and connectivity."""
    edges, _ = gq.trade_graph(spark, sf_dir)
    edges = materialise(edges, "edges")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return communities.ordered(communities.communities(nodes, edges))

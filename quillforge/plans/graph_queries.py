"""Graphs made of foreign keys, event sequences and page addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import graph, ranges, render, resolve
from quillforge.plans.registry import query, table

# customers and suppliers point at their nation, a nation at its region
ENTITY_SQL = """nodes AS (SELECT 'c:' || c_custkey AS node FROM customer UNION ALL SELECT 's:' || s_suppkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey FROM nation UNION ALL SELECT 'r:' || r_regionkey FROM region),
edges AS (SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation)"""
DEGREE_SQL = "deg AS (SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS fan_in, (SELECT count(*) FROM edges WHERE src = node) AS fan_out FROM nodes)"


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def entity_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    nodes = c.select(_key("c", "c_custkey").alias("node")).unionAll(s.select(_key("s", "s_suppkey"))).unionAll(n.select(_key("n", "n_nationkey"))).unionAll(r.select(_key("r", "r_regionkey")))
    edges = c.select(_key("c", "c_custkey").alias("src"), _key("n", "c_nationkey").alias("dst")).unionAll(s.select(_key("s", "s_suppkey"), _key("n", "s_nationkey"))).unionAll(n.select(_key("n", "n_nationkey"), _key("r", "n_regionkey")))
    return nodes, edges


def event_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = graph.clean_edges(events.select(F.col("event_type").alias("src"), after.alias("dst")).filter("dst is not null"))
    return events.select(F.col("event_type").alias("node")).distinct(), edges


EVENT_SQL = "edges AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst), nodes AS (SELECT DISTINCT event_type AS node FROM events)"
WALK_SQL = "walk(node, dst) AS (SELECT src, dst FROM edges UNION SELECT w.node, e.dst FROM walk w JOIN edges e ON w.dst = e.src)"
SCC_SQL = f"{EVENT_SQL}, {WALK_SQL}, same AS (SELECT n.node, m.node AS other FROM nodes n JOIN nodes m ON n.node = m.node OR (EXISTS (SELECT 1 FROM walk w WHERE w.node = n.node AND w.dst = m.node) AND EXISTS (SELECT 1 FROM walk w WHERE w.node = m.node AND w.dst = n.node))), scc AS (SELECT node, min(other) AS scc, count(*) AS size FROM same GROUP BY node)"


@query(f"WITH {ENTITY_SQL}, i AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY dst), o AS (SELECT src AS node, count(*) AS n FROM edges GROUP BY src) SELECT nodes.node, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM nodes LEFT JOIN i ON i.node = nodes.node LEFT JOIN o ON o.node = nodes.node")
def entity_graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*entity_graph(spark, sf_dir))


@query("SELECT 'd:' || doc_id AS node FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def entity_graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label points at."""
    nodes = table(spark, sf_dir, "documents").select(_key("d", "doc_id").alias("node"))
    edges = table(spark, sf_dir, "labels").select(_key("l", "doc_id").alias("src"), _key("d", "doc_id").alias("dst")).distinct()
    return graph.orphans(graph.degrees(nodes, edges), T.is_entry_point(F.col("node"))).select("node")


@query(f"WITH RECURSIVE {ENTITY_SQL}, far(node, dst, dist) AS (SELECT src, dst, CAST(1 AS BIGINT) FROM edges UNION ALL SELECT f.node, e.dst, f.dist + 1 FROM far f JOIN edges e ON f.dst = e.src), near AS (SELECT node, dst, min(dist) AS dist FROM far GROUP BY node, dst), g AS (SELECT node, count(*) AS reachable, count(*) FILTER (dist > 1) AS indirect, max(dist) AS depth FROM near GROUP BY node) SELECT nodes.node, coalesce(reachable, 0) AS reachable, coalesce(indirect, 0) AS indirect, coalesce(depth, 0) AS depth FROM nodes LEFT JOIN g ON g.node = nodes.node")
def entity_reach_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(*entity_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {ENTITY_SQL}, up(node, layer) AS (SELECT node, CAST(0 AS BIGINT) FROM nodes UNION ALL SELECT e.src, u.layer + 1 FROM up u JOIN edges e ON e.dst = u.node) SELECT node, node AS scc, max(layer) AS layer FROM up GROUP BY node")
def entity_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = entity_graph(spark, sf_dir)
    return graph.layers(edges, graph.strong_components(nodes, edges)).select("node", "scc", "layer")


@query(f"""WITH RECURSIVE {ENTITY_SQL}, up(node, layer) AS (SELECT node, 0 FROM nodes UNION ALL SELECT e.src, u.layer + 1 FROM up u JOIN edges e ON e.dst = u.node), lay AS (SELECT node, max(layer) AS layer FROM up GROUP BY node),
back AS (SELECT 'n:' || s_nationkey AS src, 's:' || min(s_suppkey) AS dst FROM supplier GROUP BY s_nationkey)
SELECT e.src, e.dst FROM (SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM back) e JOIN lay a ON a.node = e.src JOIN lay b ON b.node = e.dst WHERE a.layer < b.layer""")
def entity_layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of the foreign keys, held against these and edges from each nation to its first supplier."""
    nodes, edges = entity_graph(spark, sf_dir)
    back = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s")).select(_key("n", "s_nationkey").alias("src"), _key("s", "s").alias("dst"))
    return graph.layer_violations(edges.unionByName(back), graph.layers(edges, graph.strong_components(nodes, edges)))


RING_SQL = "SELECT CAST(o_orderkey AS BIGINT) AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS scc, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders"


@query(f"WITH r AS ({RING_SQL}) SELECT node, CAST(scc AS BIGINT) AS scc, size FROM r")
def order_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order leads to its customer's next one and the last to the first: rings as long as customers are busy."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("long").alias("src"), "o_orderdate")
    own = Window.partitionBy("o_custkey")
    after = F.coalesce(F.lead("src").over(own.orderBy("o_orderdate", "src")), F.first("src").over(own.orderBy("o_orderdate", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return graph.strong_components(orders.select(F.col("src").alias("node")), orders.select("src", after.alias("dst")))


@query("SELECT event_id AS node, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS layer FROM events")
def event_chain_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event leads to the same user's next one: layers as deep as users are busy."""
    events = table(spark, sf_dir, "events")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = events.select(F.col("event_id").alias("src"), after.alias("dst")).filter("dst is not null")
    nodes = events.select(F.col("event_id").alias("node"))
    return graph.layers(edges, graph.strong_components(nodes, edges)).select("node", "layer")


@query(f"WITH {EVENT_SQL} SELECT src, dst FROM edges")
def event_transition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_graph(spark, sf_dir)[1]


@query(f"WITH RECURSIVE {EVENT_SQL}, {WALK_SQL} SELECT n.node, count(DISTINCT w.dst) FILTER (w.dst <> n.node) AS reachable FROM nodes n LEFT JOIN walk w ON w.node = n.node GROUP BY n.node")
def event_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(*event_graph(spark, sf_dir)).select("node", "reachable")


@query(f"WITH RECURSIVE {SCC_SQL} SELECT DISTINCT scc, size FROM scc WHERE size >= 2")
def event_transition_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(graph.strong_components(*event_graph(spark, sf_dir)))


@query(f"WITH RECURSIVE {SCC_SQL}, inside AS (SELECT a.scc, e.src, e.dst, row_number() OVER (PARTITION BY a.scc ORDER BY e.src, e.dst) AS k FROM edges e JOIN scc a ON a.node = e.src JOIN scc b ON b.node = e.dst WHERE a.scc = b.scc AND a.size >= 2) SELECT scc, src, dst FROM inside WHERE k = 1")
def break_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = event_graph(spark, sf_dir)
    return graph.break_edges(edges, graph.strong_components(nodes, edges))


@query(f"WITH RECURSIVE {SCC_SQL}, inside AS (SELECT a.scc, e.src, e.dst, row_number() OVER (PARTITION BY a.scc ORDER BY e.src, e.dst) AS k FROM edges e JOIN scc a ON a.node = e.src JOIN scc b ON b.node = e.dst WHERE a.scc = b.scc AND a.size >= 2) SELECT e.src, e.dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE k = 1 AND i.src = e.src AND i.dst = e.dst)")
def what_if_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = event_graph(spark, sf_dir)
    return graph.without_breaks(edges, graph.break_edges(edges, graph.strong_components(nodes, edges)))


TRADE_SQL = "edges AS (SELECT DISTINCT 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey), grp AS (SELECT 'c:' || c_custkey AS node, n_name AS grp FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 's:' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), crossing AS (SELECT src, dst, a.grp AS src_group, b.grp AS dst_group FROM edges JOIN grp a ON a.node = src JOIN grp b ON b.node = dst WHERE a.grp <> b.grp)"


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    edges = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct().select(_key("c", "o_custkey").alias("src"), _key("s", "l_suppkey").alias("dst"))
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("grp")))  # 25 rows at any size
    groups = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(_key("c", "c_custkey").alias("node"), "grp")
    return edges, groups.unionAll(table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(_key("s", "s_suppkey"), "grp"))


@query(f"WITH {TRADE_SQL} SELECT src, dst, src_group, dst_group FROM crossing")
def cross_group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cross_group(*trade_graph(spark, sf_dir)).select("src", "dst", "src_group", "dst_group")


@query(f"WITH {TRADE_SQL} SELECT src_group AS src, dst_group AS dst, count(*) AS weight FROM crossing GROUP BY 1, 2")
def quotient_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.quotient(*trade_graph(spark, sf_dir))


@query(f"WITH {TRADE_SQL} SELECT least(src_group, dst_group) AS a, greatest(src_group, dst_group) AS b, count(*) AS weight FROM crossing GROUP BY 1, 2")
def group_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected_weights(*trade_graph(spark, sf_dir))


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nodes = n.select(F.col("n_name").alias("node")).unionAll(r.select("r_name")).withColumn("label", F.col("node"))
    return nodes, n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))


_ID = "'{p}__' || lower(regexp_replace({c}, '[^A-Za-z0-9]', '_', 'g'))"


@query(f"""SELECT 0 AS part, name AS ord, '  ' || {_ID.format(p="n", c="name")} || '["' || name || '"]' AS line FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region)
UNION ALL SELECT 1, n_name || ' ' || r_name, '  ' || {_ID.format(p="n", c="n_name")} || ' --> ' || {_ID.format(p="n", c="r_name")} FROM nation JOIN region ON n_regionkey = r_regionkey""")
def graph_mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.mermaid_lines(*nation_graph(spark, sf_dir), "n")


@query("""SELECT 0 AS part, name AS ord, '  "n:' || name || '" [label="' || name || '"];' AS line FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region)
UNION ALL SELECT 1, n_name || ' ' || r_name, '  "n:' || n_name || '" -> "n:' || r_name || '";' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def graph_dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.dot_lines(*nation_graph(spark, sf_dir), "n")


PAGE_SQL = "pg AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), part AS (SELECT page_id, list_filter(string_split(path, '/'), lambda p: p <> '') AS p FROM pg)"
MODULE_SQL = f"{PAGE_SQL}, named AS (SELECT page_id, p[1:len(p) - 1] AS d, regexp_replace(p[len(p)], '(.)\\.[^.]*$', '\\1') AS stem FROM part), mods AS (SELECT page_id, array_to_string(list_transform(list_append(d, stem), lambda x: replace(x, '.', '')), '.') AS module, stem AS bare, array_to_string(list_append(d, stem), '.') AS suffix, CAST(len(list_distinct(list_append(d, stem))) AS INTEGER) AS identifiers FROM named)"


def page_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", F.array_join(T.path_parts(path), "/").alias("path"))
    p = F.col("path")
    return pages.select("page_id", T.module_name_py(p).alias("module"), T.bare_name_py(p).alias("bare"), T.module_suffix(p).alias("suffix"), F.size(T.path_identifiers(p)).alias("identifiers"))


@query(f"WITH {MODULE_SQL} SELECT page_id, module, bare, suffix, identifiers FROM mods")
def module_names_from_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_modules(spark, sf_dir)


def import_sql(what: str) -> str:
    return f"m AS (SELECT DISTINCT module, bare FROM mods), imp AS (SELECT DISTINCT a.module, regexp_replace(a.module, '\\.[^.]*$', '') AS parent, {what} AS import FROM mods a JOIN mods b ON b.page_id = a.page_id + 1)"


def next_imports(spark: SparkSession, sf_dir: str, what: str) -> tuple[DataFrame, DataFrame]:
    """(imports, modules): every page imports a name of the page after it; `what` is an expression over its columns."""
    pages = page_modules(spark, sf_dir)
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.expr(what).alias("import"))
    imports = pages.select("page_id", "module", F.regexp_replace("module", "\\.[^.]*$", "").alias("parent")).join(after, "page_id").select("module", "parent", "import").distinct()
    return imports, pages.select("module", "bare").distinct()


@query(f"WITH {MODULE_SQL}, {import_sql('b.bare')}, met AS (SELECT i.module AS src, i.import, m.module AS dst, starts_with(m.module, i.parent || '.') AS below FROM imp i JOIN m ON m.bare = i.import WHERE NOT contains(i.import, '.')), c AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (below) OVER w AS nb FROM met WINDOW w AS (PARTITION BY src, import)) SELECT DISTINCT src, dst FROM c WHERE (n = 1 OR (below AND nb = 1)) AND src <> dst")
def bare_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page imports the bare name of the next one; several pages may have it."""
    return resolve.resolve_bare(*next_imports(spark, sf_dir, "bare"))


_TAIL_SQL = "regexp_extract(b.module, '[^.]*\\.[^.]*$')"


@query(f"WITH {MODULE_SQL}, {import_sql(_TAIL_SQL)}, met AS (SELECT i.module AS src, i.import, m.module AS dst, starts_with(m.module, i.parent || '.') AS below FROM imp i JOIN m ON m.bare = regexp_extract(i.import, '[^.]*$') AND ends_with(m.module, i.import) WHERE contains(i.import, '.')), c AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (below) OVER w AS nb FROM met WINDOW w AS (PARTITION BY src, import)) SELECT DISTINCT src, dst FROM c WHERE (n = 1 OR nb <> 1 OR below) AND src <> dst")
def dotted_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page imports the last two parts of the next one's name, which other pages may end with too."""
    return resolve.resolve_dotted(*next_imports(spark, sf_dir, "regexp_extract(module, '[^.]*[.][^.]*$', 0)"))


HREF_SQL = "link AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS h FROM pages UNION ALL SELECT page_id - 1, module FROM mods)"


@query(f"WITH {MODULE_SQL}, {HREF_SQL}, m AS (SELECT DISTINCT page_id, module FROM mods) SELECT DISTINCT a.module AS src, b.module AS dst FROM link JOIN m a ON a.page_id = link.page_id JOIN m b ON b.module = h WHERE a.module <> b.module")
def page_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page links to what its text names, and to the page after it; addresses outside the table make no edge."""
    modules = page_modules(spark, sf_dir).select("page_id", "module")
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("import"))
    links = links.unionByName(modules.select((F.col("page_id") - 1).alias("page_id"), F.col("module").alias("import")))
    return resolve.resolve_exact(links.join(modules, "page_id").select("module", "import"), modules.select("module").distinct())


@query("""WITH r AS (SELECT user_id, event_id, ts, ts + to_seconds(CAST(floor(value) * 60 AS BIGINT)) AS until FROM events), n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, until, event_id) AS next_start FROM r)
SELECT user_id, event_id FROM n WHERE next_start < until""")
def edit_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.overlaps(_event_ranges(spark, sf_dir), "user_id", "ts", "until", "event_id").select("user_id", "event_id")


def _event_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)") * 60)
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", until.alias("until"))


NEST_SQL = "r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text) AS a, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + CASE WHEN turn % 3 = 0 THEN 500 ELSE 0 END AS b FROM conversations)"


def conversation_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    up_to = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    upto = F.sum("n").over(up_to)
    return rows.select("conv_id", "turn", (upto - F.col("n")).alias("a"), (upto + F.when(F.col("turn") % 3 == 0, 500).otherwise(0)).alias("b"))


@query(f'WITH {NEST_SQL} SELECT o.conv_id, o.turn AS "outer", i.turn AS "inner" FROM r o JOIN r i ON o.conv_id = i.conv_id AND o.turn <> i.turn WHERE o.a <= i.a AND i.b <= o.b AND (o.a < i.a OR i.b < o.b OR o.turn < i.turn)')
def nested_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.nested(conversation_ranges(spark, sf_dir), "conv_id", "turn", "a", "b")


@query(f"WITH {NEST_SQL}, met AS (SELECT p.conv_id, p.turn, r.turn AS holder, row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY r.b - r.a, r.turn) AS k FROM r p JOIN r ON r.conv_id = p.conv_id AND r.a <= p.b AND p.b <= r.b) SELECT conv_id, turn, holder FROM met WHERE k = 1")
def smallest_enclosing_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the end of each turn the shortest range of its conversation that holds it."""
    held = conversation_ranges(spark, sf_dir)
    points = held.select("conv_id", "turn", F.col("b").alias("at"))
    return ranges.smallest_enclosing(points, held.select("conv_id", F.col("turn").alias("holder"), "a", "b"), "conv_id", "at", "a", "b", "holder").select("conv_id", "turn", "holder")

import ast
import random

import pytest
from pyspark.sql import functions as F
from quillforge.functions import text as T
from quillforge.operators import components, dedup, graph, profile, ranges, render, resolve, rules
from quillforge.operators.components import connected_components
from quillforge.plans import text_queries
from quillforge.schema import METRICS, default_thresholds
from quillforge.sources import files
from quillforge.sources.python_code import cyclomatic


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expression.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("x = 123", "x = N"), ("  hello   world  ", "hello world"), ("a1b22C", "aNbNc"), ("1 2", "N N"), ("A\u00a0\u3000É", "a É"), ("", "")])
def test_normalize_code(spark, raw, want):
    assert one(spark, T.normalize_code(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,lines", [("", 0), ("a", 1), ("a\n", 1), ("a\n\nb", 3), ("\n", 1)])
def test_line_count(spark, raw, lines):
    assert one(spark, T.line_count(F.col("t")), t=raw) == lines


def test_shingles(spark):
    tokens = F.split("t", " ")
    assert one(spark, T.shingles(tokens, 3), t="a b c d e") == ["a b c", "b c d", "c d e"]
    assert one(spark, T.shingles(tokens, 3), t="a b") == [] and one(spark, T.shingles(tokens, 0), t="a b") == []


@pytest.mark.parametrize(
    "path,module,bare,rust",
    [
        ("src/pkg/a.py", "pkg.a", "a", "pkg.a"),
        ("x/src/y/src/z/m.py", "z.m", "m", "z.m"),
        ("pkg/__init__.py", "pkg", "pkg", "pkg.__init__"),
        ("m.py", "m", "m", "m"),
        ("/home/u/proj/lib/q.rs", "home.u.proj.lib.q", "q", "proj.lib.q"),
        ("tests/t/mod.rs", "tests.t.mod", "mod", "t"),
    ],
)
def test_module_names(spark, path, module, bare, rust):
    p = F.col("p")
    assert one(spark, T.module_name_py(p), p=path) == module
    assert one(spark, T.bare_name_py(p), p=path) == bare
    assert one(spark, T.module_name_rs(p), p=path) == rust


@pytest.mark.parametrize("path,is_test", [("a_test.py", True), ("_test.py", False), ("test_x.py", True), ("conftest.py", True), ("tests/x.py", True), ("src/latest.py", False)])
def test_test_paths(spark, path, is_test):
    assert one(spark, T.is_test_path(F.col("p")), p=path) is is_test


@pytest.mark.parametrize("name,entry", [("main", True), ("a.tests.b", True), ("tests", True), ("bin.x", True), ("a.bin", False), ("a.test_b", True), ("a.b_test", True), ("x.perf_bench", True), ("a.b", False)])
def test_entry_points(spark, name, entry):
    assert one(spark, T.is_entry_point(F.col("m")), m=name) is entry


def test_ignore_rules(spark):
    paths = ["a/venv/x.py", "vendor_x/y.py", "src/vendor.py", "src/build/x.py", "src/keep/build/ok.py", ".hidden/x.py", "docs/a.py"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    left = {r.path for r in frame.filter(~T.ignored(F.col("path"), [" vendor/ "])).collect()}
    assert left == set(paths) - {"a/venv/x.py", "vendor_x/y.py"}
    kept = {r.path for r in files.apply_ignore_file(frame, ["# note", "build/", "!src/keep/build/", "/docs"]).collect()}
    assert kept == {"a/venv/x.py", "vendor_x/y.py", "src/vendor.py", "src/keep/build/ok.py"}


@pytest.mark.parametrize("values,want", [([42], (1, 42, 42, 42, 42, 42)), ([1, 2, 3, 4], (4, 3, 4, 4, 4, 4)), (list(range(1, 101)), (100, 51, 90, 95, 99, 100)), ([5] * 9 + [None], (9, 5, 5, 5, 5, 5))])
def test_percentiles(spark, values, want):
    rows = profile.percentiles(spark.createDataFrame([("m", v) for v in values], "metric string, value bigint"), ["metric"]).collect()
    assert [tuple(r)[1:] for r in rows] == [want]


def test_thresholds_allow_equality(spark):
    rows = spark.createDataFrame([("python", "a", 3), ("python", "a", 4), ("rust", "a", 9), ("python", "b", 9)], "language string, metric string, value bigint")
    held = spark.createDataFrame([("python", "a", 3), ("rust", "a", None)], "language string, metric string, threshold bigint")
    assert [r.value for r in rules.violations(rows, held, ["language", "metric"]).collect()] == [4]
    assert len(METRICS) == 27 and ("python", "arguments_per_function") not in default_thresholds()


def test_shrink(spark):
    now = spark.createDataFrame([("files", 10), ("statements", 100), ("edges", 5)], "metric string, value bigint")
    old = spark.createDataFrame([("files", 9), ("statements", 120), ("edges", 5)], "metric string, value bigint")
    assert {tuple(r) for r in rules.shrink(now, old, "statements", 90).collect()} == {("files", 10, 9, False), ("statements", 100, 90, True)}
    with pytest.raises(ValueError):
        rules.shrink_start(5, 6)


def test_coverage_numbers(spark):
    defs = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("b", "g1")], "file string, name string")
    missing = spark.createDataFrame([("a", "f2")], "file string, name string")
    by_file = rules.coverage_by_file(defs, missing)
    assert {r.file: r.percent for r in by_file.collect()} == {"a": 50, "b": 100}
    assert tuple(rules.overall_coverage(by_file).first()) == (67, 50, 3)
    assert rules.gate(rules.overall_coverage(by_file.filter("false")), 90).first().passed


def test_uncovered_by_import_owner_and_unique_name(spark):
    defs = spark.createDataFrame([("src/auth.py", "process", None), ("src/bill.py", "process", None), ("src/x.py", "run", "Job"), ("src/x.py", "solo", None)], "file string, name string, owner string")
    refs = spark.createDataFrame([("process",), ("Job",), ("solo",)], "ref string")
    bindings = spark.createDataFrame([("auth", "process")], "module string, name string")
    suffixes = defs.select("file", T.module_suffix(F.col("file")).alias("suffix")).distinct()
    assert [(r.file, r.name) for r in resolve.uncovered(defs, refs, bindings, suffixes).collect()] == [("src/bill.py", "process")]


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs] or [("", "")], "src string, dst string").filter("src <> ''")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@pytest.mark.parametrize(
    "names,pairs,want",
    [
        ("a", [], {"a": 0}),
        ("abc", ["cb", "ba"], {"a": 0, "b": 1, "c": 2}),
        ("abcd", ["db", "dc", "ba", "ca"], {"a": 0, "b": 1, "c": 1, "d": 2}),
        ("ab", ["ab", "ba"], {"a": 0, "b": 0}),
        ("abc", ["ab", "ba", "ca"], {"a": 0, "b": 0, "c": 1}),
        ("abu", ["ab", "ba", "bu"], {"a": 1, "b": 1, "u": 0}),
    ],
)
def test_layers(spark, names, pairs, want):
    e, n = edges(spark, *pairs), nodes(spark, names)
    found = graph.layers(e, graph.strong_components(n, e))
    assert {r.node: r.layer for r in found.collect()} == want
    assert graph.layer_violations(e, found).isEmpty()


def test_reach_counts_shortest_distances(spark):
    chain = graph.reach(nodes(spark, "abcd"), edges(spark, "ab", "bc", "cd"))
    assert {tuple(r) for r in chain.collect() if r.node == "a"} == {("a", 3, 2, 3)}
    diamond = graph.reach(nodes(spark, "abcd"), edges(spark, "ab", "ac", "bd", "cd", "ad"))
    assert {tuple(r) for r in diamond.collect() if r.node == "a"} == {("a", 3, 0, 1)}
    ring = graph.reach(nodes(spark, "abc"), edges(spark, "ab", "bc", "ca"))
    assert {tuple(r)[1:] for r in ring.collect()} == {(2, 1, 2)}


def test_strong_components_and_breaks(spark):
    e, n = edges(spark, "ab", "bc", "ca", "cd", "de", "ed", "xa", "xe"), nodes(spark, "abcdexy")
    found = graph.strong_components(n, e)
    assert {r.node: (r.scc, r.size) for r in found.collect()} == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 2), "e": ("d", 2), "x": ("x", 1), "y": ("y", 1)}
    assert {tuple(r) for r in graph.break_edges(e, found).collect()} == {("a", "a", "b"), ("d", "d", "e")}


def in_group(spark, name, run):
    """What run() gives, and how many jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        found = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_long_chains_take_few_rounds(spark):
    """10,000 nodes one behind another, shuffled names, with a ring in the middle of a second path."""
    order = list(range(10_000))
    random.Random(1).shuffle(order)
    ahead = list(zip(order, order[1:], strict=False))
    ring = [(20_000 + k, 20_000 + (k + 1) % 3000) for k in range(3000)] + [(30_000, 20_007), (20_011, 30_001)]
    e = spark.createDataFrame(ahead + ring, "src long, dst long")
    n = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    rows, jobs = in_group(spark, "scc", lambda: {r.node: (r.scc, r.size) for r in graph.strong_components(n, e).collect()})
    assert jobs < 200 and all(rows[x] == (x, 1) for x in [*order, 30_000, 30_001])
    assert {rows[20_000 + k] for k in range(3000)} == {(20_000, 3000)}
    held = spark.createDataFrame([(x, *v) for x, v in rows.items()], "node long, scc long, size long")
    rows, jobs = in_group(spark, "layers", lambda: {r.node: r.layer for r in graph.layers(e, held).collect()})
    assert jobs < 100 and all(rows[x] == 9_999 - k for k, x in enumerate(order))
    assert (rows[30_001], rows[20_500], rows[30_000]) == (0, 1, 2)


@pytest.mark.parametrize("seed", range(4))
def test_graphs_match_brute_force(spark, seed):
    draw = random.Random(seed)
    n = 60
    pairs = {(draw.randrange(n), draw.randrange(n)) for _ in range((40, 70, 110, 25)[seed])} | {(k, k + 1) for k in range(40, 50)}
    reached = {a: {a: 0} for a in range(n)}
    for a in range(n):
        front, step = [a], 0
        while front:
            step += 1
            front = [y for y in {y for x in front for z, y in pairs if z == x} if y not in reached[a]]
            reached[a] |= dict.fromkeys(front, step)
    e, all_nodes = spark.createDataFrame(list(pairs), "src long, dst long"), spark.createDataFrame([(k,) for k in range(n)], "node long")
    found = {r.node: (r.reachable, r.indirect, r.depth) for r in graph.reach(all_nodes, e).collect()}
    assert found == {a: (len(d) - 1, sum(x > 1 for x in d.values()), max(d.values())) for a, d in reached.items()}
    same = {a: {b for b in reached[a] if a in reached[b]} for a in range(n)}
    scc = graph.strong_components(all_nodes, e)
    assert {(r.node, r.scc, r.size) for r in scc.collect()} == {(a, min(b), len(b)) for a, b in same.items()}

    def height(a):
        return max((1 + height(min(same[y])) for x in same[a] for z, y in pairs if z == x and y not in same[a]), default=0)

    assert {r.node: r.layer for r in graph.layers(e, scc).collect()} == {a: height(a) for a in range(n)}


@pytest.mark.parametrize("few", [0, 12, 1 << 17])
def test_components_in_rounds_or_at_once(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    links = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(20) if k % 7] + [("é", "z"), ("z", "a"), ("b", "b"), (None, "a"), ("a", "é")]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
    want = {"a": "a", "z": "a", "é": "a"}
    for low, high in ((1, 7), (8, 14), (15, 20)):
        want |= {f"n{k:02d}": f"n{low:02d}" for k in range(low, high + 1)}
    assert found == want
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_components_and_clusters(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 1.0), (7, 8, 0.95), (8, 7, 0.95)], "id1 long, id2 long, similarity double")
    members = dedup.clusters(pairs)
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    summary = {r.cluster_id: r for r in dedup.cluster_summary(pairs.filter("id1 < id2"), members).collect()}
    assert summary[1].size == 3 and round(summary[1].avg_similarity, 9) == 0.95
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(None, 3), (4, 4)], "a long, b long")
    assert {r.component for r in connected_components(path).collect()} == {0}
    assert connected_components(path.filter("false")).collect() == []


def test_minhash(spark):
    rows = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon"), (3, "one two three four five"), (4, "x"), (5, "")]
    signed = dedup.signatures(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3, 100)
    got = {r.id: r.signature for r in signed.collect()}
    assert got[1] == got[2] and len(got[1]) == 100 and got[4] == got[5] == [dedup.PRIME] * 100
    pairs = dedup.candidates(signed, "id", 20)
    found = {(r.id1, r.id2): r.similarity for r in dedup.verified(pairs, signed, "id", 0.9).collect()}
    assert found == {(1, 2): 1.0, (4, 5): 1.0}
    same = signed.select(F.explode(F.sequence(F.lit(1), F.lit(101))).alias("k"), "signature").filter("false")
    assert dedup.candidates(same, "k").collect() == []
    with pytest.raises(ValueError):
        dedup.candidates(signed, "id", 0)


def test_large_buckets_are_left_out(spark):
    for n, want in ((3, 3), (1, 0), (101, 0)):
        signed = spark.range(n).select("id", F.array(*map(F.lit, range(4))).alias("signature"))
        assert dedup.candidates(signed, "id", 1).count() == want


def test_exact_candidates_group_as_all_pairs_do(spark):
    draw = random.Random(3)
    signed = spark.createDataFrame([(k, [draw.randrange(3) for _ in range(4)]) for k in range(60)], "id long, signature array<long>")

    def groups(largest, exact):
        own = list(range(60))
        for r in dedup.verified(dedup.candidates(signed, "id", 2, largest, exact), signed, "id", 0.75).collect():
            x, y = sorted((own[r.id1], own[r.id2]))
            own = [x if o == y else o for o in own]
        return own

    assert groups(5, True) == groups(1, True) == groups(60, False) != groups(5, False)


def test_queries_hold_groups_over_the_cap(spark, tmp_path):
    copies = [(k, "alpha beta gamma delta epsilon zeta") for k in range(150)]
    spark.createDataFrame([*copies, (150, "one two three four five")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in text_queries.near_dup_clusters(spark, str(tmp_path)).collect()} == {(k, 0) for k in range(150)}
    pairs = {(0, k) for k in range(1, 150)}
    assert {tuple(r) for r in text_queries.lsh_candidates(spark, str(tmp_path)).collect()} == pairs
    assert {tuple(r) for r in text_queries.near_dup_pairs(spark, str(tmp_path)).collect()} == {(a, b, 1.0) for a, b in pairs}
    (row,) = text_queries.cluster_summary(spark, str(tmp_path)).collect()
    assert row.size == 150 and row.avg_similarity == 1.0


@pytest.mark.parametrize("block", [4, 1024])
def test_links_and_pairs_inside_buckets(spark, monkeypatch, block):
    """The same pairs as joining buckets and verifying, and links of the same clusters, whatever a block holds."""
    monkeypatch.setattr(dedup, "BLOCK", block)
    draw = random.Random(11)
    base = [[draw.randrange(9) for _ in range(12)] for _ in range(3)]
    rows = [(k, [draw.randrange(50) if draw.random() < 0.15 else v for v in base[k % 3]]) for k in range(90)] + [(200 + k, base[0]) for k in range(9)]
    signed = spark.createDataFrame(rows, "id long, signature array<long>").repartition(3)
    want = {tuple(r) for r in dedup.verified(dedup.candidates(signed, "id", 4, exact=True), signed, "id", 0.75).collect()}
    found = [tuple(r) for r in dedup.alike_pairs(signed, "id", 4, 0.75).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    links = dedup.alike_links(signed, "id", 4, 0.75)
    both = [{tuple(r) for r in dedup.clusters(x).collect()} for x in (links, spark.createDataFrame(found, "id1 long, id2 long, similarity double"))]
    assert both[0] == both[1]


def test_a_bucket_of_ten_thousand_near_copies_is_linear(spark):
    draw = random.Random(2)
    same = [draw.randrange(1 << 30) for _ in range(100)]
    rows = [(k, [*same[:5], *(v if draw.random() > 0.05 else draw.randrange(1 << 30) for v in same[5:])]) for k in range(10_000)]
    links = dedup.alike_links(spark.createDataFrame(rows, "id long, signature array<long>").repartition(4), "id", 20, 0.8).select("id1", "id2").distinct()
    links = links.persist()
    assert links.count() < 25 * 10_000
    assert {r.component for r in connected_components(links, "id1", "id2").select("component").distinct().collect()} == {0}


def test_ranges(spark):
    rows = spark.createDataFrame([("f", 1, 0, 10), ("f", 2, 10, 12), ("f", 3, 11, 15), ("g", 4, 0, 3)], "path string, k int, a int, b int")
    assert [r.k for r in ranges.overlaps(rows, "path", "a", "b", "k").collect()] == [2]
    points = spark.createDataFrame([("f", 11), ("g", 9)], "path string, at int")
    assert [(r.at, r.k) for r in ranges.smallest_enclosing(points, rows, "path", "at", "a", "b", "k").collect()] == [(11, 2)]
    held = spark.createDataFrame([("f", 1, 0, 10), ("f", 2, 2, 5), ("f", 3, 2, 5)], "path string, k int, a int, b int")
    assert {(r.outer, r.inner) for r in ranges.nested(held, "path", "k", "a", "b").collect()} == {(1, 2), (1, 3), (2, 3)}


def test_rendering(spark):
    assert one(spark, T.truncate_left(F.col("t"), 10), t="short") == "short"
    assert one(spark, T.truncate_left(F.col("t"), 10), t="this_is_a_very_long_string") == "..._string"
    assert one(spark, T.mermaid_id("py", F.col("t")), t="A.b-c") == "py__a_b_c"
    assert one(spark, T.mermaid_label(F.col("t")), t='<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, T.dot_label(F.col("t")), t='a"\\') == 'a\\"\\\\'
    assert render.viz_format("x/out.MMD") == "mermaid" and graph.target_nodes(10, 0) == 1 and graph.target_nodes(10, 1) == 10
    with pytest.raises(ValueError):
        render.viz_format("out.png")


def test_cyclomatic():
    assert cyclomatic(ast.parse("def f():\n if a and b:\n  for x in y: pass\n return 1")) == 4

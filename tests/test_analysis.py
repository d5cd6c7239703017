import re

import pytest
from quillforge.plans import cache
from quillforge.plans.analysis import Corpus, Settings
from quillforge.sources import config, files, python_code, rust_code

BODY = "    total = 0\n    for item in rows:\n        if item > 3:\n            total += item * 2\n        else:\n            total -= item\n    print(total, rows, 'done with the work')\n    return total\n"
TREE = {
    "src/pkg/__init__.py": "# a package\n",
    "src/pkg/a.py": "from pkg import b\nimport os\n\ndef work(rows):\n" + BODY,
    "src/pkg/b.py": "import pkg.c\n\ndef wider(rows):\n" + BODY,
    "src/pkg/c.py": "import pkg.a\n\nclass Thing:\n    def used(self, a, b, c, d, e):\n        return a\n    def _hidden(self): pass\n",
    "src/pkg/lonely.py": "def unused(p1, p2, p3, p4, p5):\n    return 1, 2\n",
    "tests/test_a.py": "from pkg.a import work\n\ndef test_work():\n    assert work([1]) == 1\n",
    "broken.py": "def f(:\n",
    "rs/src/lib.rs": "mod child;\nuse child::go;\npub fn top(flag: bool) -> i32 { if flag { go() } else { 1 } }\n",
    "rs/src/child.rs": "pub fn go() -> i32 { let (a, b) = (1, 2); a + b }\n",
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, source in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(source)
    (root / "venv").mkdir()
    (root / "venv/skip.py").write_text("x = 1\n")
    return Corpus(files.scan(spark, str(root)), Settings())


def test_scan(corpus):
    assert {r.path: r.language for r in corpus.files.collect()} == {p: "python" if p.endswith("py") else "rust" for p in TREE}


def test_walk_and_ignore_rules(spark, tmp_path):
    texts = {
        "__init__.py": "", "a/_x.py": "é = 1", "a b/c d.py": "x", "build/q.py": "1", "keep/build/z.py": "2", "keep/foo?.py": "1", "sub/only.py": "1", "sub/deep/only.py": "2",
        ".gitignore": "build\n!keep\n# note\nfoo[!a]1.py\n*.tmp.py\n", ".git/info/exclude": "ex.py\n", "ex.py": "1", "foob1.py": "1", "fooa1.py": "1", "x.tmp.py": "1", "sub/.ignore": "/only.py\n!x.tmp.py\n", "sub/x.tmp.py": "3",
        "node_modules/r.py": "1", ".hidden/x.py": "1", "n.RS": "fn f() {}", "a(1).py": "1", "vendor/d.py": "1", "plain.txt": "1",
    }
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = {r.path: (r.language, r.source, r.length) for r in files.scan(spark, str(tmp_path), ignore=["vend"], ignore_lines=["a(1).py"]).collect()}
    kept = ["__init__.py", "a/_x.py", "a b/c d.py", "keep/foo?.py", "sub/deep/only.py", "fooa1.py", "sub/x.tmp.py", "n.RS"]
    assert found == {p: ("rust" if p == "n.RS" else "python", texts[p], len(texts[p].encode())) for p in kept}
    assert [r.path for r in files.scan(spark, str(tmp_path), language="rust").collect()] == ["n.RS"]
    roots = files.scan(spark, str(tmp_path / "sub"), str(tmp_path / "sub/deep"), str(tmp_path / "a"))
    assert sorted(r.path for r in roots.collect()) == ["a/_x.py", "sub/deep/only.py", "sub/x.tmp.py"]
    (tmp_path / "none").mkdir()
    assert files.scan(spark, str(tmp_path / "none")).collect() == []
    rule = lambda line, path: bool(re.search(files.gitignore_regex(line)[0], path))
    assert rule("a(1)", "x/a(1)") and rule("foo?.py", "foo1.py") and not rule("foo?.py", "foo/.py") and rule("a/**/b", "a/b") and rule("**/x", "x") and not rule("/docs", "a/docs")
    assert files.gitignore_regex("#x") is None and files.gitignore_regex("") is None and rule("\\#x", "#x") and rule("[", "[")


def test_graph_and_cycle(corpus):
    assert {(r.src, r.dst) for r in corpus.edges("python").collect()} >= {("pkg.a", "pkg.b"), ("pkg.b", "pkg.c"), ("pkg.c", "pkg.a")}
    sizes = {r.node: r.cycle_size for r in corpus.module_metrics("python").collect()}
    assert sizes["pkg.a"] == sizes["pkg.b"] == sizes["pkg.c"] == 3 and sizes["pkg.lonely"] == 0
    assert {(r.src, r.dst) for r in corpus.edges("rust").collect()} == {("lib", "child")}
    assert {r.node for r in corpus.orphans("python").collect()} == {"broken", "pkg.lonely"}


def test_violations(corpus):
    found = {(r.unit_name, r.metric, r.value) for r in corpus.violations().collect()}
    assert ("pkg.a", "cycle_size", 3) in found and ("unused", "positional_args", 5) in found
    assert ("pkg.lonely", "orphan_module", 0) in found
    assert not any(name == "used" and metric == "positional_args" for name, metric, _ in found)  # a method
    assert len([f for f in found if f[1] == "cycle_size"]) == 1


def test_duplicates(corpus):
    members, summary = corpus.duplicate_clusters("python")
    assert {r.name for r in members.collect()} == {"work", "wider"}
    assert [(r.size, r.avg_similarity) for r in summary.collect()] == [(2, 1.0)]


def test_coverage(corpus):
    assert {r.name for r in corpus.uncovered.collect()} == {"wider", "Thing", "used", "unused", "top", "go"}
    assert {(r.name, r.test_id) for r in corpus.covering().collect()} == {("work", "test_work")}
    assert corpus.gate().first().percent == 14
    changed = corpus.spark.createDataFrame([("src/pkg/a.py",)], "file string")
    assert [(r.test_file, r.test_id) for r in corpus.tests_of(changed).collect()] == [("tests/test_a.py", "test_work")]


def test_stats_mimic_and_totals(corpus):
    stats = {(r.language, r.metric): r for r in corpus.stats().collect()}
    assert stats["python", "positional_args"].max == 5
    limits = corpus.mimic()
    assert limits["python", "cycle_size"] == 3
    again = Corpus(corpus.files, Settings(limits))
    again._kept = corpus._kept
    assert {r.metric for r in again.violations().collect()} == {"orphan_module"}
    totals = {r.metric: r.value for r in corpus.totals().collect()}
    assert totals["files"] == len(TREE) and totals["graph_edges"] == corpus.edges("python").count() + 1
    assert {r.metric for r in corpus.top(1).collect()} == {m for _, m in stats}


def measures(source, name="f"):
    return next(u for u in python_code.units("a.py", source) if u["name"] == name)


def test_python_measures():
    m = measures("def f(left, right=1, /, *rest, key, **more):\n    return left, right")
    assert (m["positional_args"], m["keyword_only_args"], m["return_values_per_function"]) == (3, 1, 2)
    assert measures("def f(self, quiet=False, *, loud=True, size=None): ...")["boolean_parameters"] == 2
    assert measures("@cache\n@traced(1)\nasync def f(): ...")["annotations_per_function"] == 2
    source = "def f(path):\n    try:\n        text = open(path).read()\n        size = len(text)\n    except OSError:\n        size = 0\n    finally:\n        print(size)\n    try:\n        pass\n    finally:\n        pass\n    return size\n"
    m = measures(source)
    assert (m["statements_per_try_block"], m["calls_per_function"], m["local_variables_per_function"], m["statements_per_function"]) == (2, 4, 2, 9)
    m = measures("def f(rows):\n    class Inner:\n        def go(self):\n            if self: return 5\n    def again():\n        def deep(): return 1\n        return deep\n    kept = rows\n    return again\n")
    assert [m[k] for k in ("returns_per_function", "branches_per_function", "local_variables_per_function", "statements_per_function", "max_indentation_depth", "nested_function_depth")] == [1, 0, 1, 2, 1, 2]
    assert measures("def f():\n    from a import b\n    import c\n    return b(c)")["statements_per_function"] == 1
    assert measures("class C:\n    x = 1\n    async def a(self): ...\n    def b(self): ...\n    def c(self): ...", "C")["methods_per_class"] == 3
    names = lambda s: python_code.imported_names(python_code.parse(s))
    assert names("import a.b\nimport c as d\nfrom e import f, g as h\nif typing.TYPE_CHECKING:\n    import z\ndef k():\n    import a.q, m\n") == {"a", "d", "f", "h", "m"}
    assert names("from everything import *\n") == {"*"}
    assert next(python_code.units("a.py", "def f(\n"))["parse_error"]


def test_rust_measures():
    source = "fn f(first: bool, n: &mut u8) -> u8 { let Pair { x, y: [p, _] } = g(); let q = |z| z; while n > 3 { if first { return q(x); } else if p == 4 { h(); } } n }"
    m = next(u for u in rust_code.units("x.rs", source) if u["name"] == "f")
    assert (m["branches_per_function"], m["calls_per_function"], m["returns_per_function"], m["arguments_per_function"], m["boolean_parameters"], m["nested_function_depth"]) == (2, 3, 1, 2, 1, 1)
    module = next(rust_code.units("x.rs", "use one::{two, three::four}; use five::*; pub use six::seven; struct A; enum B {} trait C {}"))
    assert (module["imported_names_per_file"], module["concrete_types_per_file"], module["interface_types_per_file"]) == (3, 2, 1)
    assert rust_code.is_test_only([["#", "[", "cfg", "(", "test", ")", "]"]]) and not rust_code.is_test_only([["#", "[", "cfg", "(", "not", "(", "test", ")", ")", "]"]])
    assert next(rust_code.units("x.rs", "fn broken( {"))["parse_error"]
    assert [d["name"] for d in rust_code.definitions("pub enum Kind { A } fn _quiet() {} #[cfg(test)] mod checks { fn inner() {} } impl Kind { fn name(&self) {} fn _own(&self) {} }")] == ["Kind", "name"]


def test_result_cache(spark, tmp_path):
    rows = [("a.py", "def f(a, b, c, d): pass\n"), ("b.py", "def g(): pass\n")]
    tree = lambda rows: spark.createDataFrame([(p, "python", s, len(s), "t") for p, s in rows], "path string, language string, source string, length bigint, mtime string")
    made = []

    def make(files):
        made.append(1)
        return Corpus(files).units.select("path", "name", "line", "positional_args")

    first = cache.kept(str(tmp_path), tree(rows), Settings(), "units", lambda: make(tree(rows)))
    again = cache.kept(str(tmp_path), tree(rows), Settings(), "units", lambda: make(tree(rows)))
    assert first.collect() == again.collect() and len(made) == 1
    cache.kept(str(tmp_path), tree(rows), Settings({("python", "lines_per_file"): 9}), "units", lambda: make(tree(rows)))
    other = cache.kept(str(tmp_path), tree(rows[:1]), Settings(), "units", lambda: make(tree(rows[:1])))
    assert len(made) == 3 and other.count() == 2
    before = spark.createDataFrame([("a.py", "f", 1, "x"), ("a.py", "gone", 1, "x"), ("a.py", "f", 2, "x")], "file string, unit_name string, line int, metric string")
    assert [tuple(r) for r in cache.still_there(before, other.withColumnRenamed("path", "file")).collect()] == [("a.py", "f", 1, "x")]


def test_settings(tmp_path):
    (tmp_path / "a").write_text("[python]\nmax_indentation = 9\n[gate]\nmin_similarity = 0.5\n")
    limits, gate = config.load(str(tmp_path / "a"))
    assert limits["python", "max_indentation_depth"] == 9 and gate["min_similarity"] == 0.5 and limits["rust", "arguments_per_function"] == 8
    with pytest.raises(config.SettingsError, match="statements_per_file"):
        config.parse("[python]\nstatement_per_file = 1")
    assert config.parse("[python]\nnope = 1\n[rust]\nlines_per_file = 2", strict=False)[0] == {("rust", "lines_per_file"): 2}
    merged = config.merge("[python]\nlines_per_file = 1\n[rust]\nlines_per_file = 2\n", {("python", "lines_per_file"): 5}, {"python"})
    assert config.parse(merged)[0] == {("python", "lines_per_file"): 5, ("rust", "lines_per_file"): 2}


def test_tolerant_parse():
    source = "import os\n\ndef good(a):\n    return a\n\ndef bad(:\n    x = 1\n\n@mark\nclass C:\n    def one(self):\n        return 1\n\n    def two(self:\n        pass\n\n    def three(self): pass\n\nif x\n    y = 1\nelse:\n    z = 2\nlast = (\n    1,\n)\n"
    rows = list(python_code.units("a.py", source))
    assert rows[0]["parse_error"] and rows[0]["functions_per_file"] == 3 and rows[0]["imported_names_per_file"] == 1
    assert [(r["name"], r["line"], r["inside_class"]) for r in rows[1:]] == [("good", 3, False), ("C", 10, False), ("one", 11, True), ("three", 17, True)]
    assert [d["name"] for d in python_code.definitions(source)] == ["good", "C", "one", "three"]
    assert python_code.parse("def f(\n") is None and python_code.parse("") is not None
    assert [r["name"] for r in python_code.units("a.py", "def f():\n    if True\n        pass\n\ndef g(): pass\n")] == ["a", "g"]


def test_modules_of_one_name(spark):
    tree = {"src/util.py": "import one\n", "lib/src/util.py": "import two\n", "src/one.py": "x = 1\n", "src/two.py": "x = 1\n"}
    found = Corpus(spark.createDataFrame([(p, "python", s) for p, s in tree.items()], "path string, language string, source string"))
    assert {(r.src, r.dst) for r in found.edges("python").collect()} == {("util", "one"), ("util", "two")}
    assert found.nodes("python").count() == 3

from quillforge.operators import coarsen


def frame(spark, paths):
    return spark.createDataFrame([(f"n{k:02d}", p) for k, p in enumerate(paths)], "node string, path string")


def sizes(groups):
    return sorted(r["count"] for r in groups.groupBy("grp").count().collect())


def test_directories(spark):
    nodes = frame(spark, ["src/a/x.py"] * 5 + ["src/b/x.py"] * 3 + ["src/c/x.py"] * 2 + ["src/d/x.py"])
    assert sizes(coarsen.by_directories(nodes, 4)) == [1, 2, 3, 5]
    assert sizes(coarsen.by_directories(nodes, 3)) == [3, 3, 5]
    many = coarsen.by_directories(nodes, 6)
    assert many.count() == 11 and len(sizes(many)) == 6
    titles = {r.grp: r.title for r in coarsen.titles(coarsen.by_directories(nodes, 3), nodes).collect()}
    assert titles == {"a": "a", "b": "b", "(other)": "mixed"}


def test_edges_find_two_cliques():
    left, right = ["a", "b", "c"], ["x", "y", "z"]
    edges = [(p, q) for side in (left, right) for p in side for q in side if p < q] + [("a", "x")]
    found = coarsen.by_edges(left + right, edges, 2)
    assert {found[n] for n in left} == {"a"} and {found[n] for n in right} == {"x"}
    assert set(coarsen.by_edges(left + right, [], 1).values()) == {"a"}


def test_coarsen(spark):
    nodes = frame(spark, ["src/a/x.py", "src/a/y.py", "src/b/x.py", None])
    edges = spark.createDataFrame([("n00", "n01"), ("n01", "n02"), ("n02", "n03")], "src string, dst string")
    groups, quotient = coarsen.coarsen(nodes, edges, 2)
    assert len(sizes(groups)) == 2 and quotient.count() == 1
    groups, quotient = coarsen.coarsen(nodes, edges, 1)
    assert sizes(groups) == [4] and quotient.count() == 0

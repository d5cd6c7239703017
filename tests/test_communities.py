import random

import pytest
from pyspark.sql import functions as F
from quillforge.operators import communities as cm


def planted(groups, size, inner, outer, seed):
    draw, n = random.Random(seed), groups * size
    return n, [(a, b) for a in range(n) for b in range(n) if a != b and draw.random() < (inner if a // size == b // size else outer) / 2]


def brute_modularity(pairs, of):
    total, inner, degree = 0, 0, {}
    for a, b in pairs:
        if a != b:
            total += 2
            inner += 2 * (of[a] == of[b])
            degree[of[a]] = degree.get(of[a], 0) + 1
            degree[of[b]] = degree.get(of[b], 0) + 1
    return inner / total - sum(d * d for d in degree.values()) / total**2


def frames(spark, n, pairs, parts=3):
    return spark.createDataFrame([(k,) for k in range(n)], "node long").repartition(parts), spark.createDataFrame(pairs, "src long, dst long").repartition(parts)


def test_the_order_of_rows_tells_nothing(spark):
    n, pairs = planted(2, 5, 1.8, 0.06, 5)
    runs = [{tuple(r) for r in cm.communities(*frames(spark, n, p, parts)).collect()} for p, parts in ((pairs, 3), (pairs[::-1], 1))]
    assert runs[0] == runs[1] == {(k, k - k % 5, 5) for k in range(n)}


def test_modularity_connectivity_and_order(spark):
    n, pairs = planted(5, 8, 0.5, 0.06, 9)
    nodes, edges = frames(spark, n, pairs)
    rows = cm.ordered(cm.communities(nodes, edges)).collect()
    of = {r.node: r.community for r in rows}
    q = cm.modularity(edges, spark.createDataFrame(list(of.items()), "node long, community long")).first()[0]
    assert q == pytest.approx(brute_modularity(pairs, of)) and q >= 0.9 * brute_modularity(pairs, {k: k // 8 for k in range(n)})
    for c in set(of.values()):
        inside, reached = {k for k in of if of[k] == c}, {c}
        while more := {x for p in pairs for x, y in (p, p[::-1]) if y in reached and x in inside} - reached:
            reached |= more
        assert reached == inside and c == min(inside)
    order = sorted({(-r.size, r.community, r.rank) for r in rows})
    assert [r for *_, r in order] == list(range(1, len(order) + 1))


def test_no_edges(spark):
    nodes, edges = frames(spark, 3, [(0, 0)])
    assert {tuple(r) for r in cm.communities(nodes, edges).collect()} == {(k, k, 1) for k in range(3)}
    assert cm.modularity(edges, cm.communities(nodes, edges)).first()[0] == 0.0


def test_a_round_takes_the_edges_of_its_class_only(spark, monkeypatch):
    """Two groups without an edge between them; before, each round dealt out all edges for a class of the nodes."""
    n, pairs = planted(2, 6, 1.8, 0.0, 3)
    near, classes = cm._near, []

    def seen(adjacent, state):
        found = adjacent.join(state.select(F.col("node").alias("src"), F.col("turn").alias("of")), "src")
        classes.append({(r.turn, r.of) for r in found.select("turn", "of").distinct().collect()})
        return near(adjacent, state)

    monkeypatch.setattr(cm, "_near", seen)
    rows = {tuple(r) for r in cm.communities(*frames(spark, n, pairs)).collect()}
    assert rows == {(k, k - k % 6, 6) for k in range(n)}
    assert all(a == b for c in classes for a, b in c) and len(classes[0]) == 1
    assert all(len(c) <= 1 for c in classes[: cm.CLASSES // 2])


@pytest.mark.parametrize("total", [7, cm.LONG_TOTAL, cm.LONG_TOTAL + 1, 10**12])
def test_gains_are_exact(spark, total):
    row = spark.range(1).select(F.lit(total).cast("long").alias("w"), F.lit(total).cast("long").alias("x"), F.lit(total - 1).cast("long").alias("y"))
    assert int(row.select(cm._gain(total, F.col("w"), F.col("x"), F.col("y"))).first()[0]) == total
    assert int(row.select(cm._gain(total, F.lit(0), F.col("x"), F.col("y"))).first()[0]) == -total * (total - 1)

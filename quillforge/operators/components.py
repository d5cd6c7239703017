"""Connected components by alternating large and small stars.

Each round points every node at the smallest node next to it; rounds are O(log^2 n), and every step
is an aggregation and an equi-join, so a hub's edges are pre-aggregated and its join can be split.
Each round's edges are written to the shared folder, which cuts the lineage. As soon as FEW edges or fewer are
left, one task follows them to their ends: some megabytes at most, whatever the input, in place of the last
rounds of small shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.sources.scratch import drop, materialise

#: Edges that one task may finish.
FEW = 1 << 17


def _followed(edges: DataFrame) -> DataFrame:
    """Stars of all edges, made in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in parent]
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found if x[0] != x[1]], kind.field(k).type) for k in (0, 1)], schema=kind)

    return edges.select("u", "v").repartition(1).mapInArrow(run, edges.schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node points at one other at most, and none that is pointed at points."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out = 1 and `in` = 1)").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) for every id that a link names; the component is its smallest id.

    Null ends and links of a node to itself tell nothing; repeated links count once."""
    edges = materialise(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(rounds):
        if edges.count() <= FEW:
            edges = materialise(_followed(edges), "edges")
            break
        before, edges = edges, materialise(_small_star(_large_star(edges)).distinct(), "edges")
        drop(before)
        if _settled(edges):
            break
    else:
        raise RuntimeError(f"the components are not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

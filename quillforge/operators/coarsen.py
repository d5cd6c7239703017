"""Coarse views of a graph: at most `target` groups of nodes, their titles, and the edges between them.

Large graphs, and views far smaller than their graph, are grouped by directories, in DataFrames
throughout. Only graphs below SMALL nodes and edges are grouped by their edges; that bound is what
allows a plain loop over them on the driver."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions.text import path_prefix
from quillforge.operators.graph import quotient

# Nodes and edges from which a graph is grouped by directories.
SMALL = (1500, 7500)
DEEPEST = 32


def by_directories(nodes: DataFrame, target: int) -> DataFrame:
    """(node, grp): the shallowest directory depth that has `target` groups; the smallest groups beyond
    target - 1 are one, and where there are too few, the largest are halved by a hash of the name."""
    keys = F.coalesce(path_prefix(F.col("path"), DEEPEST), F.lit(""))
    rows = nodes.select("node", F.split(keys, "/").alias("_p"))
    at = lambda d: F.array_join(F.slice("_p", 1, d), "/")
    most = min(rows.agg(F.max(F.size("_p"))).first()[0] or 1, DEEPEST)
    counts = rows.agg(*(F.count_distinct(at(d)).alias(str(d)) for d in range(1, most + 1))).first()
    depth = next((d for d in range(1, most + 1) if counts[str(d)] >= target), most)
    named = rows.select("node", at(depth).alias("grp"))
    size = named.groupBy("grp").agg(F.count("*").alias("_n"))
    found = counts[str(depth)]
    if found > target:
        order = F.row_number().over(Window.orderBy(F.desc("_n"), "grp"))  # directories, not nodes
        kept = size.withColumn("_k", order).select("grp", F.when(F.col("_k") < target, F.col("grp")).otherwise("(other)").alias("_to"))
        return named.join(kept, "grp").select("node", F.col("_to").alias("grp"))
    bit = 0
    while found < target and bit < 40:
        largest = named.groupBy("grp").agg(F.count("*").alias("_n")).filter("_n > 1").orderBy(F.desc("_n"), "grp").limit(target - found)
        if largest.isEmpty():
            break
        half = F.concat("grp", F.lit(f"#{bit}."), F.getbit(F.xxhash64("node"), F.lit(bit)).cast("string"))
        named = named.join(F.broadcast(largest.select("grp", F.lit(True).alias("_split"))), "grp", "left").select("node", F.when(F.col("_split"), half).otherwise(F.col("grp")).alias("grp"))  # at most `target` rows
        found, bit = named.agg(F.count_distinct("grp")).first()[0], bit + 1
    return named


def by_edges(nodes: list[str], edges: list[tuple[str, str]], target: int) -> dict[str, str]:
    """Node to group (named by its least node): join the pair that raises modularity most while one does,
    then the smallest group to the neighbour with most edges, until there are `target`."""
    group = {n: {n} for n in nodes}
    weight: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for a, b in edges:
        if a != b:
            weight[a][b] += 1
            weight[b][a] += 1
    degree = {n: sum(weight[n].values()) for n in nodes}
    total = sum(degree.values()) or 1

    def join(a: str, b: str) -> None:
        a, b = min(a, b), max(a, b)
        group[a] |= group.pop(b)
        degree[a] += degree.pop(b)
        for c, w in weight.pop(b, {}).items():
            weight[c].pop(b, None)
            if c != a:
                weight[a][c] += w
                weight[c][a] += w
        weight[a].pop(b, None)

    while len(group) > target:
        gains = [(w / total - 2 * degree[a] * degree[b] / total**2, a, b) for a in group for b, w in weight[a].items() if a < b]
        gain, a, b = max(gains, key=lambda g: (g[0], [-ord(c) for c in g[1] + g[2]]), default=(0, "", ""))
        if gain <= 0:
            break
        join(a, b)
    while len(group) > target:
        small = min(group, key=lambda g: (len(group[g]), g))
        near = max(weight[small], key=lambda g: (weight[small][g], -len(group[g])), default=None)
        join(small, near or min((g for g in group if g != small), key=lambda g: (len(group[g]), g)))
    return {n: name for name, members in group.items() for n in members}


def coarsen(nodes: DataFrame, edges: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """(groups(node, grp), quotient edges(src, dst, weight)); nodes has (node, path)."""
    spark, target = nodes.sparkSession, max(1, target)
    n, m = nodes.count(), edges.count()
    if target == 1:
        groups = nodes.select("node", F.lit("codebase").alias("grp"))
    elif 2 * target < n or n >= SMALL[0] or m >= SMALL[1]:
        groups = by_directories(nodes, target)
    else:
        found = by_edges(sorted(r.node for r in nodes.select("node").collect()), sorted((r.src, r.dst) for r in edges.select("src", "dst").collect()), target)
        groups = spark.createDataFrame(sorted(found.items()), "node string, grp string")
    return groups, quotient(edges, groups)


def titles(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grp, title): the directories that all paths of a group share, `mixed` if none, `external` without paths."""
    parts = groups.join(nodes, "node", "left").select("grp", F.filter(F.split(path_prefix(F.col("path"), DEEPEST), "/"), lambda p: p != "").alias("p"))
    ends = parts.groupBy("grp").agg(F.min("p").alias("a"), F.max("p").alias("b"))  # what the least and largest share, all share
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.size("a"), F.lit(1))), lambda i: F.slice("a", F.lit(1), i) == F.slice("b", F.lit(1), i))
    common = F.slice("a", F.lit(1), F.size(F.filter(same, lambda x: x)))
    return ends.select("grp", F.when(F.col("a").isNull(), "external").when(F.size(common) == 0, "mixed").otherwise(F.array_join(common, "/")).alias("title"))

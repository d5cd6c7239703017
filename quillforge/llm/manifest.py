"""A Merkle manifest of a dataset: a digest of every row, a tree for each group, one root, and proofs.

A row's leaf is the digest of its fields. The leaves of a group stand in the order of their ids and are
numbered by Spark (dealt by range, counted part by part), so that a group of any size is cut into
aligned blocks of 2^BLOCK leaves. A task visits the tree of a block in postorder: a visit returns the
subtree's digest, and on the way back appends the sibling's to the path of every leaf below. The blocks'
roots are the leaves of the next traversal, until a group has one node, its subroot; the subroots make
one more tree, whose last node is the root. Then paths come down the same way: a block's own path is
continued by that of its root. Of a row only digests are shuffled, and no path before the last step.

Cases: a null field is `-`; an empty text is a field of 0 bytes; a null group is a group of its own, the
first; rows with a null id come first in theirs, and rows that repeat an id stand in the order of their
leaves; a long text is hashed where it is read; a group of one row is its own subroot, and one group
alone its own root; an empty table gives no rows; columns that are no fields are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.llm.common import materialise, parallelism, table

#: A block has 2^BLOCK leaves at most.
BLOCK = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree string, rank long, n long, digest string"
_STEP = re.compile(r"([LR])([0-9a-f]{64})|-")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def tree_of(group: Column) -> Column:
    """Names of trees in the order of their groups, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def visit(nodes: list[str], height: int, paths: list[list[str]]) -> str:
    """The digest over `nodes`, `height` levels up; each leaf's path gets a sibling (L or R), or -, a level."""

    def below(low: int, high: int, height: int) -> str:
        if not height:
            return nodes[low]
        middle = low + (1 << (height - 1))
        left = below(low, min(middle, high), height - 1)
        if middle >= high:
            for path in paths[low:high]:
                path.append("-")
            return digest(left)
        right = below(middle, high, height - 1)
        for path in paths[low:middle]:
            path.append("R" + right)
        for path in paths[middle:high]:
            path.append("L" + left)
        return digest(left, right)

    return below(0, len(nodes), height)


def siblings(path: str) -> list[str]:
    return [m[2] for m in _STEP.finditer(path) if m[2]]


def fold(node: str, path: str) -> str:
    """The root that a leaf and its path lead to."""
    for m in _STEP.finditer(path):
        node = digest(m[2], node) if m[1] == "L" else digest(node, m[2]) if m[1] == "R" else digest(node)
    return node


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """rows with their `rank` from 0 in their `tree` by the columns `by`, and the tree's size `n`."""
    dealt = rows.repartitionByRange(parallelism(rows.sparkSession), "tree", *by).sortWithinPartitions("tree", *by)
    placed = materialise(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "placed")
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    parts = parts.select("tree", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    return placed.join(parts, ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("rank", bits))


def _visited(rows: pa.Table, bits: int) -> tuple[pa.Table, str, list[list[str]]]:
    """The rows of a block in order, its root, and the paths of its leaves."""
    rows = rows.sort_by("rank")
    n = rows.column("n")[0].as_py()
    height = bits if n > 1 << bits else (n - 1).bit_length()
    paths: list[list[str]] = [[] for _ in range(rows.num_rows)]
    return rows, visit(rows.column("digest").to_pylist(), height, paths), paths


def climb(leaves: DataFrame, bits: int = BLOCK) -> list[DataFrame]:
    """Tables (tree, rank, n, digest) from the leaves to one node a tree."""

    def run(rows: pa.Table) -> pa.Table:
        rows, root, _ = _visited(rows, bits)
        first = rows.slice(0, 1).to_pylist()[0]
        return pa.table({"tree": [first["tree"]], "rank": [first["block"]], "n": [-(-first["n"] >> bits)], "digest": [root]})

    levels = [leaves]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        up = _blocks(levels[-1], bits).select("tree", "rank", "n", "digest", "block").groupBy("tree", "block").applyInArrow(run, _NODE)
        levels.append(materialise(up, "nodes"))
    return levels


def descend(levels: list[DataFrame], above: DataFrame, carried: dict[str, str], bits: int = BLOCK) -> DataFrame:
    """The leaves' columns `carried` (with their types), with their `path` to the root and their `subroot`.

    above has (tree, rank, path, subroot) of the last of the levels."""
    def continued(own: dict[str, str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(rows: pa.Table, upper: pa.Table) -> pa.Table:
            rows, _, paths = _visited(rows, bits)
            more = upper.slice(0, 1).to_pylist()[0]
            out = rows.select(list(own))
            return out.append_column("path", pa.array(["".join(p) + more["path"] for p in paths])).append_column("subroot", pa.array([more["subroot"]] * len(paths), pa.string()))

        return run

    for k in range(len(levels) - 2, -1, -1):
        own = carried if k == 0 else {"tree": "string", "rank": "long"}
        nodes = _blocks(levels[k], bits).groupBy("tree", "block")
        upper = above.withColumnRenamed("rank", "block").groupBy("tree", "block")
        above = nodes.cogroup(upper).applyInArrow(continued(own), ", ".join(f"`{c}` {t}" for c, t in own.items()) + ", path string, subroot string")
        if k:
            above = materialise(above, "paths")
    if len(levels) == 1:  # every tree is one leaf
        above = levels[0].join(above, ["tree", "rank"]).select(*carried, "path", "subroot")
    return above


def proofs(leaves: DataFrame, carried: dict[str, str], bits: int = BLOCK) -> tuple[DataFrame, str | None]:
    """(carried columns, path, subroot) of leaves (tree, id, digest, ...), and the root (None without leaves)."""
    levels = climb(ranked(leaves, "id", "digest"), bits)
    tops = materialise(ranked(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name"), "tops")
    upper = climb(tops, bits)
    root = upper[-1].first()
    last = upper[-1].select("tree", "rank", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"))
    down = descend(upper, last, {"name": "string", "digest": "string"}, bits)
    above = materialise(down.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("rank"), "path", F.col("digest").alias("subroot")), "above")
    return descend(levels, above, carried, bits), root and root.digest


def checked(found: DataFrame, root: str | None) -> DataFrame:
    """Rows of `proofs` that carry `seen`, a leaf as found now: digest of the siblings, and where `seen` leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            folded = [fold(x, p) for x, p in zip(batch.column("seen").to_pylist(), paths, strict=True)]
            rest = batch.drop_columns(["path"])
            yield rest.append_column("proof_sha256", pa.array([digest(*siblings(p)) for p in paths], pa.string())).append_column("folded_root", pa.array(folded, pa.string()))

    kept = found.drop("path")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    out = found.select(*kept.columns, "path").mapInArrow(run, f"{schema}, proof_sha256 string, folded_root string")
    return out.withColumn("root", F.lit(root).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame, bits: int = BLOCK) -> DataFrame:
    """Leaf, proof and verdict of every document, held against a copy in which some rows' n_chars are one more."""
    columns = {c: F.col(c) for c in FIELDS}
    changed = columns | {"n_chars": F.col("n_chars") + 1}
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    own = leaf(*columns.values())
    leaves = docs.select(tree_of(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("id"), own.alias("digest"), F.when(touched, leaf(*changed.values())).alias("changed"))
    found, root = proofs(materialise(leaves, "digests"), {"id": "long", "digest": "string", "changed": "string"}, bits)
    out = checked(found.select("id", "digest", F.coalesce("changed", "digest").alias("seen"), "path", "subroot"), root)
    return out.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of `documents`: proofs of all rows, and what they say of a tampered copy."""
    return tampered(table(spark, sf_dir, "documents"))


#: crc32 has no name here: the bits of each digit are shifted through, one after another.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(**other: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(other.get(c, c)) for c in FIELDS) + ")"


OP12_SQL = f"""
WITH RECURSIVE base AS (
    SELECT doc_id, lang, {_leaf_sql()} AS leaf, CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql(n_chars="(n_chars + 1)")} ELSE {_leaf_sql()} END AS seen FROM documents
), leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM base),
tree AS (
    SELECT lang, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
    UNION ALL
    SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, idx // 2
), subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
    SELECT 0 AS level, idx, h, n FROM subroots
    UNION ALL
    SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, idx // 2
), steps AS (
    SELECT l.lang, l.idx, t.level, (l.idx >> t.level) & 1 AS side, s.h
    FROM leaves l JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.idx = xor(l.idx >> t.level, 1)
    UNION ALL
    SELECT l.lang, l.idx, 1000 + t.level, (r.idx >> t.level) & 1, s.h
    FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) t
    LEFT JOIN top s ON s.level = t.level AND s.idx = xor(r.idx >> t.level, 1)
), numbered AS (SELECT *, row_number() OVER (PARTITION BY lang, idx ORDER BY level) AS k FROM steps),
folded AS (
    SELECT lang, idx, 0 AS k, seen AS h FROM leaves
    UNION ALL
    SELECT f.lang, f.idx, f.k + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.side = 1 THEN s.h || f.h ELSE f.h || s.h END)
    FROM folded f JOIN numbered s ON s.lang IS NOT DISTINCT FROM f.lang AND s.idx = f.idx AND s.k = f.k + 1
), ends AS (SELECT lang, idx, arg_max(h, k) AS h FROM folded GROUP BY ALL),
proof AS (SELECT lang, idx, sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS proof_sha256 FROM numbered GROUP BY ALL)
SELECT l.doc_id, l.leaf, r.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.idx = l.idx
LEFT JOIN proof p ON p.lang IS NOT DISTINCT FROM l.lang AND p.idx = l.idx
"""

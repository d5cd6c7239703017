"""Exact top-k inner products by KD-trees: one over the shards, one inside each shard.

A tree splits at the median of its widest dimension and keeps the tight box of every node. The upper
levels are fitted on a bounded sample (SAMPLE rows or SAMPLE_BYTES, whichever is less) and only deal
the vectors out: each of their cells is a shard, a cell with more than SHARD_ROWS vectors (copies of
one vector, say) several. In a shard the tree goes down to leaves of LEAF rows. A query walks it best
box first: the largest inner product that any point of the box could have is the bound, and the walk
ends when no open box can reach the query's k-th score.

Queries first search the shard that holds them. The k-th score found there is held against the boxes
of the others (merged to BOXES at most, so that what is sent to the tasks is bounded), and a query goes,
with that score, only to those that could reach it; a shard is sent on once for QUERY_BLOCK of its queries.

Cases: vectors that are null, empty, or hold a null or non-finite component take no part; only
vectors of the same length are compared; a query's own id is no candidate, however often it
occurs; rows that repeat another id are candidates each; an id that several query rows have asks
once, with the shortest and then least of their vectors; ties go to the smaller id; fewer than k
candidates give fewer rows; an empty table gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.llm.common import materialise, parallelism, table

SHARD_ROWS, LEAF, QUERY_BLOCK = 8192, 512, 8192
SAMPLE, SAMPLE_BYTES, BOXES = 16384, 32 << 20, 4096
LEAST = np.iinfo(np.int64).min
FOUND = "query_id long, vec_id long, score long"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
PLACED = "vec_id long, n int, cell int, v binary"
#: Shards of a cell are cell * SALTS + salt.
SALTS = 1 << 20


class Tree:
    """Rows of integers (as float64, or Python integers where sums could pass 2^53)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        low, high, by = [], [], np.arange(len(rows))
        todo = [(0, len(rows), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node, part = len(self.spans), rows[by[a:b]]
            if parent >= 0:
                self.children[parent][side] = node
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            self.spans.append((a, b))
            width = high[-1] - low[-1]
            if b - a <= leaf or not width.max() > 0:
                self.children.append(None)
                continue
            self.children.append([0, 0])
            middle = (b - a) // 2
            by[a:b] = by[a:b][np.argpartition(part[:, int(np.argmax(width))], middle)]
            todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.ids, self.rows = ids[by], rows[by]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each node and query, the largest inner product that the node's box allows."""
        return self.high @ np.maximum(queries, 0).T + self.low @ np.minimum(queries, 0).T

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k, none below `least`; ties at the end go to smaller ids."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least:
            _, node = heapq.heappop(heap)
            if (pair := self.children[node]) is not None:
                for child in pair:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.spans[node]
            score = self.rows[a:b] @ query
            keep = (score >= least) & (self.ids[a:b] != own)
            ids, scores = np.concatenate([ids, self.ids[a:b][keep]]), np.concatenate([scores, score[keep]])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) >= k:
                least = max(least, scores.min())
        return ids, scores


def _pack(row: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all."""
    most = float(np.abs(row).max())
    return row.astype(np.int8 if most < 128 else np.int16 if most < 32768 else np.float64).tobytes()


def _matrix(packed: pa.ChunkedArray, n: int) -> np.ndarray:
    kinds = {n: np.int8, 2 * n: np.int16, 8 * n: np.float64}
    rows = packed.to_pylist()
    return np.array([np.frombuffer(r, kinds[len(r)]) for r in rows], dtype=np.float64).reshape(len(rows), n)


class Cells:
    """The upper levels of a tree over vectors of one length, as planes; cells are numbered from left to right."""

    def __init__(self, rows: np.ndarray, cells: int):
        self.planes: list[tuple[int, float, int, int] | int] = []
        self.count = 0

        def split(part: np.ndarray, wanted: int) -> int:
            at = len(self.planes)
            width = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
            if wanted <= 1 or not width.max() > 0:
                self.planes.append(self.count)
                self.count += 1
                return at
            self.planes.append(0)
            by = int(np.argmax(width))
            value = float(np.median(part[:, by]))
            left = part[:, by] < value
            if not left.any():  # the median is the least value
                value = float(part[:, by][part[:, by] > value].min())
                left = part[:, by] < value
            self.planes[at] = (by, value, split(part[left], wanted // 2), split(part[~left], wanted - wanted // 2))
            return at

        split(rows, cells)

    def of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            at, who = todo.pop()
            plane = self.planes[at]
            if isinstance(plane, int):
                out[who] = plane
                continue
            left = rows[who, plane[0]] < plane[1]
            todo += [(plane[2], who[left]), (plane[3], who[~left])]
        return out


def _exact(*parts: np.ndarray) -> list[np.ndarray]:
    most = max((float(np.abs(p).max()) if p.size else 0.0) for p in parts)
    if most * most * parts[0].shape[1] < 2**53:
        return list(parts)
    return [np.array([[int(x) for x in row] for row in p], dtype=object).reshape(p.shape) for p in parts]


def _answers(tree: Tree, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> pa.Table:
    own, found, scores = [], [], []
    for a in range(0, len(ids), 256):
        bounds = tree.bounds(queries[a : a + 256])
        for j in range(bounds.shape[1]):
            i, s = tree.search(queries[a + j], bounds[:, j], int(ids[a + j]), k, int(least[a + j]))
            own.append(np.full(len(i), ids[a + j]))
            found.append(i)
            scores.append(np.clip(s, LEAST, -LEAST - 1).astype(np.int64))
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (own, found, scores)]
    return pa.table([pa.array(x, pa.int64()) for x in joined], schema=_FOUND)


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, n): floor(scale * x) of whole vectors of finite components."""
    x = F.col(vector_col)
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    floor = F.transform(x, lambda c: F.rint(F.floor(c.cast("double") * scale).cast("double")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector_col).filter(F.col("vec_id").isNotNull() & whole).select("vec_id", floor.alias("v"), F.size(x).alias("n"))


def _cells(points: DataFrame, shards: int) -> dict[int, Cells]:
    """Cells by length of the vectors, from a sample that does not grow with them."""
    longest = points.agg(F.max("n")).first()[0] or 1
    drawn = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * longest)))).select("n", "v").toArrow()
    lengths = drawn.column("n").to_numpy()
    rows = drawn.column("v").to_pylist()
    return {int(n): Cells(np.array([rows[k] for k in np.flatnonzero(lengths == n).tolist()], dtype=np.float64), max(1, round(shards * float((lengths == n).mean())))) for n in np.unique(lengths)}


def _placed(points: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy()
            flat, at = batch.column(2).flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])
            cell, packed = np.zeros(len(n), np.int32), [b""] * len(n)
            for size in np.unique(n).tolist():
                who = np.flatnonzero(n == size)
                rows = flat[at[who][:, None] + np.arange(size)]
                if size in cells:
                    cell[who] = cells[size].of(rows)
                for k, row in zip(who.tolist(), rows, strict=True):
                    packed[k] = _pack(row)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(cell), pa.array(packed, pa.binary())], names=["vec_id", "n", "cell", "v"])

    return points.select("vec_id", "n", "v").mapInArrow(run, PLACED)


def _merged_boxes(boxes: DataFrame, step: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: groups of `step` neighbouring cells, with the low and high corners of what they hold."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        n = key[1].as_py()
        low, high = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.float64).reshape(-1, n) for c in ("low", "high"))
        return pa.table([[key[0].as_py()], [n], [low.min(axis=0).tobytes()], [high.max(axis=0).tobytes()]], schema=pa.schema([("part", pa.int32()), ("n", pa.int32()), ("low", pa.binary()), ("high", pa.binary())]))

    found = boxes.withColumn("part", F.floor(F.col("cell") / step).cast("int")).groupBy("part", "n").applyInArrow(merge, "part int, n int, low binary, high binary").collect()  # BOXES rows at most for a length
    return {n: (np.array([r.part for r in found if r.n == n]), *(np.array([np.frombuffer(r[c], np.float64) for r in found if r.n == n]) for c in ("low", "high"))) for n in {r.n for r in found}}


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row that is_query (of vec_id) selects."""
    points = scaled(vectors, id_col, vector_col, scale)
    rows = points.count()
    parallel = parallelism(vectors.sparkSession)
    shards = max(1, -(-rows // SHARD_ROWS), min(parallel, -(-8 * rows // SHARD_ROWS)))  # small tables are dealt finer, to use the cores
    cells = _cells(points, shards)
    step = max(1, -(-max((c.count for c in cells.values()), default=1) // BOXES))
    placed = materialise(_placed(points, cells), "vectors")
    sizes = placed.groupBy("cell", "n").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("_salts"))
    salt = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("_salts"))
    dealt = placed.join(sizes, ["cell", "n"]).withColumn("shard", F.col("cell") * F.lit(SALTS).cast("long") + salt).drop("_salts")
    chosen = dealt.filter(F.coalesce(is_query, F.lit(False))).groupBy("vec_id").agg(F.min(F.struct("n", "v", "shard", "cell")).alias("x"))
    queries = materialise(chosen.select("vec_id", "x.n", "x.v", "x.shard"), "queries")
    own = queries.select("vec_id", "n", "v", "shard", F.lit(True).alias("q"))
    stored = dealt.select("vec_id", "n", "v", "shard", F.lit(False).alias("q"))

    def at_home(key: tuple, table: pa.Table) -> pa.Table:
        ids, v = table.column("vec_id").to_numpy(), _exact(_matrix(table.column("v"), key[1].as_py()))[0]
        asked = table.column("q").to_numpy(zero_copy_only=False)
        tree = Tree(ids[~asked], v[~asked])
        found = _answers(tree, ids[asked], v[asked], np.full(int(asked.sum()), LEAST), k)
        corner = lambda c: pa.array([None] * found.num_rows + [c[0].astype(np.float64).tobytes()], pa.binary())
        whole = pa.concat_tables([found, pa.table([[None], [None], [None]], schema=_FOUND)])
        n = whole.num_rows
        for name, column in (("shard", pa.array([key[0].as_py()] * n, pa.int64())), ("n", pa.array([key[1].as_py()] * n, pa.int32())), ("low", corner(tree.low)), ("high", corner(tree.high))):
            whole = whole.append_column(name, column)
        return whole

    visited = materialise(stored.unionByName(own).groupBy("shard", "n").applyInArrow(at_home, FOUND + ", shard long, n int, low binary, high binary"), "home")
    home = visited.filter("query_id is not null").select("query_id", "vec_id", "score")
    boxes = visited.filter("low is not null").select("shard", "n", "low", "high", F.floor(F.col("shard") / SALTS).cast("int").alias("cell"))
    merged = _merged_boxes(boxes, step)
    least = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(LEAST)).alias("least"))
    asked = queries.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(LEAST)))

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, floor = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            for n in np.unique(length).tolist():
                who = np.flatnonzero(length == n)
                part, low, high = merged[n]
                for a in range(0, len(who), 256):
                    some = who[a : a + 256]
                    v = _matrix(batch.column(2).take(pa.array(some)), n)
                    bound = np.maximum(v, 0) @ high.T + np.minimum(v, 0) @ low.T
                    q, p = np.nonzero(bound + 1e-9 * np.abs(bound) + 1 >= floor[some][:, None])  # bounds of huge components are rounded
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some[q])) for c in range(5)), pa.array(part[p].astype(np.int32))], names=["vec_id", "n", "v", "home", "least", "part"])

    pairs = asked.select("vec_id", "n", "v", F.col("shard").alias("home"), "least").mapInArrow(reachable, "vec_id long, n int, v binary, home long, least long, part int")
    there = boxes.select("shard", "n", F.floor(F.col("cell") / step).cast("int").alias("part"))
    pairs = materialise(pairs.join(there, ["part", "n"]).filter("shard <> home").drop("part", "home"), "pairs")
    blocks = pairs.groupBy("shard", "n").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    away = pairs.join(blocks, ["shard", "n"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    copies = stored.join(blocks, ["shard", "n"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "q")

    def elsewhere(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        n = key[1].as_py()
        rows, queries = _exact(_matrix(right.column("v"), n), _matrix(left.column("v"), n))
        return _answers(Tree(right.column("vec_id").to_numpy(), rows), left.column("vec_id").to_numpy(), queries, left.column("least").to_numpy(), k)

    found = home.unionByName(away.groupBy("shard", "n", "block").cogroup(copies.groupBy("shard", "n", "block")).applyInArrow(elsewhere, FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products for every twentieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 20
"""

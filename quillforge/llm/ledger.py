"""Global lookups of hashed keys without a row for each key.

Documents are dealt into chunks by their id. A chunk posts its distinct keys with one value each
(so a key that a third of all documents hold counts once a chunk), packed into one row for each
bucket of the key space. A bucket combines the values of equal keys and replies to every chunk
that posted; the chunk meets its replies in a cogroup. Keys are one or two unsigned 64-bit words,
values 64-bit integers (written as bytes of 8 bits where all of a row fit), both as binary columns;
a mark of 8 bits may stand beside a key. Chunks and buckets are counted from the bytes of the input,
so that what a task holds grows neither with it nor with the length of its texts (but for one text
longer than a chunk). Where a table is so large that a chunk has fewer keys than there are buckets,
a post holds one key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of texts, or of what stands for them, in a chunk, about.
CHUNK_BYTES = 5 << 20

POST = "bucket int, chunk int, keys binary, vals binary, marks binary"
REPLY = "chunk int, keys binary, vals binary"
_POST = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary()), ("marks", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])


def chunk_count(size: int, rows: int, parallelism: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(1, min(parallelism, rows), -(-size // chunk_bytes))


def measure(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(bytes of all texts, rows)."""
    found = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    return int(found.b), int(found.n)


def chunk_of(chunks: int, *by: str) -> Column:
    """By the id and, as an id may be null or stand in many rows, the text."""
    return F.pmod(F.xxhash64(*by), F.lit(chunks)).cast("int")


def order(keys: np.ndarray) -> np.ndarray:
    """Sorting order of keys of shape (n,) or (n, 2)."""
    return np.argsort(keys, kind="stable") if keys.ndim == 1 else np.lexsort((keys[:, 1], keys[:, 0]))


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = keys[1:] != keys[:-1]
    return np.flatnonzero(np.concatenate([[True], new if keys.ndim == 1 else new.any(axis=1)]))


#: How values of a key are combined: how(values in order of their keys, first place of each key).
Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]
add: Combine = np.add.reduceat
least: Combine = np.minimum.reduceat

def combine(keys: np.ndarray, values: np.ndarray, how: Combine) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the values of each combined."""
    by = order(keys)
    keys, values = keys[by], values[by]
    at = runs(keys)
    return keys[at], how(values, at) if len(at) else values


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key is in a sorted table of distinct keys, or -1."""
    if not len(table):
        return np.full(len(keys), -1, dtype=np.int64)
    if table.ndim == 1:
        at = np.searchsorted(table, keys)
        at[at == len(table)] = 0
        return np.where(table[at] == keys, at, -1)
    at = np.searchsorted(table[:, 0], keys[:, 0])
    out = np.full(len(keys), -1, dtype=np.int64)
    left = np.arange(len(keys))
    while len(left):  # more than once only if two keys share their first word
        left = left[at[left] < len(table)]
        left = left[table[at[left], 0] == keys[left, 0]]
        same = table[at[left], 1] == keys[left, 1]
        out[left[same]] = at[left[same]]
        left = left[~same]
        at[left] += 1
    return out


def pack(values: np.ndarray) -> bytes:
    small = not len(values) or (values.min() >= 0 and values.max() < 256)
    return values.astype(np.uint8 if small else np.int64).tobytes()


def posts(chunk: int, keys: np.ndarray, values: np.ndarray, buckets: int, marks: np.ndarray | None = None) -> pa.Table:
    """Rows of POST for the (distinct) keys of one chunk."""
    first = keys if keys.ndim == 1 else keys[:, 0]
    bucket = (first % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    bucket, keys, values = bucket[by], keys[by], values[by]
    at = runs(bucket)
    edges = np.append(at, len(bucket)).tolist()
    pairs = list(zip(edges[:-1], edges[1:], strict=True))
    marked = [None] * len(pairs) if marks is None else [marks[by][a:b].astype(np.uint8).tobytes() for a, b in pairs]
    return pa.table([pa.array(bucket[at], pa.int32()), pa.array([chunk] * len(at), pa.int32()), pa.array([keys[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([pack(values[a:b]) for a, b in pairs], pa.binary()), pa.array(marked, pa.binary())], schema=_POST)


def unpack(table: pa.Table, words: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of all rows of POST or REPLY."""
    packed = table.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(packed), dtype=np.uint64)
    each = [np.frombuffer(v, np.uint8 if len(v) * 8 * words == len(k) else np.int64).astype(np.int64) for k, v in zip(packed, table.column("vals").to_pylist(), strict=True)]
    return keys if words == 1 else keys.reshape(-1, words), np.concatenate(each) if each else np.zeros(0, np.int64)


def sorted_reply(table: pa.Table, words: int = 1) -> tuple[np.ndarray, np.ndarray]:
    keys, values = unpack(table, words)
    by = order(keys)
    return keys[by], values[by]


#: In place of a chunk, rows of a bucket's own totals: (keys,) values (number of keys with a value, sum).
SUMMARY = -1
#: Buckets below zero hold a side table; each replies its combined rows under this in place of a chunk.
SIDE = -2


def replies(posted: DataFrame, how: Combine, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], words: int = 1, summary: bool = False) -> DataFrame:
    """Rows of REPLY: for each chunk, those of its keys that are kept, with the combined value.

    keep(combined value, own value, mark) tells which; it sees one entry for each chunk and key."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, values = unpack(table, words)
        sizes = [len(k) // (8 * words) for k in table.column("keys").to_pylist()]
        distinct, total = combine(keys, values, how)
        if key[0].as_py() < 0:
            return pa.table([[SIDE], [distinct.tobytes()], [pack(total)]], schema=_REPLY)
        whole = total[find(distinct, keys)]
        marks = np.frombuffer(b"".join(m or bytes(n) for m, n in zip(table.column("marks").to_pylist(), sizes, strict=True)), np.uint8)
        kept = keep(whole, values, marks)
        out, at = [], 0
        if summary:
            out.append((SUMMARY, b"", np.array([(total > 0).sum(), total.sum()], np.int64).tobytes()))
        for chunk, n in zip(table.column("chunk").to_pylist(), sizes, strict=True):
            mine = kept[at : at + n]
            if mine.any():
                out.append((chunk, keys[at : at + n][mine].tobytes(), pack(whole[at : at + n][mine])))
            at += n
        return pa.table(list(map(list, zip(*out, strict=True))) if out else [[], [], []], schema=_REPLY)

    return posted.groupBy("bucket").applyInArrow(run, REPLY)

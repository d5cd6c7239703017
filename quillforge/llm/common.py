"""Shared parts: table access, materialised tables, and vectorised word splitting.

Text helpers work on Arrow string arrays and never loop over bytes in Python. A word is a
maximal run of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillforge.sources.scratch import materialise

__all__ = ["Words", "byte_view", "mapped", "materialise", "mix", "parallelism", "slices", "strings", "table", "windows"]

#: Text handled at once by the vectorised helpers; a longer document is still taken whole.
SLICE_BYTES = 4 << 20
HASHED_BYTES = 1 << 19

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MULT = 0xD6E8FEB86659FD93
_INV = pow(_MULT, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """docs with its rows rewritten; columns may have any names, and `run` finds them by their places."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A contiguous string array with nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def byte_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 values) of a string array without nulls; no copy of the text."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], dtype=width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of text (or one longer document)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_view(strings(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, HASHED_BYTES + (1 << 16))
        for name, base in (("_powers", _MULT), ("_inverses", _INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """Words of a slice of texts: byte spans, first word of each document, 64-bit hashes."""

    def __init__(self, array: pa.Array, lower: bool = False):
        data, self.offsets = byte_view(array)
        self.data = _LOWER[data] if lower else data
        inside = ~_WS[data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: words of document d are first[d]:first[d + 1]
        self.first = np.searchsorted(self.start, self.offsets)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            h = np.empty(len(self.start), np.uint64)
            k = 0
            while k < len(h):  # so many bytes at once that the sums stay small
                base = self.start[k]
                upto = max(int(np.searchsorted(self.end, base + HASHED_BYTES, side="right")), k + 1)
                part = self.data[base : self.end[upto - 1]]
                power, inverse = _power_tables(len(part) + 1)
                total = np.empty(len(part) + 1, np.uint64)
                total[0] = 0
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
                first = self.start[k:upto] - base
                h[k:upto] = (total[self.end[k:upto] - base] - total[first]) * inverse[first]
                k = upto
            h += (self.end - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            self._hash = mix(h)
        return self._hash

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(word_hash: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive words; entries that cross documents are the caller's."""
    n = len(word_hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h *= np.uint64(0x9FB21C651E98DF25)
        h += word_hash[k : k + n]
        h ^= h >> np.uint64(31)
    return mix(h)

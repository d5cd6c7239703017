"""Substring dedup by level-wise doubling over words.

Windows of `length` words that start in two documents are wanted. The lengths of the levels double
from a short one up to `length` (7, 13 for 13; 7, 13, 25, 50 for 50). At each level a full window
stands for itself by the least hash among the shorter windows inside it, which equal windows share;
only full windows whose short one is repeated across documents go on to the next length, and the
levels end at `length` or when no candidate survives. At the last level keys have 128 bits and the
smallest document of each window is found. A word goes if a window covers it that also starts in a
document with a smaller id; all windows are those of the input.

Text is shuffled once, into chunks by id; what is posted at a level is each chunk's distinct hashes
(see ledger), so copies and common passages count once a chunk.

Cases: null and empty texts have no words; documents shorter than a window lose nothing; a null id
counts as larger than any other; rows with the same id do not cover each other; in a text that is
cut, what is left keeps its bytes, white space included; very long texts are taken whole; an empty
table gives no rows; extra columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm import ledger
from quillforge.llm.common import Words, mix, parallelism, strings, table, windows

SHORTEST = 7
NO_ID = np.iinfo(np.int64).max


def levels(length: int) -> list[int]:
    """Lengths from short to full, each at most twice the one before it."""
    found = [length]
    while found[0] > SHORTEST:
        found.insert(0, -(-found[0] // 2))
    return found


class Chunk:
    """Words and ids of the documents of a chunk."""

    def __init__(self, rows: pa.ChunkedArray, id_col: str, text_col: str):
        self.rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
        self.texts = strings(self.rows.field(text_col))
        self.ids = self.rows.field(id_col).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.words = Words(self.texts)

    def full(self, length: int) -> np.ndarray:
        """First words of the windows of `length` that stay inside a document."""
        doc = self.words.doc_of_word()
        n = len(doc) - length + 1
        return np.flatnonzero(doc[:n] == doc[length - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return self.words.doc_of_word()[at]

    def anchors(self, at: np.ndarray, short: int, length: int) -> np.ndarray:
        """The least hash of the windows of `short` words in each window of `length` that starts at `at`."""
        h = windows(self.words.hash, short)
        run = length - short + 1
        return sliding_window_view(h, run).min(axis=1)[at] if len(h) >= run else np.zeros(0, np.uint64)

    def whole(self, at: np.ndarray, length: int) -> np.ndarray:
        """128-bit keys of the windows of `length`."""
        other = mix(self.words.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        return np.stack([windows(self.words.hash, length)[at], windows(other, length)[at]], axis=1)


def _post_level(chunk: int, part: Chunk, at: np.ndarray, short: int, length: int, buckets: int) -> pa.Table:
    """Distinct hashes of the chunk, each with the number of ids that hold it."""
    keys, ids = part.anchors(at, short, length), part.ids[part.owner(at)]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[new], ids[new]
    by = np.lexsort((ids, keys))
    keys, ids = keys[by], ids[by]
    first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]) if len(keys) else np.zeros(0, bool)
    return ledger.posts(chunk, *ledger.combine(keys[first], np.ones(int(first.sum()), np.int64), ledger.add), buckets)


def _post_last(chunk: int, part: Chunk, at: np.ndarray, length: int, buckets: int) -> pa.Table:
    """Distinct windows of the chunk, each with its smallest id, marked if the chunk has it under another id too."""
    keys, ids = part.whole(at, length), part.ids[part.owner(at)]
    by = ledger.order(keys)
    keys, ids = keys[by], ids[by]
    first = ledger.runs(keys)
    low, high = (np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)) if len(first) else (ids, ids)
    return ledger.posts(chunk, keys[first], low, buckets, low != high)


def remove_repeats(docs: DataFrame, length: int, finish: Callable[[Chunk, np.ndarray], pa.Table], schema: str | object, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """finish(chunk, mask of the words to remove) gives the rows of the result, chunk by chunk."""
    if length < 1:
        raise ValueError("a window has at least one word")
    spark = docs.sparkSession
    chunks = ledger.chunk_count(*ledger.measure(docs, text_col), parallelism(spark))
    buckets = max(parallelism(spark), chunks // 2)
    dealt = docs.select(ledger.chunk_of(chunks, id_col, text_col).alias("chunk"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    lengths = levels(length)

    def start(key: tuple, left: pa.Table) -> pa.Table:
        part = Chunk(left.column("row"), id_col, text_col)
        at = part.full(length)
        return _post_last(key[0].as_py(), part, at, length, buckets) if len(lengths) == 1 else _post_level(key[0].as_py(), part, at, lengths[0], length, buckets)

    def extend(k: int) -> Callable:
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return ledger.posts(0, np.zeros((0, 2) if k + 1 == len(lengths) else 0, np.uint64), np.zeros(0, np.int64), buckets)
            part = Chunk(left.column("row"), id_col, text_col)
            at = part.full(length)
            repeated, _ = ledger.sorted_reply(right)
            at = at[ledger.find(repeated, part.anchors(at, lengths[k - 1], length)) >= 0]
            chunk = key[0].as_py()
            return _post_last(chunk, part, at, length, buckets) if k + 1 == len(lengths) else _post_level(chunk, part, at, lengths[k], length, buckets)

        return run

    def end(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            left = left.slice(0, 0)
        part = Chunk(left.column("row"), id_col, text_col)
        at = part.full(length)
        seen, first = ledger.sorted_reply(right, 2)
        where = ledger.find(seen, part.whole(at, length)) if len(at) else np.zeros(0, np.int64)
        at, where = at[where >= 0], where[where >= 0]
        at = at[first[where] < part.ids[part.owner(at)]] if len(at) else at
        edge = np.zeros(len(part.words.start) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        return finish(part, np.cumsum(edge[:-1]) > 0)

    posted = dealt.groupBy("chunk").applyInArrow(start, ledger.POST)
    for k in range(1, len(lengths)):
        found = ledger.replies(posted, ledger.add, lambda whole, own, mark: whole > 1)
        posted = dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(extend(k), ledger.POST)
    found = ledger.replies(posted, ledger.least, lambda whole, own, mark: (whole < own) | (mark > 0), words=2)
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(end, schema)


def cut_texts(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the repeated words, and `n_chars` (if there) set to what is left."""

    def finish(part: Chunk, gone: np.ndarray) -> pa.Table:
        words, rows = part.words, part.rows
        names = [f.name for f in rows.type]
        columns = dict(zip(names, rows.flatten(), strict=True))
        texts = part.rows.field(text_col).to_pylist()
        sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else None
        for d in np.unique(words.doc_of_word()[gone]).tolist():
            raw, a, b, base = texts[d].encode(), words.first[d], words.first[d + 1], words.offsets[d]
            start = np.append(words.start[a:b] - base, len(raw))
            keep = ~gone[a:b]  # a word goes with the white space after it
            texts[d] = (raw[: start[0]] + b"".join(raw[x:y] for x, y, k in zip(start[:-1].tolist(), start[1:].tolist(), keep.tolist(), strict=True) if k)).decode()
            if sizes is not None:
                sizes[d] = len(texts[d])
        columns[text_col] = pa.array(texts, columns[text_col].type)
        if sizes is not None:
            columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
        return pa.table(columns)

    return remove_repeats(docs, length, finish, docs.schema, id_col, text_col)


def digest(docs: DataFrame, length: int) -> DataFrame:
    def finish(part: Chunk, gone: np.ndarray) -> pa.Table:
        first = part.words.first
        total = np.concatenate([[0], np.cumsum(gone)])[first]
        removed = np.diff(total)
        shas = []
        for text, a, b, n in zip(part.texts.to_pylist(), first[:-1].tolist(), first[1:].tolist(), removed.tolist(), strict=True):
            words = text.encode().split()
            shas.append(hashlib.sha256(b" ".join(itertools.compress(words, (~gone[a:b]).tolist()) if n else words)).hexdigest())
        return pa.table({"doc_id": part.rows.field("doc_id"), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without words of 13-word windows that an earlier document also has."""
    return digest(table(spark, sf_dir, "documents"), 13)

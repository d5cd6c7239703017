"""Sum-of-squares online packing of token documents into windows.

A document's full windows stand alone. What is left of it is one item, placed into the fill level
that makes the sum over levels of (partially filled windows at that level)^2 smallest; a level
array holds the counts and each level a stack of its open windows. A task packs the rows of its
own input partition, so nothing is shuffled. At its end, and one window at a time while they hold over
OPEN tokens between them, the emptiest open window is dealt to the others by the same rule; only an item
that fits into none of them is cut. The last window is cut into sizes that are powers of two, which take
no padding, as do windows left at such a level.

Cases: a null or empty text is one token, the end id; a document of any length is cut freely;
repeated rows are packed each on its own; ties go to the lowest level; a table without rows has
no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quillforge.llm.chunks import ChunkCoder
from quillforge.llm.common import slices, strings, table

RANKS = "byte_bpe_50k.tiktoken"
WINDOW = 1024
END_ID = 0
#: The added tokens of byte_bpe_50k.json; none holds a space, before which chunks are cut.
ADDED = {"<|endoftext|>": 50256}
#: Tokens that open windows of a task hold at most.
OPEN = 1 << 22
#: Sequence ids are task * TASK + count.
TASK = 1 << 40


class Packer:
    """Online packing of (key, ids); yields (key, start, length, crc, total, sequence, offset)."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0, most: int = OPEN):
        self.window, self.next, self.most = window, first_sequence, most
        #: Open windows at each fill level; level 0 stands for a new window, level `window` for a full one.
        self.count = np.zeros(self.window + 1, dtype=np.int64)
        self.open: list[list[tuple[int, list[tuple]]]] = [[] for _ in range(self.window + 1)]
        self.held = self.placed = self.cut = 0
        self.rest: list[tuple] = []

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def level(self, size: int, new: bool = True) -> int:
        """The level whose use for an item of `size` gives the smallest sum of squared counts; -1 if no open
        window has room and there may be no new one."""
        fits = np.arange(self.window - size + 1)
        gain = 2 * self.count[fits + size] + 1
        gain[-1] = 0  # a full window is no longer partial
        gain[1:] -= 2 * self.count[1 : len(fits)] - 1
        usable = self.count[fits] > 0
        usable[0] = new
        return int(np.argmin(np.where(usable, gain, np.iinfo(np.int64).max))) if usable.any() else -1

    def _take(self, level: int) -> tuple[int, list[tuple]]:
        self.count[level] -= 1
        self.held -= level
        return self.open[level].pop()

    def _place(self, at: int, item: tuple) -> Iterator[tuple]:
        """Put an item into a window of fill level `at`, which is written if that fills it."""
        sequence, held = self._take(at) if at else (self._new(), [])
        held.append(item)
        fill = at + len(item[2])
        if fill == self.window:
            yield from self._write(sequence, held)
        else:
            self.open[fill].append((sequence, held))
            self.count[fill] += 1
            self.held += fill

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        total, w = len(ids), self.window
        whole = total - total % w
        for start in range(0, whole, w):
            yield (key, start, w, zlib.crc32(ids[start : start + w]), total, self._new(), 0)
        if whole < total:
            part = ids[whole:].copy()
            yield from self._place(self.level(len(part)), (key, whole, part, total))
            self.placed += 1
        while self.held > self.most:
            yield from self._dissolve()

    def _dissolve(self) -> Iterator[tuple]:
        """Deal the items of the emptiest window to the other open ones, by the same rule; an item that fits into
        none is cut, to fill the emptiest. What is left when no window is open goes to `rest`."""
        _, items = self._take(int(np.argmax(self.count > 0)))
        items.reverse()
        while items:
            key, start, part, total = items.pop()
            at = self.level(len(part), new=False)
            if at < 0 and self.held:
                at = int(np.argmax(self.count > 0))
                room = self.window - at
                items.append((key, start + room, part[room:], total))
                part = part[:room]
                self.cut += 1
            if at < 0:
                self.rest.append((key, start, part, total))
            else:
                yield from self._place(at, (key, start, part, total))

    @staticmethod
    def _write(sequence: int, held: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, part, total in held:
            yield (key, start, len(part), zlib.crc32(part), total, sequence, offset)
            offset += len(part)

    def close(self) -> Iterator[tuple]:
        """Write what is open: windows whose fill is a power of two as they are, the others filled from the
        emptiest of them, and what is left at last cut into powers of two."""
        for level in range(1, self.window):
            while level & (level - 1) == 0 and self.count[level]:
                yield from self._write(*self._take(level))
        while self.held:
            yield from self._dissolve()
        left = sum(len(item[2]) for item in self.rest)
        self.rest.reverse()
        for bit in range(self.window.bit_length() - 1, -1, -1):
            filled, parts = 0, []
            while left >> bit & 1 and filled < 1 << bit:
                key, start, part, total = self.rest.pop()
                take = min((1 << bit) - filled, len(part))
                parts.append((key, start, part[:take], total))
                if take < len(part):
                    self.rest.append((key, start + take, part[take:], total))
                    self.cut += 1
                filled += take
            if parts:
                yield from self._write(self._new(), parts)


@functools.cache
def load(path: str, added: bool = False) -> ChunkCoder:
    """Byte-level BPE; the rank file holds the vocabulary of byte_bpe_50k.json, id for id. With
    `added` a text is split at ADDED first, whose ids stand for their literals, as the library does by
    default; else the literals are text, as with its encode_special_tokens."""
    special = ADDED if added else {}
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    tokens = {**{t.encode(): k for t, k in special.items()}, **ranks}
    lengths = np.zeros(max(tokens.values()) + 1, dtype=np.int64)
    for token, rank in tokens.items():
        lengths[rank] = len(token)

    def encode(text: str) -> list[int]:
        return encoding.encode(text, allowed_special="all") if any(t in text for t in special) else encoding.encode_ordinary(text)

    return ChunkCoder(lambda chunks: list(map(encode, chunks)), lengths, drop=False)


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: which tokens of which document stand where in which sequence."""
    path = path or public_tokenizers.path(RANKS)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(part.split()[0] for part in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, added=True)
        packer = Packer(window, TaskContext.get().partitionId() * TASK)
        id_type = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for batch in slices(batches):
            id_type = batch.schema.field(0).type
            ids, first = coder.ids(strings(batch.column(1)))
            rows = []
            for key, a, b in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                rows += packer.add(key, np.append(ids[a:b], END_ID).astype("<u4"))
            if rows:
                yield batch_of(rows)
        if rows := list(packer.close()):
            yield batch_of(rows)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))

"""SentencePiece encoding and decoding with source offsets.

The model file is read here: pieces, and the normaliser's compiled character map, a double-array
trie over UTF-8 bytes whose values point into a block of replacements. Every text is normalised by
the longest prefix in the trie (else one character as it is), which records, for every byte that it
writes, the source byte that it came from; the pieces of a text cover its normalised bytes from the
first to the last, which is checked, so each piece's place there gives its span of source bytes. Ids
come from the library itself.

Where the map is empty, as in the 32k model, each character is its own longest prefix, and a whole
slice of texts is normalised at once; where also no piece can hold a space mark after another
character, a text's ids are found for its chunks between single spaces, each distinct chunk once.

Cases: null and empty texts have no ids and decode to an empty text; texts are taken whole,
whatever their length; equal texts give equal rows, and repeated rows are rows each; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm.chunks import ChunkCoder
from quillforge.llm.common import byte_view, slices, strings, table

MODEL = "piece_bpe_32k.model"
MARK = "▁".encode()
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """A compiled map: u32 size of the trie, its units, then replacements that end with a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", count=size // 4, offset=4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest key that data has at `at`."""
        units, found, node = self.units, None, 0
        if not units:
            return None
        jump = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = jump(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= jump(unit)
            if unit & 256:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Model:
    def __init__(self, data: bytes):
        self.data = data
        self.names: list[bytes] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        self.dummy_prefix = self.squeeze = self.escape = True
        blob = b""
        self.suffix = False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.names.append(piece.get(1, b""))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, 1))
            elif number == 2:
                self.suffix = bool(dict(_fields(value)).get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                blob = spec.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.map = CharacterMap(blob)
        self.user = sorted((n for n, k in zip(self.names, self.kinds, strict=True) if k == USER_DEFINED), key=len, reverse=True)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.plain = self.dummy_prefix and self.escape and not (blob or self.squeeze or self.suffix or self.user) and not any(MARK in n.lstrip(MARK) for n in self.names) and not any(n.strip(MARK) and MARK in n[len(MARK) :] and not n.startswith(MARK) for n in self.names)
        #: Normalised bytes of each piece, and source bytes where every character is kept and a mark is one space.
        self.sizes = np.array([1 if k == BYTE else len(n) for n, k in zip(self.names, self.kinds, strict=True)], dtype=np.int64)
        self.lengths = np.array([1 if k == BYTE else len(n.replace(MARK, b" ")) for n, k in zip(self.names, self.kinds, strict=True)], dtype=np.int64)
        self.kinds_of = np.array(self.kinds)
        #: Whether a character is always its own longest prefix, so that a slice can be normalised at once.
        self.whole = self.dummy_prefix and self.escape and not (blob or self.squeeze or self.suffix or self.user)
        self.coder = ChunkCoder(self._chunks, self.lengths, drop=True)
        self.decimal = pa.array([str(k) for k in range(len(self.names))], pa.string())

    def _chunks(self, chunks: list[str]) -> list[list[int]]:
        lone = self.library.piece_to_id(MARK.decode())
        return [ids or [lone] for ids in self.library.encode(chunks, num_threads=1)] if chunks else []

    def normalise(self, text: bytes) -> tuple[bytes, list[int]]:
        """The normalised text, and for each of its bytes (and its end) the source byte it came from."""
        out, source, at = bytearray(), [], 0
        space = MARK if self.escape else b" "

        def prefix(at: int) -> tuple[int, bytes]:
            for name in self.user:
                if text.startswith(name, at):
                    return len(name), name
            if (found := self.map.longest(text, at)) is not None:
                return found
            lead = text[at]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return n, text[at : at + n]

        if self.squeeze:
            while at < len(text):
                n, new = prefix(at)
                if new != b" ":
                    break
                at += n
        if at == len(text):
            return b"", [at]
        if self.dummy_prefix and not self.suffix:
            out += space
            source += [at] * len(space)
        after_space = self.squeeze
        while at < len(text):
            n, new = prefix(at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                written = new.replace(b" ", space)
                out += written
                source += [at] * len(written)
                after_space = self.squeeze and new.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = source[len(out)]
                del source[len(out) :]
        if self.dummy_prefix and self.suffix:
            out += space
            source += [at] * len(space)
        return bytes(out), [*source, at]

    def normalise_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(normalised bytes, offsets of n + 1 values, source byte of each): the sources of a text have one
        value more than its bytes, its end, so those of text d start at offset d + d."""
        data, offsets = byte_view(texts)
        n = len(texts)
        if not self.whole:
            out, source = [], []
            for text in texts.to_pylist():
                one, two = self.normalise(text.encode())
                out.append(one)
                source.append(two)
            first = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
            return np.frombuffer(b"".join(out), np.uint8), first, np.array([x for s in source for x in s], np.int64)
        space, full = data == 32, np.diff(offsets) > 0
        upto = np.concatenate([[0], np.cumsum(np.where(space, len(MARK), 1))])
        first = np.concatenate([[0], np.cumsum(np.diff(upto[offsets]) + len(MARK) * full)])
        doc = np.repeat(np.arange(n), np.diff(offsets))
        place = upto[:-1] + (first[:-1] + len(MARK) * full - upto[offsets[:-1]])[doc]
        lead = np.maximum.accumulate(np.where((data & 0xC0) == 0x80, 0, np.arange(len(data)))) - offsets[:-1][doc] if len(data) else np.zeros(0, np.int64)
        out, source = np.empty(first[-1], np.uint8), np.empty(first[-1] + n, np.int64)
        out[place] = data
        source[place + doc] = lead
        begin = np.flatnonzero(full)
        for k, byte in enumerate(MARK):
            out[place[space] + k] = byte
            source[place[space] + doc[space] + k] = lead[space]
            out[first[begin] + k] = byte
            source[first[begin] + begin + k] = 0
        source[first[1:] + np.arange(n)] = np.diff(offsets)
        return out, first, source

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of n + 1 values)."""
        if self.plain:
            return self.coder.ids(texts)
        each = self.library.encode(texts.to_pylist(), num_threads=1)
        return np.array([i for ids in each for i in ids], dtype=np.int32), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)

    def spans(self, texts: pa.Array, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes (start, end) of each id, counted in its own text, by way of the normalised text."""
        _, begins, source = self.normalise_all(texts)
        sizes = self.sizes[ids]
        if (self.kinds_of[ids] == UNKNOWN).any():  # an unknown piece stands for what it covers
            sizes = self._surfaces(texts)
        end = np.concatenate([[0], np.cumsum(sizes)])
        if not np.array_equal(end[first], begins):
            raise ValueError("the pieces of a text do not cover its normalised form")
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        return source[end[:-1] + doc], source[end[1:] + doc]

    def _surfaces(self, texts: pa.Array) -> np.ndarray:
        found = []
        for text in texts.to_pylist():
            found += [1 if self.kinds[p.id] == BYTE else len(p.piece.encode()) for p in self.library.encode(text, return_type="proto").pieces] if text else []
        return np.array(found, np.int64)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        flat = ids.tolist()
        at = first.tolist()
        return self.library.decode([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], num_threads=1) if len(at) > 1 else []


@functools.cache
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, starts, ends): piece ids with their spans of source bytes."""
    path = path or public_tokenizers.path(MODEL)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in slices(batches):
            texts = strings(batch.column(1))
            ids, first = model.encode(texts)
            listed = lambda x, first=first: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(ids), *map(listed, model.spans(texts, ids, first))], names=["id", "ids", "starts", "ends"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows of (id, ids); null ids give an empty text."""
    path = path or public_tokenizers.path(MODEL)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = load(path).library.decode([x or [] for x in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(encoded[id_col].alias("id"), "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and digests of ids, spans (start and end of each piece as unsigned 32-bit numbers, little
    end first) and decoded texts, without passing the ids through rows."""
    path = path or public_tokenizers.path(MODEL)
    sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in slices(batches):
            texts = strings(batch.column(1))
            ids, first = model.encode(texts)
            starts, ends = model.spans(texts, ids, first)
            both = np.stack([starts, ends], axis=1).astype("<u4")
            at = first.tolist()
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), model.decimal.take(pa.array(ids))), ",")
            last = np.zeros(len(texts), np.int64)
            full = np.diff(first) > 0
            last[full] = ends[first[1:][full] - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first)), sha(joined.cast(pa.binary()).to_pylist()), sha(t.encode() for t in model.decode(ids, first)), pa.array(last), sha(both[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes", "spans_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spanned_bytes long, spans_sha256 string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 32k piece model."""
    return digests(table(spark, sf_dir, "documents"))

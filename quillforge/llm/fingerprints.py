"""Document fingerprints by one-permutation MinHash.

Each shingle of k words is hashed once; the upper half of the hash names one of `bins` bins, and a bin
keeps its least hash. An empty bin takes the value of a full one, found by hashing (bin, attempt) until
a full bin is hit (optimal densification), the same for every text. Of each bin's value, mixed with
the bin's number so that one borrowed value agrees by chance in each bin anew, the `bits` low-order
bits are kept, packed. Two fingerprints agree by chance in 1 of 2^bits bins, which the likeness takes
off again: (agreement - 2^-bits) / (1 - 2^-bits), at least 0.

Comparing each document with its successor needs an order of all rows, by id (null last) and hash of the
text. The order is closed to a ring and cut into arcs at keys of the table; the row at a cut is
also sent to the arc before it, so that every successor is found inside an arc and each text is
shuffled once.

Cases: null text reads as empty; a text without words has an empty fingerprint, alike (1.0) to
another empty one and to nothing else; fewer than k words make one shingle of them all; a text's length is
not bounded, what a task holds are about 4 MB of texts or one longer text; rows that repeat an id, or have
none, stand in the order of their texts' hashes, and rows equal in both are each other's successors; a
table of one row follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.llm.common import Words, mix, parallelism, slices, strings, table, windows

SHINGLE, BINS, BITS = 5, 512, 4
#: Keys sampled for each arc; the driver holds about this many of 17 bytes a shuffle partition, whatever the table.
SAMPLED = 16

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BIN = np.uint64(0x9E3779B97F4A7C15)
_TRY = 0xC2B2AE3D27D4EB4F


def bin_minima(texts: pa.Array, k: int = SHINGLE, bins: int = BINS, lower: bool = True) -> np.ndarray:
    """The least shingle hash of each text and bin; all ones where there is none."""
    words = Words(texts, lower)
    h, first = words.hash, words.first
    n = np.diff(first)
    doc = words.doc_of_word()
    whole = windows(h, k)
    inside = np.arange(len(whole)) + k <= first[1:][doc[: len(whole)]]
    hashes, owner = [whole[inside]], [doc[: len(whole)][inside]]
    for d in np.flatnonzero((n > 0) & (n < k)).tolist():
        hashes.append(windows(h[first[d] : first[d + 1]], int(n[d])))
        owner.append(np.array([d]))
    flat, at = np.concatenate(hashes), np.concatenate(owner)
    out = np.full(len(n) * bins, _EMPTY)
    place = ((flat >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    np.minimum.at(out, at * bins + place.astype(np.int64), flat)
    return out.reshape(len(n), bins)


def densify(minima: np.ndarray) -> np.ndarray:
    """Empty bins filled from full ones; rows without any full bin stay empty."""
    bins = minima.shape[1]
    full = minima != _EMPTY
    row, place = np.nonzero(~full & full.any(axis=1)[:, None])
    out, attempt = minima.copy(), 1
    while len(row):
        salt = np.uint64(attempt * _TRY % (1 << 64))
        source = (mix(place.astype(np.uint64) * _BIN + salt) % np.uint64(bins)).astype(np.int64)
        hit = full[row, source]
        out[row[hit], place[hit]] = minima[row[hit], source[hit]]
        row, place = row[~hit], place[~hit]
        attempt += 1
    return out


def pack(dense: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The low-order bits of each bin's value; b'' for an empty row."""
    mixed = mix(dense ^ (np.arange(dense.shape[1], dtype=np.uint64) * _BIN))
    each = (mixed[..., None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
    packed = np.packbits(each.reshape(len(dense), -1), axis=1)
    return [row.tobytes() if some else b"" for row, some in zip(packed, (dense != _EMPTY).all(axis=1).tolist(), strict=True)]


def fingerprint(texts: pa.Array, k: int = SHINGLE, bins: int = BINS, bits: int = BITS, lower: bool = True) -> list[bytes]:
    return pack(densify(bin_minima(texts, k, bins, lower)), bits)


def likeness(ones: list[bytes], others: list[bytes], bins: int = BINS, bits: int = BITS) -> list[float]:
    """The estimated similarity of the sets behind pairs of fingerprints, 0 to 1."""
    out = np.array([float(not a and not b) for a, b in zip(ones, others, strict=True)])
    both = [k for k, (a, b) in enumerate(zip(ones, others, strict=True)) if a and b]
    if both:
        x, y = (np.frombuffer(b"".join(s[k] for k in both), np.uint8).reshape(len(both), -1) for s in (ones, others))
        apart = np.unpackbits(x ^ y, axis=1, count=bins * bits).reshape(len(both), bins, bits).any(axis=2)
        chance = 2.0**-bits
        out[both] = np.clip((1 - apart.mean(axis=1) - chance) / (1 - chance), 0, 1)
    return out.tolist()


def fingerprints(docs: DataFrame, k: int = SHINGLE, bins: int = BINS, bits: int = BITS, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint(strings(batch.column(1)), k, bins, bits, lower), pa.binary())], names=["id", "fingerprint"])

    rows = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint binary")


def cuts(keyed: DataFrame) -> list[tuple[bool, int, int]]:
    """Keys (gone, id, hash) of the table that cut its order into arcs, about one a shuffle partition."""
    keys, arcs = keyed.select("gone", "id", "hash"), parallelism(keyed.sparkSession)
    every = max(1, keyed.count() // (SAMPLED * arcs))
    drawn = keys.filter(F.pmod(F.xxhash64("id", "hash", F.lit(11)), F.lit(every)) == 0).distinct().collect() or keys.limit(1).collect()
    found = sorted(tuple(r) for r in drawn)
    return found[:: max(1, len(found) // arcs)]


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, fingerprint, next_text, next_fingerprint) of every row, the last followed by the first."""
    keyed = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)).alias("id"), F.col(f"`{id_col}`").isNull().alias("gone"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    bounds = cuts(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("gone", "id", "hash")), strict=True))
            at = [bisect.bisect_right(bounds, key) - 1 for key in keys]
            rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprint(batch.column("text")), pa.binary())], names=[*batch.schema.names, "fingerprint"])
            yield rows.append_column("arc", pa.array([k % len(bounds) for k in at], pa.int32())).append_column("lap", pa.array([int(k < 0) for k in at], pa.int32()))
            cut = [r for r, k in enumerate(at) if k >= 0 and bounds[k] == keys[r]]
            if cut:  # the last of the arc before
                yield rows.take(cut).append_column("arc", pa.array([(at[r] - 1) % len(bounds) for r in cut], pa.int32())).append_column("lap", pa.array([2] * len(cut), pa.int32()))

    dealt = keyed.select("id", "gone", "hash", "text").mapInArrow(run, "id long, gone boolean, hash long, text string, fingerprint binary, arc int, lap int")
    order = Window.partitionBy("arc").orderBy("lap", "gone", "id", "hash")
    ring = dealt.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)}).filter("lap < 2")
    return ring.select(F.when(~F.col("gone"), F.col("id")).alias("id"), "text", "fingerprint", "next_text", "next_fingerprint")


def compared(pairs: DataFrame) -> DataFrame:
    """Rows of `successors` with their edited text's fingerprint and both likenesses, without the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "edited"):
            own, after = batch.column("fingerprint").to_pylist(), batch.column("next_fingerprint").to_pylist()
            edited = fingerprint(strings(batch.column("edited")))
            columns = [pa.array(likeness(own, edited)), pa.array(likeness(own, after)), pa.array([x.hex() for x in own], pa.string()), pa.array([x.hex() for x in edited], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_chars", "edited_sha256")), *columns], names=["id", "n_chars", "edited_sha256", "near_edited", "near_next", "fingerprint", "edited_fingerprint"])

    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    rows = edited.select("id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "edited", "fingerprint", "next_fingerprint")
    return rows.mapInArrow(run, "id long, n_chars long, edited_sha256 string, near_edited double, near_next double, fingerprint string, edited_fingerprint string")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, held against its edited text's and the next document's."""
    found = compared(successors(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

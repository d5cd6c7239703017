"""Media columns: Netpbm and BMP decoding, area resize by integral images, NPY tiles, difference hashes.

An image is a numpy array of shape (height, width) for grey or (height, width, 3) for colour.
Cases: null text reads as empty, empty text becomes one full row block of 255; equal texts give
equal rows; a very long text is one tall image, whose area means are summed in bands of BAND rows, so
that no table of its size in wider numbers is made; every other input column is ignored, so clashing
names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillforge.llm.common import slices, table

#: Samples in one row of a stored text image; payloads are padded to a multiple of it.
ROW = 576
TILE = (8, 9)
#: Rows that are summed at once, and bytes of texts whose images are held at once.
BAND, HELD_BYTES = 2048, 1 << 20


class MediaError(ValueError):
    pass


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """`count` decimal fields after the magic number; comments run from # to the end of the line."""
    fields, at = [], 2
    while len(fields) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                stop = data.find(b"\n", at)
                at = len(data) if stop < 0 else stop
            at += 1
        stop = at
        while stop < len(data) and 48 <= data[stop] <= 57:
            stop += 1
        if stop == at:
            raise MediaError("a header field is missing")
        fields.append(int(data[at:stop]))
        at = stop
    return fields, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6. Bitmaps give 0 for ink and 255 for paper; samples of two bytes give uint16."""
    magic = data[:2]
    if len(magic) < 2 or magic[0] != 80 or magic[1] not in b"123456":
        raise MediaError("not a Netpbm file")
    kind = magic[1] - 48
    bitmap, colour, plain = kind in (1, 4), kind in (3, 6), kind < 4
    fields, at = _header(data, 2 if bitmap else 3)
    width, height = fields[:2]
    top = 1 if bitmap else fields[2]
    if not 0 < top < 65536:
        raise MediaError("the largest value is out of range")
    shape = (height, width, 3) if colour else (height, width)
    need = height * width * (3 if colour else 1)
    if bitmap and not plain:
        stride = (width + 7) // 8
        body = np.frombuffer(data, np.uint8, offset=at + 1)
        if len(body) < stride * height:
            raise MediaError("the file is cut short")
        bits = np.unpackbits(body[: stride * height].reshape(height, stride), axis=1)[:, :width]
        return np.where(bits == 1, 0, 255).astype(np.uint8)
    if plain:
        body = data[at:]
        digits = [int(c) for c in body.decode("ascii", "ignore") if c in "01"] if bitmap else [int(x) for x in body.split()]
        if len(digits) < need:
            raise MediaError("the file is cut short")
        samples = np.array(digits[:need], dtype=np.uint16 if top > 255 else np.uint8)
        if bitmap:
            samples = np.where(samples == 1, 0, 255).astype(np.uint8)
        return samples.reshape(shape)
    width_of = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
    if len(data) - at - 1 < need * width_of.itemsize:
        raise MediaError("the file is cut short")
    body = np.frombuffer(data, width_of, count=need, offset=at + 1)
    return body.astype(body.dtype.newbyteorder("=")).reshape(shape)


def encode_pgm(image: np.ndarray) -> bytes:
    height, width = image.shape
    return b"P5\n%d %d\n255\n" % (width, height) + image.astype(np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 24 or 32 bits; bottom-up or top-down; alpha is left out."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not a BMP file")
    (start,) = struct.unpack_from("<I", data, 10)
    size, width, height, _, depth, packing = struct.unpack_from("<IiiHHI", data, 14)
    if size < 40 or packing not in (0, 3) or (packing == 3 and depth != 32):
        raise MediaError("this BMP is compressed")
    if depth not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise MediaError("unknown BMP layout")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if len(data) < start + rows * stride:
        raise MediaError("the file is cut short")
    body = np.frombuffer(data, np.uint8, count=rows * stride, offset=start).reshape(rows, stride)
    if height > 0:
        body = body[::-1]
    if depth >= 24:
        step = depth // 8
        image = body[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]
        return np.ascontiguousarray(image)
    used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.frombuffer(data, np.uint8, count=4 * used, offset=14 + size).reshape(used, 4)[:, 2::-1]
    bits = np.unpackbits(body, axis=1).reshape(rows, -1, depth)
    index = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, :width]
    if index.size and index.max() >= used:
        raise MediaError("a palette entry is missing")
    image = palette[index]
    if (palette == palette[:, :1]).all():
        return np.ascontiguousarray(image[:, :, 0])
    return np.ascontiguousarray(image)


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey with a full palette, or 24-bit colour; bottom-up."""
    height, width = image.shape[:2]
    depth = 24 if image.ndim == 3 else 8
    palette = b"" if depth == 24 else b"".join(bytes((k, k, k, 0)) for k in range(256))
    flat = image[:, :, ::-1].reshape(height, width * 3) if depth == 24 else image
    stride = (width * depth + 31) // 32 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : flat.shape[1]] = flat[::-1]
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, 0, body.size, 2835, 2835, 0, 0) + palette + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def _integral(image: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows `at` (from 0 to the height) of the integral image: sums of all samples above and to the left."""
    rows, cols = image.shape
    if rows <= BAND:
        whole = np.zeros((rows + 1, cols + 1))
        np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=whole[1:, 1:])
        return whole[at]
    total, above = np.zeros((len(at), cols + 1)), 0.0
    for start in range(0, rows, BAND):
        band = np.cumsum(image[start : start + BAND], axis=0, dtype=np.float64)
        inside = np.flatnonzero((at > start) & (at <= start + len(band)))
        total[inside, 1:] = above + band[at[inside] - start - 1]
        above = above + band[-1]
    return np.cumsum(total, axis=1)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the (fractional) source area under each target pixel, read from an integral image."""
    rows, cols = image.shape
    if not rows or not cols:
        raise MediaError("the image has no samples")

    def along(count: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(target + 1) * (count / target)
        low = np.minimum(at.astype(np.int64), count)
        return low, np.minimum(low + 1, count), at - low

    low, high, part = along(rows, height)
    both = _integral(image, np.concatenate([low, high]))
    across = both[: len(low)] * (1 - part)[:, None] + both[len(low) :] * part[:, None]
    low, high, part = along(cols, width)
    corner = across[:, low] * (1 - part) + across[:, high] * part
    area = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return area * (height * width / (rows * cols))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 area means is smaller than its right neighbour."""
    small = np.rint(area_resize(grey(image), *TILE) * 256).astype(np.int64)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, height: int = 24, width: int = 24) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey(image), height, width)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def store_text(text: bytes) -> bytes:
    """A text as a grey PGM, one row for each ROW bytes, padded with 255."""
    short = -len(text) % ROW or (ROW if not text else 0)
    return encode_pgm(np.frombuffer(text + b"\xff" * short, np.uint8).reshape(-1, ROW))


def _stored(text: str | None) -> tuple[int, bytes, bytes, bytes, str]:
    """(bytes of the text, its PGM, and of what was read back: samples, tile and difference hash)."""
    raw = (text or "").encode()
    media = store_text(raw)
    image = decode(media)
    return len(raw), media, image.tobytes(), npy_tile(image), difference_hash(image)


def _rows(docs: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[str | None], tuple]) -> DataFrame:
    """A row of `schema` (behind the id) for each text; what is held at once is bounded by the texts' bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names, kinds = zip(*(part.split() for part in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=HELD_BYTES):
            columns = zip(*map(make, batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True))], names=["id", *names])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its PGM, an NPY tile, and the difference hash of what was read back."""
    return _rows(docs, id_col, text_col, "n_bytes long, media binary, payload binary, tile binary, dhash string", _stored)


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lengths and digests of the columns of text_media, taken where they are made."""

    def make(text: str | None) -> tuple:
        n, media, payload, tile, feature = _stored(text)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return n, len(payload), sha(payload), zlib.crc32(payload[-32:]), len(media), sha(media), feature, sha(tile)

    return _rows(docs, id_col, text_col, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string", make)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` stored as an image, read back, and described."""
    return describe(table(spark, sf_dir, "documents"))

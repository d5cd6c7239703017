"""Repeated stretches of text are tokenised once.

Both tokenisers here can be cut before a space that follows another character: no merge crosses
such a cut, so the ids of a text are the ids of its chunks. A slice of texts becomes a dictionary
of distinct chunks (in C++); the distinct chunks are joined by the same kind of cut, encoded in one
call, and told apart again by the bytes that each id stands for. Chunks that could not stand so
beside others (`odd`) are encoded one by one.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillforge.llm.common import byte_view

#: Distinct chunks that are encoded as one text; an encoder's heap grows with its text.
BLOCK = 128

#: First bytes of white space beyond ASCII in UTF-8, and ASCII that some engines hold for space.
_UNSURE = np.zeros(256, dtype=bool)
_UNSURE[:33] = True
_UNSURE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def cuts(data: np.ndarray, offsets: np.ndarray, strict: bool) -> np.ndarray:
    """Places of spaces before which a text can be cut, never a text's first byte.

    strict: the next character must also be no white space of any kind; else the one before must
    not be U+2581, which the piece models hold for a space."""
    space = data == 32
    hit = space.copy()
    hit[1:] &= ~space[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    hit[begin] = False
    if strict:
        end = offsets[1:][np.diff(offsets) > 0] - 1
        hit[:-1] &= ~_UNSURE[data[1:]]
        hit[end] = False
    else:
        mark = np.flatnonzero(hit[3:] & (data[2:-1] == 0x81) & (data[1:-2] == 0x96) & (data[:-3] == 0xE2)) + 3
        hit[mark] = False
    return np.flatnonzero(hit)


class ChunkCoder:
    """encode: texts to lists of ids. lengths: source bytes of each id. drop: a cut's space belongs
    to no chunk but is written before each (as the piece models do); else it starts the chunk."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], lengths: np.ndarray, drop: bool):
        self.encode, self.lengths, self.drop = encode, lengths, drop

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of n + 1 values); an empty text has none."""
        data, offsets = byte_view(texts)
        full = np.diff(offsets) > 0
        if not full.any():
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = cuts(data, offsets, strict=not self.drop)
        if self.drop:
            keep = np.ones(len(data), dtype=bool)
            keep[cut] = False
            data = data[keep]
        # the text's own start sorts after a cut before the end of the text in front of it
        starts = np.sort(np.concatenate([offsets[:-1][full], cut + self.drop]), kind="stable")
        ends = np.append(starts - (np.searchsorted(cut, starts) if self.drop else 0), len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        flat, lengths = self._distinct(coded.dictionary)
        code = coded.indices.to_numpy()
        begins = np.cumsum(lengths) - lengths
        n = lengths[code]
        total = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(begins[code] - total[:-1], n) + np.arange(total[-1])]
        first = np.searchsorted(cut, offsets) + np.concatenate([[0], np.cumsum(full)])
        return out, total[first]

    def _odd(self, chunks: pa.Array) -> np.ndarray:
        data, offsets = byte_view(chunks)
        size = np.diff(offsets)
        odd = size < 2
        some = np.flatnonzero(~odd)
        if self.drop:
            odd[some] = data[offsets[1:][some] - 1] == 32
            return odd | pc.match_substring(chunks, "▁").to_numpy(zero_copy_only=False) | (size == 0)
        odd[some] = (data[offsets[some]] != 32) | _UNSURE[data[offsets[some] + 1]]
        return odd

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, number of each)."""
        odd = self._odd(chunks)
        lone = self.encode(chunks.filter(pa.array(odd)).to_pylist())
        even = chunks.filter(pa.array(~odd))
        _, offsets = byte_view(even)
        n = np.zeros(len(chunks), dtype=np.int64)
        n[odd] = [len(x) for x in lone]
        joined = np.zeros(0, np.int32)
        if len(even):
            blocks = pa.array([*range(0, len(even), BLOCK), len(even)], pa.int32())
            whole = pc.binary_join(pa.ListArray.from_arrays(blocks, even), " " if self.drop else "")
            joined = np.fromiter(itertools.chain.from_iterable(self.encode(whole.to_pylist())), dtype=np.int32)
            upto = np.searchsorted(np.cumsum(self.lengths[joined]), offsets[1:] + self.drop * np.arange(1, len(even) + 1)) + 1
            n[~odd] = np.diff(upto, prepend=0)
        flat = np.empty(n.sum(), dtype=np.int32)
        from_lone = np.repeat(odd, n)
        flat[from_lone] = np.fromiter((i for x in lone for i in x), dtype=np.int32)
        flat[~from_lone] = joined
        return flat, n

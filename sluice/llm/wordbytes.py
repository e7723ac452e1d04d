"""Vectorised word splitting over Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered;
other bytes are left as they are, so multi-byte characters are never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = SPACE


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(texts) else raw[:0], offsets - offsets[0]


class Words:
    """The words of a batch of texts.

    ``starts``/``ends`` index ``data`` (folded bytes); ``first[d]:first[d+1]`` are
    the words of text ``d``.
    """

    def __init__(self, texts: pa.Array):
        raw, offsets = text_bytes(texts)
        self.data = _FOLD[raw]
        word = self.data != SPACE
        edge = np.zeros(len(word) + 1, dtype=bool)
        edge[offsets] = True  # a word ends where its text ends
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end = word.copy()
        end[:-1] &= ~word[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """(index of each word, distinct words as an array)."""
        size = self.ends - self.starts
        offsets = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=offsets[1:])
        packed = self.data[self.data != SPACE]
        array = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        coded = array.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def encode(self) -> tuple[np.ndarray, list[bytes]]:
        """(index of each word, distinct words)."""
        index, distinct = self.coded()
        return index, distinct.to_pylist()

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Words of each text with one space between; (bytes, starts, ends) of the words."""
        size = self.ends - self.starts
        starts = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size + 1, out=starts[1:])
        out = np.full(int(starts[-1]), SPACE, dtype=np.uint8)
        keep = np.ones(len(out), dtype=bool)
        keep[starts[1:] - 1] = False
        out[keep] = self.data[self.data != SPACE]
        return out.tobytes(), starts[:-1], starts[:-1] + size


def pieces(batches: Iterator[pa.RecordBatch], text: str | int = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        slot = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def ragged_take(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``values[starts[i]:starts[i]+sizes[i]]`` for i in index; (flat, offsets)."""
    size = sizes[index]
    offsets = np.zeros(len(index) + 1, dtype=np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(starts[index] - offsets[:-1], size)
    at += np.arange(offsets[-1])
    return values[at], offsets

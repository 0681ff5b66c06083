"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and the last ends; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, raw = texts.buffers()
    off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off.astype(np.int64) - off[0]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of bytes ``inside`` a word; no run crosses a text's end."""
    if not inside.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = off[(off > 0) & (off < inside.size)]
    before[edge], after[edge - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def coded(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """The number of each word among the distinct ones, and these."""
    if not begin.size:
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    # Words and the gaps between them take turns, so that Arrow sees one buffer with growing offsets.
    cuts = np.empty(2 * begin.size, np.int32)
    cuts[::2], cuts[1::2] = begin, end
    pieces = pa.Array.from_buffers(pa.binary(), cuts.size - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    words = pieces.take(pa.array(np.arange(0, cuts.size - 1, 2))).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary

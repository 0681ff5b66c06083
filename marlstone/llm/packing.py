"""Order-preserving packing into windows of a fixed size by dynamic programming.

The documents of a partition, in their order, form one stream of ids. Windows are cut where documents
or sentences end, or, within long sentences, at every ``stride``-th id. A cut costs nothing at the end
of a document, ``sentence_cost`` at the end of a sentence and ``truncation_cost`` elsewhere; a window
costs its padding. With p the position of a cut, the best cost of a stream that ends at j is

    f(j) = cost(j) + window - p(j) + min over i with p(j) - p(i) <= window of (f(i) + p(i)),

a minimum over a sliding range, which a monotone queue gives in constant time for each cut. The last
window of a stream is split at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.tokenize import default_path, encoder, text_slices

STREAM_IDS = 262_144


def best_cuts(places: list[int], costs: list[int], window: int) -> list[int]:
    """The cheapest cuts (positions) from ``places[0]`` to ``places[-1]``; gaps are at most ``window``."""
    f, back = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(places[0], places[0], 0)])  # f + p, p, index
    for j in range(1, len(places)):
        p = places[j]
        while queue[0][1] < p - window:
            queue.popleft()
        least = queue[0]
        back[j] = least[2]
        key = costs[j] + window + least[0]  # f(j) + p(j)
        f[j] = key - p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


def stream_cuts(sizes: list[int], sentence_ends: np.ndarray, window: int = 1024, sentence_cost: int = 1, truncation_cost: int = 3, stride: int = 16) -> list[int]:
    """The cuts of one stream of documents of ``sizes`` ids; ``sentence_ends`` are positions after sentences."""
    ends = np.cumsum(np.array(sizes, np.int64))
    total = int(ends[-1])
    cost = np.full(total + 1, truncation_cost, np.int8)
    cost[sentence_ends] = sentence_cost
    cost[ends] = 0
    mark = np.zeros(total + 1, bool)
    mark[0] = mark[sentence_ends] = mark[ends] = True
    marks = np.flatnonzero(mark)
    more = (np.diff(marks) - 1) // stride  # further places in each gap
    mark[np.repeat(marks[:-1], more) + stride * (1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))] = True
    places = np.flatnonzero(mark)
    cost = cost[places]
    cuts = best_cuts(places.tolist(), cost.tolist(), window)
    at = cuts[-2] if len(cuts) > 1 else 0
    del cuts[-1]
    for k in range(window.bit_length() - 1, -1, -1):
        while total - at >= 1 << k and at < total:
            at += 1 << k
            cuts.append(at)
    return cuts


_SENTENCE_END: dict[str, np.ndarray] = {}


def _sentence_end_ids(tokenizer: str) -> np.ndarray:
    """Which ids end a sentence: those whose text ends in a full stop, a mark or a line end."""
    if tokenizer not in _SENTENCE_END:
        tok = encoder(tokenizer).tok
        texts = [tok.decode([i]) for i in range(tok.get_vocab_size())]
        _SENTENCE_END[tokenizer] = np.array([t.rstrip(" ").endswith((".", "!", "?", "\n")) for t in texts])
    return _SENTENCE_END[tokenizer]


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack every whole text into sequences of at most ``window`` ids, a power of two.

    Documents keep the order they have in their partition, and no sequence spans partitions. Returns one
    row for each piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` (partition and number within it), ``offset``, ``sequence_length``, and the piece's
    ``ids`` if asked for. Null and empty texts are the end id alone; repeated rows are packed each;
    other columns are ignored; an empty table gives no rows.
    """
    tokenizer = tokenizer or default_path()
    kinds = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"))]
    schema = pa.schema([*kinds, *([("ids", pa.list_(pa.int64()))] if with_ids else [])])

    def emit(keys: list, sizes: list[np.ndarray], parts: list[np.ndarray], sequence: int) -> tuple[pa.RecordBatch, int]:
        ids, sizes = np.concatenate(parts).astype("<u4"), np.concatenate(sizes)
        raw = memoryview(ids).cast("B")
        cuts = np.array(stream_cuts(sizes.tolist(), np.flatnonzero(_sentence_end_ids(tokenizer)[ids]) + 1, window), np.int64)
        ends = np.cumsum(sizes)
        stops = np.union1d(ends, cuts)
        starts = np.concatenate([[0], stops[:-1]])
        doc = np.searchsorted(ends, starts, side="right")
        seq = np.searchsorted(cuts, starts, side="right")
        seq_start = np.concatenate([[0], cuts])
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
        cols = [pa.array(keys, pa.int64()).take(pa.array(doc)), starts - (ends - sizes)[doc], stops - starts, crc, sizes[doc], sequence + seq, starts - seq_start[seq], np.diff(seq_start)[seq]]
        if with_ids:
            cols.append([ids[a:b] for a, b in zip(starts.tolist(), stops.tolist())])
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema), sequence + len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(tokenizer).encode, TaskContext.get().partitionId() << 33
        held: list[list] = [[], [], []]
        size = 0
        for whole in batches:
            for b in text_slices(whole, 1):
                keys, (ids, sizes) = b.column(0).to_pylist(), encode(b.column(1), end_id)
                ends, at = np.cumsum(sizes), 0
                while at < len(keys):
                    before = int(ends[at] - sizes[at])
                    to = min(len(keys), int(np.searchsorted(ends, before + STREAM_IDS - size)) + 1)
                    held[0] += keys[at:to]
                    held[1].append(sizes[at:to])
                    held[2].append(ids[before : ends[to - 1]])
                    size, at = size + int(ends[to - 1]) - before, to
                    if size >= STREAM_IDS:
                        out, sequence = emit(*held, sequence)
                        yield out
                        held, size = [[], [], []], 0
        if size:
            yield emit(*held, sequence)[0]

    names = ", ".join(f"{f.name} long" for f in schema if f.name != "ids") + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, names)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all ``documents``; nulls, repeated rows and an empty table as ``pack_documents`` says."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

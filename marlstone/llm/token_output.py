"""Token-id output in Simple-8b blocks.

A word of 64 bits holds a selector in its high four bits and up to 60 ids in the other 60. Selector 15
is an escape: the next word is one raw 64-bit value. A block holds whole documents; within it, every
``LANE`` ids start a new word, and the block keeps the word offset of each such lane, so that lanes are
encoded and decoded side by side in numpy.

Blocks are rows of a Parquet folder: ``shard`` and ``block`` (their order is the order of the ids),
``first`` (ids of the shard before the block), ``keys`` and ``sizes`` of its documents, ``words`` and
``lanes``. The folder is written by Spark and can lie wherever Spark can write.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import shared_dir, slices
from marlstone.llm.tokenize import default_path, encoder, text_slices

LANE = 128
BLOCK_IDS = 65_536
# Ids a word and bits an id, by selector; 15 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 64], np.int64)
ESCAPE = 15
_BITS = np.array([i.bit_length() for i in range(1 << 17)], np.uint8)

BLOCK_SCHEMA = "shard int, block int, first long, keys array<long>, sizes array<long>, words binary, lanes binary"
_BLOCK_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("keys", pa.list_(pa.int64())),
     ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("lanes", pa.binary())]
)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of ``ids`` (unsigned) and the word offset of every lane."""
    ids = ids.astype(np.uint64)
    n = ids.size
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    lane_end = np.minimum((np.arange(n) // LANE + 1) * LANE, n)
    bits = _BITS[ids.astype(np.int64)] if int(ids.max()) < _BITS.size else np.ceil(np.log2(ids.astype(np.longdouble) + 1)).astype(np.uint8)
    # A selector fits where all ids that it would take, up to the end of the lane, are small enough.
    rows = -(-n // LANE)
    grid = np.zeros((rows, LANE + 64), np.uint8)
    body = np.zeros(rows * LANE, np.uint8)
    body[:n] = bits
    grid[:, :LANE] = body.reshape(rows, LANE)
    choice = np.full((rows, LANE), ESCAPE, np.uint8)
    for s in range(13, -1, -1):
        fits, have, c = grid <= WIDTHS[s], 1, int(COUNTS[s])
        while have < c:
            more = min(have, c - have)
            fits = fits[:, :-more] & fits[:, more:]
            have += more
        np.putmask(choice, fits[:, :LANE], np.uint8(s))
    choice = choice.ravel()[:n]
    step = COUNTS[choice]
    # All lanes advance side by side from word to word.
    pos, ends = np.arange(0, n, LANE), np.minimum(np.arange(LANE, n + LANE, LANE), n)
    lane = np.arange(pos.size)
    got, of = [], []
    while pos.size:
        got.append(pos)
        of.append(lane)
        pos = pos + step[pos]
        more = pos < ends
        pos, lane, ends = pos[more], lane[more], ends[more]
    start = np.concatenate(got)
    order = np.argsort(start)
    start, of_lane = start[order], np.concatenate(of)[order]
    sel = choice[start]
    size = np.where(sel == ESCAPE, 2, 1)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(sel).tolist():
        k = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[where[k]] = np.uint64(ESCAPE) << np.uint64(60)
            words[where[k] + 1] = ids[start[k]]
            continue
        word = np.full(k.size, s, np.uint64) << np.uint64(60)
        for j in range(int(COUNTS[s])):
            p = start[k] + j
            word |= np.where(p < lane_end[start[k]], padded[p], np.uint64(0)) << np.uint64(j * int(WIDTHS[s]))
        words[where[k]] = word
    first = np.concatenate([[True], of_lane[1:] != of_lane[:-1]])
    return words, where[first].astype(np.uint32)


def unpack(words: np.ndarray, lanes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == ESCAPE).any():  # a raw value may look like any selector, so escapes are found word by word
        raw = np.zeros(words.size, bool)
        for i in np.flatnonzero(sel == ESCAPE).tolist():
            if not raw[i]:
                raw[i + 1] = True
        sel[raw] = 14
    count = COUNTS[sel]
    before = np.cumsum(count) - count
    lane = np.searchsorted(lanes, np.arange(words.size), side="right") - 1
    base = lane * LANE + before - before[lanes[lane]]
    end = np.minimum((lane + 1) * LANE, n)
    for s in np.unique(sel).tolist():
        k = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[base[k]] = words[k + 1]
        elif s != 14:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for j in range(int(COUNTS[s])):
                p = base[k] + j
                ok = p < end[k]
                out[p[ok]] = (words[k[ok]] >> np.uint64(j * int(WIDTHS[s]))) & mask
    return out


def _block(shard: int, block: int, first: int, keys: list, sizes: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
    words, lanes = pack(np.concatenate(parts))
    cols = [[shard], [block], [first], [keys], [np.concatenate(sizes)], [words.astype("<u8").tobytes()], [lanes.astype("<u4").tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _BLOCK_ARROW.types)], schema=_BLOCK_ARROW)


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0) -> None:
    """Encode every whole text and write the ids in ascending order of ``key`` to the folder ``path``.

    Null and empty texts give the end id alone; rows with equal keys each keep their ids (ordered by
    text); a null key is stored as null and comes first; other columns are ignored. A document lies in
    one block, so a block is as large as its longest document. An empty table writes an empty folder.
    """
    tokenizer = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer).encode, TaskContext.get().partitionId()
        block = first = size = 0
        held: list[list] = [[], [], []]
        for whole in batches:
            for b in text_slices(whole, 1):
                keys, (ids, sizes) = b.column(0).to_pylist(), encode(b.column(1), end_id)
                ends, at = np.cumsum(sizes), 0
                while at < len(keys):
                    before = int(ends[at] - sizes[at])
                    to = min(len(keys), int(np.searchsorted(ends, before + BLOCK_IDS - size)) + 1)
                    held[0] += keys[at:to]
                    held[1].append(sizes[at:to])
                    held[2].append(ids[before : ends[to - 1]])
                    size, at = size + int(ends[to - 1]) - before, to
                    if size >= BLOCK_IDS:
                        yield _block(shard, block, first, *held)
                        block, first, size, held = block + 1, first + size, 0, [[], [], []]
        if size:
            yield _block(shard, block, first, *held)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    rows.mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a folder that ``write_ids`` wrote.

    Returns ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (array), or
    with ``digest`` the unsigned ``ids_crc32`` of the ids as little-endian uint32 instead of the ids.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row for each shard, that is for each file: as many as the writing job had tasks.
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    base, before = {}, 0
    for r in sorted(totals, key=lambda r: r["shard"]):
        base[r["shard"]] = before
        before += r["n"]
    kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                r = b.to_pylist()[0]
                sizes = np.array(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                words, lanes = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["lanes"], "<u4")
                ids = unpack(words, lanes, int(ends[-1])).astype("<u4")
                spans, raw = list(zip((ends - sizes).tolist(), ends.tolist())), memoryview(ids).cast("B")
                last = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in spans] if digest else [ids[a:z].astype(np.int64) for a, z in spans]
                cols = [r["keys"], base[r["shard"]] + r["first"] + ends - sizes, sizes, last]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path, digest=True)

"""Vectors that take part in searches, and tables of vectors as blocks for numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.worker import only

ROW_BYTES = 256 << 10  # the doubles of a row of a block, so that no task meets rows or batches of a whole block's size
ROWS_AT_ONCE = 64  # of these rows in an Arrow batch, of which JVM and Python hold several copies
MOST_TASKS = 4096
BLOCK_SCHEMA = "part long, piece long, ids array<long>, extra array<long>, x binary, graph binary"
_ARROW = pa.schema([("part", pa.int64()), ("piece", pa.int64()), ("ids", pa.list_(pa.int64())), ("extra", pa.list_(pa.int64())), ("x", pa.binary()), ("graph", pa.binary())])


def valid(v: Column) -> Column:
    """True for vectors of finite components that are not all zero; false, never null, for others."""
    v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def lengths(vectors: DataFrame) -> list[tuple[int, int]]:
    """Each length of the vectors ``v`` and how many have it; there are no more lengths than the longest one."""
    return [(r["size"], r["n"]) for r in vectors.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow list column of valid vectors as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def blocks(rows: DataFrame, parts: int, size: int, graph: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """Rows (``id``, ``extra``, ``v``) dealt by a hash of the id into ``parts`` blocks, each in rows of ``ROW_BYTES``.

    A task holds one block at a time. What ``graph`` makes of a block's vectors is cut over its rows.
    """
    step = max(1, ROW_BYTES // (8 * size))

    def cut(part: int, held: list) -> Iterator[pa.RecordBatch]:
        ids, extra, x = (np.concatenate(a) for a in zip(*held))
        held.clear()
        more = graph(x) if graph else b""
        n = -(-ids.size // step)
        each = -(-len(more) // n)
        for i in range(n):
            k = slice(i * step, (i + 1) * step)
            cols = [[part], [i], [ids[k]], [extra[k]], [x[k].astype("<f8").tobytes()], [more[i * each : (i + 1) * each]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("vectors")
        last, held = None, []
        for b in batches:
            part = b.column(0).to_numpy()
            ids, extra, x = b.column(1).to_numpy(), b.column(2).to_numpy(), matrix(b.column(3), size)
            head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: part.size]
            for i, j in zip(head.tolist(), [*head[1:].tolist(), part.size]):
                if held and part[i] != last:
                    yield from cut(last, held)
                last = int(part[i])
                held.append((ids[i:j], extra[i:j], x[i:j]))
        if held:
            yield from cut(last, held)

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "id", "extra", "v").repartition(parts, "part")
    return dealt.sortWithinPartitions("part", "id").mapInArrow(run, BLOCK_SCHEMA)


def meet(shards: DataFrame, queries: DataFrame, parts: int, sets: int, per_task: int) -> DataFrame:
    """The rows of every shard (``side`` 0), then those of every block of queries (``side`` 1), ``per_task`` blocks or more for each copy of a shard.

    Both come from ``blocks``; ``met`` puts them together. Queries of a part that has no shard come without one.
    """
    groups, long = min(-(-sets // per_task), max(1, MOST_TASKS // parts)), lambda n: F.lit(n).cast("long")
    rest = ["piece", "ids", "extra", "x", "graph"]
    left = shards.select("part", F.explode(F.sequence(long(0), long(groups - 1))).alias("group"), F.lit(0).alias("side"), long(0).alias("block"), *rest)
    right = queries.select(F.explode(F.sequence(long(0), long(parts - 1))).alias("part"), F.pmod("part", long(groups)).alias("group"), F.lit(1).alias("side"), F.col("part").alias("block"), *rest)
    rows = left.unionByName(right).repartition(min(MOST_TASKS, 3 * parts * groups), "part", "group")
    return rows.sortWithinPartitions("part", "group", "side", "block", "piece").drop("piece")


def met(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Part, side, ids, extra, vectors and graph of each block of ``meet``, one block at a time."""
    last, held = None, []

    def whole() -> tuple:
        ids, extra, x, graph = zip(*held)
        held.clear()
        return last[0], last[2], np.concatenate(ids), np.concatenate(extra), np.frombuffer(b"".join(x), "<f8").reshape(-1, size), b"".join(graph)

    for b in batches:
        for i in range(b.num_rows):
            part, group, side, block, ids, extra, x, graph = (c[0].as_py() for c in b.slice(i, 1).columns)
            if held and (part, group, side, block) != last:
                yield whole()
            last = (part, group, side, block)
            held.append((np.array(ids, np.int64), np.array(extra, np.int64), x, graph))
    if held:
        yield whole()

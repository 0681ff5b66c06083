"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors get one more component that makes their lengths equal, so that the largest inner product is the
smallest angle. ``ROTATIONS`` rotations learned on a bounded sample (principal axes, then iterative
quantisation from different starts) turn each into a code of up to 60 bits a rotation, split into substrings
of up to ``PART_BITS`` bits with one table each. By the pigeonhole principle every code within radius r of the
query's is within floor(r / parts) in some part (within one less in the parts beyond the remainder), so probing
those buckets retrieves all of them. What the buckets hold is thinned by the distance of the whole code, and the rest is
ranked by inner products in doubles.

The radius is the smallest whose buckets hold ``OPEN_RECALL`` of the neighbours of audit queries, searched by
brute force over all rows, and the distance the smallest that leaves ``FAR_RECALL`` of these. Queries that find fewer
than they ask for are searched again with twice the radius, until they have enough or the radius takes in all codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlstone.llm.shared import saved
from marlstone.llm.vectors import blocks, lengths, matrix, meet, met, valid
from marlstone.llm.worker import only

ROTATIONS = 4
FIT_ROWS = 8_000
PART_BITS, ROTATION_BITS = 12, 60
AUDIT_QUERIES = 96
OPEN_RECALL, FAR_RECALL = 0.96, 0.99
SHARD_ROWS = 8_192
QUERY_ROWS, QUERY_BLOCKS = 1_024, 8


class Codes:
    """The learned rotations; some ten thousand doubles."""

    def __init__(self, sample: np.ndarray, longest: float, rotations: int = ROTATIONS, rounds: int = 30, seed: int = 3):
        self.longest = max(longest, 1e-300)
        y = self.lifted(sample)
        self.mean = y.mean(0)
        y = y - self.mean
        bits = min(ROTATION_BITS, y.shape[1])
        _, axes = np.linalg.eigh(y.T @ y)
        axes = axes[:, ::-1][:, :bits]
        v, turns = y @ axes, []
        for k in range(rotations):
            r = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(bits, bits)))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            turns.append(axes @ r)
        self.turn = np.concatenate(turns, 1)
        self.bits = bits * rotations
        parts = -(-self.bits // PART_BITS)
        self.all_codes = parts * (PART_BITS + 1)  # a radius whose buckets hold all codes

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], 1)

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The substrings of the code of each row, as numbers; queries have no added length."""
        if query:
            x = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], 1)
        else:
            x = self.lifted(x)
        bits = (x - self.mean) @ self.turn >= 0
        return np.stack([bits[:, i : i + PART_BITS] @ (1 << np.arange(min(PART_BITS, self.bits - i))) for i in range(0, self.bits, PART_BITS)], 1).astype(np.uint16)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Differing bits of each code and ``code``."""
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


def needed(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The least radius whose buckets hold each code."""
    parts = codes.shape[1]
    return (np.bitwise_count(codes ^ code).astype(np.int64) * parts + np.arange(parts)).min(1)


@lru_cache(maxsize=PART_BITS + 1)
def _masks(reach: int) -> np.ndarray:
    """All substrings of at most ``reach`` bits set."""
    values = np.arange(1 << PART_BITS, dtype=np.uint16)
    return values[np.bitwise_count(values) <= reach]


class Tables:
    """One table for each substring of the codes: rows ordered by its value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = [np.argsort(codes[:, m], kind="stable") for m in range(codes.shape[1])]
        self.begin = [np.searchsorted(codes[r, m], np.arange((1 << PART_BITS) + 1)) for m, r in enumerate(self.rows)]

    def opened(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows in the buckets that hold every code which differs from ``code`` in at most ``radius`` bits."""
        near, rest = divmod(radius, len(self.rows))
        mark = np.zeros(len(self.codes), bool)
        for m in range(len(self.rows)):
            reach = min(PART_BITS, near if m <= rest else near - 1)
            if reach < 0:
                continue
            values = _masks(reach) ^ code[m]
            first, last = self.begin[m][values], self.begin[m][values.astype(np.int64) + 1]
            some = np.flatnonzero(last > first)
            n = (last - first)[some]
            ends = np.cumsum(n)
            if n.size:
                mark[self.rows[m][np.arange(ends[-1]) + np.repeat(first[some] - ends + n, n)]] = True
        return np.flatnonzero(mark)

    def within(self, code: np.ndarray, radius: int, far: int) -> np.ndarray:
        """The opened rows whose code differs from ``code`` in at most ``far`` bits."""
        got = self.opened(code, radius)
        return got[distances(self.codes[got], code) <= far]


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    some = np.arange(ids.size)
    if ids.size > k:
        some = np.flatnonzero(scores >= np.partition(scores, ids.size - k)[ids.size - k])
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in the same order for every row, so that equal vectors tie."""
    return (x * q).sum(1)


def radii(need: np.ndarray, far: np.ndarray) -> tuple[int, int]:
    """The radius and the distance that keep the wanted shares of neighbours, given what each of these needs."""
    radius = int(np.sort(need)[min(need.size - 1, int(np.ceil(OPEN_RECALL * need.size)))])
    left = np.sort(far[need <= radius])
    return radius, int(left[min(left.size - 1, int(np.ceil(FAR_RECALL * left.size)))])


def _audit(rows: DataFrame, codes: Codes, size: int, k: int, queries: np.ndarray, query_ids: np.ndarray) -> tuple[int, int]:
    """The radius and distance at which the audit queries find enough of their ``k`` nearest of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((codes, queries, query_ids))  # AUDIT_QUERIES vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("vectors")
        codes, queries, query_ids = shared.value
        code = codes.of(queries, query=True)
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1), size)
            all_scores, mine = queries @ x.T, codes.of(x)
            for j in range(len(queries)):
                other = np.flatnonzero(ids != query_ids[j])
                t = other[top(ids[other], all_scores[j, other], k)]
                yield pa.RecordBatch.from_arrays([pa.array([j] * t.size, pa.int64()), pa.array(all_scores[j, t]), pa.array(needed(mine[t], code[j])), pa.array(distances(mine[t], code[j]))], ["q", "score", "need", "far"])

    found = rows.select("id", "v").mapInArrow(run, "q long, score double, need long, far long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "far"))).filter(F.col("rank") <= k)
    got = best.select("need", "far").collect()  # k rows for each audit query
    return radii(np.array([r["need"] for r in got], np.int64), np.array([r["far"] for r in got], np.int64)) if got else (codes.all_codes, codes.bits)


def _search(rows: DataFrame, size: int, k: int) -> DataFrame | None:
    """(query_id, rank, vec_id, score) of the queries among vectors of one length; none without queries."""
    spark = rows.sparkSession
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("extra"), F.lit(0)).alias("q"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    if not facts["q"]:
        return None
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < 1_000_003 * min(1.0, FIT_ROWS / facts["n"])).select("v").limit(2 * FIT_ROWS).toPandas()
    codes = Codes(np.stack(sample["v"]) if len(sample) else np.zeros((1, size)), facts["longest"])
    some = rows.filter("extra = 1").orderBy(F.xxhash64("id"), "id").limit(AUDIT_QUERIES).select("id", "v").collect()
    radius, far = _audit(rows, codes, size, k, np.array([r["v"] for r in some]), np.array([r["id"] for r in some]))
    parts, shared = -(-facts["n"] // SHARD_ROWS), spark.sparkContext.broadcast(codes)
    index = saved(blocks(rows, parts, size), "shards")

    def run(radius: int, far: int):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only("vectors")
            codes, part = shared.value, None
            for of, side, *block in met(batches, size):
                if not side:
                    part, (ids, _, x, _) = of, block
                    tables = Tables(codes.of(x))
                if side == 0 or of != part:
                    continue
                q_ids, _, q_x, _ = block
                out = []
                for q, v, c in zip(q_ids.tolist(), q_x, codes.of(q_x, query=True)):
                    near = tables.within(c, radius, far)
                    near = near[ids[near] != q]
                    score = products(x[near], v)
                    t = top(ids[near], score, k)
                    out.append((np.full(t.size, q), ids[near[t]], score[t]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in zip(*out)], ["query_id", "vec_id", "score"])

        return go

    done, asked = None, rows.filter("extra = 1")
    while True:
        # The stated query set against all rows: every block of queries meets every shard.
        sets = max(1, -(-asked.count() // QUERY_ROWS))
        found = meet(index, blocks(asked, sets, size), parts, sets, QUERY_BLOCKS).mapInArrow(run(radius, far), "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
        found = saved(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")
        enough = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
        short = saved(asked.join(enough, "id", "left_anti"), "short")
        if radius >= codes.all_codes and far >= codes.bits or short.isEmpty():
            return found if done is None else done.unionByName(found)
        found = found.join(enough, found["query_id"] == enough["id"], "left_semi")
        done = found if done is None else done.unionByName(found)
        asked, radius, far = short, min(codes.all_codes, 2 * radius + 1), min(codes.bits, 2 * far + 1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row where ``is_query``, the ``k`` other rows found with the largest inner products.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``; ties go to the smaller id; where there are
    fewer than ``k`` other rows all are returned. Rows are searched among those whose vectors have the same
    length. Vectors that are null, zero, or hold null or non-finite components take no part; neither do rows
    with a null key; a repeated key is a row each, never a neighbour of its own key, and asks once for the
    distinct vectors it has; other columns are ignored.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).cast("long").alias("extra"))
    rows = rows.filter(valid(F.col("v")) & F.col("id").isNotNull())
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size, _ in lengths(rows):
        got = _search(rows.filter(F.size("v") == size), size, k)
        out = out if got is None else out.unionByName(got)
    return out


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of every 20th of all ``embeddings``; nulls, repeated rows and lengths as ``nearest`` says."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)

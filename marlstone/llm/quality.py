"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` code points. A passage is encoded from its character
classes, the pairs of adjacent classes and the repetition of its words. A gated attention layer, learned
from document labels alone, weighs the passages; the weighted sum of their encodings is scored. A bag is a
whole document, in learning as in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.codepoints import codes, groups
from marlstone.llm.language_id import fold
from marlstone.llm.shared import saved, slices, with_fields
from marlstone.llm.worker import only

PASSAGE = 512
FIT_ROWS, FIT_BYTES = 6_000, 64 << 20
THRESHOLD = 0.3
# Character classes of ASCII; the rest are letters (11) or other signs (12).
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",;:", "!?", "*#%$&@^~", "|", "()[]{}<>/\\=+_-"]
N_CLASSES = 13
FEATURES = N_CLASSES + N_CLASSES * N_CLASSES + 4


def _class_table() -> np.ndarray:
    table = np.full(0x3000, 12, np.int64)
    for i in range(0x80, 0x3000):
        if chr(i).isalpha():
            table[i] = 1 if chr(i).isupper() else 11
    for k, chars in enumerate(_GROUPS):
        table[[ord(c) for c in chars]] = k
    return table


_CLASS = _class_table()
_POSITION = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def encode_passages(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of each part (passages x ``FEATURES``) and the passages of each part (1 at least)."""
    length = np.array([len(p) for p in parts], np.int64)
    n = np.maximum(1, -(-length // PASSAGE))
    c = codes("".join(parts))
    inside = np.arange(c.size) - np.repeat(np.cumsum(length) - length, length)
    of = np.repeat(np.cumsum(n) - n, length) + inside // PASSAGE
    total = int(n.sum())
    kind = _CLASS[np.minimum(c, 0x2FFF)]
    size = np.maximum(np.bincount(of, minlength=total), 1).astype(np.float64)
    one = np.bincount(of * N_CLASSES + kind, minlength=total * N_CLASSES).reshape(total, -1)
    same = of[1:] == of[:-1]
    two = np.bincount((of[1:] * N_CLASSES * N_CLASSES + kind[:-1] * N_CLASSES + kind[1:])[same], minlength=total * N_CLASSES * N_CLASSES).reshape(total, -1)
    # Words: their number, and how many equal the word before.
    space = (kind == 3) | (kind == 4)
    start = ~space & np.concatenate([[True], space[:-1] | ~same])[: c.size]
    s = np.flatnonzero(start)
    words = np.bincount(of[s], minlength=total)
    again = np.zeros(total, np.int64)
    if s.size:
        place = np.minimum(np.arange(c.size) - np.maximum.accumulate(np.where(start, np.arange(c.size), 0)), 63)
        h = np.add.reduceat(np.where(space, np.uint64(0), c.astype(np.uint64) * _POSITION[place]), s)
        again = np.bincount(of[s[1:]][(h[1:] == h[:-1]) & (of[s[1:]] == of[s[:-1]])], minlength=total)
    more = np.stack([again / np.maximum(words, 1), size / np.maximum(words, 1) / 20, np.log1p(size) / 7, (words <= 3) * 1.0], 1)
    return np.concatenate([np.sqrt(one / size[:, None]), np.sqrt(two / size[:, None]), more], 1).astype(np.float32), n


def bags(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of passages and the number of the text of each, group by group; null counts as empty."""
    for at, parts in groups([t or "" for t in texts], limit=PASSAGE << 11):
        x, n = encode_passages(parts)
        yield x, np.repeat(np.array(at), n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Parameters of the passage encoder, the gated attention and the document score."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, hidden: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        put = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.std = mean, std
        self.p = {"E": put(mean.size, hidden), "e": np.zeros(hidden, np.float32), "V": put(hidden, gate), "U": put(hidden, gate), "w": put(gate, 1)[:, 0], "c": put(hidden, 1)[:, 0], "b": np.zeros(1, np.float32)}

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        x = (x - self.mean) / self.std
        e = np.tanh(x @ self.p["E"] + self.p["e"])
        t, g = np.tanh(e @ self.p["V"]), _sigmoid(e @ self.p["U"])
        return x, e, t, g, (t * g) @ self.p["w"]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text; attention sums over parts of a long text are carried on."""
        weight, rep = np.zeros(len(texts)), np.zeros((len(texts), self.p["c"].size))
        for x, of in bags(texts):
            _, e, _, _, a = self.passages(x)
            a = np.exp(a.astype(np.float64))  # at most the sum of the sizes of ``w``
            np.add.at(weight, of, a)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            np.add.at(rep, of[first], np.add.reduceat(e * a[:, None], first, axis=0))
        return _sigmoid(rep / weight[:, None] @ self.p["c"] + self.p["b"][0])

    def gradients(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The weighted log loss of documents of ``size`` passages each, and its derivatives."""
        p = self.p
        starts = np.cumsum(size) - size
        k = np.repeat(np.arange(size.size), size)
        x, e, t, g, a = self.passages(x)
        a = np.exp(a - np.maximum.reduceat(a, starts)[k])
        a /= np.add.reduceat(a, starts)[k]
        z = np.add.reduceat(e * a[:, None], starts, axis=0)
        s = _sigmoid(z @ p["c"] + p["b"])
        loss = -(weight * np.log(np.where(y == 1, s, 1 - s))).sum()
        dl = ((s - y) * weight).astype(s.dtype)
        dz = dl[:, None] * p["c"]
        da = (e * dz[k]).sum(1)
        ds = a * (da - np.add.reduceat(a * da, starts)[k])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        de = a[:, None] * dz[k] + dt @ p["V"].T + dg @ p["U"].T
        de *= 1 - e * e
        return float(loss), {"E": x.T @ de, "e": de.sum(0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dl, "b": dl.sum(keepdims=True)}

    def train(self, x: np.ndarray, of: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> None:
        """Adam on the class-balanced log loss of the documents; ``of`` is sorted."""
        rng, p = np.random.default_rng(seed), self.p
        lo, hi = np.searchsorted(of, np.arange(y.size)), np.searchsorted(of, np.arange(y.size), side="right")
        balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * y.size
        m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(y.size)
            for i in range(0, y.size, batch):
                d = order[i : i + batch]
                size = hi[d] - lo[d]
                rows = np.repeat(lo[d] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                _, grad = self.gradients(x[rows], size, y[d], balance[d] / d.size)
                step += 1
                for n, q in grad.items():
                    q = q + 1e-4 * p[n]
                    m[n] = 0.9 * m[n] + 0.1 * q
                    v[n] = 0.999 * v[n] + 0.001 * q * q
                    p[n] -= (rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", where: Column | None = None, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """A model from labelled documents in the order of a hash of their keys, as many as ``fit_rows`` and ``fit_bytes`` of features allow.

    The sizes of features are known from the lengths of texts; a document that does not fit is left out, those behind it are not.

    A document with several labels counts as 1 only if all are 1, and one with several texts as the first in
    their order; null keys and labels are no examples. Features are kept in 16 bits. Without
    examples of both labels the model gives 0.5 plus or minus nothing it has learned: it stays untrained.
    """
    some = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    some = some.filter("key IS NOT NULL AND y IS NOT NULL")
    if where is not None:
        some = some.filter(where)
    some = some.groupBy("key").agg(F.min("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(fit_rows)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(some), "key")  # fit_rows rows at most
    rows = saved(rows.groupBy("key", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "examples")
    cost = F.greatest(F.lit(1), F.ceil(F.length("text") / PASSAGE)) * (2 * FEATURES)
    chosen, bytes_ = [], 0
    for r in rows.select("key", F.xxhash64("key").alias("h"), cost.alias("bytes")).orderBy("h", "key").collect():  # fit_rows rows at most
        if bytes_ + r["bytes"] <= fit_bytes:
            chosen.append((r["key"],))
            bytes_ += r["bytes"]
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, rows.select("key").schema)), "key").select("key", "y", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 256):
                held: dict[int, list[np.ndarray]] = {}
                for x, of in bags(b.column(2).to_pylist()):
                    for i in np.unique(of).tolist():
                        held.setdefault(i, []).append(x[of == i].astype("<f2"))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), pa.array([np.concatenate(held[i]).tobytes() for i in range(b.num_rows)], pa.binary())], ["key", "y", "x"])

    rows = rows.mapInArrow(encode, "key long, y long, x binary")
    got = sorted(rows.collect(), key=lambda r: r["key"])  # fit_bytes at most
    if len({r["y"] for r in got}) < 2:
        model = Model(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32))
        model.p["c"][:] = 0
        return model
    x = [np.frombuffer(r["x"], "<f2").astype(np.float32).reshape(-1, FEATURES) for r in got]
    n = np.array([len(a) for a in x])
    x = np.concatenate(x)
    model = Model(x.mean(0), x.std(0) + 0.02)
    model.train(x, np.repeat(np.arange(n.size), n), np.array([r["y"] for r in got]))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1, of every whole text, from the text alone.

    Null and empty texts are one empty passage and get its score. A column named ``score`` is replaced;
    all others, nulls and repeated rows are kept.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand floats
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for whole in batches:
            for b in slices(whole, 512):
                got = shared.value.scores(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got.astype(np.float64))], [*b.schema.names, "score"])

    return docs.mapInArrow(run, with_fields(docs, score="double"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; nulls, empty texts and repeated rows as ``fit`` and ``score`` say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, where=fold(F.col("key"), 5) != 0)
    got = score(docs.select("doc_id", "text"), model)
    return got.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

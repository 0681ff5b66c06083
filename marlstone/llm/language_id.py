"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; its n-grams of 1 to 3 code points, white-space runs and digits folded, are hashed
into ``BUCKETS`` buckets. Counts by language are summed by Spark over a sample of at most ``fit_rows``
labelled rows (a documented bound of the fit, not of the prediction); the log-probability matrix, of
languages x buckets, and the log of each language's share of the sample are broadcast, and batches are
scored by summing rows of the matrix over the n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.codepoints import codes, groups
from marlstone.llm.shared import slices, with_fields
from marlstone.llm.worker import only

BUCKETS = 1 << 15
FIT_ROWS = 20_000
MAX_LANGUAGES = 1_000  # 128 MiB of matrix
UNDETERMINED = "und"
# n-grams that count at most towards the score of a text; more evidence changes the choice, not its scale.
EVIDENCE = 60.0
_LETTER = re.compile(r"[^\W\d_]")
# Odd multipliers of the n-gram hash.
_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_buckets(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram that starts at each character (characters x 3) and the length of each part.

    An n-gram that would leave its part is given the bucket of the shorter one.
    """
    length = np.array([len(p) for p in parts], np.int64)
    c = codes("".join(parts)).astype(np.uint32)
    c = np.where(c < 65, np.uint32(32), c)
    out = np.empty((c.size, 3), np.int32)
    left = np.repeat(np.cumsum(length), length) - np.arange(c.size)
    h = np.zeros(c.size, np.uint32)
    for n in range(3):
        step = c[n:] * _M[n]
        step ^= step >> np.uint32(15)
        h[: c.size - n] += np.where(left[: c.size - n] > n, step * np.uint32(2654435761), np.uint32(0))
        out[:, n] = (h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)
    return out, length


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, where: Column | None = None, key: str = "doc_id") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log-probability matrix (buckets x languages) and log priors from at most ``fit_rows`` labelled rows.

    Rows are sampled by the hash of their text and, if there is one, key at the rate that the labelled rows allow. Rows without
    text or language are no examples; without any example there is no language and nothing can be told.
    More than ``MAX_LANGUAGES`` languages are an error, for the matrix is broadcast.
    """
    rows = docs.select(F.xxhash64(*([key] if key in docs.columns else []), text).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang"), (F.lit(True) if where is None else where).alias("ok"))
    rows = rows.filter("ok AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    rate = min(1.0, fit_rows / max(1, rows.count()))
    rows = rows.filter((F.pmod("h", F.lit(1_000_003)) < rate * 1_000_003)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        examples: dict[str, int] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for g in langs:
                examples[g] = examples.get(g, 0) + 1
            for at, parts in groups([t.lower() for t in b.column(0).to_pylist()], overlap=2):
                h, length = ngram_buckets(parts)
                of = np.repeat(np.array([langs[i] for i in at], object), length)
                for g in {langs[i] for i in at}:
                    sums.setdefault(g, np.zeros(BUCKETS, np.int64))
                    sums[g] += np.bincount(h[of == g].ravel(), minlength=BUCKETS)
        for g, n in sums.items():
            k = np.flatnonzero(n)
            k, n = np.append(k, BUCKETS), np.append(n[k], examples[g])  # the last one counts rows
            yield pa.RecordBatch.from_arrays([pa.array([g] * k.size), pa.array(k), pa.array(n)], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def packed(cells: pa.Table) -> pa.Table:
        n = np.zeros(BUCKETS + 1, np.int64)
        n[cells.column("bucket").to_numpy()] = cells.column("n").to_numpy()
        return pa.table({"lang": cells.column("lang")[:1], "cells": pa.array([n.tobytes()], pa.binary())})

    got = sums.groupBy("lang").applyInArrow(packed, "lang string, cells binary").collect()  # BUCKETS numbers a language
    langs = sorted(r["lang"] for r in got)
    counts = np.ones((BUCKETS + 1, len(langs)))
    for r in got:
        counts[:, langs.index(r["lang"])] += np.frombuffer(r["cells"], np.int64)
    grams, examples = counts[:-1], counts[-1]
    return langs, np.log(grams / grams.sum(0, keepdims=True)).astype(np.float32), np.log(examples / max(1.0, examples.sum()))


def predict_texts(texts: list[str | None], langs: list[str], matrix: np.ndarray, prior: np.ndarray | float = 0.0) -> tuple[list[str], np.ndarray]:
    """The language of each text and its score; ``und`` and 0 for texts without a letter."""
    letters = [bool(t and _LETTER.search(t)) for t in texts]
    total, n = np.zeros((len(texts), max(1, len(langs)))), np.zeros(len(texts))
    if langs:
        for at, parts in groups([t.lower() if ok else "" for t, ok in zip(texts, letters)], overlap=2):
            h, length = ngram_buckets(parts)
            full = np.flatnonzero(length)
            if full.size:
                starts = (np.cumsum(length) - length)[full]
                cells = matrix[h[:, 0]] + matrix[h[:, 1]] + matrix[h[:, 2]]
                np.add.at(total, np.array(at)[full], np.add.reduceat(cells, starts, axis=0, dtype=np.float64))
                np.add.at(n, np.array(at)[full], 3.0 * length[full])
    n = np.maximum(n, 1)
    z = (total + prior) * (np.minimum(n, EVIDENCE) / n)[:, None] if langs else total
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    known = np.array(letters) & bool(langs)
    best = p.argmax(1)
    return [langs[j] if ok else UNDETERMINED for j, ok in zip(best.tolist(), known.tolist())], np.where(known, p.max(1), 0.0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) of every whole text.

    Null texts, empty texts and texts without a letter are ``und`` with score 0. Columns of these two
    names are replaced; all others, nulls and repeated rows are kept.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language_id")
        langs, matrix, prior = shared.value
        for whole in batches:
            for b in slices(whole, 512):
                found, score = predict_texts(b.column(at).to_pylist(), langs, matrix, prior)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, with_fields(docs, lang_pred="string", score="double"))


def fold(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % n


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all ``documents``; nulls, texts without letters and repeated rows as ``fit`` and ``identify`` say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, where=fold(F.col("doc_id"), 4) != 2)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

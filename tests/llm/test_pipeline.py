"""The pipeline against its stages' own rules, computed plainly."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import language_id, quality, tokenize
from tests.llm.test_duplicates import brute_components, brute_spans

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "language_id", "ngram_jaccard_join", "suffix_array_dedup", "packing"]
    quality = steps["quality_classifier"](spark, docs, SF)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in quality.collect()}
    assert quality.columns == COLUMNS and sum((k in kept) == bool(v) for k, v in labels.items()) >= 0.97 * len(labels)
    language = steps["language_id"](spark, quality, SF)
    assert language.columns == COLUMNS and language.count() >= 0.98 * len(kept)

    joined = steps["ngram_jaccard_join"](spark, docs, SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert joined.columns == COLUMNS
    assert {r["doc_id"] for r in joined.collect()} == {k for k, (_, c) in brute_components(rows, 5, 80).items() if k == c}

    left = steps["suffix_array_dedup"](spark, docs, SF)
    want = {k: n - gone for k, (n, gone, _, _) in brute_spans(rows).items()}
    assert left.columns == COLUMNS
    for r in left.collect():
        assert len(r["text"].encode()) <= want[r["doc_id"]] and r["n_chars"] == len(r["text"])


def rest(docs):
    """The texts without bytes that a 100-byte string which starts earlier covers."""
    seen, out = set(), {}
    for k, t in sorted(docs):
        b = (t or "").encode()
        keep = bytearray(b"\x01" * len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                keep[i : i + 100] = bytes(100)
            seen.add(b[i : i + 100])
        out[k] = bytes(x for x, y in zip(b, keep) if y).decode("utf-8", "ignore")
    return out


def test_run(spark):
    """All five stages, computed plainly from the fitted models, give the documents and the ids of every piece."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).scores([t for _, t in rows])
    rows = [r for r, s in zip(rows, scores.tolist()) if s >= quality.THRESHOLD]
    langs, matrix, prior = language_id.fit(docs.filter(F.col("doc_id").isin([k for k, _ in rows])))
    found, score = language_id.predict_texts([t for _, t in rows], langs, matrix, prior)
    rows = [r for r, f, s in zip(rows, found, score.tolist()) if f != "und" and s >= corpus_pipeline.LANGUAGE_SCORE]
    same = brute_components(rows, 5, 80)
    rows = [r for r in rows if same[r[0]][1] == r[0]]
    left = rest(rows)
    texts = {k: left[k] for k, t in rows if left[k] == t or left[k].strip(" ")}
    library = Tokenizer.from_file(tokenize.default_path())
    want = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}

    pieces = corpus_pipeline.run(spark, SF).collect()
    assert len(texts) > 50 and {r["doc_id"] for r in pieces} == set(want)
    done = dict.fromkeys(want, 0)
    for r in pieces:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        done[r["doc_id"]] += r["length"]
    assert done == {k: len(ids) for k, ids in want.items()}


def test_empty_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, None, None), (2, None, None, None, None), (3, "the and of " * 30_000, "en", "s", 9)]):
        frame = spark.createDataFrame(rows, docs.schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, str(tmp_path)).collect()

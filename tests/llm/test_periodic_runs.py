"""Periodic runs against a plain search over all stretches, and the query against a plain form of its contract."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import periodic_runs


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def plain_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i:
                b, e = i, j + q
                if e - b >= max(6, 4 * q) and smallest_period(w[b:e]) == q:
                    out.add((b, e - b, q))
            i = j + 1
    return sorted(out)


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{k},{q}\n" for s, k, q in runs), plain_collapsed(w, runs))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digest)


letters = st.text(alphabet="ab", max_size=40) | st.text(alphabet="abc", max_size=60) | st.tuples(st.text(alphabet="abc", min_size=1, max_size=5), st.integers(1, 12), st.text(alphabet="ab", max_size=8)).map(lambda t: t[2] + t[0] * t[1] + t[2])


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, max_size=5))
def test_runs_equal_plain_search(texts):
    import pyarrow as pa

    n, runs, collapsed = periodic_runs._texts(pa.array([" ".join(t) for t in texts], pa.string()))
    assert n == [len(t) for t in texts]
    assert runs == [plain_runs(list(t)) for t in texts]
    assert collapsed == [plain_collapsed(list(t), plain_runs(list(t))) for t in texts]


@pytest.mark.parametrize("pairs", [8, 1 << 21])
def test_lag_counts_are_exact(monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, k, n) for n, k in ((0, 1), (1, 1), (300, 1), (500, 3), (257, 40), (900, 400), (3, 2))]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got, base = periodic_runs.lag_matches(np.concatenate(texts), off)
    for t, a, z in zip(texts, base[:-1], base[1:]):
        assert got[a + 1 : z].tolist() == [int((t[q:] == t[:-q]).sum()) for q in range(1, len(t) // 4 + 1)]
    heavy = [(np.bincount(t) > periodic_runs.heavy_from(np.array(len(t)))).sum() for t in texts if len(t)]
    assert max(heavy) >= 3 and min(heavy) == 0


def test_query_equals_plain_form(spark, sf, tmp_path):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids = [i for i in range(100_000, 101_000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    odd = ["", "x", None, " \t\n", "go " * 50, "a b a b a b a b", "a\x1cb " * 9, "é ü é ü é ü é ü é", "ha ha " * 7, "A a " * 5 + "a " * 9]
    rows = given + [(i, odd[k % len(odd)]) for k, i in enumerate(ids)] + [(7_000_001 + k, t) for k, t in enumerate(odd)] + given[:2]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()))
    assert got == sorted(plain_row(*r) for r in rows)


def test_long_text_nulls_and_empty_table(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000)) + " stop" * 30_000
    docs = spark.createDataFrame([(None, "a " * 8), (None, None), (1, long)], "doc_id long, text string")
    got = {r["n_words"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[8]["runs"]] == [(0, 8, 1)] and got[8]["collapsed"] == "a" and tuple(got[8]["strongest"]) == (0, 8, 1)
    assert got[0]["runs"] == [] and got[0]["strongest"] is None and got[0]["collapsed"] == ""
    assert [tuple(r) for r in got[90_000]["runs"]] == [(0, 60_000, 977), (60_000, 30_000, 1)]
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []

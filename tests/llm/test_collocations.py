"""Collocations against a plain count, sketches that collide, and texts that are cut."""

import re
from collections import Counter

import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import collocations
from marlstone.llm.collocations import Grams, collocations as mined

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def plain_counts(texts, longest):
    out = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            out.update(" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return out


def plain_collocations(rows, least, longest, top, subsumed):
    out = []
    for lang in {r[1] or "und" if r[1] is None else r[1] for r in rows}:
        f = plain_counts([t for t, x in rows if ("und" if x is None else x) == lang], longest)
        n = sum(c for p, c in f.items() if " " not in p)
        own = {p: c for p, c in f.items() if " " in p and c >= least}
        found = []
        for p, a in own.items():
            w = p.split(" ")
            score, _, l, r = min((1_000_000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w)))
            if not any(f" {p} " in f" {q} " and q != p and 100 * c >= subsumed * a for q, c in own.items()):
                found.append((-score, -a, p.encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


TEXTS = ["the red fox. The red fox ran, the red fox!", "A b\ta b a b a b\x0ba b", "é ü é ü: É ü", "to be or not to be", "", None, "  , ; ", "new york city in new york state; new york", "x" * 300 + " y " + "x" * 300 + " y"]


@pytest.mark.parametrize("least, longest, chunk, share, top", [(2, 3, 4 << 20, 1_000, 2_000), (3, 3, 40, 5, 4), (2, 5, 25, 20, 50), (300, 2, 60, 1, 9)])
def test_equals_plain_form(spark, monkeypatch, least, longest, chunk, share, top):
    monkeypatch.setattr(collocations, "HOT_SHARE", share)
    rows = [(TEXTS[k % len(TEXTS)], ["en", "de", None, "und", ""][k % 5 if k % 3 else 0]) for k in range(90)] + [("go on " * 400, "en"), ("to be, " * 300, "und")]
    docs = spark.createDataFrame([(k, t, x, "x", 1) for k, (t, x) in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in mined(docs, least=least, longest=longest, top=top, chunk_bytes=chunk).collect())
    assert got == plain_collocations(rows, least, longest, top, 50)
    assert got or least == 300 and longest == 2


def test_empty_and_textless_tables(spark):
    docs = spark.createDataFrame([(1, None, None, "x", 1), (2, " ,", "en", "x", 1)], SCHEMA)
    assert mined(docs).collect() == []
    assert mined(docs.limit(0)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ,\té", max_size=60), st.integers(1, 30), st.integers(1, 4))
def test_cut_texts_lose_and_repeat_nothing(text, limit, longest):
    whole, parts = plain_counts([text], longest), Counter()
    for skip, raw in collocations.cut(text.encode(), limit, longest):
        g = Grams("en", raw, skip, longest)
        words = g.vocabulary.cast(pa.string()).to_pylist()
        for columns, counts in zip(g.words, g.counts):
            parts.update({" ".join(words[i] for i in c): n for c, n in zip(columns.tolist(), counts.tolist()) if n})
    assert parts == whole


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d e f g h i j k l m n o p".split()), max_size=30), min_size=1, max_size=6), st.integers(1, 600), st.sampled_from([1, 4, 64]))
def test_survivors_hold_all_frequent_phrases(texts, least, blocks):
    """Sketches of 8 to 512 cells in blocks of 8, so that most cells collide."""
    kept, collocations.BLOCK_BITS, collocations.FOUND_ROWS = (collocations.BLOCK_BITS, collocations.FOUND_ROWS), 3, 40
    try:
        texts = [" ".join(t) for t in texts] + ["a b " * 100] * 2
        chunks = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "chunk": list(range(len(texts))), "skip": [0] * len(texts), "text": [zstandard.compress(t.encode()) for t in texts]})
        touched = pa.Table.from_batches(list(collocations._touched(3, blocks, least)([chunks]))).sort_by([("block", "ascending"), ("chunk", "ascending")])
        answers = pa.Table.from_batches(list(collocations._merged(least)(touched.to_batches(max_chunksize=3))))
        each = [{"lang": "en", "skip": 0, "text": zstandard.compress(t.encode()), "bits": None, "chunk": i, "block": -1} for i, t in enumerate(texts)]
        rows = sorted(each + [{"lang": None, "skip": None, "text": None, **a} for a in answers.to_pylist()], key=lambda r: (r["chunk"], r["block"]))
        schema = pa.schema([("lang", pa.string()), ("skip", pa.int32()), ("text", pa.binary()), ("bits", pa.binary())])
        found = Counter()
        packed = pa.Table.from_batches(list(collocations._survivors(3, blocks, 5)(pa.Table.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema).to_batches(max_chunksize=4))))
        for b in collocations._exact(1)(packed.sort_by([("lang", "ascending"), ("bucket", "ascending")]).to_batches(max_chunksize=2)):
            for r in b.to_pylist():
                assert len(r["phrase"].split(" ")) == r["size"]
                found[r["phrase"]] += r["f"]
        true = plain_counts(texts, 3)
        assert {p for p, c in true.items() if c >= least} <= set(found)
        assert all(true[p] == c for p, c in found.items())
        if blocks == 64 and least > 5 + sum(map(len, texts)):
            assert not found
    finally:
        collocations.BLOCK_BITS, collocations.FOUND_ROWS = kept

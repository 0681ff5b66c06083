"""Token output, packing and pieces against the libraries and exact round trips."""

import copy
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import packing, pieces, token_output, tokenize
from marlstone.llm.shared import shared_dir

ODD = ["", " ", "a  b \n c", "<|endoftext|> x", "don't  stop\r\n\tnow  ", "é x 日本 語 😀", "x " * 50 + "  ", "a\x1cb \x1c c", "\n b", "#  $ 12a", " lead", "tail ", "'s it's", " wide  x"]
SCHEMA = "doc_id long, text string, n_tokens string, start string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenize.default_path())


def fresh(cache):
    """An encoder that has met nothing; the library's tables are read once."""
    encode = copy.copy(tokenize.encoder(tokenize.default_path()))
    encode.cache = cache
    encode._clear()
    return encode


def truth(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab zÉé日!'\n\t  .,1s"), max_size=40), max_size=6))
def test_encoder_equals_library(texts):
    encode = tokenize.encoder(tokenize.default_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [truth(encode.tok, t) for t in texts]


@pytest.mark.parametrize("texts", [["the", "the dog"], ["the cat", "the dog"], ["Hello world", "Hello there"], ["a b", " c"], ["", "", " a"], ["x", "", "x  y\n z"]])
def test_fresh_encoder(library, texts):
    encode = tokenize.Encoder(tokenize.default_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [truth(library, t) for t in texts]
    ids, sizes = tokenize.Encoder(tokenize.default_path()).encode(pa.array(texts), end=0)
    assert ids.tolist() == [i for t in texts for i in [*truth(library, t), 0]]
    assert sizes.tolist() == [len(truth(library, t)) + 1 for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet=st.sampled_from("ab zé!'\n\t  1s"), max_size=12), max_size=5), max_size=4))
def test_fresh_encoder_that_forgets(tables):
    encode = fresh(50)
    for texts in tables:
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [truth(encode.tok, t) for t in texts]


def test_lines_that_do_not_come_back_whole(library):
    encode = fresh(1 << 20)
    chunks = [b"the", b"", b" dog", b"  ", b" x", b"end"]
    ids, sizes = encode._lines(chunks)
    assert np.concatenate(ids).tolist() == [i for c in chunks for i in truth(library, c.decode())]
    assert sizes.tolist() == [len(truth(library, c.decode())) for c in chunks]


def test_encoder_with_a_small_cache(library, spark, sf):
    encode = tokenize.Encoder(tokenize.default_path(), cache=50)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect()]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [truth(library, t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60_000) | st.integers(0, 1), max_size=700))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, lanes = token_output.pack(ids)
    assert (token_output.unpack(words, lanes, ids.size) == ids).all()
    assert lanes.size == -(-ids.size // token_output.LANE)


def test_token_files(spark, library):
    rows = [(i, t, "x", None) for i, t in enumerate(ODD)] + [(100, None, "y", "z"), (50, "same", None, None), (50, "same", None, None), (None, "no key", None, None), (7_000, "w " * 70_000, None, None)]
    docs = spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)
    path = shared_dir(spark, "test")
    token_output.write_ids(docs, path)
    got = sorted(token_output.read_ids(spark, path).collect(), key=lambda r: r["start"])
    want, at = [], 0
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*truth(library, text), 0]
        want.append((key, at, len(ids), ids))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_output.read_ids(spark, path, digest=True).collect()}
    assert digests == {(k, s): zlib.crc32(np.array(i, "<u4").tobytes()) for k, s, _, i in want}


def test_token_files_empty(spark):
    path = shared_dir(spark, "test")
    token_output.write_ids(spark.createDataFrame([], SCHEMA), path)
    assert token_output.read_ids(spark, path).collect() == []


def best_cost(places, costs, window):
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        best[j] = costs[j] + min(best[i] + window - places[j] + places[i] for i in range(j) if places[j] - places[i] <= window)
    return best[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 8), st.integers(0, 5)), min_size=1, max_size=40))
def test_cuts_are_cheapest(steps):
    places = [0, *np.cumsum([s for s, _ in steps]).tolist()]
    costs = [0, *(c for _, c in steps)]
    cuts = packing.best_cuts(places, costs, 8)
    cost = sum(costs[places.index(c)] for c in cuts) + sum(8 - b + a for a, b in zip([0, *cuts], cuts))
    assert cost == best_cost(places, costs, 8)
    assert all(0 < b - a <= 8 for a, b in zip([0, *cuts], cuts)) and cuts[-1] == places[-1]


def check_pieces(rows, docs, library):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    padding = tokens = 0
    for key, text in docs:
        ids = [*truth(library, text), 0]
        at = 0
        for p in sorted(by_doc[key], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / max(1, tokens)


def test_packing(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    share = check_pieces(packing.pack_documents(docs).collect(), [tuple(r) for r in docs.collect()], library)
    assert share < 0.02


def test_packing_edges(spark, library):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (91, "x" * 9_000), (92, "w. " * 3_000)]
    frame = spark.createDataFrame([(*d, "a", "b") for d in docs], SCHEMA)
    check_pieces(packing.pack_documents(frame).collect(), docs, library)
    assert packing.pack_documents(frame.limit(0)).collect() == []
    twice = frame.filter("doc_id = 5").union(frame.filter("doc_id = 5")).coalesce(1)
    rows = packing.pack_documents(twice).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and sum(r["length"] for r in rows) == 2 * rows[0]["doc_tokens"]
    null_key = spark.createDataFrame([(None, "x", None, None)], SCHEMA)
    assert packing.pack_documents(null_key, with_ids=True).first()["doc_id"] is None


def viterbi(model, word):
    known = {p: k for k, p in enumerate(model.pieces)}
    best = [(0.0, 0, -1)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - model.longest), j):
            k = known.get(word[i:j], -1)
            if k < 0 and j - i > 1:
                continue
            total = best[i][0] + (model.score[k] if k >= 0 else model.unknown)
            if best[j] is None or total > best[j][0]:
                best[j] = (total, i, k)
    out, j = [], len(word)
    while j:
        _, i, k = best[j]
        out = (model._fallback(word[i]) if k < 0 else [int(model.ids[k])]) + out
        j = i
    return out


def test_pieces_equal_plain_viterbi():
    model = pieces.piece_model(pieces.default_path())
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeé日theing▁qu\n"), rng.integers(1, 25))) for _ in range(400)]
    for w, raw in zip(words, model.segment(words)):
        assert np.frombuffer(raw, "<u4").tolist() == viterbi(model, w), w


def test_pieces_of_rows(spark):
    texts = [*ODD, "▁x ▁", None, "日" * 3000, "a" * 20_000]
    rows = [(i % 9, t, "x", "y") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_pieces string, n_bytes string")
    done = pieces.decode_pieces(pieces.encode_pieces(frame))
    got = done.collect()
    assert len(got) == len(rows) and all(r["decodes"] for r in got)
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for t in texts)
    assert pieces.encode_pieces(frame.limit(0)).collect() == []


def test_double_array_holds_exactly_its_keys():
    rng = np.random.default_rng(0)
    keys = sorted({tuple(rng.integers(1, 6, rng.integers(1, 6)).tolist()) for _ in range(200)})
    t = pieces.DoubleArray(keys)
    for key in keys:
        s = 0
        for c in key:
            n = t.base[s] + c
            assert t.check[n] == s
            s = n
        assert keys[t.leaf[s]] == key
    assert (t.leaf >= 0).sum() == len(keys)

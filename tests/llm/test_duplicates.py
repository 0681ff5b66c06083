"""Near copies, similar vectors and repeated strings against brute force."""

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, near_vectors, ngram_join, suffix_dedup, worker
from marlstone.llm import vectors as vector_blocks
from marlstone.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def tie(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


def grams(text, size):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(docs, size, threshold):
    sets, union = {k: grams(t, size) for k, t in docs}, Union()
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                union.tie(a, b)
    return {k: (len(sets[k]), union.root(k)) for k in keys}


def variants(seed, n=60):
    rng = np.random.default_rng(seed)
    base = [rng.choice(["al", "be", "ce", "de", "ef", "gi"], 60).tolist() for _ in range(4)]
    out = []
    for _ in range(n):
        w = list(base[rng.integers(4)])
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(60)] = "x%d" % rng.integers(30)
        out.append(" ".join(w[: rng.integers(40, 61)]))
    return out


@pytest.mark.parametrize("size,threshold,block,bits", [(4, 85, 1024, 32), (5, 80, 4, 8)])
def test_ngram_components(spark, monkeypatch, size, threshold, block, bits):
    """Short hashes collide everywhere; they must cost time alone."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(ngram_join, "TIE_DOCS", block)
    texts = [*variants(1), None, "", " \t ", "one", "One", "one two three", "ONE two\nthree", "a b c d", "é É", "w " * 30_000]
    docs = [*enumerate(texts), *((1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, n_shingles string, component_id int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(frame, size=size, threshold=threshold, bits=bits).collect()}
    assert got == brute_components(docs, size, threshold)


def test_ngram_edges(spark):
    frame = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "A b c d e")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(frame).collect()), key=str)
    assert got == [(2, 2), (3, 2), (3, 2), (None, None)]
    assert ngram_join.ngram_components(frame.limit(0)).collect() == []


def test_texts_that_share_nothing_stay_apart(spark):
    rows = [(1, "w4x alpha139684 beta46561 gamma442"), (2, "w18x alpha246592 beta82197 gamma396")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (32, 1):
        assert {r["component_id"] for r in ngram_join.ngram_components(frame, bits=bits).collect()} == {1, 2}


def test_one_key_with_several_texts_is_one_node(spark):
    rows = [(1, "a b c d e"), (2, "p q r s t u"), (2, "a b c d e"), (3, "P q r s t u"), (4, "other words are these ones")]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_frequent_ngrams_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LOCAL_COUNT", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT_SHARE", 10**9)
    texts = [f"{t} and so it goes on with one common line" for t in variants(2, 300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(frame).collect()}
    assert got == brute_components(list(enumerate(texts)), 4, 85)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(1000, x) for x in range(1001, 1100)] + [(x, x + 1) for x in range(2000, 2070)] + [(5000, 5000)]
    union = Union()
    for a, b in edges:
        union.tie(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: union.root(x) for x in list(union)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_spans(docs):
    seen, out = set(), {}
    for k, t in sorted(docs):
        b, spans = (t or "").encode(), []
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w not in seen:
                seen.add(w)
            elif spans and i <= spans[-1][1]:
                spans[-1][1] = i + 100
            else:
                spans.append([i, i + 100])
        rest, at = b"", 0
        for s, e in spans:
            rest, at = rest + b[at:s], e
        rest += b[at:]
        out[k] = (len(b), len(b) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_suffix_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 3000)
    rng = np.random.default_rng(5)
    passage = ["".join(rng.choice(list("abcdefgh éß\x00"), n)) for n in (99, 100, 101, 130, 400)]
    make = lambda: "".join(passage[rng.integers(5)] if rng.random() < 0.3 else "".join(rng.choice(list("mnopqr "), rng.integers(1, 90))) for _ in range(rng.integers(1, 9)))
    texts = [make() for _ in range(60)] + ["ab" * 300, "a" * 99, "a" * 100, "a" * 350, "", None, "ab" * 300]
    docs = list(enumerate(texts))
    if chunk > 700:
        docs += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, n_bytes string, n_spans string").repartition(5)
    rows = suffix_dedup.remove_repeats(frame, digest=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute_spans(docs)


def test_hot_anchors_are_split(spark, monkeypatch):
    limit = 20_000
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", limit, raising=False)
    compare = suffix_dedup._compare

    def watched(batches):
        size = {}

        def through():
            for b in batches:
                for h, raw in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                    size[h] = size.get(h, 0) + len(raw)
                assert max(size.values(), default=0) <= limit, "one anchor in one task"
                yield b

        yield from compare(through())

    monkeypatch.setattr(suffix_dedup, "_compare", watched)
    rng = np.random.default_rng(7)
    text = lambda n, of="abcdefgh ": "".join(rng.choice(list(of), n))
    line = text(97)
    docs = [(i, text(150) + "xyz"[i % 3] + line + text(1, "no") + text(rng.integers(0, 9), "pq") + text(140)) for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = suffix_dedup.remove_repeats(frame, digest=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute_spans(docs)
    assert sum(r["n_removed"] > 0 for r in rows) > 50


def test_suffix_dedup_edges(spark):
    text = "".join(np.random.default_rng(6).choice(list("abcdefgh "), 300))
    frame = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(frame).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0, 0, 0] and sum(r["text"] is None for r in got) == 1
    assert suffix_dedup.remove_repeats(frame.limit(0)).collect() == []
    both = spark.createDataFrame([(1, text), (2, "x" + text + "y")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(both).collect()} == {1: text, 2: "xy"}


def test_shared_keys(spark):
    rng = np.random.default_rng(9)
    a, b, c, d = ("".join(rng.choice(list("abcdefgh "), 300)) for _ in range(4))
    rows = [(1, a), (2, a + b), (2, c), (2, "x" + d), (2, "y" + d), (3, c)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in got}
    assert got[1, a] == 0 and got[2, a + b] == 300 and got[2, c] == 0 and got[3, c] == 300
    assert sorted((got[2, "x" + d], got[2, "y" + d])) == [0, 300]  # one of the two is the first


def test_longest_previous_factor():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 200):
        w = rng.integers(0, 2, (n // 3 + 1, 100)).astype(np.uint8)[rng.integers(0, n // 3 + 1, n)]
        w[:, 7:] ^= (rng.random((n, 1)) < 0.3).astype(np.uint8)
        order = rng.permutation(n)
        same = [[int((w[i] != w[j]).argmax()) if (w[i] != w[j]).any() else 100 for j in range(n) if order[j] < order[i]] for i in range(n)]
        assert suffix_dedup.previous_factors(w, order).tolist() == [max(x, default=0) for x in same]


def vectors(n=500, size=16, seed=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    for i in range(0, n, 3):
        x[i] = x[rng.integers(n)] + 0.25 * rng.normal(size=size)
    x[10:40] = x[5]
    return x.astype(np.float32)


EXTRA = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [None] + [1.0] * 15), (9005, [float("nan")] + [1.0] * 15), (9006, [float("inf")] + [1.0] * 15), (9007, [1.0] * 3), (9008, [2.0] * 3), (9009, [1.0, 1.0])]


def table(spark, x):
    rows = [(i, [float(v) for v in r], 1, "z") for i, r in enumerate(x)] + [(*e, 1, "z") for e in EXTRA]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")


@pytest.mark.parametrize("shards", [1, 4])
def test_near_vectors(spark, shards):
    x = vectors()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    union = Union()
    for a, b in zip(*np.nonzero(link)):
        union.tie(int(a), int(b))
    want = {i: (int(link[i].sum()) - 1, union.root(i)) for i in range(len(x))} | {k: (0, k) for k, _ in EXTRA} | {9007: (1, 9007), 9008: (1, 9007)}
    rows = near_vectors.near_vectors(table(spark, x), shards=shards).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_pairs_beside_a_large_family(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=96)
    a = rng.normal(size=(300, 96))
    x = np.concatenate([a + 0.35 * rng.normal(size=a.shape), base + 0.2 * rng.normal(size=(1000, 96)), a])
    x = x[rng.permutation(len(x))].astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = dict(enumerate(((u @ u.T >= 0.9).sum(1) - 1).tolist()))
    assert sorted(set(want.values())) == [1, 999]
    assert {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(table(spark, x), shards=1).collect() if r["vec_id"] < 9000} == want


@pytest.mark.parametrize("count", [1_025, 2_047, 8_191])
def test_no_query_is_left_unaudited(spark, count):
    rng = np.random.default_rng(count)
    a = rng.normal(size=(count // 3, 24))
    x = np.concatenate([a, a + 0.3 * rng.normal(size=a.shape), rng.normal(size=(count - 2 * len(a), 24))])
    x = x[rng.permutation(count)].astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = dict(enumerate(((u @ u.T >= 0.9).sum(1) - 1).tolist()))
    got = near_vectors.near_vectors(spark.createDataFrame(enumerate(x.tolist()), "vec_id long, embedding array<float>"), shards=1)
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == want


def test_hot_vectors_and_shards_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "HOT_ROWS", 8)
    monkeypatch.setattr(near_vectors, "HOT_LIST", 1_000)
    monkeypatch.setattr(near_vectors, "SHARD_BYTES", 8 * 4 * 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)).astype(np.float32).tolist()
    rows = [*enumerate(x), *((100 + i, x[3]) for i in range(50)), *((200 + i, x[9]) for i in range(20)), (300, None), (301, [0.0] * 4), (302, [-0.0, 1.0, 0.0, 0.0]), (303, [0.0, 1.0, -0.0, 0.0])]
    u = {k: np.array(v, float) / np.linalg.norm(v) for k, v in rows if v and any(v)}
    links = {k: {j for j in u if j != k and u[j] @ u[k] >= 0.9} if k in u else set() for k, _ in rows}
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert {k: r["n_links"] for k, r in got.items()} == {k: len(v) for k, v in links.items()}
    assert got[100]["component_id"] == got[3]["component_id"] and got[300]["kept"] and got[301]["kept"]


def test_blocks_come_in_small_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "ROW_BYTES", 8 * 16 * 50)
    x = vectors(700).astype(np.float64)
    rows = table(spark, x).filter("vec_id < 9000").selectExpr("vec_id id", "1L extra", "embedding v")
    shards = vector_blocks.blocks(rows, 3, 16, lambda v: v[:, 0].tobytes()).cache()
    most = shards.selectExpr("max(size(ids))", "max(length(x))", "max(length(graph))", "count(*)").first()
    assert most[0] == 50 and most[1] == 8 * 16 * 50 and most[2] <= 8 * 50 and most[3] >= 14
    asked = vector_blocks.blocks(rows, 5, 16)

    def run(batches):
        shard = None
        for part, side, ids, extra, v, made in vector_blocks.met(batches, 16):
            assert (v == x[ids].astype(np.float32)).all() and extra.size == ids.size and made == (b"" if side else v[:, 0].tobytes())
            shard = (part, ids) if not side else shard
            if side and shard[0] == part:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, shard[1].size)), pa.array(np.tile(shard[1], ids.size))], ["a", "b"])

    pairs = vector_blocks.meet(shards, asked, 3, 5, 2).mapInArrow(run, "a long, b long")
    assert tuple(pairs.selectExpr("count(*)", "count(distinct a, b)").first()) == (700 * 700, 700 * 700)


def test_near_vectors_edges(spark):
    empty = table(spark, vectors(60)).limit(0)
    assert near_vectors.near_vectors(empty).collect() == []
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in near_vectors.near_vectors(twice).collect()] == [(1, 1, 1, True)] * 2


def test_nearest(spark):
    x = vectors(900) * np.random.default_rng(1).uniform(0.5, 2, (900, 1)).astype(np.float32)
    rows = ann.nearest(table(spark, x), F.col("vec_id") % 20 == 0).collect()
    d, hits = x.astype(float), 0
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(range(0, 900, 20))
    for q, own in got.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r["vec_id"] != q for r in own)
        assert all(abs(r["score"] - d[q] @ d[r["vec_id"]]) < 1e-9 for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        s = d @ d[q]
        s[q] = -np.inf
        hits += len({r["vec_id"] for r in own} & set(np.lexsort((np.arange(900), -s))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_nearest_few_and_none(spark):
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    got = ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4]
    assert ann.nearest(few.limit(0), F.lit(True)).collect() == []


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << ann.PART_BITS, (3000, 11)).astype(np.uint16)
    codes[:500] = codes[0]
    codes[np.arange(500), rng.integers(0, 11, 500)] ^= rng.integers(0, 1 << ann.PART_BITS, 500).astype(np.uint16)
    tables, far = ann.Tables(codes), ann.distances(codes, codes[3])
    for radius in (0, 1, 7, 20, 37):
        opened = tables.opened(codes[3], radius)
        assert set(np.flatnonzero(far <= radius).tolist()) <= set(opened.tolist())
        assert opened.tolist() == np.flatnonzero(ann.needed(codes, codes[3]) <= radius).tolist()
        assert tables.within(codes[3], radius, 30).tolist() == [i for i in opened.tolist() if far[i] <= 30]


def test_share_of_candidates():
    """In a table of 2,000 rows the tables open little more than half of the rows for 0.95 of the neighbours, and less than an eighth is ranked.

    The vectors have no structure: the twentieth neighbour stands at a cosine of 0.29.
    """
    rows = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist()
    x = np.array([v for v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)])
    codes = ann.Codes(x, float(np.linalg.norm(x, axis=1).max()))
    q, score = codes.of(x[::20], query=True), x[::20] @ x.T
    score[np.arange(len(q)), np.arange(0, len(x), 20)] = -np.inf
    mine, best = codes.of(x), np.argsort(-score, axis=1)[:, :20]
    need, far = (np.stack([f(mine, c) for c in q]) for f in (ann.needed, ann.distances))
    radius, most = ann.radii(np.take_along_axis(need, best, 1).ravel(), np.take_along_axis(far, best, 1).ravel())
    ranked = (need <= radius) & (far <= most)
    assert np.take_along_axis(ranked, best, 1).mean() >= 0.95
    assert (need <= radius).mean() < 0.55 and ranked.mean() < 0.125


def test_queries_with_few_neighbours_are_searched_again(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(200, 8)) + 9, -np.eye(8)[:1]])  # the last one has no code near its own
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, [1.0, 2.0]), (901, [2.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(frame, F.col("vec_id").isin(0, 200, 900), k=30).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {0: 30, 200: 30, 900: 1}


def test_walk_through_a_large_group():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 24))
    x[300:] = x[0] + 0.08 * rng.normal(size=(600, 24))  # two thirds are copies of one vector
    x[:40] = x[40:80] + 0.05 * rng.normal(size=(40, 24))  # and some have one copy
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph, ids = near_vectors.Graph(unit), np.arange(900)
    got = {(int(a), int(b)) for q, n in near_vectors._links(graph, ids, x, ids, x, 0.9) for a, b in zip(q, n) if a != b}
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.9)) if a != b}
    assert len(want) > 300_000 and got <= want and len(want - got) <= 0.001 * len(want)
    assert {p for p in want - got if max(p) < 300} == set()

def test_segments_are_made_in_small_parts(monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in [2_000] * 500 + [300_000]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([0] * len(texts), pa.int64())], ["doc", "text", "base"])
    monkeypatch.setattr(worker, "_KEPT", {})
    tracemalloc.start()
    rows = [b.to_pydict() for b in suffix_dedup._cut(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    windows = [0] * len(texts)
    for b in rows:
        for doc, n in zip(b["doc"], b["n"]):
            windows[doc] += n
    assert windows == [len(t) - 99 for t in texts]
    assert peak < 60 << 20  # 1.3 MB of texts; some 130 MB when a MiB was cut at once

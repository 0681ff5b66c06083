"""The curriculum against a plain form: water-filling, prefix sums and schedules inverted by bisection."""

import hashlib
import random
import re

import pytest

from marlstone.llm import curriculum

SCHEMA = "doc_id long, text string, source string, size string, target int"


def plain_targets(sizes, weights, share, most):
    target, stopped = {}, set()
    while True:
        free = [s for s in sizes if s not in stopped and weights[s] > 0]
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        total = sum(weights[s] for s in free)
        target = {s: most * sizes[s] if s in stopped else left * weights[s] / total if s in free else 0.0 for s in sizes}
        over = {s for s in free if target[s] > most * sizes[s] or target[s] == most * sizes[s] == 0}
        if not over:
            return target
        stopped |= over


def plain_time(share, shape):
    def met(t):
        done = 0.0
        for (a, w), (b, v) in zip(shape, shape[1:]):
            x = min(max(t - a, 0), b - a)
            done += w * x + (v - w) * x * x / (2 * (b - a))
        return done

    low, high, goal = 0.0, 1.0, share * met(1.0)
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if met(mid) < goal else (low, mid)
    return high


def plain_mix(rows, shapes, share, most):
    rows = [(i, t or "", s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    shape = {s: shapes[k % len(shapes)] for k, s in enumerate(names)}
    weights = {s: sum((b - a) * (w + v) / 2 for (a, w), (b, v) in zip(shape[s], shape[s][1:])) for s in names}
    sizes = {s: sum(r[3] for r in rows if r[2] == s) for s in names}
    target = plain_targets(sizes, weights, share, most)
    out = []
    for s in names:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1]}".encode()).hexdigest(), r[0] or 0))
        ahead = 0
        for i, _, _, size in own:
            uses = []
            for copy in range(most):
                at = ahead + copy * sizes[s]
                words = max(0, min(size, int(target[s]) - at))
                if words:
                    uses.append((copy, words, plain_time(at / target[s], shape[s])))
            out.append((i, size, s, sizes[s], target[s], sum(u[1] for u in uses), uses))
            ahead += size
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (str(r[2]), str(r[0]), r[1], r[5], r[6]))


BENT = (((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (1.0, 0.0)), ((0.0, 3.0), (0.9, 0.0), (1.0, 4.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 0.0)))


@pytest.mark.parametrize("shapes, share, most, bucket", [(curriculum.SHAPES, 1.5, 2, 7), (BENT, 0.8, 3, 4), (curriculum.SHAPES, 5.0, 2, 50), (BENT, 0.1, 1, 50)])
def test_mix_equals_plain_form(spark, monkeypatch, shapes, share, most, bucket):
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", bucket)
    rng = random.Random(4)
    names = [None, "", "a", "b", "é", "😀", "￿", "z"]
    rows = [(k, " ".join("x" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(names) if k % 3 else "a") for k in range(120)]
    rows += [(None, "no key", "b"), (3, None, "a"), (5, "same row", "z"), (5, "same row", "z"), (900, "w " * 5_000, "long"), (901, "", "hollow")]
    docs = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], SCHEMA).repartition(5)
    got = ordered([(r["doc_id"], r["size"], r["source"], r["source_size"], r["target"], r["taken"], [tuple(u) for u in r["uses"]]) for r in curriculum.mix(docs, shapes, share=share, most=most).collect()])
    want = ordered(plain_mix(rows, shapes, share, most))
    assert [r[:4] + r[5:6] for r in got] == [r[:4] + r[5:6] for r in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], abs=1e-6)
        assert [u[:2] for u in g[6]] == [u[:2] for u in w[6]]
        assert [u[2] for u in g[6]] == pytest.approx([u[2] for u in w[6]], abs=1e-6)
    for s in {r[2] for r in got}:
        own = [r for r in got if r[2] == s]
        assert abs(sum(r[5] for r in own) - own[0][4]) < 1
        assert all(r[5] <= most * r[1] for r in own)


def test_training_order(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * 10, "abc"[k % 3]) for k in range(90)], "doc_id long, text string, source string")
    mixed = curriculum.mix(docs, carry=["text"])
    rows = curriculum.in_training_order(mixed, text="text").collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert all(len(r["text"].split()) == r["words"] for r in rows)
    early, late = [[r["words"] for r in rows if r["source"] == "a" and (r["position"] < 0.5) == half] for half in (True, False)]
    assert sum(early) > 1.5 * sum(late)
    again = curriculum.in_training_order(curriculum.mix(docs.repartition(7), carry=["text"]), text="text").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_named_shapes_empty_table_and_bad_schedules(spark):
    docs = spark.createDataFrame([(1, "a b c d", "p"), (2, "a b c d", "q")], "doc_id long, text string, source string")
    got = {r["source"]: r["taken"] for r in curriculum.mix(docs, named={"p": 2}, share=0.5).collect()}
    assert got == {"p": 1, "q": 2}
    assert curriculum.mix(docs.limit(0)).collect() == []
    assert [r["taken"] for r in curriculum.mix(docs.withColumn("text", curriculum.F.lit(None).cast("string"))).collect()] == [0, 0]
    for bad in ([(0, 1)], [(0, 1), (0.5, 1)], [(0, 1), (1, -1)], [(0, 1), (0, 2), (1, 1)]):
        with pytest.raises(ValueError):
            curriculum.integrated(bad)

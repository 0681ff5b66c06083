"""Replies from fragments: the table form, the stream form, and what both do with odd input."""

import random
import time

import pytest

from marlstone.functions.fragments import Reply, grown, without_thoughts
from marlstone.operators.replies import fold_fragments
from marlstone.streaming.replies import folded_replies

SCHEMA = "conv long, seq long, kind string, piece string, index int, call_id string, name string, extra string"
TURN = [
    ("reasoning", "Let", None, None, None), ("reasoning", "Let me", None, None, None), ("reasoning", "Wait, no", None, None, None), ("content", "ab", None, None, None), ("call", None, 1, "c1", "read"), ("call", '{"p"', 1, None, None),
    ("call", '{"q": 2}', 0, None, "list"), ("content", "abcd", None, None, None), ("call", ': "x"}', 1, None, "_file"), ("content", "abc", None, None, None), ("call", None, None, "c0", None), ("other", "z", None, None, None), ("finish", "tool_calls", None, None, None),
]
WANT = ("abcd", "Let me\nWait, no", [(0, "c0", "list", '{"q": 2}'), (1, "c1", "read_file", '{"p": "x"}')], "tool_calls", 13, True)


def _rows(conv, turn):
    return [(conv, i, *f, "e") for i, f in enumerate(turn)]


def _plain(r):
    return (r["conv"], r["content"], r["reasoning"], [tuple(c) for c in r["calls"]], r["finish"], r["fragments"], r["complete"])


def test_grown():
    assert [grown(a, b) for a, b in [("", "x"), ("ab", "abc"), ("ab", "a"), ("ab", None), ("ab", "")]] == ["x", "abc", "ab", "ab", "ab"]
    assert grown("ab", "Hmm, so") == "ab\nHmm, so" and grown("ab", "\nHmm") == "ab\nHmm" and grown("ab", " hmm") == "ab hmm"
    assert grown("ab", "z" * 47) == "ab" + "z" * 47 and grown("ab", "z" * 48) == "ab\n" + "z" * 48


def test_thoughts():
    assert without_thoughts("a <think> b </think><THINKING>c\nd</THINKING><think></think> e") == ("b\nc\nd", "a  e")
    assert without_thoughts("1 < 2") == ("", "1 < 2") and without_thoughts("") == ("", "") and without_thoughts(" plain ") == ("", " plain ")
    r = Reply(content="<think>x</think>y", reasoning=" ")
    assert (r.row()["reasoning"], r.row()["content"]) == ("x", "y")
    r.reasoning = "z"
    assert (r.row()["reasoning"], r.row()["content"]) == ("z", "y")


def test_table(spark):
    rows = _rows(1, TURN) + _rows(1, TURN)[2:4] + _rows(2, TURN[:3]) + _rows(3, TURN)[:4] + _rows(3, TURN)[7:] + _rows(None, TURN) + [(4, None, "content", "x", None, None, None, "e")]
    random.Random(5).shuffle(rows)
    got = {r[0]: r[1:] for r in map(_plain, fold_fragments(spark.createDataFrame(rows, SCHEMA), ["conv"]).collect())}
    assert got[1] == got[None] == WANT and set(got) == {1, 2, 3, None}
    assert got[2] == ("", "Let me\nWait, no", [], None, 3, False)
    assert got[3] == ("abcd", "Let me\nWait, no", [(0, "c0", "", "{}"), (1, None, "_file", ': "x"}')], "tool_calls", 10, False)
    assert fold_fragments(spark.createDataFrame([], SCHEMA), ["conv"]).count() == 0
    after = _rows(5, [("finish", None, None, None, None), ("content", "late", None, None, None)])
    assert _plain(fold_fragments(spark.createDataFrame(after, SCHEMA), ["conv"]).first()) == (5, "", "", [], None, 1, True)
    long = [(6, i, "content", f"{i:09d}", None, None, None, "e") for i in range(30_000)]
    r = fold_fragments(spark.createDataFrame(long, SCHEMA), ["conv"]).first()
    assert r["content"] == "".join(p[3] for p in long) and r["fragments"] == 30_000


def folded_schema(spark):
    return fold_fragments(spark.createDataFrame([], SCHEMA), ["conv"]).schema


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def _until(query, done, seconds=60):
    """Runs the query until ``done``; timers keep a query busy, so it never waits for data alone."""
    end = time.monotonic() + seconds
    try:
        while not done() and time.monotonic() < end:
            assert query.exception() is None
            time.sleep(0.3)
    finally:
        query.stop()


def test_stream_equals_table(rocks, tmp_path):
    """Fragments out of order over four batches, with copies, some after the end."""
    rows = [r for conv in range(6) for r in _rows(conv, TURN[: len(TURN) - conv % 3 - 1] + TURN[-1:])]
    dice = random.Random(3)
    dice.shuffle(rows)
    for part in range(4):
        batch = rows[part::4] + dice.sample(rows[: 20 * part], 2 * part) if part else rows[::4]
        rocks.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(map(_plain, fold_fragments(rocks.createDataFrame(rows, SCHEMA), ["conv"]).collect()))
    assert len(want) == 6 and all(r[-1] for r in want)
    source = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = folded_replies(source, ["conv"]).writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    _until(q, lambda: len([p for p in q.recentProgress if p["numInputRows"]]) == 4)
    assert sorted(_plain(r) for r in rocks.table("whole").collect()) == want


def test_stream_goes_on_after_a_stop_and_gives_up_on_gaps(rocks, tmp_path):
    first, rest = _rows(1, TURN)[::2], _rows(1, TURN)[1::2]
    rocks.createDataFrame(first + [(9, 0, "content", "a", None, None, None, "e"), (9, 2, "finish", "stop", None, None, None, "e")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def go(done):
        source = rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream = folded_replies(source, ["conv"], 8_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
        q = stream.outputMode("append").trigger(processingTime="1 second").start()
        _until(q, lambda: done(q))

    go(lambda q: any(p["numInputRows"] for p in q.recentProgress))
    assert rocks.read.schema(folded_schema(rocks)).parquet(out).count() == 0
    rocks.createDataFrame(rest, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go(lambda q: rocks.read.schema(folded_schema(rocks)).parquet(out).count() == 2)
    got = {r[0]: r[1:] for r in map(_plain, rocks.read.parquet(out).collect())}
    assert got == {1: WANT, 9: ("a", "", [], "stop", 2, False)}

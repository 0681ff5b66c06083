"""Operators on small inputs with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import labels, numbers, scans, texts
from marlstone.operators import coverage, ledger, logs, plans, rules, spans, state
from marlstone.sources import reports, stores
from marlstone.streaming import sessions


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


# Two engines, one file: line -> (mi, ci, mb, cb) of the unit and of the instrumented engine.
LINES = {3: ((0, 2, 1, 1), (0, 2, 0, 2)), 4: ((2, 0, 0, 0), (0, 2, 0, 0)), 5: ((0, 1, 0, 0), (1, 0, 0, 0)), 6: ((3, 0, 2, 0), (3, 0, 1, 1)), 7: ((1, 1, 0, 0), (2, 0, 0, 0))}


def report(side):
    lines = "".join('<line nr="%d" mi="%d" ci="%d" mb="%d" cb="%d"/>' % (n, *v[side]) for n, v in LINES.items())
    method = '<method name="go" desc="()V" line="3"><counter type="LINE" missed="2" covered="3"/><counter type="BRANCH" missed="%d" covered="%d"/></method>' % ((3, 1), (1, 3))[side]
    return f'<report name="r"><package name="a/b"><class name="a/b/Foo" sourcefilename="Foo.kt">{method}</class><sourcefile name="Foo.kt">{lines}<counter type="LINE" missed="2" covered="3"/></sourcefile><sourcefile name="X_Factory.kt"><line nr="1" mi="1" ci="0" mb="0" cb="0"/></sourcefile></package></report>'


@pytest.fixture(scope="module")
def packages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    out = []
    for side, engine in enumerate(("unit", "instrumented")):
        folder = root / "app" / "build" / "reports" / engine
        folder.mkdir(parents=True)
        (folder / "report.xml").write_text(report(side))
        (folder / "broken.xml").write_text("<report><pack")
        (folder / "cut.xml").write_text(report(side).replace("Foo.kt", "Cut.kt").replace("</report>", "") + '<package name="a/c"><sourcefile name="C.kt"><line nr="1" mi')
        out.append(reports.read_packages(spark, str(folder), engine, str(root)))
    return out[0].unionByName(out[1])


def test_report_to_merge(packages):
    p = reports.probes(packages)
    assert {tuple(r) for r in p.select("module", "package", "source_name").distinct().collect()} == {("app", "a/b", "Foo.kt")}
    snap = coverage.engine_snapshot(p)
    got = {r["engine"]: (r["missed_lines"], r["covered_lines"], r["branch_lines"]) for r in snap.collect()}
    assert got == {"unit": ([4, 6], [3, 5, 7], [3, 6]), "instrumented": ([5, 6, 7], [3, 4], [6])}
    assert coverage.merge_engines(snap).first()["merged_missed"] == [5, 6, 7]
    assert coverage.merge_engines(snap, "documented").first()["merged_missed"] == [6]
    assert tuple(coverage.module_coverage(p).select("files", "covered", "missed", "line_pct").first()) == (1, 4, 1, 80.0)
    kinds = p.filter("engine = 'unit'").select("line_no", labels.gap_kind(F.col("mi"), F.col("ci"), F.col("mb")).alias("k")).collect()
    assert {r["line_no"]: r["k"] for r in kinds} == {3: "branch", 4: "line", 5: None, 6: "line_and_branch", 7: "line"}
    assert reports.probes(packages, include_generated=True).filter("source_name <> 'Foo.kt'").count() == 2


def test_zero_hit_report_keeps_the_unit_values(spark):
    rows = [("unit", "m", "p", "s", 1, 1, 0, 0, 0), ("unit", "m", "p", "s", 2, 0, 1, 0, 0), ("instrumented", "m", "p", "s", 2, 1, 0, 0, 0)]
    snap = coverage.engine_snapshot(spark.createDataFrame(rows, "engine string, module string, package string, source_name string, line_no int, mi int, ci int, mb int, cb int"))
    assert coverage.merge_engines(snap).first()["merged_missed"] == [1]


def test_counters_and_elements(packages):
    assert reports.counters(packages).filter("metric = 'line'").agg(F.sum("missed"), F.sum("covered")).first() == (4, 6)
    e = reports.elements(packages).filter("metric = 'branch'")
    assert tuple(coverage.element_union(e, ["module"], ["owner"]).first()) == ("app", 3, 4, 75.0)
    assert reports.missed_methods(packages, "BRANCH").first()["methods"] == ["go"]


def test_delta(packages):
    snap = coverage.engine_snapshot(reports.probes(packages))
    r = coverage.coverage_delta(snap.filter("engine = 'unit'"), snap.filter("engine = 'instrumented'"), ["source_name"]).first()
    assert (r["resolved_lines"], r["new_missed_lines"], r["resolved_branches"], r["accepted"]) == ([4], [5, 7], [3], False)
    same = coverage.coverage_delta(snap.filter("engine = 'unit'"), snap.filter("engine = 'unit'"), ["source_name"]).first()
    assert not same["improved"] and not same["regressed"] and not same["accepted"]


def test_failures(spark, tmp_path):
    (tmp_path / "TEST-FooTest.xml").write_text('<testsuite><testcase name="a" classname="c"/><testcase name="b"><failure message="bad">trace</failure></testcase><testcase name="c"><error message="worse">t</error></testcase></testsuite>')
    (tmp_path / "TEST-Bar.xml").write_text('<testsuite><testcase name="z"><failure message="x">y</failure></testcase></testsuite>')
    got = reports.test_failures(spark, str(tmp_path), "Foo").collect()
    assert [(r["test"], r["message"]) for r in got] == [("b", "bad"), ("c", "worse")]


@pytest.mark.parametrize("numbers_,text", [([4, 6], "4, 6"), ([3, 4, 5, 7, 7], "3-5, 7"), ([], "none"), ([9, None, 1, 2], "1-2, 9")])
def test_ranges(spark, numbers_, text):
    assert spark.createDataFrame([(numbers_,)], "a array<int>").select(numbers.compact_ranges(F.col("a"))).first()[0] == text


@pytest.mark.parametrize("covered,missed,pct", [(1, 15, 6.2), (23, 57, 28.7), (0, 0, None), (0, 4, 0.0)])
def test_ratio(spark, covered, missed, pct):
    assert one(spark, numbers.ratio_pct(F.lit(covered), F.lit(missed)))[0] == pct


def test_number_functions(spark):
    null = F.lit(None).cast("double")
    assert one(spark, numbers.capped_sum_pct(F.lit(70.0), F.lit(40.0)), numbers.capped_sum_pct(null, F.lit(4.04)), numbers.capped_sum_pct(null, null)) == (100.0, 4.0, None)
    assert one(spark, numbers.int_set(F.array(F.lit("3"), F.lit("x"), F.lit("1"), F.lit("3"))))[0] == [1, 3]
    assert one(spark, numbers.credited(F.lit(5), F.lit(2)), numbers.effective_pct(F.lit(3), F.lit(2), F.lit(1)), numbers.merged_covered(F.lit(5), F.lit(5), F.lit(3))) == (2, 80.0, 2)
    assert one(spark, *[numbers.pct_band(F.lit(x)) for x in (59.9, 60.0, 85.0, 85.1)]) == ("low", "medium", "medium", "high")


def test_text_functions(spark):
    t = lambda f, *a: one(spark, f(*[F.lit(x) for x in a]))[0]
    assert [t(texts.module_name, x) for x in (":feature:x", "feature/x", "/a/b/")] == ["feature/x", "feature/x", "a/b"]
    assert t(texts.source_key, "a.b", "F.kt") == "a/b/F.kt"
    assert one(spark, texts.module_of_report(F.lit("file:/r/app/build/x.xml"), "/r"), texts.module_of_report(F.lit("/r/build/x.xml"), "/r")) == ("app", ".")
    assert one(spark, *[texts.module_of_report(F.lit(p), "/r") for p in ("/r/app/out/x.xml", "/r/x.xml", "/q/app/x.xml")]) == ("app/out", ".", "/q/app")
    assert t(texts.fenced_blocks, "a\n```json\n{1}\n```\nb ```\nx\n``` ```json\n{1}\n```") == ["{1}", "x"]
    assert t(texts.brace_slice, "x {a {b}} y") == "{a {b}}" and t(texts.brace_slice, "} {") is None
    assert one(spark, texts.first_json(F.lit('text {"k": 3} end'), "k int")["k"])[0] == 3
    assert t(texts.camel_case, "my_id_name") == "myIdName" and t(texts.package_of, "a.b.C") == "a.b" and t(texts.simple_name, "a.b.C") == "C"
    assert one(spark, texts.short_text(F.lit("a  b\n c"), 10), texts.short_text(F.lit("abcdefghijkl"), 8)) == ("a b c", "abcde...")
    assert t(texts.task_variant, ":app:testDebugUnitTest") == "Debug" and t(texts.flag, " Yes ") and not t(texts.flag, "no")
    assert one(spark, texts.succeeded_last(F.lit("FAILED then OK"), "OK", "FAILED"), texts.succeeded_last(F.lit("OK then FAILED"), "OK", "FAILED")) == (True, False)
    assert [tuple(s) for s in t(texts.headed_sections, "intro\n# A\nx\n## B\ny\nz")] == [("A", "x"), ("B", "y\nz")]
    assert t(texts.front_matter, "---\na: 1\n---\nrest") == "a: 1"
    generated = [("dagger.hilt.internal.x", "A.kt"), ("a", "B_Factory.kt"), ("a", "Hilt_X.java"), ("a", "_X.kt"), ("a", "R$id.java"), ("a", "Manifest.java"), ("a", "MainBinding.kt"), ("a", "MainBindingImpl.java"), ("a", "X_GeneratedInjector.java"), ("a.databinding", "A.kt"), ("b/build/generated/c", "A.kt")]
    written = [("dagger.x", "A.kt"), ("a", "B.kt"), ("a", "B_Impl.kt"), ("a", "BR.java"), ("a.databinding.b", "A.kt"), ("a", "R.txt")]
    told = lambda rows: [one(spark, texts.is_generated(F.lit(p), F.lit(n)))[0] for p, n in rows]
    assert all(told(generated)) and not any(told(written))


def test_brace_spans():
    assert scans.brace_spans_of('a { "}" { } } // {\n{ /* } */ } {') == [(2, 13), (19, 30)]
    assert scans.brace_spans_of(None) == []


def test_single_values_are_lists_of_one(spark):
    holds = lambda when, text: one(spark, rules.rule_column(when, F.lit(text), F.lit("src")))[0]
    assert not holds({"test": "foo"}, "fox of") and holds({"test": "foo"}, "a foo") and holds({"test_any": "o+", "source_any": "sr"}, "a foo")
    assert not holds({"test_not_contains": "fo"}, "a foo") and holds({"test_not_contains": "of"}, "a foo") and holds({"test": None}, "x")


def test_rule_quantifiers(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "src one"), (2, "alpha", "two"), (3, None, None)], "id long, test string, source string")
    cases = [
        ({}, {1, 2, 3}), ({"test": ["alpha", "beta"]}, {1}), ({"test_any": ["beta", "alpha"]}, {1, 2}), ({"source": ["one", "two"]}, {1, 2}), ({"source_all": ["src", "one"]}, {1}),
        ({"test_not": ["beta", "x"]}, {2, 3}), ({"test_contains": ["alp", "bet"]}, {1}), ({"test_contains_any": ["bet", "zz"]}, {1}), ({"source_any": ["t"]}, {2}), ({"source_not_any": ["two", "q"]}, {1, 3}),
        ({"test": ["ALPHA"], "flags": ["I"]}, {1, 2}), ({"test_not_contains": ["alpha"]}, {3}),
    ]
    for when, ids in cases:
        got = rules.run_rules(docs, [{"id": "r", "when": when}], ["id"], "test", "source").collect()
        assert {r["id"] for r in got} == ids, when
    stopped = rules.run_rules(docs, [{"id": "a", "when": {"test": ["beta"]}, "stop": True}, {"id": "b"}], ["id"], "test").collect()
    assert {(r["id"], r["rule"]) for r in stopped} == {(1, "a"), (2, "b"), (3, "b")}
    ctx = spark.createDataFrame([(1, "x", {"lane": "a", "on": "true"}), (2, "x", {"lane": "b"})], "id long, test string, ctx map<string,string>")
    for want, ids in (({"lane": "a"}, {1}), ({"lane_any": ["a", "b"]}, {1, 2}), ({"on_true": 1}, {1}), ({"on_false": 1}, {2})):
        got = rules.run_rules(ctx, [{"id": "r", "when": {"ctx": want}}], ["id"], "test", context="ctx").collect()
        assert {r["id"] for r in got} == ids, want


def test_ledger(spark):
    kind = "source long, reason string, category string"
    old = spark.createDataFrame([(1, "long reason", "plan"), (2, "", "plan"), (3, "longer text", "residual"), (4, "abc", "plan")], kind)
    new = spark.createDataFrame([(1, "short", "x"), (2, "now", "x"), (3, "new", "x"), (4, " ", "x"), (5, "five", "y")], kind)
    assert {tuple(r) for r in ledger.upsert(old, new, ["source"]).collect()} == {(1, "long reason", "plan"), (2, "now", "plan"), (3, "new", "residual"), (4, "abc", "plan"), (5, "five", "y")}
    entries = spark.createDataFrame([(1, "s", [1, 2]), (2, "s", [9]), (3, "t", [1])], "entry long, source string, lines array<int>")
    seen = spark.createDataFrame([("s", 2, False, True), ("t", 1, False, False)], "source string, line int, accepted boolean, covered boolean")
    assert {r["entry"] for r in ledger.reconcile(entries, seen, "source").collect()} == {2, 3}


def test_spans(spark):
    s = spark.createDataFrame([("f", "out", 1, 200), ("f", "in", 60, 70), ("f", "same", 60, 70)], "k string, name string, lo int, hi int")
    p = spark.createDataFrame([("f", 65), ("f", 100), ("f", 300), ("g", 5)], "k string, at int")
    assert {(r["at"], r["name"]) for r in spans.narrowest_owner(p, s, "k").collect()} == {(65, "in"), (100, "out")}
    w = spans.merged_windows(spark.createDataFrame([("f", 1), ("f", 4), ("f", 20)], "k string, at int"), "k", "at", 1)
    assert {(r["lo"], r["hi"]) for r in w.collect()} == {(1, 5), (19, 21)}
    names = spark.createDataFrame([(1, "com.a.b.C"), (2, "org.x")], "i long, n string")
    heads = spark.createDataFrame([("com",), ("com.a",)], "p string")
    assert {(r["i"], r["prefix"]) for r in spans.longest_prefix(names, "n", heads, "p", 20).collect()} == {(1, "com.a"), (2, None)}


def test_longest_prefix_sends_no_heads_to_the_driver(spark, tmp_path):
    texts = ["com.a.b.C", "com.a.b.C", "org.x", "", None, "co"]
    spark.createDataFrame([(i if i != 1 else None, t) for i, t in enumerate(texts)], "i long, n string").write.parquet(str(tmp_path / "n"))
    spark.createDataFrame([("com",), ("com.a",), ("com.a",), (None,), ("or",)], "p string").write.parquet(str(tmp_path / "p"))
    names, heads = spark.read.parquet(str(tmp_path / "n")), spark.read.parquet(str(tmp_path / "p"))
    found = spans.longest_prefix(names, "n", heads, "p", 20)
    # Small as the files are, they may hold many texts, and heads are several times as many.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_head" in plan
    assert sorted(((r.i, r.n, r.prefix) for r in found.collect()), key=str) == sorted([(0, texts[0], "com.a"), (None, texts[1], "com.a"), (2, "org.x", "or"), (3, "", None), (4, None, None), (5, "co", None)], key=str)
    every = spans.longest_prefix(names, "n", heads.union(spark.createDataFrame([("",)], "p string")), "p", 20)
    assert sorted((r.prefix for r in every.collect()), key=str) == sorted(["com.a", "com.a", "or", "", None, ""], key=str)


def test_logs(spark):
    text = "ok\nCaused by: x\nat a\nat b\nfine\nerror one\nerror one"
    got = logs.error_lines(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", after=2).orderBy("n").collect()
    assert [(r["n"], r["line"]) for r in got] == [(2, "Caused by: x"), (3, "at a"), (4, "at b"), (6, "error one")]
    r = logs.summarize(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", {"err": "error", "none": "zzz"}).first()
    assert (r["err_n"], r["err_first"], r["none_n"], r["none_first"]) == (2, "error one", 0, None)


def test_plans(spark):
    items = spark.createDataFrame([(1, "a", [1, 2, 9]), (1, "b", [8])], "k long, item string, lines array<int>")
    allow = spark.createDataFrame([(1, [1, 2, 3])], "k long, lines array<int>")
    assert {(r["item"], tuple(r["lines"])) for r in plans.clamp_items(items, allow, "k").collect()} == {("a", (1, 2)), ("rest", (3,))}
    assert {(r["item"], tuple(r["lines"])) for r in plans.exclusive_items(items, allow, "k").collect()} == {("a", (9,)), ("b", (8,))}
    sizes = spark.createDataFrame([(1, n, s) for n, s in enumerate([10, 10, 15, 30, 1, 1, 1, 1, 1, 1])] + [(2, 0, 40)], "k long, n long, s long")
    got = plans.greedy_chunks(sizes, "k", "n", "s").orderBy("k", "n").collect()
    assert [r["chunk"] for r in got] == [0, 0, 1, 2, 3, 3, 3, 3, 3, 4, 0]


EVENTS = [(1, 1, "failure"), (1, 2, "failure"), (1, 3, "look"), (1, 4, "reset"), (1, 5, "failure"), (2, 1, "failure")]


def test_lock_and_its_stream(spark, tmp_path):
    rows = spark.createDataFrame(EVENTS, "key long, seq long, kind string")
    batch = state.failure_lock(rows, "key", ["seq"], F.col("kind") == "failure", F.col("kind") == "reset")
    want = {(r["key"], r["seq"], r["failures"], r["locked"]) for r in batch.collect()}
    assert (1, 3, 2, True) in want and (1, 4, 0, False) in want
    for n, part in enumerate(("seq <= 2", "seq > 2")):
        rows.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.lock_states(stream).writeStream.format("memory").queryName("locks").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("locks").select("key", "seq", "failures", "locked").collect()}
    assert got == want


def test_fold_and_its_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "ab"), (1, 2, "abc"), (1, 3, "d"), (2, 1, None)], "key long, seq long, piece string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = sessions.folded_turns(stream).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("folded").collect()} == {(1, "abcd", 3), (2, "", 1)}
    good = state.last_good(rows.withColumn("ok", F.col("seq") == 1), "key", ["seq"], F.col("ok"), "piece").orderBy("key", "seq")
    assert [r["last_good"] for r in good.collect()] == ["ab", "ab", "ab", None]


def test_stores(spark, tmp_path):
    (tmp_path / "ledger.json").write_text('{"entries": [{"source": "a", "lines": [1, 2], "reason": "r"}, {"source": "b"}]}')
    got = stores.read_ledger(spark, str(tmp_path / "ledger.json")).collect()
    assert [(r["source"], r["lines"], r["schema_version"]) for r in got] == [("a", [1, 2], "1"), ("b", None, "1")]
    (tmp_path / "runs.json").write_text('{"sources": {"p/q": {"source": "p/q", "accepted": true}}}')
    assert tuple(stores.read_runs(spark, str(tmp_path / "runs.json")).select("key", "accepted").first()) == ("p/q", True)
    (tmp_path / "lessons.json").write_text('{"generation_lessons": [{"summary": "x", "tags": ["A"]}, {"summary": "y", "tags": []}, {"summary": "z", "tags": ["b"]}]}')
    assert [r["summary"] for r in stores.read_lessons(spark, str(tmp_path / "lessons.json"), ["a"], 5).collect()] == ["x", "y"]
    for path in ("src/A.kt", "src/x/A.kt", "build/B.kt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("one\ntwo needle")
    found = stores.read_texts(spark, str(tmp_path), "*.kt")
    assert {r["class_name"].split("@")[0] for r in stores.source_catalog(found).collect()} == {"A"} and stores.source_catalog(found).select("class_name").distinct().count() == 2
    assert {r["line_no"] for r in stores.search_lines(found, "needle").collect()} == {2}
    (tmp_path / "rules.json").write_text('{"rules": [{"when": {"test": ["x"]}, "message": "m"}]}')
    assert stores.load_rules(spark, str(tmp_path / "rules.json")) == [{"id": "0", "when": {"test": ["x"]}, "message": "m"}]
    assert spark.read.parquet(stores.write_version(spark.range(3), str(tmp_path / "t"), 1)).count() == 3


def test_context_around(spark):
    lines = spark.createDataFrame([(d, n, (d, n) in {("a", 2), ("a", 9), ("c", 5)}) for d in "abc" for n in range(1, 13)], "doc string, n int, probe boolean")
    got = sorted((r["doc"], r["n"], r["mark"]) for r in spans.context_around(lines, ["doc"], "n", "probe").collect())
    assert got == [("a", n, ">>" if n in (2, 9) else "  ") for n in [*range(1, 6), *range(6, 13)]] + [("c", n, ">>" if n == 5 else "  ") for n in range(2, 9)]

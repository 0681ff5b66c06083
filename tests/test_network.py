"""Fuzzy joins, rule networks, tickets, tags, versions, renderings and documents."""

import json
import os
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from marlstone.operators import fuzzy, network, render, tags, versions
from marlstone.operators.rules import run_rules
from marlstone.sources import documents, reports

NAMES = ["btn_ok", "BtnOk", "button_okay", "title", "titel", "a", "", None, "main_title", "zzz", "subtitle_view", "viewSubTitle", "ok", "aab", "aabb", "éé", "x" * 220]
INDEX = ["btn_ok", "b_tn_ok", "title", "tile", "main_titles", "sub_title_view", "aaab", "e", "éé_", None, "", "x" * 210, "view_sub"]


def test_similar_pairs_equal_all_pairs(spark):
    left = spark.createDataFrame([(k, n) for k in ("id", "s") for n in NAMES] + [(None, "title")], "kind string, name string")
    right = spark.createDataFrame([("id", n) for n in INDEX] + [("s", "titles"), (None, "title")], "kind string, candidate string")
    for cutoff in (0.3, 0.55, 0.8, 1.0):
        got = {(r["kind"], r["name"], r["candidate"]): r["ratio"] for r in fuzzy.similar_pairs(left, right, cutoff).collect()}
        want = {(k, n, c): q for k, some in (("id", INDEX), ("s", ["titles"])) for n in NAMES if n for c in some if c and (q := SequenceMatcher(None, c, n).ratio()) >= cutoff}
        assert got == want


def test_unique_matches(spark):
    left = spark.createDataFrame([("id", n) for n in NAMES * 2], "kind string, name string")
    right = spark.createDataFrame([("id", n) for n in INDEX * 2], "kind string, candidate string")
    got = {r["name"]: (r["candidate"], r["how"]) for r in fuzzy.unique_matches(left, right).collect()}
    own, want = sorted({c for c in INDEX if c}), {}
    for n in {n for n in NAMES if n}:
        plain = [c for c in own if c.replace("_", "").lower() == n.replace("_", "").lower()]
        near = get_close_matches(n, own, n=2, cutoff=0.55)
        if len(plain) == 1:
            want[n] = (plain[0], "plain")
        elif len(near) == 1:
            want[n] = (near[0], "fuzzy")
    assert got == want and {h for _, h in got.values()} == {"plain", "fuzzy"}


def test_corrected_references(spark):
    texts = spark.createDataFrame([(1, "R.id.title + R.id.TITLE; x.R.id.TITLE R.id.TITLEs R.id.nothing_like", "e"), (2, None, "e"), (3, "plain", "e")], "doc int, text string, edits string").drop("edits")
    index = spark.createDataFrame([("id", "title"), ("id", "t_itle2"), ("string", "TITLE")], "kind string, name string")
    got = {r["doc"]: (r["text"], r["corrections"]) for r in fuzzy.corrected_references(texts, "doc", "text", index).collect()}
    assert got[1][0].startswith("R.id.title + R.id.title; x.R.id.TITLE") and got[1][0].endswith("R.id.nothing_like") and got[1][1] >= 1
    assert got[2] == (None, 0) and got[3] == ("plain", 0)


RULES_YAML = r"""
rules:
  - id: needs_harness
    message: "missing_harness: the source is injected"
    when:
      source_any: ["@Entry", "inject.android"]
      test_not_contains: "@HarnessTest"
  - id: rule
    message: needs a rule
    stop: true
    when: {source_any: ["@Entry"], test_not: 'HarnessRule\('}
  - not a rule
  - id: hidden
    message: behind the stop
    when: {source_any: ["@Entry"]}
"""
STATIC_YAML = r"""
- id: teardown
  message: "invalid_teardown: statics stay mocked"
  when: {test: '(?<!un)mock(?:Object|Static)\s*\(', test_not: 'unmockAll|@After[\s\S]*unmock(?:Object|Static)'}
- id: shout
  message: shouts
  when: {test: 'fixme', flags: I}
"""
TABLE_YAML = """
id: lanes
title: Lanes
columns: [when, use]
when_any_tags: [unit, device]
rows:
  - {when: "a | b", use: 1}
  - {use: two}
"""
CASES = [
    (1, "class T { fun a() {} }", "class Cut { @Inject lateinit var dep: Dep }", "src/test/T.kt"),
    (2, "class T { fun a() {} }", "@Entry class Cut", "src/test/T.kt"),
    (3, "class T { fun a() {} }", "import inject.android.Entry", "src/test/T.kt"),
    (4, "@HarnessTest class T { val r = HarnessRule(this) }", "@Entry class Cut", "src/test/T.kt"),
    (5, "mockObject(Helper) // FIXME", "", "src/test/T.kt"),
    (6, "@Before fun a() { mockObject(H) } @After fun b() { unmockObject(H) }", None, "src/test/T.kt"),
    (7, "mockStatic(Log::class)\nunmockAll()", "", "src/androidTest/T.kt"),
    (8, None, None, None),
    (9, "mockStatic(L)", "@Entry", "src/androidTest/T.kt"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("yaml")
    (out / "deep").mkdir()
    for name, text in (("a_harness.yaml", RULES_YAML), ("deep/b_static.yml", STATIC_YAML), ("broken.yaml", "rules: [a: {"), ("empty.yaml", ""), ("other.txt", "rules: []"), ("tables.yaml", TABLE_YAML)):
        (out / name).write_text(text)
    return str(out)


@pytest.fixture(scope="module")
def stages(spark, folder):
    rules = documents.rules_by_file(documents.read_rules(spark, folder))
    assert sorted(rules) == ["a_harness.yaml", "b_static.yml"] and [r["id"] for r in rules["a_harness.yaml"]] == ["needs_harness", "rule", "hidden"]
    return [network.Stage("harness", rules["a_harness.yaml"], skip=("/androidTest/",)), network.Stage("static", rules["b_static.yml"])]


def test_stages_from_yaml(spark, stages):
    docs = spark.createDataFrame(CASES, "doc int, test string, source string, path string")
    got = sorted((r["doc"], r["stage"], r["rule"]) for r in network.Network(stages).run(docs, ["doc"], "test", "source", "path").collect())
    assert got == [(2, "harness", "needs_harness"), (2, "harness", "rule"), (3, "harness", "needs_harness"), (4, "harness", "hidden"), (5, "static", "shout"), (5, "static", "teardown"), (9, "static", "teardown")]
    ends = [network.Stage("first", stages[0].rules[:1], ends=True), network.Stage("static", stages[1].rules)]
    late = network.Network(ends).run(docs.withColumn("test", F.concat("test", F.lit(" fixme"))), ["doc"], "test", "source").filter("stage = 'static'")
    assert {r["doc"] for r in late.collect()} == {1, 4, 5, 6, 7}
    assert network.Network([]).run(docs, ["doc"], "test").collect() == []


def test_conditions_are_computed_once(spark, stages):
    docs = spark.createDataFrame(CASES, "doc int, test string, source string, path string")
    net = network.Network([*stages, network.Stage("again", stages[0].rules + stages[1].rules)])
    assert len(net.places) == 8
    plan = net.run(docs, ["doc"], "test", "source", "path")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("Contains(") <= 8


def test_network_agrees_with_single_rules(spark, stages):
    docs = spark.createDataFrame(CASES, "doc int, test string, source string, path string")
    for stage in stages:
        one = sorted((r["doc"], r["rule_ord"]) for r in run_rules(docs, stage.rules, ["doc"], "test", "source").collect())
        assert one == sorted((r["doc"], r["rule_ord"]) for r in network.Network([network.Stage(stage.name, stage.rules)]).run(docs, ["doc"], "test", "source").collect())


def test_call_checks(spark):
    calls = spark.createDataFrame([(1, "repo", "load", 3), (1, "repo", "gone", 4), (1, "other", "x", 5), (1, "free", "y", 6), (1, "repo", "gone", 9)], "doc int, variable string, name string, line int")
    owners = spark.createDataFrame([(1, "repo", "Repo"), (1, "other", "Unknown")], "doc int, variable string, type string")
    declared = spark.createDataFrame([("Repo", "load"), ("Repo", "save")], "type string, name string")
    assert [tuple(r) for r in network.undeclared_calls(calls, owners, declared).collect()] == [(1, "repo", "Repo", "gone")]
    spans = spark.createDataFrame([(1, 1, 4), (1, 4, 5), (2, 1, 99)], "doc int, lo int, hi int")
    out = network.calls_out_of_context(calls, spark.createDataFrame([("gone",), ("load",)], "name string"), spans)
    assert [tuple(r) for r in out.collect()] == [(1, "gone", 9)]


def test_tickets_of_several_sources(spark):
    schema = "t string, code string, detail string, specific boolean"
    rules = spark.createDataFrame([("a", "import", "missing at line 3", False), ("a", "mock", "x", None), ("b", "import", "y", False)], schema)
    logs = spark.createDataFrame([("a", "import", "add org.x.Y", True), ("a", "mock", "X ", False), ("b", "Import", "Y", False), ("b", "import", None, False)], schema)
    got = sorted((r["t"], r["code"], r["source"], r["detail"], r["n"]) for r in network.merged_tickets([("rules", rules), ("log", logs)], "t").withColumn("detail", F.coalesce("detail", F.lit(""))).collect())
    assert got == [("a", "import", "log", "add org.x.Y", 1), ("a", "mock", "rules", "x", 2), ("b", "Import", "log", "Y", 1), ("b", "import", "log", "", 1), ("b", "import", "rules", "y", 1)]
    open_ = network.still_open(rules, spark.createDataFrame([("a", "mock")], "t string, code string"), ["t", "code"])
    assert sorted((r["t"], r["code"]) for r in open_.collect()) == [("a", "import"), ("b", "import")]


TAGS = [
    {"tag": "db", "any": [("prefix", "imports", ["room."]), ("member", "annotations", ["Dao", "Entity"])]},
    {"tag": "flow", "all": [("contains", "names", ["Flow"])], "none": [("member", "annotations", ["Dao"])]},
    {"tag": "plain", "none": [("prefix", "imports", ["room.", "x."]), ("suffix", "names", ["Test"])]},
    *({"tag": f"t{i}", "all": [("member", "names", [f"n{i}"])]} for i in range(52)),
]


def test_tag_masks(spark):
    rows = [(1, ["room.A"], ["Dao"], ["aFlow"]), (2, [None, "y"], ["Entity"], ["Flows", None, "n51"]), (3, None, None, None), (4, ["x.y"], [], ["n0"])]
    d = spark.createDataFrame(rows, "id int, imports array<string>, annotations array<string>, names array<string>")
    mask = tags.tag_mask(TAGS, {c: F.col(c) for c in ("imports", "annotations", "names")})
    got = {r["id"]: r["tags"] for r in d.select("id", tags.tags_of(mask, TAGS).alias("tags")).collect()}
    assert got == {1: ["db"], 2: ["db", "flow", "plain", "t51"], 3: ["plain"], 4: ["t0"]}
    with pytest.raises(ValueError):
        tags.tag_mask([{"tag": str(i)} for i in range(64)], {})


def test_versions(spark):
    rows = [
        ("p", "app", "junit", "4.1", None), ("p", "module", "junit", None, "lib"), ("p", "common", "lib", None, "base"), ("p", "app", "base", "9", None), ("p", "module", "a", None, "b"), ("p", "module", "b", None, "a"),
        ("p", "module", "self", None, "self"), ("p", "module", "lost", None, "nowhere"), ("p", "elsewhere", "x", "1", None), ("q", "app", "junit", "5", None), ("q", "app", None, "5", None), ("q", "app", "no", None, None),
        *(("r", "app", f"k{i}", None, f"k{i + 1}") for i in range(40)), ("r", "app", "k40", "end", None),
    ]
    d = spark.createDataFrame(rows, "project string, scope string, key string, value string, ref string")
    got = {(r["project"], r["key"]): (r["scope"], r["version"], r["steps"]) for r in versions.resolved_versions(d, ["module", "common", "app"]).collect()}
    assert {k: v for k, v in got.items() if k[0] != "r"} == {("p", "junit"): ("module", "9", 2), ("p", "lib"): ("common", "9", 1), ("p", "base"): ("app", "9", 0), ("q", "junit"): ("app", "5", 0)}
    assert {k[1] for k in got if k[0] == "r"} == {f"k{i}" for i in range(8, 41)}
    assert versions.resolved_versions(d.limit(0), ["app"]).collect() == []


@pytest.mark.parametrize("deepest", [0, 1, 31, 150])
def test_versions_have_no_bounds_of_recursion(spark, deepest):
    rows = [("p", "app", f"k{i}", None if i else "1", f"k{i - 1}" if i else None) for i in range(200)]
    rows += [("p", "app", "a", None, "b"), ("p", "app", "b", None, "a"), ("p", "app", "c", None, "b"), (None, "app", "k300", "2", None), (None, "app", "k301", None, "k300"), ("p", "app", "d", None, "gone")]
    d = spark.createDataFrame(rows, "project string, scope string, key string, value string, ref string")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        got = {(r.project, r.key, r.version, r.steps) for r in versions.resolved_versions(d, ["app"], deepest).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {("p", f"k{i}", "1", i) for i in range(deepest + 1)} | {(None, "k300", "2", 0)}


def test_rendered_blocks(spark):
    rows = [("f", 1, ["aa", "bb"], [1]), ("f", 2, [f"line {i}" for i in range(1, 21)], [3, 10, 99]), ("f", 3, ["x"] * 9, None), ("f", 4, [], None), ("f", 5, None, None), ("g", 1, ["y" * 100], None)]
    d = spark.createDataFrame(rows, "k string, o int, lines array<string>, anchors array<int>")
    got = {(r["k"], r["o"]): (r["how"], r["text"]) for r in render.rendered_blocks(d, "k", "o", 80, 1).collect()}
    assert got == {("f", 1): ("whole", "aa\nbb"), ("f", 2): ("window", "...\nline 2\nline 3\nline 4\n...\nline 9\nline 10\nline 11\n..."), ("f", 3): ("window", "...\nx\nx\nx\n...")}


def test_tables_from_yaml(spark, folder):
    tables = documents.read_tables(spark, folder)
    want = "## Lanes\n| when | use |\n| --- | --- |\n| a / b | 1 |\n|  | two |"
    assert [tuple(r) for r in documents.table_texts(tables, ["unit"]).collect()] == [("lanes", want)]
    assert documents.table_texts(tables, []).collect() == [] and documents.table_texts(tables).count() == 1
    assert documents.read_yaml(spark, folder + "/nowhere").collect() == []


def test_one_document(spark, tmp_path):
    path = str(tmp_path / "out" / "ledger.json")
    rows = spark.createDataFrame([(f"k{i % 40:02d}", i, [i, None], None) for i in range(40)] + [("é", 1, None, "z\n")], "name string, b int, a array<int>, c string").repartition(5)
    documents.write_document(rows, path, "name")
    text = open(path).read()
    got = json.loads(text)
    assert len(got) == 41 and list(got) == sorted(got) and got["k03"] == {"a": [3, None], "b": 3, "c": None, "name": "k03"} and list(got["é"]) == ["a", "b", "c", "name"]
    bad = rows.withColumn("b", F.when(F.col("name") == "k07", F.raise_error(F.lit("lost"))).otherwise(F.col("b")))
    with pytest.raises(Exception, match="lost"):
        documents.write_document(bad, path, "name")
    assert open(path).read() == text and os.listdir(tmp_path / "out") == ["ledger.json"]
    documents.write_document(rows.limit(0), path, "name")
    assert json.load(open(path)) == {}


XML = '<report name="r"><package name="a"><sourcefile name="F.kt">{}</sourcefile></package></report>'
LINE = '<line nr="{}" mi="{}" ci="{}" mb="0" cb="0"/>'


def test_latest_reports(spark, tmp_path):
    def put(path, missed, age, text=None):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text or XML.format("".join(LINE.format(n, int(n in missed), int(n not in missed)) for n in (1, 2, 3))))
        os.utime(at, (1_000_000_000 + age, 1_000_000_000 + age))

    put("app/build/reports/kover/old.xml", {1, 2, 3}, 0, "<report> broken")
    put("app/build/reports/unit-coverage/debug/new.xml", {1, 2}, 9)
    put("app/build/reports/jacoco/a.xml", {3}, 5)
    put("app/build/reports/coverage/androidTest/b.xml", {1}, 5)
    put("app/build/outputs/code_coverage/x/c.xml", {2, 3}, 4)
    put("lib/core/build/reports/instrumented-coverage/d.xml", {2}, 1)
    put("lib/core/build/reports/tests/e.xml", {2}, 99)
    root = str(tmp_path)
    listing = reports.list_reports(spark, root)
    assert listing.count() == 6 and "content" not in listing._jdf.queryExecution().executedPlan().toString()
    latest = {(r["engine"], r["module"]): r["path"].rsplit("/", 1)[1] for r in reports.latest_reports(listing).collect()}
    assert latest == {("unit", "app"): "new.xml", ("instrumented", "app"): "a.xml", ("instrumented", "lib/core"): "d.xml"}
    merged, unit, instrumented = reports.latest_gaps(spark, root)
    assert {(r["module"], tuple(r["merged_missed"])) for r in merged.collect()} == {("app", (3,)), ("lib/core", (2,))}
    assert [r["missed_lines"] for r in unit.collect()] == [[1, 2]] and instrumented.count() == 2
    opened = {r["path"].rsplit("/", 1)[1] for r in reports.read_latest(spark, root).select("path").collect()}
    assert opened == {"new.xml", "a.xml", "d.xml"}
    twice = spark.createDataFrame([("/a/./b//c/../d.xml",), ("/a/b/d.xml",), ("file:///x/y/z/../../d.xml",), ("s3://k/a/../b",)], "p string").select(reports.plain_path(F.col("p")).alias("p"))
    assert [r["p"] for r in twice.collect()] == ["/a/b/d.xml", "/a/b/d.xml", "/x/d.xml", "s3://k/b"]
    empty = tmp_path / "none"
    empty.mkdir()
    assert reports.latest_gaps(spark, str(empty))[0].collect() == []


def test_fuzzy_query_equals_all_pairs(spark, sf):
    from marlstone.plans.fact_queries import fuzzy_join

    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    names = {(p["p_brand"], f"{p['p_type'].lower()}_{p['p_name']}") for p in parts}
    index = {}
    for p in parts:
        index.setdefault(p["p_brand"], set()).add(p["p_name"])
    want = set()
    for kind, name in names:
        near = get_close_matches(name, sorted(index[kind]), n=2, cutoff=0.55)
        if len(near) == 1:
            want.add((kind, name, near[0], "fuzzy"))
    assert {tuple(r) for r in fuzzy_join(spark, sf).collect()} == want and len(want) > 20

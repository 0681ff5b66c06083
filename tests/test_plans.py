"""Plan documents and checks, chunks by owner, modules, deltas, reports and signatures against results worked out by hand or by brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.numbers import int_set
from marlstone.functions.signatures import signature_lines, type_shape
from marlstone.functions.tables import number_cell, numbered_section, pipe_rows, word_cell
from marlstone.operators import catalog, deltas, ledger, logs, modules, plan_checks, plan_documents, plans, rules
from marlstone.sources import stores

ITEM = "kind string, lines array<int>, methods array<string>, approach string, fixture_hint string, reason string, category string, tag string, tc_ids array<string>, branch_targets array<string>, test_layer string"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_pipe_tables(spark):
    text = "| A | b |\r\n|:--|---|\n| 1 | x|y |\n|| \n |  |  |\nno | row |\n| 0 7 | 2 |"
    assert [list(r) for r in one(spark, pipe_rows(F.lit(text)))] == [["A", "b"], ["1", "x", "y"], ["0 7", "2"]]
    assert one(spark, pipe_rows(F.lit(None).cast("string"))) == []
    body = "x\n## 1. One\na\n## 3. Old\nb\n### 3. No\n##  03.  Three\nc\n## 4."
    assert one(spark, numbered_section(F.lit(body), 3)) == "##  03.  Three\nc\n## 4."
    assert one(spark, numbered_section(F.lit(body), 9)) is None
    assert one(spark, number_cell(F.lit(" 7, 3;3 x 1-2 +4"))) == [3, 4, 7]
    assert one(spark, word_cell(F.lit("a; b/c,, "))) == ["a", "b", "c"]


def test_plan_documents(spark):
    front = "---\nschema_version: 2\nrecipe_lane: plain_jvm\ntestable:\n  - lines: [3, '1', x, 3]\n    approach: 'branch: a; b'\n    test_layer: ' Unit '\n  - text\nnot_testable:\n  - lines: [9]\n    tc_ids: [T1, '', T2]\n---\n## 3. T\n| kover lines |\n| 5 |"
    tables = "---\nk: [\n---\n## 3. T\n| ID | Kover Lines | Scenario |\n|--|--|--|\n| T7 | 5, 4 | go |\n| T8 | none | x |\n## 4. D\n| kover lines | methods | reason |\n| 8 | a/b | |"
    rows = [("front", front), ("tables", tables), ("empty", " \n"), ("none", None), ("text", "no plan"), ("list", "---\n- a\n---\n"), ("bare", "---\nk: 1\n---\n")]
    p = plan_documents.parsed_plans(spark.createDataFrame(rows, "id string, text string"), "id", "text").cache()
    assert {r.id: (r.parsed, r.fallback_reason, r.recipe_lane) for r in p.collect()} == {
        "front": (True, "", "plain_jvm"), "tables": (True, "", ""), "empty": (False, "missing markdown plan", ""), "none": (False, "missing markdown plan", ""),
        "text": (False, "missing or invalid YAML frontmatter", ""), "list": (False, "missing or invalid YAML frontmatter", ""), "bare": (True, "", ""),
    }
    got = {(r.id, r.pos): r for r in plan_documents.plan_items(p, "id").collect()}
    assert sorted(got) == [("front", 0), ("front", 1), ("tables", 0), ("tables", 1)]
    a, b, c, d = (got[k] for k in sorted(got))
    assert (a.kind, a.lines, a.branch_targets, a.test_layer, a.category) == ("testable", [1, 3], ["a", "b"], "unit", "")
    assert (b.kind, b.lines, b.fixture_hint, b.tc_ids, b.category) == ("not_testable", [9], "tickets: T1, T2", ["T1", "T2"], "not_unit_testable")
    assert (c.lines, c.tc_ids, c.approach.split("\n")[:3]) == ([4, 5], ["T7"], ["1. Scenario: go", "2. Given: N/A", "3. When: N/A"])
    assert (d.lines, d.methods, d.reason) == ([8], ["a", "b"], "Deferred (not_unit_testable): lines [8] marked not_testable in Section 13.")
    p.unpersist()
    nothing = spark.createDataFrame([], "id string, text string")
    assert plan_documents.parsed_plans(nothing, "id", "text").collect() == []


def test_plan_documents_look_each_header_up_once(spark):
    # A header was looked up again for each use of each cell, and each failed cast to an integer cost an exception.
    plans_ = plan_documents.parsed_plans(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert plans_._jdf.queryExecution().analyzed().toString().count("array_position(") <= 14
    texts = ["5", " 7\t", "+8", "-9", "x", "1x", "", "1.5", "2147483648", "5", None]
    assert one(spark, int_set(F.array(*map(F.lit, texts)))) == [-9, 5, 7, 8]


@pytest.mark.parametrize("text", ["k: [1, 'a']\ntestable:\n- lines: [1, z]\n  tag: O", "k: [", "- a", "k: \t[1]", "=~: !", "testable:\n- tag: !\n", "\ufeffk: 1", "a: &x {b: 1}\nc: *x", "k: 2020-02-31", "k: {" * 200, "", None])
def test_front_matter_is_read_alike(text):
    import yaml

    try:
        meta = yaml.safe_load(text) if text else None
    except (yaml.YAMLError, ValueError):
        meta = None
    got = plan_documents._as_json(text)
    assert (got is not None) == isinstance(meta, dict)
    if got and isinstance(meta.get("testable"), list):
        assert [(r["tag"], r["lines"]) for r in json.loads(got)["testable"]] == [(str(r.get("tag") or ""), [str(x) for x in r.get("lines") or []]) for r in meta["testable"]]


def item(kind="testable", lines=(1,), approach="", layer="", fixture="", reason=""):
    return (kind, list(lines), [], approach, fixture, reason, "", "", [], [], layer)


@pytest.mark.parametrize(
    ("body", "lane", "allow", "items", "codes"),
    [
        ("", "plain_jvm", None, [], ["plan_empty"]),
        (None, None, None, None, ["plan_empty"]),
        ("", "plain_jvm", [], [item(lines=(9,))], []),
        ("x", "plain_jvm", [1], [item(lines=(9, 1)), item("not_testable", (8,))], ["plan_lines_outside_delta"]),
        ("assertEquals(1, a._b)", "", None, [], ["plan_private_field_assert"]),
        ("verify { x }\nfoo(a._b)", "", None, [], []),
        ("see view._binding", "", None, [], ["plan_private_field_assert"]),
        ("view._bindings", "", None, [], []),
        ("getDeclaredField ('x')", "", None, [], ["plan_private_field_assert"]),
        ("HostActivity", "hilt_fragment", None, [], ["plan_placeholder_host"]),
        ("MyHostActivity HostActivity2", "plain_jvm", None, [], []),
        ("@HiltAndroidTest", "plain_jvm", None, [], ["plan_wrong_harness_lane"]),
        ("@HiltAndroidTest", "hilt_view", None, [], []),
        ("launchFragmentInContainer", "hilt_fragment", None, [], ["plan_wrong_harness_lane"]),
        ("launchFragmentInContainer HostActivity", "hilt_fragment", None, [], ["plan_placeholder_host"]),
        ("x", "hilt_view", None, [item(approach="RobolectricTestRunner", layer=" Instrumented")], ["plan_layer_harness_mismatch"]),
        ("x", "plain_jvm", None, [item(fixture="@Config(application = A)", layer="unit"), item(approach="ActivityScenario.launch(a)", layer="unit")], ["plan_layer_harness_mismatch"]),
        # A text that only deferred items have counts as the text of the plan.
        (" ", "", None, [item("not_testable", reason="HostActivity")], ["plan_placeholder_host"]),
        (" ", "", None, [item(), item("not_testable", reason="HostActivity")], ["plan_placeholder_host"]),
    ],
)
def test_plan_checks(spark, body, lane, allow, items, codes):
    plan = spark.createDataFrame([(1, body, items, lane, allow)], f"id int, body string, items array<struct<{ITEM.replace(' ', ': ').replace(',:', ',')}>>, recipe_lane string, allow array<int>")
    rows = plan_checks.plan_tickets(plan, "id").orderBy("pos").collect()
    assert [r.code for r in rows] == codes
    assert all(r.lines == [9] for r in rows if r.code == "plan_lines_outside_delta")


def chunks_by_hand(items, max_items=5, max_lines=30, max_methods=2):
    """Owner by owner, as the limits say it."""
    out, owners = [], {}
    for owner, order, lines in sorted(items, key=lambda i: i[1]):
        for at in range(0, max(len(lines), 1), max_lines):
            owners.setdefault(owner, []).append((order, at // max_lines, lines[at : at + max_lines]))
    first = {o: min([n for i in v for n in i[2]], default=0) for o, v in owners.items()}
    batch, held = [], set()

    def flush():
        if batch:
            out.append(list(batch))
        batch.clear()
        held.clear()

    size = lambda rows: sum(len(r[2]) for r in rows)
    for o in sorted(owners, key=lambda o: (first[o], o)):
        rows = owners[o]
        big = len(rows) > max_items or size(rows) > max_lines
        if big or len(batch) + len(rows) > max_items or size(batch) + size(rows) > max_lines or len(held) >= max_methods:
            flush()
        for r in rows:
            if big and (len(batch) + 1 > max_items or size(batch) + len(r[2]) > max_lines):
                flush()
            batch.append(r)
            held.add(o)
        if big:
            flush()
    flush()
    return {(r[0], r[1]): n for n, b in enumerate(out) for r in b}


def test_owner_chunks(spark):
    rng, rows = random.Random(3), []
    for key in range(40):
        for order in range(rng.randint(1, 25)):
            start = rng.randint(1, 300)
            lines = list(range(start, start + rng.choice([0, 1, 2, 5, 12, 31, 70])))
            rows.append((key, "t" if order % 3 else None, rng.choice(["a", "b", "c", "d", None]), order, lines or rng.choice([None, []])))
    d = spark.createDataFrame(rows, "k int, tag string, owner string, n int, lines array<int>")
    got = {}
    for r in plans.owner_chunks(d, "k", "tag", "owner", "n").collect():
        got.setdefault((r.k, r.tag), {})[(r.n, r.part)] = r.chunk
    groups = {}
    for k, tag, owner, n, lines in rows:
        groups.setdefault((k, tag), []).append((owner or "<unknown>", n, lines or []))
    assert got == {g: chunks_by_hand(v) for g, v in groups.items()}
    assert plans.owner_chunks(d.limit(0), "k", "tag", "owner", "n").collect() == []


def test_clamped_tags(spark):
    rows = [(1, "testable", None, "c", " FLOW "), (2, "testable", "r", "c", None), (3, "testable", "", "c", "odd"), (4, "not_testable", "r", "c", ""), (5, "not_testable", "r", "c", "odd"), (6, "testable", "r", "c", "plain_unit")]
    d = spark.createDataFrame(rows, "id int, kind string, reason string, category string, tag string")
    got = {r.id: (r.kind, r.reason, r.category, r.tag) for r in plans.clamped_tags(d, "tag", {"x": "flow"}, ["flow"], F.col("id") == 2).collect()}
    lost = "untagged_or_invalid_slice"
    assert got == {1: ("testable", None, "c", "flow"), 2: ("testable", "r", "c", "plain_unit"), 3: ("not_testable", lost, lost, "plain_unit"), 4: ("not_testable", "r", "c", "plain_unit"), 5: ("not_testable", "r", "c", "odd"), 6: ("testable", "r", "c", "plain_unit")}


def test_modules(spark):
    file = "engine string, module string, package string, source_name string"
    counters = spark.createDataFrame([("unit", "m", "p", "A", "line", 2, 2), ("instrumented", "m", "p", "A", "line", 0, 4), ("unit", "m", "p", "B", "branch", None, 3), ("unit", None, None, "C", "branch", 1, 1), ("instrumented", "", None, "C", "branch", 3, 1), ("unit", "g", None, "G", "line", 1, 0)], file + ", metric string, covered int, missed int")
    lines = spark.createDataFrame([("unit", "m", "p", "A", 1, True), ("instrumented", "m", "p", "A", 1, False), ("unit", "m", "p", "B", 1, False), ("unit", "m", "p", "B", None, True), ("unit", "m", "p", "B", 2, None)], file + ", line_no int, covered boolean")
    elements = spark.createDataFrame([("unit", "m", "class", "A", False), ("instrumented", "m", "class", "A", True), ("unit", "m", "class", "B", None), ("unit", "m", "class", None, True)], "engine string, module string, metric string, element string, covered boolean")
    gone = spark.createDataFrame([("g", None, "G")], "module string, package string, source_name string")
    got = {r.module: r for r in modules.module_projection(counters, lines, elements, gone).collect()}
    assert sorted(got) == ["(unknown)", "m"]
    m, u = got["m"], got["(unknown)"]
    assert (m.files, m.unit_line_covered, m.instrumented_line_missed, m.unit_line_pct, m.instrumented_line_pct, m.unit_branch_missed) == (2, 2, 4, 50.0, None, 3)
    assert (m.union_covered, m.union_lines, m.combined_line_pct, m.class_elements, m.combined_class_pct, m.combined_branch_pct) == (1, 3, 33.3, 2, 50.0, None)
    assert (u.files, u.unit_branch_pct, u.instrumented_branch_pct, u.combined_branch_pct, u.union_lines) == (1, 50.0, 75.0, 100.0, 0)
    assert modules.module_projection(counters.limit(0), lines, elements).collect() == []


def test_file_states(spark):
    files = spark.createDataFrame([(1, "m", "A", [1, 2], [3], 1, 2, 0, 1), (2, "m", "B", None, None, 0, 0, None, 0), (3, "m", "C", [1], None, 0, 1, 0, 0), (4, "m", "D", [1], [], 0, 1, 0, 0)], "id int, module string, source_name string, missed_lines array<int>, branch_lines array<int>, line_covered int, line_missed int, branch_covered int, branch_missed int")
    entries = spark.createDataFrame([("m", "A", [1], None, "plan"), ("m", "C", [1], [], "plan")], "module string, source_name string, lines array<int>, branches array<int>, category string")
    sources = spark.createDataFrame([("a/A", "class A"), ("b/A", "class A"), ("b/B", "interface B"), ("b/C", None)], "path string, text string")
    out = modules.file_states(files, entries, sources, [F.concat(F.lit(p), "source_name") for p in ("a/", "b/")])
    got = {r.id: (r.source_path, r.pending_lines, r.pending_branches, r.gap_work_status) for r in out.collect()}
    assert got == {1: ("a/A", "2", "3", "actionable"), 2: ("b/B", "none", "none", "no_exec"), 3: ("b/C", "none", "none", "deferred_only"), 4: (None, "1", "none", "generated")}
    assert [r.id for r in modules.with_source(out).orderBy("id").collect()] == [1, 2, 3]


def test_gap_deltas(spark):
    schema = "k string, missed_lines array<int>, branch_lines array<int>, missed_methods array<string>, branch_methods array<string>, line_missed int, line_covered int, branch_missed int, branch_covered int"
    before = spark.createDataFrame([("same", [1], [], ["f"], [], 1, 1, 0, 0), ("moved", [1], [], ["f"], [], 1, 1, 0, 0), ("method", [1], None, ["f"], ["g"], 1, 1, 0, 0), ("worse", [1], [2], [], [], 1, 1, 1, 1), ("gone", [1], [], [], [], 1, 1, 0, 0)], schema)
    after = spark.createDataFrame([("same", [1], [], ["f"], [], 1, 1, 0, 0), ("moved", [1], [], [], ["f"], 1, 1, 0, 0), ("method", [1], [], [], ["f"], 1, 1, 0, 0), ("worse", [], [2], [], ["h"], 0, 2, 1, 1), ("new", [1], [], [], [], 1, 1, 0, 0), ("idle", [1], [], [], [], 1, 0, 0, 0)], schema)
    got = {r.k: (r.resolved_methods, r.new_methods, r.regressed, r.improved, r.accepted) for r in deltas.gap_deltas(before, after, ["k"], True).collect()}
    assert got == {"same": ([], [], False, False, False), "moved": ([], [], False, False, False), "method": (["g"], [], False, True, True), "worse": ([], ["h"], True, True, False), "gone": (None, None, None, None, False), "new": (None, None, None, None, True), "idle": (None, None, None, None, False)}
    assert not any(r.accepted for r in deltas.gap_deltas(before, after, ["k"]).collect() if r.k in ("new", "idle"))


def test_reports(spark):
    long = "a" * 500 + "b" * 400
    assert one(spark, ledger.failure_snippet(F.lit(f"\n {long} "))) == long[:400] + "\n...\n" + long[-350:]
    assert one(spark, ledger.failure_snippet(F.lit(None).cast("string"))) == "" and one(spark, ledger.failure_snippet(F.lit("a" * 800))) == "a" * 800
    old = spark.createDataFrame([("s", "t", "m", "x"), (None, "t", "m", "y"), ("o", "t", "m", "z")], "source string, test string, module string, snippet string")
    new = spark.createDataFrame([("s", "t", 1, "n1", "a"), ("s", "t", 2, None, "b"), (None, "t", 1, "n3", "c"), ("f", None, 1, "n4", "d")], "source string, test string, at int, snippet string, tag string")
    got = {(r.source, r.test): (r.module, r.snippet, r.tag) for r in ledger.upsert_reports(old, new, ["source", "test"], "at").collect()}
    assert got == {("s", "t"): ("m", None, "b"), (None, "t"): ("m", "n3", "c"), ("o", "t"): ("m", "z", None), ("f", None): (None, "n4", "d")}


def test_type_shapes(spark):
    listing = "Compiled from\npublic final class a.B {\n  public a.B(int, java.lang.String);\n  public a.Other(int);\n  public static final int of(int);\n  public static java.util.Map<K, V> no(int);\n  public static int of(long);\n  public int size();\n}"
    rows = [("B", listing), ("", "public interface X\npublic static void a();"), (None, "  public a.b.C();"), ("D", "class D"), ("E", None), (None, "public enum a.E")]
    d = spark.createDataFrame(rows, "simple string, text string").select("simple", signature_lines(F.col("text")).alias("l")).select(type_shape(F.col("l"), F.col("simple")).alias("s"))
    assert [r.s and tuple(r.s) for r in d.collect()] == [
        ("B", "class", ["(int, String)"], ["of"], "constructor", "mockkConstructor"), ("X", "interface", [], ["a"], "static", "mockkStatic"), ("", "class", ["()"], [], "constructor", "mockkConstructor"), None, None,
        ("a.E", "enum", [], [], "constructor", "mockkConstructor"),
    ]


def test_type_shapes_compute_each_step_once(spark):
    # What several fields need was written out in each of them: a line was split hundreds of times.
    assert str(signature_lines(F.col("text"))).count("split(") <= 2
    assert str(type_shape(F.col("l"), F.col("simple"))).count("filter(") == 3


def test_documented(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"api": [{"class": "x.A", "qualified_name": "y.A"}, "text", {"class": " "}], "api_index": [{"qualified_name": "z.B"}], "classes": [{"class": "x.C"}]}))
    (tmp_path / "b.json").write_text('["x"]')
    (tmp_path / "c.json").write_text("{")
    entries = stores.documented_entries(spark, str(tmp_path))
    assert sorted(r.name for r in stores.documented_names(entries).collect()) == ["x.A", "y.A", "z.B"]
    rows = [("p", 0, 0, "x.A", None), ("p", 0, 1, None, "k.A"), ("p", 1, 0, "", "x.A"), ("p", 1, 1, "A", "x.A"), ("p", 1, 2, None, None)]
    e = spark.createDataFrame(rows, "path string, part int, pos int, class string, qualified_name string")
    names = spark.createDataFrame([("x.A",), ("x.A",), ("q.A",), ("x.B",), (None,)], "fqcn string")
    assert sorted(tuple(r) for r in catalog.documented_entry(names, e).collect()) == [("q.A", "p", 1, 1, False), ("x.A", "p", 0, 0, True)]


def filtered_by_hand(text, after=2, kept=4, tail=3, limit=60, quiet=9):
    lines, useful, left = (text or "").splitlines(), [], 0
    for line in lines:
        if "E" in line:
            useful.append(line)
            left = after if "W" in line else left
        elif left:
            useful.append(line)
            left -= 1
    if not useful:
        return (text or "")[-quiet:]
    out, seen = [], set()
    for line in [*useful[-kept:], "", logs.TAIL_HEADING, *lines[-tail:]]:
        if not line.strip() or line.strip() not in seen:
            out.append(line)
        seen.add(line.strip())
    return "\n".join(out)[-limit:]


def test_filtered_output(spark):
    rng = random.Random(5)
    texts = [None, "", "\n", "E", "E\n", " E\r\nE ", "W\nx\ny", "E W\na\nE\nb\nc\nd\n" + "z" * 90]
    texts += ["\n".join(rng.choice(["E", "EW", "W", "a", " a", "b", "", "c" * 9]) for _ in range(rng.randint(1, 15))) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.filtered for r in logs.filtered_output(d, "id", "text", "E", "W", 2, 4, 3, 60, 9).collect()}
    assert got == {n: filtered_by_hand(t) for n, t in enumerate(texts)}
    assert logs.filtered_output(d.limit(0), "id", "text").collect() == []


def test_ranked_selection(spark):
    rows = [(1, "has LICENSE", ["b ", "a", ""], None), (2, None, None, None), (3, "x", ["license"], "two"), (4, "x", ["a"], "other")]
    d = spark.createDataFrame(rows, "id int, text string, tags array<string>, pin string")
    pick = lambda **k: sorted((r.id, r.rank, r.name) for r in rules.ranked_selection(d, "id", "text", "tags", {"a": "one", "b": "two"}, [(("license",), "legal"), (("x",), "one")], 2, **k).collect())
    assert pick() == [(1, 0, "two"), (1, 1, "one"), (3, 0, "legal"), (3, 1, "one"), (4, 0, "one")]
    assert pick(default="none", pin="pin") == [(1, 0, "two"), (1, 1, "one"), (2, 0, "none"), (3, 0, "two"), (3, 1, "legal"), (4, 0, "one")]

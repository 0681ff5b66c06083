"""Queries of modules, gap states and deltas, plan documents and their checks, and the SQL that gives the same rows.

Texts (plans, listings) are written by Spark from the rows of the benchmark tables and read back by the operators; the SQL
computes the results from the same rows without the texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.numbers import compact_ranges
from marlstone.functions.signatures import signature_lines, type_shape
from marlstone.operators import catalog, deltas, ledger, logs, modules, plan_checks, plan_documents, plans, rules
from marlstone.plans.surrogate import probe_sql, probes, ranges_sql, table

_text = lambda c: F.col(c).cast("string")


def _named(spark, d):
    """Line items with engine, module, package and source."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("package"))
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") != 3, _text("c_nationkey")).alias("module"))
    j = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.withColumns({"engine": F.when(F.col("l_linestatus") == "O", "unit").otherwise("instrumented"), "source_name": _text("l_orderkey"), "hit": F.col("l_returnflag") != "N"})


def module_projection(spark, d):
    """Counters, lines and elements of line items: suppliers are classes, parts methods, one metric has no elements."""
    li = _named(spark, d)
    metric = {"class": (F.lit(1), "hit"), "method": (F.lit(1), "tax"), "branch": (F.lit(2), "hit"), "line": (F.lit(1), "hit"), "instruction": (F.col("l_quantity").cast("int"), "tax")}
    li = li.withColumn("tax", F.col("l_tax") > 0.04)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.col(c), n).otherwise(0).alias("covered"), F.when(F.col(c), 0).otherwise(n).alias("missed")) for m, (n, c) in metric.items()]))
    counters = li.select("engine", "module", "package", "source_name", cells.alias("c")).select("engine", "module", "package", "source_name", "c.*")
    lines = li.select("engine", "module", "package", "source_name", F.col("l_linenumber").alias("line_no"), F.col("hit").alias("covered"))
    elements = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _text(c).alias("element")) for m, c in (("class", "l_suppkey"), ("method", "l_partkey"))]))
    elements = li.select("engine", "module", elements.alias("e"), F.col("hit").alias("covered")).select("engine", "module", "e.*", "covered")
    generated = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(_text("o_orderkey").alias("source_name"))
    return modules.module_projection(counters, lines, elements, li.join(generated, "source_name").select("module", "package", "source_name"))


def file_states(spark, d):
    """Orders as files; sources of finished ones lie in one folder, those of open ones in another, others have none."""
    li = _named(spark, d).withColumn("module", F.coalesce("module", F.lit("-")))
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_linenumber"))))
    off = F.col("package") == "5-LOW"  # no counters
    files = li.groupBy("l_orderkey", "module", "source_name", "package").agg(some(~F.col("hit")).alias("missed_lines"), some(F.col("l_tax") > 0.06).alias("branch_lines"), F.count_if("hit").alias("line_covered"))
    files = files.select(
        F.col("l_orderkey").alias("id"), "module", "source_name", F.when(~off, F.col("missed_lines")).alias("missed_lines"), F.when(~off, F.col("branch_lines")).alias("branch_lines"), F.when(off, 0).otherwise(F.col("line_covered")).alias("line_covered"),
        F.when(off, 0).otherwise(F.size("missed_lines")).alias("line_missed"), F.lit(0).alias("branch_covered"), F.when(off, 0).otherwise(F.size("branch_lines")).alias("branch_missed"),
    )
    entries = li.filter("l_discount >= 0.03").select("module", "source_name", F.when(~F.col("hit"), F.array("l_linenumber")).alias("lines"), F.when(F.col("l_tax") > 0.06, F.array("l_linenumber")).alias("branches"), F.lit("plan").alias("category"))
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    folder = F.when(F.col("o_orderstatus") == "F", "main/").otherwise("other/")
    text = F.when(F.col("o_totalprice") > 150000, "interface A {\n  fun a()\n}").otherwise("class A { fun a() { run() } }")
    sources = o.select(F.concat(folder, _text("o_orderkey")).alias("path"), text.alias("text"))
    out = modules.file_states(files, entries, sources, [F.concat(F.lit(p), _text("id")) for p in ("main/", "other/")])
    return out.select("id", "source_path", "source_resolvable", "pending_lines", "pending_branches", "non_executable", "gap_work_status")


def _gaps(p, engine):
    some = lambda c: F.array_sort(F.collect_set(c))
    line, m = F.col("line_no"), F.concat(F.lit("m"), _text("line_no"))
    missed, partial = (F.col("mi") > 0) & (F.col("ci") == 0), F.col("mb") > 0
    return p.filter(F.col("engine") == engine).groupBy("source_name").agg(
        some(F.when(missed, line)).alias("missed_lines"), some(F.when(partial, line)).alias("branch_lines"), some(F.when(missed & (F.col("discount") > 0.05), m)).alias("missed_methods"),
        some(F.when(partial & (F.col("discount") > 0.05), m)).alias("branch_methods"), F.count_if(missed).alias("line_missed"), F.count_if(F.col("ci") > 0).alias("line_covered"),
        F.sum("mb").alias("branch_missed"), F.sum("cb").alias("branch_covered"),
    )


def gap_deltas(spark, d):
    """The instrumented engine before, the unit engine after."""
    p = probes(spark, d)
    j = deltas.gap_deltas(_gaps(p, "instrumented"), _gaps(p, "unit"), ["source_name"], bootstrap=True)
    pair = lambda s: (F.col(s + "_line_missed"), F.col(s + "_line_covered"))
    text = deltas.delta_text(F.col("resolved_lines"), F.col("resolved_branches"), F.col("resolved_methods"), F.col("a_missed_lines"), pair("b"), pair("a"))
    return j.select("source_name", compact_ranges(F.col("new_lines")).alias("new_lines"), compact_ranges(F.col("new_branches")).alias("new_branches"), F.array_join("new_methods", ",").alias("new_methods"), "regressed", "improved", "accepted", text.alias("text"))


# The order in which the rows of a document follow; rows that are equal in it are equal in their results.
_PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _plan_bodies(spark, d):
    """A document for each order: two tables behind headings, or front matter, or broken front matter before the tables."""
    li = table(spark, d, "lineitem")
    part = (F.col("l_orderkey") % 2) == 0  # the columns of the table change places
    lines = F.when(F.col("l_quantity") < 5, "x;").otherwise(F.format_string("%d; 1x, %d %d", F.col("l_linenumber") + 2, F.col("l_linenumber"), F.col("l_linenumber")))
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    ident, tag = F.concat(F.lit("TC"), _text("l_partkey")), F.when(F.col("l_tax") > 0.02, F.col("l_linestatus")).otherwise("")
    category, reason = F.when(F.col("l_discount") < 0.05, "").otherwise("late"), F.when(F.col("l_tax") < 0.05, "").otherwise("known")
    test = F.when(part, cells(ident, lines, tag, F.lit("go"), F.col("l_linestatus"))).otherwise(cells(tag, F.col("l_linestatus"), ident, F.lit("go"), lines))
    late = cells(lines, F.lit("a/ b;"), category, reason)
    row = F.when(F.col("l_returnflag") == "N", test).otherwise(late)
    yaml = F.concat(F.lit("- lines: ["), F.concat_ws(", ", _text("l_linenumber"), F.lit("z"), _text("l_linenumber")), F.lit("]\n  approach: 'branch: a; b'\n  tag: "), F.col("l_linestatus"))
    rows = li.select("l_orderkey", F.struct(*_PLACE).alias("place"), row.alias("row"), yaml.alias("yaml"), (F.col("l_returnflag") == "N").alias("test"))
    listed = lambda c, w: F.array_join(F.sort_array(F.collect_list(F.when(w, F.struct("place", F.col(c).alias("t")))))["t"], "\n")
    kind = F.col("l_orderkey") % 7
    g = rows.groupBy("l_orderkey").agg(listed("row", F.col("test")).alias("a"), listed("row", ~F.col("test")).alias("b"), listed("yaml", F.col("test") & (kind == 0)).alias("y"))
    even = (F.col("l_orderkey") % 2) == 0
    head = F.when(even, "| ID | Kover lines | Tag | Branch target | When |").otherwise("| Tag | WHEN | id | branch target | kover LINES |")
    first, second = F.when(even, "## 3. Test Cases").otherwise("## 7. Test Cases"), F.when(even, "## 4. Deferred").otherwise("## 13. Deferred")
    tables = F.concat_ws("\n", F.lit("# Test Plan\n## 1. Scope\n| kover lines |\n| 99 |"), first, head, F.lit("|---|:-:|---|---|---|"), F.col("a"), F.lit("\n"), second, F.lit("| Kover lines | Methods | Category | Reason |\n|--|--|--|--|"), F.col("b"))
    front = F.concat(F.lit("---\nschema_version: 2\nrecipe_lane: plain_jvm\ntestable:\n"), F.col("y"), F.lit("\n---\n"), tables)
    return g.select("l_orderkey", F.when(kind == 0, front).when(kind == 1, F.concat(F.lit("---\nk: [\n---\n"), tables)).otherwise(tables).alias("text"))


def plan_document_items(spark, d):
    items = plan_documents.plan_items(plan_documents.parsed_plans(_plan_bodies(spark, d), "l_orderkey", "text"), "l_orderkey")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return items.select("l_orderkey", "pos", "kind", joined("lines"), joined("methods"), "approach", "fixture_hint", "reason", "category", "tag", joined("tc_ids"), joined("branch_targets"))


_WORDS = ("HostActivity", "@HiltAndroidTest", "launchFragmentInContainer", "assertEquals(a._b, 1)", "x._adapter", "verify(a, b)", "myHostActivity", "RobolectricTestRunner")
_LANES = ("plain_jvm", "hilt_fragment", "hilt_view", "robolectric_non_hilt")


def plan_tickets(spark, d):
    """Orders as plans whose items name one word each; a plan's text are its items."""
    li = table(spark, d, "lineitem")
    pick = lambda c, values: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    kind = F.when(F.col("l_returnflag") == "R", "not_testable").otherwise("testable").alias("kind")
    layer = F.when(F.col("l_linestatus") == "O", " Unit").otherwise("instrumented").alias("test_layer")
    item = F.struct(*[F.col(c) for c in _PLACE], kind, F.array("l_linenumber").alias("lines"), pick(F.col("l_partkey"), _WORDS).alias("approach"), F.lit("").alias("fixture_hint"), F.lit(None).cast("string").alias("reason"), layer)
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    plans_ = g.select("l_orderkey", F.lit(" ").alias("body"), "items", pick(F.col("l_orderkey"), _LANES).alias("recipe_lane"), F.when(F.col("l_orderkey") % 3 == 0, F.array(F.lit(1), F.lit(2))).alias("allow"))
    t = plan_checks.plan_tickets(plans_, "l_orderkey")
    return t.groupBy("l_orderkey", "code").agg(F.count("*").alias("n"), F.sum(F.size("lines")).alias("lines"))


def owner_chunks(spark, d):
    """Line items as items of a customer's month, with their suppliers as owners; an item has as many lines as its quantity."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    start = (F.col("l_extendedprice") % 400).cast("int")
    rows = li.select("o_custkey", F.month("l_shipdate").alias("month"), (F.col("l_suppkey") % 5).cast("string").alias("owner"), F.xxhash64("l_orderkey", *_PLACE).alias("item"), F.sequence(start, start + F.col("l_quantity").cast("int") - 1).alias("lines"))
    out = plans.owner_chunks(rows, "o_custkey", "month", "owner", "item")
    return out.groupBy("o_custkey", "month", "chunk").agg(F.count("*").alias("parts"), F.sum(F.size("lines")).alias("lines"), F.countDistinct("owner").alias("owners"))


def clamped_tags(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", "not_testable").otherwise("testable").alias("kind"), F.when(F.col("l_tax") > 0.04, "said").otherwise("").alias("reason"),
        F.lit("old").alias("category"), F.element_at(F.array(*map(F.lit, (" Flow", "room", "", "odd", "io "))), (F.col("l_partkey") % 5 + 1).cast("int")).alias("tag"),
    )
    out = plans.clamped_tags(li, "tag", {"io": "room"}, ["flow", "room"], F.col("l_linenumber") % 2 == 0)
    return out.groupBy("kind", "reason", "category", "tag").agg(F.count("*").alias("n"))


def report_upserts(spark, d):
    """Finished orders are the old reports of a customer and priority, open ones the new."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    said = F.concat(F.lit(" \n"), F.repeat(F.lit("ab"), (F.col("o_orderkey") % 500).cast("int")), F.repeat(F.lit("z"), (F.col("o_orderkey") % 300).cast("int")))
    old = o.filter("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_key"), F.lit("old").alias("snippet"))
    new = o.filter("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority", "o_orderkey", ledger.failure_snippet(said).alias("snippet"), F.lit("n").alias("slice_tag"))
    out = ledger.upsert_reports(old, new, ["o_custkey", "o_orderpriority"], "o_orderkey")
    return out.select("o_custkey", "o_orderpriority", "first_key", F.md5("snippet").alias("snippet"), F.length("snippet").alias("n"), "slice_tag")


def type_shapes(spark, d):
    """A listing for each order: its head, a constructor or static function for each line item, and lines that are neither."""
    li = table(spark, d, "lineitem")
    name = F.concat(F.lit("a.b.T"), _text("l_orderkey"))
    line = (
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit("  public static "), F.when(F.col("l_tax") > 0.04, "final ").otherwise(""), F.lit("int s"), _text("l_suppkey"), F.lit("(int);")))
        .when(F.col("l_discount") > 0.05, F.concat(F.lit("  public "), name, F.lit("(java.lang.String, int[] , x.P"), _text("l_linenumber"), F.lit(");"))).otherwise(F.concat(F.lit("  public int m"), _text("l_linenumber"), F.lit("(java.lang.String);")))
    )
    rows = F.sort_array(F.collect_list(F.struct(*_PLACE, line.alias("line"))))["line"]
    g = li.groupBy("l_orderkey").agg(F.array_join(rows, "\n").alias("lines"))
    kind = F.element_at(F.array(F.lit("class"), F.lit("final class"), F.lit("interface")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    listed = g.select("l_orderkey", F.concat(F.lit('Compiled from "T"\npublic '), kind, F.lit(" a.b.T"), _text("l_orderkey"), F.lit(" {\n"), "lines", F.lit("\n}")).alias("text"))
    parsed = listed.select("l_orderkey", signature_lines(F.col("text")).alias("lines"))
    shape = parsed.select("l_orderkey", type_shape(F.col("lines"), F.concat(F.lit("T"), _text("l_orderkey"))).alias("s"))
    return shape.select("l_orderkey", "s.fqcn", "s.kind", F.array_join("s.constructors", ";").alias("constructors"), F.array_join(F.sort_array("s.statics"), ";").alias("statics"), "s.seam", "s.mock")


def documented_types(spark, d):
    """Parts as entries of documents, one document a brand; line items ask for names, of which some have another package."""
    p = table(spark, d, "part")
    entries = p.select(F.col("p_brand").alias("path"), (F.col("p_partkey") % 2).cast("int").alias("part"), _text("p_partkey").cast("int").alias("pos"), F.when(F.col("p_partkey") % 3 > 0, F.concat_ws(".", F.lit("a"), F.regexp_replace("p_name", " ", "_"))).alias("class"), F.concat_ws(".", F.lit("b"), F.regexp_replace("p_name", " ", "_")).alias("qualified_name"))
    names = p.select(F.concat_ws(".", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("p_size") % 3 + 1).cast("int")), F.regexp_replace("p_name", " ", "_")).alias("fqcn"))
    return catalog.documented_entry(names, entries)


def filtered_outputs(spark, d):
    """Turns of conversations, cut to lines at their sentences, as outputs."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))
    out = logs.filtered_output(c.select("conv_id", F.regexp_replace("text", "[.,] ", "\n").alias("text")), "conv_id", "text", errors="wh|que", wide="an", after=2, kept=6, tail=3, limit=200, quiet=20)
    return out.select("conv_id", F.md5("filtered").alias("filtered"), F.length("filtered").alias("n"))


_BY_TAG, _BY_NEEDLE = {"en": "english", "de": "german", "web": "open"}, [(("token", "LICENSE"), "legal"), (("@",), "contact"), (("de",), "german"), (("|", "!!"), "noise")]


def ranked_selection(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.array(F.concat(F.lit(" "), "lang"), F.col("source")).alias("tags"), F.when(F.col("doc_id") % 5 == 0, "legal").when(F.col("doc_id") % 5 == 1, "odd").alias("pin"))
    return rules.ranked_selection(docs, "doc_id", "text", "tags", _BY_TAG, _BY_NEEDLE, 2, "general", "pin")


QUERIES = {f.__name__: f for f in (
    module_projection, file_states, gap_deltas, plan_document_items, plan_tickets, owner_chunks, clamped_tags, report_upserts, type_shapes, documented_types, filtered_outputs, ranked_selection,
)}

_NAMED = """li AS (SELECT l.*, o_orderkey, o_orderstatus, o_orderpriority AS package, CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS VARCHAR) END AS module, CASE WHEN l_linestatus = 'O' THEN 'unit' ELSE 'instrumented' END AS engine, CAST(l_orderkey AS VARCHAR) AS source_name, l_returnflag <> 'N' AS hit
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
_METRICS = {"class": ("1", "hit"), "method": ("1", "l_tax > 0.04"), "branch": ("2", "hit"), "line": ("1", "hit"), "instruction": ("CAST(TRUNC(l_quantity) AS INT)", "l_tax > 0.04")}
_sum = lambda e, m, side: f"COALESCE(CAST(SUM({_METRICS[m][0]}) FILTER (engine = '{e}' AND {'' if side == 'covered' else 'NOT '}({_METRICS[m][1]})) AS BIGINT), 0) AS {e}_{m}_{side}"
_pct = lambda a, b: f"CASE WHEN {a} + {b} > 0 THEN round_even(CAST({a} AS DOUBLE) / ({a} + {b}) * 100, 1) END"
_COUNTS = ", ".join(_sum(e, m, s) for e in modules.ENGINES for m in modules.METRICS for s in ("covered", "missed"))
_ENGINE_PCTS = ", ".join(f"CASE WHEN {e}_{m}_covered > 0 THEN {_pct(f'{e}_{m}_covered', f'{e}_{m}_missed')} END AS {e}_{m}_pct" for e in modules.ENGINES for m in modules.METRICS)
_capped = lambda m: f"CASE WHEN unit_{m}_pct IS NOT NULL OR instrumented_{m}_pct IS NOT NULL THEN LEAST(100.0, round_even(COALESCE(unit_{m}_pct, 0) + COALESCE(instrumented_{m}_pct, 0), 1)) END"
_element = lambda m, c: f"{m}_e AS (SELECT COALESCE(module, '(unknown)') AS module, COUNT(DISTINCT {c}) AS {m}_elements, COUNT(DISTINCT {c}) FILTER (hit) AS {m}_elements_covered FROM li GROUP BY 1)"
_ORDER_BY = ", ".join(_PLACE)
_array = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_file_set = lambda where, name: f"LEFT JOIN ({ranges_sql('SELECT DISTINCT source_name, line_no FROM (' + where + ')', 'source_name')}) {name} USING (source_name)"
_GAP = lambda e: f"SELECT source_name, COUNT(*) FILTER (mi > 0 AND ci = 0) AS lm, COUNT(*) FILTER (ci > 0) AS lc, SUM(mb) AS bm, SUM(cb) AS bc FROM probe WHERE engine = '{e}' GROUP BY 1"
_SETS = {
    "l": "SELECT engine, source_name, line_no FROM probe WHERE mi > 0 AND ci = 0", "b": "SELECT engine, source_name, line_no FROM probe WHERE mb > 0",
    "m": "SELECT engine, source_name, line_no FROM probe WHERE discount > 0.05 AND (mi > 0 AND ci = 0 OR mb > 0)",
}
_minus = lambda s, a, b: f"(SELECT source_name, line_no FROM ({_SETS[s]}) WHERE engine = '{a}' EXCEPT SELECT source_name, line_no FROM ({_SETS[s]}) WHERE engine = '{b}')"
_B, _A = "instrumented", "unit"
_names = lambda q: f"(SELECT source_name, string_agg('m' || line_no, '%s' ORDER BY 'm' || line_no) AS names FROM {q} GROUP BY 1)"

SQL = {
    "module_projection": f"WITH {_NAMED}, s AS (SELECT COALESCE(module, '(unknown)') AS module, COUNT(DISTINCT (package, source_name)) AS files, {_COUNTS} FROM li WHERE o_orderstatus <> 'P' GROUP BY 1), p AS (SELECT *, {_ENGINE_PCTS} FROM s), {_element('class', 'l_suppkey')}, {_element('method', 'l_partkey')}, "
    "u AS (SELECT COALESCE(module, '(unknown)') AS module, COUNT(DISTINCT (source_name, l_linenumber)) AS union_lines, COUNT(DISTINCT (source_name, l_linenumber)) FILTER (hit) AS union_covered FROM li WHERE o_orderstatus <> 'P' GROUP BY 1), z AS (SELECT CAST(0 AS BIGINT) AS branch_elements, CAST(0 AS BIGINT) AS branch_elements_covered, CAST(0 AS BIGINT) AS line_elements, CAST(0 AS BIGINT) AS line_elements_covered, CAST(0 AS BIGINT) AS instruction_elements, CAST(0 AS BIGINT) AS instruction_elements_covered) "
    f"SELECT *, {_pct('class_elements_covered', '(class_elements - class_elements_covered)')} AS combined_class_pct, {_pct('method_elements_covered', '(method_elements - method_elements_covered)')} AS combined_method_pct, {_capped('branch')} AS combined_branch_pct, {_pct('union_covered', '(union_lines - union_covered)')} AS combined_line_pct, {_capped('instruction')} AS combined_instruction_pct FROM p JOIN class_e USING (module) JOIN method_e USING (module) JOIN u USING (module), z",
    "file_states": f"WITH {_NAMED}, f AS (SELECT l_orderkey AS id, source_name, COUNT(*) FILTER (hit) AS covered, COUNT(DISTINCT l_linenumber) FILTER (NOT hit) + COUNT(DISTINCT l_linenumber) FILTER (l_tax > 0.06) AS missed FROM li GROUP BY ALL), "
    "g AS (SELECT DISTINCT source_name, l_linenumber AS line_no, package FROM li WHERE NOT hit AND package <> '5-LOW' EXCEPT SELECT source_name, l_linenumber, package FROM li WHERE NOT hit AND l_discount >= 0.03), b AS (SELECT DISTINCT source_name, l_linenumber AS line_no, package FROM li WHERE l_tax > 0.06 AND package <> '5-LOW' EXCEPT SELECT source_name, l_linenumber, package FROM li WHERE l_tax > 0.06 AND l_discount >= 0.03), "
    f"j AS (SELECT id, CASE o_orderstatus WHEN 'F' THEN 'main/' || id WHEN 'O' THEN 'other/' || id END AS source_path, COALESCE(x.ranges, 'none') AS pending_lines, COALESCE(y.ranges, 'none') AS pending_branches, o_orderpriority = '5-LOW' AS off, missed, o_totalprice > 150000 AND o_orderstatus <> 'P' AS quiet FROM f JOIN orders ON o_orderkey = id {_file_set('SELECT * FROM g', 'x')} {_file_set('SELECT * FROM b', 'y')}) "
    "SELECT id, source_path, source_path IS NOT NULL AS source_resolvable, pending_lines, pending_branches, off AND quiet AS non_executable, CASE WHEN off AND quiet THEN 'no_exec' WHEN off OR missed = 0 THEN 'covered' WHEN source_path IS NULL THEN 'generated' WHEN pending_lines <> 'none' OR pending_branches <> 'none' THEN 'actionable' ELSE 'deferred_only' END AS gap_work_status FROM j",
    "gap_deltas": f"WITH {probe_sql()}, x AS ({_GAP(_B)}), y AS ({_GAP(_A)}), j AS (SELECT source_name, x.lm IS NOT NULL AS bh, y.lm IS NOT NULL AS ah, x.lm AS blm, x.lc AS blc, x.bm AS bbm, x.bc AS bbc, y.lm AS alm, y.lc AS alc, y.bm AS abm, y.bc AS abc FROM x FULL JOIN y USING (source_name)), "
    f"k AS (SELECT j.*, bh AND ah AS twosided, r1.ranges AS rl, r2.ranges AS rb, r3.names AS rm, n1.ranges AS nl, n2.ranges AS nb, n3.names AS nm, am.ranges AS am FROM j "
    + " ".join(_file_set("SELECT * FROM " + _minus(s, a, b), name) for s, a, b, name in (("l", _B, _A, "r1"), ("b", _B, _A, "r2"), ("l", _A, _B, "n1"), ("b", _A, _B, "n2")))
    + f" LEFT JOIN {_names(_minus('m', _B, _A)) % ', '} r3 USING (source_name) LEFT JOIN {_names(_minus('m', _A, _B)) % ','} n3 USING (source_name) LEFT JOIN ({ranges_sql('SELECT DISTINCT source_name, line_no FROM (' + _SETS['l'] + ') WHERE engine = ' + chr(39) + _A + chr(39), 'source_name')}) am USING (source_name)), "
    "v AS (SELECT *, nl IS NOT NULL OR alm > blm OR alc < blc OR nb IS NOT NULL OR abm > bbm OR abc < bbc OR nm IS NOT NULL AS worse, rl IS NOT NULL OR alm < blm OR alc > blc OR rb IS NOT NULL OR abm < bbm OR abc > bbc OR rm IS NOT NULL AS better FROM k) "
    "SELECT source_name, CASE WHEN twosided THEN COALESCE(nl, 'none') END AS new_lines, CASE WHEN twosided THEN COALESCE(nb, 'none') END AS new_branches, CASE WHEN twosided THEN COALESCE(nm, '') END AS new_methods, CASE WHEN twosided THEN worse END AS regressed, CASE WHEN twosided THEN better END AS improved, CASE WHEN twosided THEN better AND NOT worse ELSE NOT bh AND (alc > 0 OR abc > 0) END AS accepted, "
    "'   Covered (Kover):' || chr(10) || CASE WHEN NOT twosided THEN '     - coverage delta unavailable' ELSE concat_ws(chr(10), '     - resolved lines: ' || COALESCE(rl, 'none'), '     - resolved branch lines: ' || rb, '     - resolved methods: ' || COALESCE(rm, 'none'), '     - remaining missed lines: ' || COALESCE(am, 'none'), '     - line missed/covered: (' || blm || ', ' || blc || ') -> (' || alm || ', ' || alc || ')') END AS text FROM v",
    "plan_document_items": f"""WITH b AS (SELECT *, l_returnflag = 'N' AS test, l_orderkey % 7 = 0 AND BOOL_OR(l_returnflag = 'N') OVER (PARTITION BY l_orderkey) AS yaml, l_orderkey % 7 = 0 AS front FROM lineitem),
  c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY NOT test, {_ORDER_BY}) - 1 AS pos FROM b WHERE CASE WHEN front THEN test ELSE l_quantity >= 5 END),
  r AS (SELECT *, l_linenumber || ',' || (l_linenumber + 2) AS two, 'TC' || l_partkey AS tc, CASE WHEN l_discount < 0.05 THEN 'not_unit_testable' ELSE 'late' END AS cat FROM c)
  SELECT l_orderkey, CAST(pos AS INT) AS pos, CASE WHEN test THEN 'testable' ELSE 'not_testable' END AS kind, CASE WHEN front THEN CAST(l_linenumber AS VARCHAR) ELSE two END AS lines, CASE WHEN test THEN '' ELSE 'a,b' END AS methods,
    CASE WHEN front THEN 'branch: a; b' WHEN test THEN concat_ws(chr(10), 'branch: go', '1. Scenario: N/A', '2. Given: N/A', '3. When: ' || l_linestatus, '4. Then: N/A', '5. Assertions: N/A') ELSE '' END AS approach,
    CASE WHEN front OR NOT test THEN '' ELSE 'tickets: ' || tc END AS fixture_hint, CASE WHEN test THEN '' WHEN l_tax < 0.05 THEN 'Deferred (' || cat || '): lines [' || replace(two, ',', ', ') || '] marked not_testable in Section 13.' ELSE 'known' END AS reason,
    CASE WHEN test THEN '' ELSE cat END AS category, CASE WHEN front THEN l_linestatus WHEN NOT test OR l_tax <= 0.02 THEN '' ELSE l_linestatus END AS tag, CASE WHEN front OR NOT test THEN '' ELSE tc END AS tc_ids, CASE WHEN front THEN 'a,b' ELSE '' END AS branch_targets FROM r""",
    "plan_tickets": f"""WITH i AS (SELECT *, {_array(_WORDS)}[l_partkey % {len(_WORDS)} + 1] AS word, {_array(_LANES)}[l_orderkey % {len(_LANES)} + 1] AS lane, l_returnflag <> 'R' AS test FROM lineitem),
  p AS (SELECT l_orderkey, ANY_VALUE(lane) AS lane, BOOL_OR(word = 'HostActivity') AS host, BOOL_OR(word = '@HiltAndroidTest') AS hilt, BOOL_OR(word = 'launchFragmentInContainer') AS attach, BOOL_OR(contains(word, '._')) AS private FROM i GROUP BY 1),
  t AS (SELECT l_orderkey, 'plan_private_field_assert' AS code, 0 AS lines FROM p WHERE private UNION ALL SELECT l_orderkey, 'plan_placeholder_host', 0 FROM p WHERE host
    UNION ALL SELECT l_orderkey, 'plan_wrong_harness_lane', 0 FROM p WHERE hilt AND lane IN ('plain_jvm', 'robolectric_non_hilt') OR attach AND NOT host AND lane = 'hilt_fragment'
    UNION ALL SELECT l_orderkey, 'plan_lines_outside_delta', 1 FROM i WHERE test AND l_orderkey % 3 = 0 AND l_linenumber NOT IN (1, 2)
    UNION ALL SELECT l_orderkey, 'plan_layer_harness_mismatch', 0 FROM i WHERE test AND (l_linestatus <> 'O' AND word = 'RobolectricTestRunner' OR l_linestatus = 'O' AND lane = 'plain_jvm' AND word = '@HiltAndroidTest'))
  SELECT l_orderkey, code, COUNT(*) AS n, CAST(SUM(lines) AS BIGINT) AS lines FROM t GROUP BY ALL""",
    "clamped_tags": """WITH i AS (SELECT l_returnflag <> 'R' AS test, CASE WHEN l_tax > 0.04 THEN 'said' ELSE '' END AS said, ['flow', 'room', '', 'odd', 'room'][l_partkey % 5 + 1] AS t, l_linenumber % 2 = 0 AS public FROM lineitem), v AS (SELECT *, t IN ('flow', 'room') AS fits FROM i)
  SELECT CASE WHEN test AND (fits OR public) THEN 'testable' ELSE 'not_testable' END AS kind, CASE WHEN test AND NOT fits AND NOT public AND said = '' THEN 'untagged_or_invalid_slice' ELSE said END AS reason, CASE WHEN test AND NOT fits AND NOT public THEN 'untagged_or_invalid_slice' ELSE 'old' END AS category,
    CASE WHEN test THEN CASE WHEN fits THEN t ELSE 'plain_unit' END ELSE COALESCE(NULLIF(t, ''), 'plain_unit') END AS tag, COUNT(*) AS n FROM v GROUP BY ALL""",
    "report_upserts": """WITH o AS (SELECT *, repeat('ab', CAST(o_orderkey % 500 AS INT)) || repeat('z', CAST(o_orderkey % 300 AS INT)) AS said FROM orders), a AS (SELECT o_custkey, o_orderpriority, MIN(o_orderkey) AS first_key, 'old' AS s FROM o WHERE o_orderstatus = 'F' GROUP BY ALL),
  b AS (SELECT o_custkey, o_orderpriority, ARG_MAX(CASE WHEN length(said) > 800 THEN said[1:400] || chr(10) || '...' || chr(10) || right(said, 350) ELSE said END, o_orderkey) AS s, 'n' AS slice_tag FROM o WHERE o_orderstatus = 'O' GROUP BY ALL)
  SELECT o_custkey, o_orderpriority, first_key, md5(COALESCE(b.s, a.s)) AS snippet, CAST(length(COALESCE(b.s, a.s)) AS INT) AS n, slice_tag FROM a FULL JOIN b USING (o_custkey, o_orderpriority)""",
    "type_shapes": f"""WITH l AS (SELECT *, l_returnflag = 'N' AS static, l_returnflag <> 'N' AND l_discount > 0.05 AS made FROM lineitem),
  g AS (SELECT l_orderkey, COALESCE(string_agg('(String, int[], P' || l_linenumber || ')', ';' ORDER BY {_ORDER_BY}) FILTER (made), '') AS constructors, COALESCE(string_agg(DISTINCT 's' || l_suppkey, ';' ORDER BY 's' || l_suppkey) FILTER (static), '') AS statics FROM l GROUP BY 1)
  SELECT l_orderkey, 'T' || l_orderkey AS fqcn, ['class', 'class', 'interface'][l_orderkey % 3 + 1] AS kind, constructors, statics, CASE WHEN statics <> '' AND constructors = '' THEN 'static' ELSE 'constructor' END AS seam, CASE WHEN statics <> '' AND constructors = '' THEN 'mockkStatic' ELSE 'mockkConstructor' END AS mock FROM g""",
    "documented_types": """WITH e AS (SELECT p_brand AS path, CAST(p_partkey % 2 AS INT) AS part, CAST(p_partkey AS INT) AS pos, replace(p_name, ' ', '_') AS simple, CASE WHEN p_partkey % 3 > 0 THEN 'a.' ELSE 'b.' END || replace(p_name, ' ', '_') AS name FROM part), n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS simple, ['a.', 'b.', 'c.'][p_size % 3 + 1] || replace(p_name, ' ', '_') AS fqcn FROM part),
  r AS (SELECT fqcn, path, part, pos, name = fqcn AS exact, ROW_NUMBER() OVER (PARTITION BY fqcn ORDER BY name = fqcn DESC, CASE WHEN name = fqcn THEN part ELSE -part END, CASE WHEN name = fqcn THEN pos ELSE -pos END, path DESC) AS k FROM e JOIN n USING (simple)) SELECT fqcn, path, part, pos, exact FROM r WHERE k = 1""",
    "filtered_outputs": """WITH t AS (SELECT conv_id, regexp_replace(string_agg(COALESCE(text, ''), chr(10) ORDER BY turn, role NULLS FIRST, text NULLS FIRST), '[.,] ', chr(10), 'g') AS whole FROM conversations GROUP BY 1), s AS (SELECT conv_id, whole, string_split(regexp_replace(whole, '\\n\\z', ''), chr(10)) AS ls FROM t),
  l AS (SELECT conv_id, UNNEST(ls) AS line, generate_subscripts(ls, 1) AS n FROM s), h AS (SELECT *, regexp_matches(line, 'wh|que') AS hit FROM l), w AS (SELECT *, SUM((hit AND contains(line, 'an'))::INT) OVER (PARTITION BY conv_id ORDER BY n) AS st FROM h),
  u AS (SELECT *, hit OR st > 0 AND SUM((NOT hit)::INT) OVER (PARTITION BY conv_id, st ORDER BY n) <= 2 AS use FROM w), p AS (SELECT *, SUM(use::INT) OVER (PARTITION BY conv_id ORDER BY n DESC) AS un, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY n DESC) AS tn, BOOL_OR(hit) OVER (PARTITION BY conv_id) AS loud FROM u),
  r AS (SELECT conv_id, 0 AS place, n, line FROM p WHERE loud AND use AND un <= 6 UNION ALL SELECT conv_id, 2, n, line FROM p WHERE loud AND tn <= 3 UNION ALL SELECT DISTINCT conv_id, 1, 0, '' FROM p WHERE loud UNION ALL SELECT DISTINCT conv_id, 1, 1, '---- GRADLE OUTPUT TAIL ----' FROM p WHERE loud),
  k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') ORDER BY place, n) AS seen, regexp_replace(line, '^\\s+|\\s+$', '', 'g') = '' AS blank FROM r), f AS (SELECT conv_id, right(string_agg(line, chr(10) ORDER BY place, n), 200) AS filtered FROM k WHERE blank OR seen = 1 GROUP BY 1
  UNION ALL SELECT conv_id, right(whole, 20) FROM s WHERE conv_id NOT IN (SELECT conv_id FROM r)) SELECT conv_id, md5(filtered) AS filtered, CAST(length(filtered) AS INT) AS n FROM f""",
    "ranked_selection": """WITH d AS (SELECT doc_id, lower(COALESCE(text, '') || chr(10) || concat_ws(' ', lang, source)) AS hay, lang, source FROM documents), h AS (SELECT doc_id, 0 AS k, 'legal' AS name FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 1, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'web' THEN 'open' END FROM d WHERE lang IN ('en', 'de', 'web')
  UNION ALL SELECT doc_id, 2, CASE source WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'web' THEN 'open' END FROM d WHERE source IN ('en', 'de', 'web') UNION ALL SELECT doc_id, 3, 'legal' FROM d WHERE contains(hay, 'token') OR contains(hay, 'license') UNION ALL SELECT doc_id, 4, 'contact' FROM d WHERE contains(hay, '@')
  UNION ALL SELECT doc_id, 5, 'german' FROM d WHERE contains(hay, 'de') UNION ALL SELECT doc_id, 6, 'noise' FROM d WHERE contains(hay, '|') OR contains(hay, '!!')), f AS (SELECT doc_id, name, MIN(k) AS k FROM h GROUP BY ALL), r AS (SELECT doc_id, name, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS rank FROM f)
  SELECT doc_id, CAST(rank AS INT) AS rank, name FROM r WHERE rank < 2 UNION ALL SELECT doc_id, 0, 'general' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM f)""",
}

"""Queries of the coverage and ledger operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.labels import WORK_STATES, gap_kind, work_status
from marlstone.functions.numbers import compact_ranges, credited, effective_pct, merged_covered, pct_band, ratio_pct, union_line_pct
from marlstone.operators import coverage as C
from marlstone.operators import ledger as L
from marlstone.operators import spans as S
from marlstone.plans.surrogate import probe_sql, probes, ranges_sql, table

CUT = "1998-01-01"
P = probe_sql()
MISSED = "mi > 0 AND ci = 0"


def module_line_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.module_coverage(probes(spark, d)).withColumn("band", pct_band(F.col("line_pct"))).orderBy("module")


def file_missed_ranges(spark, d):
    s = C.engine_snapshot(probes(spark, d))
    return s.select("engine", "source_name", compact_ranges(F.col("missed_lines")).alias("missed"), compact_ranges(F.col("covered_lines")).alias("covered"))


def line_gap_kinds(spark, d):
    p = probes(spark, d).withColumn("kind", gap_kind(F.col("mi"), F.col("ci"), F.col("mb"))).filter("kind IS NOT NULL")
    return p.groupBy("module", "engine", "kind").agg(F.count("*").alias("n"))


def engine_full_outer(spark, d):
    m = C.merge_engines(C.engine_snapshot(probes(spark, d)))
    n = lambda c: F.coalesce(c, F.lit(0))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    total = lambda p: size(p + "missed_lines") + size(p + "covered_lines")
    return m.select(
        *C.SOURCE, n("u_line_covered").alias("unit_covered"), n("u_line_missed").alias("unit_missed"), n("i_line_covered").alias("instr_covered"), n("i_line_missed").alias("instr_missed"),
        F.size("merged_missed").cast("long").alias("merged_missed"), merged_covered(total("u_"), total("i_"), F.size("merged_missed")).cast("long").alias("merged_covered"),
    )


def engine_latest_snapshot(spark, d):
    s = C.best_snapshot(C.engine_snapshot(probes(spark, d)), ["package", "source_name"], "line_covered", "engine")
    return s.select("package", "source_name", "engine", "line_covered", "line_missed")


def _merged(mode):
    def run(spark, d):
        m = C.merge_engines(C.engine_snapshot(probes(spark, d)), mode)
        return m.select("source_name", compact_ranges(F.col("merged_missed")).alias("missed"))

    return run


def union_line(spark, d):
    p = probes(spark, d)
    lines = C.union_lines(p).groupBy("source_name").agg(F.count_if("covered").alias("covered"), F.count("*").alias("total"))
    nothing = F.lit(None).cast("double")
    return lines.select("source_name", "covered", "total", union_line_pct(F.col("covered"), F.col("total"), nothing, nothing).alias("pct"))


def coverage_delta(spark, d):
    before, after = (C.engine_snapshot(probes(spark, d, w)).filter("engine = 'unit'") for w in (f"l_shipdate < timestamp'{CUT}'", "true"))
    j = C.coverage_delta(before, after, ["source_name"])
    r = lambda c: compact_ranges(F.col(c)).alias(c)
    return j.select("source_name", r("resolved_lines"), r("new_missed_lines"), r("resolved_branches"), r("new_branches"), "improved", "regressed", "accepted")


def issue_bag_difference(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 2).alias("h"))
    left, right = (o.filter(f"h = {h}").drop("h") for h in (0, 1))
    return left.exceptAll(right).groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("added"))


def deferred_antijoin(spark, d):
    p = C.with_states(probes(spark, d)).filter("missed")
    left = C.without_deferred(p, p.filter("discount >= 0.09"), ["source_name", "line_no"])
    return left.groupBy("module", "engine").agg(F.count("*").alias("actionable"))


def module_effective_pct(spark, d):
    lines = C.union_lines(probes(spark, d)).groupBy("module").agg(F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("missed"))
    ledger = C.with_states(probes(spark, d)).filter("missed AND discount >= 0.09").groupBy("module").agg(F.countDistinct("source_name", "line_no").alias("deferred"))
    j = lines.join(ledger, "module", "full_outer").na.fill(0, ["covered", "missed", "deferred"])
    credit = credited(F.col("deferred"), F.col("missed"))
    return j.select("module", "deferred", credit.alias("credited"), ratio_pct(F.col("covered"), F.col("missed")).alias("line_pct"), effective_pct(F.col("covered"), F.col("missed"), credit).alias("effective_pct"))


def status_counts(spark, d):
    p = C.with_states(probes(spark, d))
    f = p.groupBy("source_name").agg(F.count("*").alias("n"), F.count_if("missed").alias("missed"), F.count_if(F.col("missed") & (F.col("discount") < 0.09)).alias("actionable"))
    status = work_status(F.col("n"), F.col("missed"), F.lit(True), F.col("actionable"))
    return C.zero_filled_counts(f.select(status.alias("status")), "status", WORK_STATES)


def module_rollup_total(spark, d):
    return C.module_rollup(C.union_lines(probes(spark, d)))


def element_union(spark, d):
    e = probes(spark, d).select("engine", "module", "source_name", "line_no", (F.col("mb") + F.col("cb")).alias("slots"), F.col("cb").alias("covered_slots"))
    return C.element_union(e, ["module"], ["source_name", "line_no"])


def metric_unpivot(spark, d):
    p = probes(spark, d).groupBy("module").agg(F.sum("ci").alias("instruction_covered"), F.sum("mi").alias("instruction_missed"), F.sum("cb").alias("branch_covered"), F.sum("mb").alias("branch_missed"))
    long = p.unpivot("module", ["instruction_covered", "instruction_missed", "branch_covered", "branch_missed"], "metric", "n")
    wide = long.groupBy("module", F.substring_index("metric", "_", 1).alias("metric")).agg(F.max(F.when(F.col("metric").endswith("_covered"), F.col("n"))).alias("covered"), F.max(F.when(F.col("metric").endswith("_missed"), F.col("n"))).alias("missed"))
    return wide.withColumn("pct", F.when(F.col("covered") > 0, ratio_pct(F.col("covered"), F.col("missed"))))


def run_latest_per_source(spark, d):
    o = L.latest(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return o.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


def run_acceptance_summary(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("runs"), F.count_if(F.col("o_orderstatus") == "F").alias("accepted"), F.countDistinct("o_custkey").alias("sources"))
    return o.withColumn("acceptance_pct", ratio_pct(F.col("accepted"), F.col("runs") - F.col("accepted")))


def ledger_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), "o_orderkey", F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("reason"), F.when(F.col("o_orderstatus") == "P", "residual").otherwise("plan").alias("category"))
    first, second = (L.latest(o.filter(f"o_orderkey % 2 = {h}"), ["source"], F.asc("o_orderkey")) for h in (0, 1))
    return L.upsert(first, second, ["source"])


def ledger_reconcile(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_orderkey").alias("source"), "o_orderstatus", F.array(F.lit(1), F.lit(2)).alias("lines"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("line"), (F.col("l_discount") >= 0.09).alias("accepted"), (F.col("l_returnflag") == "A").alias("covered"))
    return L.reconcile(o, li, "source").groupBy("o_orderstatus").agg(F.count("*").alias("left"))


def or_join_match(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.substring("s_name", -4, 4).alias("s_tail"), F.floor("s_acctbal").alias("s_bal"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.substring("c_name", -4, 4).alias("c_tail"), F.floor("c_acctbal").alias("c_bal"))
    same_nation = F.col("s_nationkey") == F.col("c_nationkey")
    j = L.match_either(s, c, [("s_nationkey", "nation")], [same_nation & (F.col("s_tail") == F.col("c_tail")), same_nation & (F.col("s_bal") == F.col("c_bal"))], ("s_suppkey", "c_custkey"))
    return j.groupBy("nation").agg(F.count("*").alias("pairs"))


def _spans(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("source"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("name"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + (F.col("l_partkey") % 4).cast("int")).alias("hi"))


SPANS = "spans AS (SELECT l_orderkey AS source, l_partkey || '-' || l_suppkey AS name, l_linenumber AS lo, l_linenumber + CAST(l_partkey % 4 AS INT) AS hi FROM lineitem)"


def span_owner(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), (F.col("l_linenumber") + 1).alias("at"))
    return S.narrowest_owner(points, _spans(spark, d), "source")


def span_overlap_semi(spark, d):
    findings = table(spark, d, "lineitem").filter("l_discount >= 0.09").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + 1).alias("hi"))
    return S.overlapping(_spans(spark, d), findings, "source").groupBy("source").agg(F.count("*").alias("n"))


def window_merge(spark, d):
    missed = C.with_states(probes(spark, d)).filter("missed")
    return S.merged_windows(missed, "source_name", "line_no", 1)


def file_sort_nulls(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("pct"), "c_mktsegment")
    return c.orderBy(F.coalesce("pct", F.lit(-1.0)), "c_mktsegment", "c_name", "c_custkey")


def top1_by_struct(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


DELTA_SIDE = lambda name: f"{name}_l AS (SELECT source_name, line_no, BOOL_OR({MISSED}) AS missed, BOOL_OR(mb > 0) AS gap, BOOL_OR(ci > 0) AS covered FROM {name} WHERE engine = 'unit' GROUP BY ALL)"

QUERIES = {
    "module_line_coverage": module_line_coverage, "file_missed_ranges": file_missed_ranges, "line_gap_kinds": line_gap_kinds, "engine_full_outer": engine_full_outer,
    "engine_latest_snapshot": engine_latest_snapshot, "merged_missed_reference": _merged("reference"), "merged_missed_documented": _merged("documented"),
    "union_line_pct": union_line, "coverage_delta": coverage_delta, "issue_bag_difference": issue_bag_difference, "deferred_antijoin": deferred_antijoin,
    "module_effective_pct": module_effective_pct, "status_counts": status_counts, "module_rollup_total": module_rollup_total, "element_union": element_union,
    "metric_unpivot": metric_unpivot, "run_latest_per_source": run_latest_per_source, "run_acceptance_summary": run_acceptance_summary, "ledger_upsert": ledger_upsert,
    "ledger_reconcile": ledger_reconcile, "or_join_match": or_join_match, "span_owner": span_owner, "span_overlap_semi": span_overlap_semi, "window_merge": window_merge,
    "file_sort_nulls": file_sort_nulls, "top1_by_struct": top1_by_struct,
}

UNION = "u AS (SELECT module, package, source_name, line_no, BOOL_OR(ci > 0) AS covered FROM probe GROUP BY ALL)"
_pct = lambda c, m: f"CASE WHEN {c} + {m} > 0 THEN round_even(({c}) / ({c} + {m}) * 100, 1) END"


def _merged_sql(mode: str) -> str:
    hit = "EXISTS (SELECT 1 FROM probe q WHERE q.source_name = p.source_name AND q.engine = 'instrumented' AND q.ci > 0)"
    unit = "EXISTS (SELECT 1 FROM probe q WHERE q.source_name = p.source_name AND q.engine = 'unit')"
    own = f"p.engine = 'instrumented' AND ({hit} OR NOT {unit})"
    both = "" if mode == "reference" else f" AND (NOT {unit} OR EXISTS (SELECT 1 FROM probe q WHERE q.source_name = p.source_name AND q.engine = 'unit' AND q.line_no = p.line_no AND q.mi > 0 AND q.ci = 0))"
    lines = f"SELECT DISTINCT source_name, line_no FROM probe p WHERE {MISSED} AND (({own}{both}) OR (p.engine = 'unit' AND NOT {hit}))"
    return f"WITH {P}, r AS ({ranges_sql(lines, 'source_name')}) SELECT s.source_name, COALESCE(ranges, 'none') AS missed FROM (SELECT DISTINCT source_name FROM probe) s LEFT JOIN r USING (source_name)"


def _ranges(select: str, name: str) -> str:
    return f"{name} AS ({ranges_sql(select, 'source_name')})"


SQL = {
    "module_line_coverage": f"WITH {P}, {UNION}, s AS (SELECT module, COUNT(DISTINCT package || source_name) AS files, COUNT(*) FILTER (covered) AS covered, COUNT(*) FILTER (NOT covered) AS missed FROM u GROUP BY module), t AS (SELECT *, {_pct('covered', 'missed')} AS line_pct FROM s) SELECT *, CASE WHEN line_pct < 60 THEN 'low' WHEN line_pct <= 85 THEN 'medium' WHEN line_pct > 85 THEN 'high' END AS band FROM t",
    "file_missed_ranges": f"WITH {P}, m AS ({ranges_sql('SELECT engine, source_name, line_no FROM probe WHERE ' + MISSED, 'engine, source_name')}), c AS ({ranges_sql('SELECT engine, source_name, line_no FROM probe WHERE ci > 0', 'engine, source_name')}) SELECT s.engine, s.source_name, COALESCE(m.ranges, 'none') AS missed, COALESCE(c.ranges, 'none') AS covered FROM (SELECT DISTINCT engine, source_name FROM probe) s LEFT JOIN m USING (engine, source_name) LEFT JOIN c USING (engine, source_name)",
    "line_gap_kinds": f"WITH {P} SELECT module, engine, kind, COUNT(*) AS n FROM (SELECT *, CASE WHEN mi > 0 AND ci = 0 AND mb > 0 THEN 'line_and_branch' WHEN mb > 0 THEN 'branch' WHEN mi > 0 THEN 'line' END AS kind FROM probe) WHERE kind IS NOT NULL GROUP BY ALL",
    "engine_full_outer": f"WITH {P}, s AS (SELECT engine, module, package, source_name, COUNT(*) FILTER (ci > 0) AS c, COUNT(*) FILTER ({MISSED}) AS m FROM probe GROUP BY ALL), j AS (SELECT COALESCE(u.module, i.module) AS module, COALESCE(u.package, i.package) AS package, COALESCE(u.source_name, i.source_name) AS source_name, COALESCE(u.c, 0) AS unit_covered, COALESCE(u.m, 0) AS unit_missed, COALESCE(i.c, 0) AS instr_covered, COALESCE(i.m, 0) AS instr_missed, CASE WHEN i.c > 0 OR u.m IS NULL THEN COALESCE(i.m, 0) ELSE u.m END AS merged_missed FROM (SELECT * FROM s WHERE engine = 'unit') u FULL JOIN (SELECT * FROM s WHERE engine = 'instrumented') i USING (module, package, source_name)) SELECT *, GREATEST(0, GREATEST(unit_covered + unit_missed, instr_covered + instr_missed) - merged_missed) AS merged_covered FROM j",
    "engine_latest_snapshot": f"WITH {P}, s AS (SELECT engine, module, package, source_name, COUNT(*) FILTER (ci > 0) AS line_covered, COUNT(*) FILTER ({MISSED}) AS line_missed FROM probe GROUP BY ALL) SELECT package, source_name, engine, line_covered, line_missed FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY package, source_name ORDER BY line_covered DESC, engine) = 1",
    "merged_missed_reference": _merged_sql("reference"),
    "merged_missed_documented": _merged_sql("documented"),
    "union_line_pct": f"WITH {P}, {UNION} SELECT source_name, COUNT(*) FILTER (covered) AS covered, COUNT(*) AS total, round_even(COUNT(*) FILTER (covered) / COUNT(*) * 100, 1) AS pct FROM u GROUP BY source_name",
    "coverage_delta": f"WITH {probe_sql(f'l_shipdate < TIMESTAMP ' + repr(CUT), 'b')}, {probe_sql('true', 'a')}, {DELTA_SIDE('b')}, {DELTA_SIDE('a')}, "
    "j AS (SELECT source_name, line_no, COALESCE(b_l.missed, false) AS bm, COALESCE(a_l.missed, false) AS am, COALESCE(b_l.gap, false) AS bg, COALESCE(a_l.gap, false) AS ag, COALESCE(b_l.covered, false) AS bc, COALESCE(a_l.covered, false) AS ac FROM b_l FULL JOIN a_l USING (source_name, line_no)), "
    + ", ".join(_ranges(f"SELECT source_name, line_no FROM j WHERE {c}", n) for n, c in (("r1", "bm AND NOT am"), ("r2", "am AND NOT bm"), ("r3", "bg AND NOT ag"), ("r4", "ag AND NOT bg")))
    + ", t AS (SELECT source_name, COUNT(*) FILTER (bm AND NOT am) AS res, COUNT(*) FILTER (am AND NOT bm) AS new, COUNT(*) FILTER (bg AND NOT ag) AS resb, COUNT(*) FILTER (ag AND NOT bg) AS newb, COUNT(*) FILTER (bm) AS mb, COUNT(*) FILTER (am) AS ma, COUNT(*) FILTER (bc) AS cb, COUNT(*) FILTER (ac) AS ca FROM j GROUP BY source_name), v AS (SELECT *, (res > 0 OR ma < mb OR ca > cb OR resb > 0) AS improved, (new > 0 OR ma > mb OR ca < cb OR newb > 0) AS regressed FROM t) "
    "SELECT source_name, COALESCE(r1.ranges, 'none') AS resolved_lines, COALESCE(r2.ranges, 'none') AS new_missed_lines, COALESCE(r3.ranges, 'none') AS resolved_branches, COALESCE(r4.ranges, 'none') AS new_branches, improved, regressed, improved AND NOT regressed AS accepted FROM v LEFT JOIN r1 USING (source_name) LEFT JOIN r2 USING (source_name) LEFT JOIN r3 USING (source_name) LEFT JOIN r4 USING (source_name)",
    "issue_bag_difference": "SELECT o_orderpriority, o_orderstatus, COUNT(*) AS added FROM (SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1) GROUP BY ALL",
    "deferred_antijoin": f"WITH {P}, m AS (SELECT * FROM probe WHERE {MISSED}) SELECT module, engine, COUNT(*) AS actionable FROM m WHERE NOT EXISTS (SELECT 1 FROM m l WHERE l.discount >= 0.09 AND l.source_name = m.source_name AND l.line_no = m.line_no) GROUP BY ALL",
    "module_effective_pct": f"WITH {P}, {UNION}, s AS (SELECT module, COUNT(*) FILTER (covered) AS covered, COUNT(*) FILTER (NOT covered) AS missed FROM u GROUP BY module), l AS (SELECT module, COUNT(DISTINCT source_name || ' ' || line_no) AS deferred FROM probe WHERE {MISSED} AND discount >= 0.09 GROUP BY module), j AS (SELECT module, covered, missed, COALESCE(deferred, 0) AS deferred, LEAST(COALESCE(deferred, 0), missed) AS credited FROM s LEFT JOIN l USING (module)) SELECT module, deferred, credited, {_pct('covered', 'missed')} AS line_pct, round_even(100 * (covered + credited) / (covered + missed), 1) AS effective_pct FROM j",
    "status_counts": f"WITH {P}, f AS (SELECT source_name, COUNT(*) AS n, COUNT(*) FILTER ({MISSED}) AS missed, COUNT(*) FILTER ({MISSED} AND discount < 0.09) AS actionable FROM probe GROUP BY source_name), s AS (SELECT CASE WHEN n <= 0 THEN 'no_exec' WHEN missed <= 0 THEN 'covered' WHEN actionable > 0 THEN 'actionable' ELSE 'deferred_only' END AS status FROM f) SELECT status, COUNT(s.status) AS n FROM (VALUES ('no_exec'), ('covered'), ('generated'), ('actionable'), ('deferred_only')) v(status) LEFT JOIN s USING (status) GROUP BY status",
    "module_rollup_total": f"WITH {P}, {UNION}, s AS (SELECT CASE WHEN GROUPING(module) = 1 THEN 'TOTAL' ELSE module END AS module, COUNT(*) FILTER (covered) AS covered, COUNT(*) FILTER (NOT covered) AS missed FROM u GROUP BY ROLLUP (module)) SELECT *, {_pct('covered', 'missed')} AS line_pct FROM s",
    "element_union": f"WITH {P}, o AS (SELECT module, source_name, line_no, MAX(mb + cb) AS slots, MAX(cb) AS c FROM probe GROUP BY ALL) SELECT module, CAST(SUM(c) AS BIGINT) AS covered, CAST(SUM(slots) AS BIGINT) AS total, CASE WHEN SUM(slots) > 0 THEN round_even(SUM(c) / SUM(slots) * 100, 1) END AS pct FROM o GROUP BY module",
    "metric_unpivot": f"WITH {P}, l AS (SELECT module, 'instruction' AS metric, CAST(SUM(ci) AS BIGINT) AS covered, CAST(SUM(mi) AS BIGINT) AS missed FROM probe GROUP BY module UNION ALL SELECT module, 'branch', CAST(SUM(cb) AS BIGINT), CAST(SUM(mb) AS BIGINT) FROM probe GROUP BY module) SELECT *, CASE WHEN covered > 0 THEN round_even(covered / (covered + missed) * 100, 1) END AS pct FROM l",
    "run_latest_per_source": "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "run_acceptance_summary": "SELECT o_orderpriority, COUNT(*) AS runs, COUNT(*) FILTER (o_orderstatus = 'F') AS accepted, COUNT(DISTINCT o_custkey) AS sources, round_even(COUNT(*) FILTER (o_orderstatus = 'F') / COUNT(*) * 100, 1) AS acceptance_pct FROM orders GROUP BY ALL",
    "ledger_upsert": "WITH o AS (SELECT o_custkey AS source, o_orderkey, o_orderstatus || ' ' || o_orderpriority AS reason, CASE WHEN o_orderstatus = 'P' THEN 'residual' ELSE 'plan' END AS category FROM orders), a AS (SELECT * FROM o WHERE o_orderkey % 2 = 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY o_orderkey) = 1), b AS (SELECT * FROM o WHERE o_orderkey % 2 = 1 QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY o_orderkey) = 1) SELECT source, CASE WHEN a.reason IS NULL OR (b.reason IS NOT NULL AND (a.category = 'residual' OR LENGTH(b.reason) > LENGTH(a.reason))) THEN b.reason ELSE a.reason END AS reason, COALESCE(a.category, b.category) AS category FROM a FULL JOIN b USING (source)",
    "ledger_reconcile": "SELECT o_orderstatus, COUNT(*) AS left FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber IN (1, 2) AND (l_discount >= 0.09 OR l_returnflag = 'A')) GROUP BY ALL".replace("AS left", 'AS "left"'),
    "or_join_match": "SELECT s_nationkey AS nation, COUNT(*) AS pairs FROM supplier JOIN customer ON s_nationkey = c_nationkey AND (right(s_name, 4) = right(c_name, 4) OR floor(s_acctbal) = floor(c_acctbal)) GROUP BY ALL",
    "span_owner": f"""WITH {SPANS}, p AS (SELECT DISTINCT l_orderkey AS source, l_linenumber + 1 AS "at" FROM lineitem) SELECT source, "at", name, lo, hi FROM p JOIN spans USING (source) WHERE "at" BETWEEN lo AND hi QUALIFY ROW_NUMBER() OVER (PARTITION BY source, "at" ORDER BY hi - lo, lo, name) = 1""",
    "span_overlap_semi": f"WITH {SPANS} SELECT source, COUNT(*) AS n FROM spans s WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_discount >= 0.09 AND l_orderkey = s.source AND s.lo <= l_linenumber + 1 AND s.hi >= l_linenumber) GROUP BY source",
    "window_merge": f"WITH {P}, w AS (SELECT DISTINCT source_name, GREATEST(line_no - 1, 1) AS lo, line_no + 1 AS hi FROM probe WHERE {MISSED}), b AS (SELECT *, CASE WHEN lo > MAX(hi) OVER (PARTITION BY source_name ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM w), g AS (SELECT *, SUM(new) OVER (PARTITION BY source_name ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS grp FROM b) SELECT source_name, MIN(lo) AS lo, MAX(hi) AS hi, COUNT(*) AS anchors FROM g GROUP BY source_name, grp",
    "file_sort_nulls": "SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS pct, c_mktsegment FROM customer ORDER BY COALESCE(pct, -1), c_mktsegment, c_name, c_custkey",
    "top1_by_struct": "SELECT o_custkey, o_orderkey AS newest FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
}

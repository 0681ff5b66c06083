"""Queries of the project report, and the SQL that gives the same rows.

The stand-in: a module is a customer's nation, a file an order; its lines are the order's line items (returned
or accepted ones are covered), branches are their tax steps; a run is an order of a finished status.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.numbers import compact_ranges
from marlstone.operators import report as R
from marlstone.plans.surrogate import ranges_sql, table

SUMS = ["line_covered", "line_missed", "branch_covered", "branch_missed"]


def _files(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), _name("c_nationkey").alias("module")), "o_custkey")
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") != "N").alias("line_covered"), F.count_if(F.col("l_returnflag") == "N").alias("line_missed"),
        F.count_if(F.col("l_tax") > 0.04).alias("branch_covered"), F.count_if(F.col("l_tax") <= 0.04).alias("branch_missed"),
    )
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    status = F.when(F.col("line_missed") == 0, "covered").when(F.col("o_orderpriority") < "3", "actionable").otherwise("deferred_only")
    return j.select("module", _name("o_orderkey").alias("source_name"), *SUMS, status.alias("status"), (F.col("o_orderpriority") != "5-LOW").alias("resolvable"), "o_orderkey")


def _name(c):
    return F.col(c).cast("string")


def _runs(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus <> 'O'")
    return o.select(_name("o_orderkey").alias("source_name"), (F.col("o_orderstatus") == "F").alias("accepted"), (F.col("o_totalprice") > 100000).alias("improved"))


def _entries(spark, d):
    li = table(spark, d, "lineitem").filter("l_discount >= 0.05 AND l_returnflag = 'N'")
    files = _files(spark, d).select("module", "source_name", "o_orderkey")
    return li.join(files, F.col("l_orderkey") == F.col("o_orderkey")).select("module", "source_name", F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("category"))


def project_report(spark, d):
    return R.project_report(_files(spark, d).drop("o_orderkey"), _runs(spark, d), _entries(spark, d))


def run_snapshots(spark, d):
    s = lambda status: table(spark, d, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("name"), "o_orderkey", F.col("o_totalprice").alias("price"))
    out = R.runs_with_snapshots(table(spark, d, "customer").select(F.col("c_custkey").alias("name"), "c_name"), {"unit": s("F"), "device": s("O"), "merged": s("P")}, "name", "o_orderkey")
    return out.select("name", "c_name", *[F.col(f"{c}.price").alias(c) for c in ("unit", "device", "merged")])


def run_ranking(spark, d):
    from pyspark.sql import Window

    runs = _runs(spark, d)
    return runs.withColumn("place", F.row_number().over(Window.partitionBy("improved").orderBy(*R.run_order()))).select("source_name", "accepted", "improved", "place")


def module_sums(spark, d):
    out = R.module_sums(_files(spark, d).withColumn("generated", F.col("line_covered") == 0), SUMS, {"line_pct": ("line_covered", "line_missed"), "branch_pct": ("branch_covered", "branch_missed")}, "generated")
    return out


def deferred_tree(spark, d):
    e = _entries(spark, d).groupBy("module", "source_name", "category").agg(F.collect_list("line").alias("lines"))
    t = R.deferred_tree(e)
    return t.select("module", "source_name", "entries", F.coalesce(F.try_element_at("categories", F.lit("O")), F.lit(0)).alias("open_entries"), compact_ranges(F.col("lines")).alias("lines"))


def outcome_buckets(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "N").alias("missed_after"), (F.col("l_discount") >= 0.05).alias("deferred"))
    b = R.outcome_buckets(li, ["l_orderkey"])
    return b.select("l_orderkey", *[compact_ranges(F.col(c)).alias(c) for c in ("attempted", "covered", "deferred")])


def untouched_files(spark, d):
    runs = _runs(spark, d).select("source_name", F.when(F.col("accepted"), "completed").otherwise("rejected").alias("status"))
    return R.with_untouched(runs, _files(spark, d).select("source_name", "line_missed", "branch_missed"), "source_name").groupBy("status").agg(F.count("*").alias("n"))


def deferred_probe_sets(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"), F.array_sort(F.collect_set(F.when(F.col("l_tax") > 0.06, F.col("l_linenumber")))).alias("branches"))
    e = li.withColumn("category", F.when(F.col("l_returnflag") == "R", R.BRANCH_CATEGORY).otherwise("plan"))
    out = R.deferred_probes(e, ["l_orderkey"])
    return out.select("l_orderkey", compact_ranges(F.col("deferred_lines")).alias("deferred_lines"), compact_ranges(F.col("deferred_branches")).alias("deferred_branches"))


def restricted_probes(spark, d):
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_linenumber"))))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(some(F.col("l_returnflag") == "N").alias("missed"), some(F.col("l_discount") > 0.07).alias("only"))
    return li.select("l_orderkey", compact_ranges(R.restricted(F.col("missed"), F.col("only"))).alias("missed"))


def status_notes(spark, d):
    o = table(spark, d, "orders")
    n = F.pmod("o_orderkey", F.lit(5)).cast("int")
    open_ = F.when(n > 2, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    status = R.file_status(F.col("o_orderstatus") != "P", F.when(F.col("o_orderpriority") == "5-LOW", " Untouched "), open_, F.array().cast("array<int>"))
    note = R.status_note(status, n, F.size(open_), F.when(F.col("o_orderpriority") < "3", 1).otherwise(0), F.when(F.col("o_totalprice") > 100000, " seen "))
    return o.select("o_orderkey", status.alias("status"), note.alias("note"), R.run_note(F.when(F.col("o_totalprice") > 100000, "e"), F.when(F.col("o_orderstatus") == "F", "ok")).alias("run"))


def searched_files(spark, d):
    p = table(spark, d, "part")
    return R.searched(p, " WIDGET ", ["p_brand", "p_name"], p_type=["ECONOMY", "STANDARD"]).select("p_partkey")


def user_sorted(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))
    w = lambda desc: Window.partitionBy("o_custkey").orderBy(R.user_order("v", desc), "o_orderkey")
    return o.select("o_orderkey", F.row_number().over(w(True)).alias("down"), F.row_number().over(w(False)).alias("up"))


def gap_lines(spark, d):
    some = lambda c: F.collect_set(F.when(c, F.col("l_linenumber")))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(some(F.col("l_returnflag") == "N").alias("a"), some(F.col("l_returnflag") == "R").alias("b"), F.array_sort(F.collect_set(F.when(F.col("l_tax") > 0.06, F.col("l_linestatus")))).alias("m"))
    return li.select("l_orderkey", R.gap_text(compact_ranges(F.col("a")), compact_ranges(F.col("b")), F.col("m")).alias("gap"))


QUERIES = {f.__name__: f for f in (
    project_report, run_snapshots, run_ranking, module_sums, deferred_tree, outcome_buckets, untouched_files, deferred_probe_sets, restricted_probes, status_notes, searched_files, user_sorted, gap_lines,
)}

_LI = "li AS (SELECT l_orderkey, COUNT(*) FILTER (l_returnflag <> 'N') AS line_covered, COUNT(*) FILTER (l_returnflag = 'N') AS line_missed, COUNT(*) FILTER (l_tax > 0.04) AS branch_covered, COUNT(*) FILTER (l_tax <= 0.04) AS branch_missed FROM lineitem GROUP BY 1)"
_FILES = f"{_LI}, files AS (SELECT CAST(c_nationkey AS VARCHAR) AS module, CAST(o_orderkey AS VARCHAR) AS source_name, o_orderkey, line_covered, line_missed, branch_covered, branch_missed, CASE WHEN line_missed = 0 THEN 'covered' WHEN o_orderpriority < '3' THEN 'actionable' ELSE 'deferred_only' END AS status, o_orderpriority <> '5-LOW' AS resolvable FROM orders JOIN customer ON c_custkey = o_custkey JOIN li ON l_orderkey = o_orderkey)"
_RUNS = "runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS source_name, o_orderstatus = 'F' AS accepted, o_totalprice > 100000 AS improved FROM orders WHERE o_orderstatus <> 'O')"
_ENTRIES = "entries AS (SELECT module, source_name, l_linenumber AS line_no, l_linestatus AS category FROM lineitem JOIN files ON o_orderkey = l_orderkey WHERE l_discount >= 0.05 AND l_returnflag = 'N')"
_pct = lambda a, b: f"CASE WHEN {a} + {b} > 0 THEN round_even(100.0 * {a} / ({a} + {b}), 1) END"
_set = lambda where, name: f"LEFT JOIN ({ranges_sql('SELECT DISTINCT l_orderkey, l_linenumber AS line_no FROM lineitem WHERE ' + where, 'l_orderkey')}) {name} USING (l_orderkey)"
_ORDERS = "(SELECT DISTINCT l_orderkey FROM lineitem)"
_last = lambda status, name: f"LEFT JOIN (SELECT o_custkey AS name, ARG_MAX(o_totalprice, o_orderkey) AS {name} FROM orders WHERE o_orderstatus = '{status}' GROUP BY 1) USING (name)"

SQL = {
    "project_report": f"WITH {_FILES}, {_RUNS}, {_ENTRIES}, here AS (SELECT * FROM files WHERE resolvable), m AS (SELECT module, COUNT(*) AS files, SUM(line_covered) AS lc, SUM(line_missed) AS lm, SUM(branch_covered) AS bc, SUM(branch_missed) AS bm FROM here GROUP BY 1), e AS (SELECT module, COUNT(DISTINCT (source_name, line_no)) AS deferred FROM entries GROUP BY 1), t AS (SELECT COUNT(*) AS modules, CAST(SUM(files) AS BIGINT) AS files, CAST(SUM(lc) AS BIGINT) AS line_covered, CAST(SUM(lm) AS BIGINT) AS line_missed, CAST(SUM(bc) AS BIGINT) AS branch_covered, CAST(SUM(bm) AS BIGINT) AS branch_missed, CAST(SUM(LEAST(COALESCE(deferred, 0), lm)) AS BIGINT) AS credited FROM m LEFT JOIN e USING (module)), s AS (SELECT COUNT(*) FILTER (status = 'covered') AS covered, COUNT(*) FILTER (status = 'actionable') AS actionable, COUNT(*) FILTER (status = 'deferred_only') AS deferred_only, CAST(0 AS BIGINT) AS no_exec, COUNT(*) FILTER ((line_missed > 0 OR branch_missed > 0) AND source_name NOT IN (SELECT source_name FROM runs)) AS untouched FROM here), r AS (SELECT COUNT(*) AS processed, COUNT(*) FILTER (accepted) AS accepted, COUNT(*) FILTER (improved) AS improved FROM runs) SELECT *, {_pct('accepted', '(processed - accepted)')} AS acceptance_pct, {_pct('line_covered', 'line_missed')} AS line_pct, {_pct('branch_covered', 'branch_missed')} AS branch_pct, {_pct('(line_covered + credited)', '(line_missed - credited)')} AS effective_pct, line_missed - credited AS open_lines FROM t, s, r",
    "run_snapshots": f"SELECT name, c_name, unit, device, merged FROM (SELECT c_custkey AS name, c_name FROM customer) {_last('F', 'unit')} {_last('O', 'device')} {_last('P', 'merged')}",
    "run_ranking": f"WITH {_RUNS} SELECT source_name, accepted, improved, CAST(ROW_NUMBER() OVER (PARTITION BY improved ORDER BY accepted DESC, source_name) AS INT) AS place FROM runs",
    "module_sums": f"WITH {_FILES}, m AS (SELECT module, COUNT(*) AS files, CAST(SUM(line_covered) AS BIGINT) AS line_covered, CAST(SUM(line_missed) AS BIGINT) AS line_missed, CAST(SUM(branch_covered) AS BIGINT) AS branch_covered, CAST(SUM(branch_missed) AS BIGINT) AS branch_missed FROM files WHERE line_covered > 0 GROUP BY 1) SELECT *, {_pct('line_covered', 'line_missed')} AS line_pct, {_pct('branch_covered', 'branch_missed')} AS branch_pct FROM m",
    "deferred_tree": f"WITH {_FILES}, {_ENTRIES}, c AS (SELECT module, source_name, COUNT(DISTINCT category) AS entries, COUNT(DISTINCT category) FILTER (category = 'O') AS open_entries FROM entries GROUP BY ALL), r AS ({ranges_sql('SELECT DISTINCT module, source_name, line_no FROM entries', 'module, source_name')}) SELECT module, source_name, entries, open_entries, ranges AS lines FROM c JOIN r USING (module, source_name)",
    "outcome_buckets": f"SELECT l_orderkey, a.ranges AS attempted, COALESCE(b.ranges, 'none') AS covered, COALESCE(c.ranges, 'none') AS deferred FROM {_ORDERS} {_set('true', 'a')} {_set('l_returnflag <> ' + chr(39) + 'N' + chr(39), 'b')} {_set('l_returnflag = ' + chr(39) + 'N' + chr(39) + ' AND l_discount >= 0.05', 'c')}",
    "untouched_files": f"WITH {_FILES}, {_RUNS}, a AS (SELECT CASE WHEN accepted THEN 'completed' ELSE 'rejected' END AS status FROM runs UNION ALL SELECT 'untouched' FROM files WHERE (line_missed > 0 OR branch_missed > 0) AND source_name NOT IN (SELECT source_name FROM runs)) SELECT status, COUNT(*) AS n FROM a GROUP BY 1",
    "deferred_probe_sets": "WITH b AS (SELECT l_orderkey, l_returnflag, BOOL_OR(l_tax > 0.06) AS has FROM lineitem GROUP BY ALL), p AS (SELECT DISTINCT l_orderkey, l_linenumber AS line_no, l_returnflag = 'R' AND NOT has AS branch FROM lineitem JOIN b USING (l_orderkey, l_returnflag) UNION SELECT l_orderkey, l_linenumber, true FROM lineitem WHERE l_tax > 0.06) "
    f"SELECT l_orderkey, COALESCE(x.ranges, 'none') AS deferred_lines, COALESCE(y.ranges, 'none') AS deferred_branches FROM {_ORDERS} LEFT JOIN ({ranges_sql('SELECT l_orderkey, line_no FROM p WHERE NOT branch', 'l_orderkey')}) x USING (l_orderkey) LEFT JOIN ({ranges_sql('SELECT l_orderkey, line_no FROM p WHERE branch', 'l_orderkey')}) y USING (l_orderkey)",
    "restricted_probes": f"WITH o AS (SELECT l_orderkey, BOOL_OR(l_discount > 0.07) AS has FROM lineitem GROUP BY 1), p AS (SELECT DISTINCT l_orderkey, l_linenumber AS line_no FROM lineitem l JOIN o USING (l_orderkey) WHERE l_returnflag = 'N' AND (NOT has OR EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = l.l_orderkey AND k.l_linenumber = l.l_linenumber AND k.l_discount > 0.07))) SELECT l_orderkey, COALESCE(ranges, 'none') AS missed FROM {_ORDERS} LEFT JOIN ({ranges_sql('SELECT * FROM p', 'l_orderkey')}) USING (l_orderkey)",
    "status_notes": "WITH o AS (SELECT *, o_orderkey % 5 AS n, CASE WHEN o_orderpriority = '5-LOW' THEN 'untouched' WHEN o_orderstatus = 'P' THEN 'rejected' WHEN o_orderkey % 5 > 2 THEN 'inprogress' ELSE 'completed' END AS status FROM orders) SELECT o_orderkey, status, CASE status WHEN 'completed' THEN CASE WHEN n = 0 THEN 'fully covered' WHEN o_orderpriority < '3' THEN 'what is left is deferred' ELSE 'nothing actionable is left' END WHEN 'inprogress' THEN 'lines or branches are still open' WHEN 'rejected' THEN CASE WHEN o_totalprice > 100000 THEN 'seen' ELSE 'last run was not accepted' END ELSE CASE WHEN o_totalprice > 100000 THEN 'seen' ELSE '' END END AS note, concat_ws(': ', CASE WHEN o_orderstatus = 'F' THEN 'ok' END, CASE WHEN o_totalprice > 100000 THEN 'e' END) AS run FROM o",
    "searched_files": "SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND contains(lower(p_brand || ' ' || p_name), 'widget')",
    "user_sorted": "WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS v FROM orders) SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY v DESC NULLS LAST, o_orderkey) AS INT) AS down, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY v ASC NULLS LAST, o_orderkey) AS INT) AS up FROM o",
    "gap_lines": f"WITH m AS (SELECT l_orderkey, string_agg(DISTINCT l_linestatus, ', ' ORDER BY l_linestatus) AS m FROM lineitem WHERE l_tax > 0.06 GROUP BY 1) SELECT l_orderkey, concat_ws('; ', 'lines ' || COALESCE(a.ranges, 'none'), 'branches ' || COALESCE(b.ranges, 'none'), 'methods ' || m) AS gap FROM {_ORDERS} {_set('l_returnflag = ' + chr(39) + 'N' + chr(39), 'a')} {_set('l_returnflag = ' + chr(39) + 'R' + chr(39), 'b')} LEFT JOIN m USING (l_orderkey)",
}

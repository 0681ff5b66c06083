"""Queries of the lookup operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import lookups as K
from marlstone.plans.surrogate import table

NEEDS = {"STEEL": ["rust", "weight"], "BRASS": ["polish", "weight"], "TIN": ["rust"]}
ALIASES, ALLOWED = {"tin": "soft", "copper": "soft"}, ["soft", "steel", "brand"]
TABLES = [{"title": "T1", "columns": ["a", "b"], "rows": [{"a": 1, "b": 2}], "when_any_tags": ["STEEL"]}, {"title": "T2", "columns": ["c"], "rows": [{"c": "x"}]}]


def _tags(spark, d):
    return table(spark, d, "part").withColumn("tags", F.split(F.concat_ws(" ", "p_type", "p_brand"), "[ #]"))


def lookup_cascade(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders")
    best = lambda status: o.filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("price"))
    return K.cascade(c, [best("P"), best("F"), best("O")], "c_custkey", "price")


def fifo_pairs(spark, d):
    e = table(spark, d, "events")
    side = lambda kind, name: e.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name))
    return K.fifo_pairs(side("click", "call"), side("purchase", "response"), ["user_id"], "call", "response")


def ranked_pick(spark, d):
    return K.best_ranked(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ["3-MEDIUM", "1-URGENT"])


def budgeted_rows(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("size"))
    return K.within_budget(li, ["l_orderkey"], F.col("size"), 60, F.desc("size"), F.asc("l_linenumber"))


def majority_vote(spark, d):
    return K.majority(table(spark, d, "lineitem"), ["l_orderkey"], "l_linestatus", "O")


def nearest_ancestor(spark, d):
    p = table(spark, d, "part").select(F.translate(F.concat_ws("/", "p_type", "p_brand", "p_partkey"), " #", "//").alias("path")).distinct()
    folders = table(spark, d, "part").filter("p_size < 10").select(F.translate(F.concat_ws("/", "p_type", "p_brand"), " #", "//").alias("folder"))
    return K.nearest_ancestor(p, "path", folders, "folder")


def suffix_members(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.concat_ws(".", F.lit("x"), F.substring_index("p_brand", "#", 1), F.col("p_size").cast("string")).alias("name"))
    files = table(spark, d, "part").select(F.concat(F.lit("root/"), F.substring_index("p_brand", "#", 1), F.lit("/"), (F.col("p_size") * 2).cast("string"), F.lit(".kt")).alias("path"))
    return K.by_suffix(names, "name", files, "path").select("p_partkey")


def slice_callees(spark, d):
    li = table(spark, d, "lineitem")
    functions = li.groupBy(F.col("l_orderkey").alias("source"), F.col("l_suppkey").cast("string").alias("name")).agg(F.min("l_linenumber").alias("lo"))
    calls = li.select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").cast("string").alias("caller"), (F.col("l_suppkey") % 7 + 1).cast("string").alias("callee")).distinct()
    seeds = li.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").cast("string").alias("name")).distinct()
    return K.callees(calls, functions, seeds, 2)


def tag_needs(spark, d):
    return K.tag_union(_tags(spark, d), "tags", NEEDS).select("p_partkey", F.array_join("needed", ",").alias("needed"))


def tag_clamp(spark, d):
    return _tags(spark, d).select("p_partkey", F.array_join(K.normal_tags(F.col("tags"), ALIASES, ALLOWED), ",").alias("tags"))


def table_text(spark, d):
    return K.render_tables(_tags(spark, d), TABLES, "tags", "p_partkey")


def repair_tickets(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("code"), F.col("l_linenumber").cast("string").alias("detail"), (F.col("l_discount") >= 0.08).alias("specific"))
    return K.tickets(li, "l_orderkey")


def open_ledger_rows(spark, d):
    li = table(spark, d, "lineitem")
    items = li.filter("l_returnflag <> 'A'").groupBy("l_orderkey", F.col("l_returnflag").alias("item")).agg(F.collect_set("l_linenumber").alias("lines"))
    still = li.filter("l_tax >= 0.04").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("lines"))
    out = K.ledger_rows(items, still, "l_orderkey", "no_delta")
    return out.select("l_orderkey", "item", "category", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


QUERIES = {
    "lookup_cascade": lookup_cascade, "fifo_pairs": fifo_pairs, "ranked_pick": ranked_pick, "budgeted_rows": budgeted_rows, "majority_vote": majority_vote, "nearest_ancestor": nearest_ancestor,
    "suffix_members": suffix_members, "slice_callees": slice_callees, "tag_needs": tag_needs, "tag_clamp": tag_clamp, "table_text": table_text, "repair_tickets": repair_tickets, "open_ledger_rows": open_ledger_rows,
}

_TAGS = "tags AS (SELECT p_partkey, regexp_split_to_array(p_type || ' ' || p_brand, '[ #]') AS t FROM part)"
_best = lambda s: f"(SELECT o_custkey AS c_custkey, MAX(o_totalprice) AS p FROM orders WHERE o_orderstatus = '{s}' GROUP BY 1)"
_side = lambda kind, name: f"(SELECT user_id, event_id AS {name}, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = '{kind}')"

SQL = {
    "lookup_cascade": f"SELECT c_custkey, COALESCE(a.p, b.p, c.p) AS price, CASE WHEN a.p IS NOT NULL THEN 1 WHEN b.p IS NOT NULL THEN 2 WHEN c.p IS NOT NULL THEN 3 ELSE 0 END AS found_in FROM customer LEFT JOIN {_best('P')} a USING (c_custkey) LEFT JOIN {_best('F')} b USING (c_custkey) LEFT JOIN {_best('O')} c USING (c_custkey)",
    "fifo_pairs": f'SELECT user_id, "call", response FROM {_side("click", chr(34) + "call" + chr(34))} FULL JOIN {_side("purchase", "response")} USING (user_id, n)',
    "ranked_pick": "SELECT o_custkey, o_orderpriority FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderpriority) = 1",
    "budgeted_rows": "WITH l AS (SELECT l_orderkey, l_linenumber, CAST(MAX(l_quantity) AS INT) AS size FROM lineitem GROUP BY ALL), u AS (SELECT *, CAST(SUM(size) OVER (PARTITION BY l_orderkey ORDER BY size DESC, l_linenumber ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM l) SELECT * FROM u WHERE used <= 60",
    "majority_vote": "SELECT * FROM (SELECT l_orderkey, l_linestatus, COUNT(*) AS votes FROM lineitem GROUP BY ALL) QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, (l_linestatus = 'O') DESC, l_linestatus) = 1",
    "nearest_ancestor": "WITH p AS (SELECT DISTINCT replace(replace(p_type || '/' || p_brand || '/' || p_partkey, ' ', '/'), '#', '/') AS path FROM part), f AS (SELECT DISTINCT replace(replace(p_type || '/' || p_brand, ' ', '/'), '#', '/') AS folder FROM part WHERE p_size < 10), b AS (SELECT path, ARG_MAX(folder, LENGTH(folder)) AS ancestor FROM p JOIN f ON starts_with(path, folder || '/') GROUP BY path) SELECT path, ancestor FROM p LEFT JOIN b USING (path)",
    "suffix_members": "SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM part f WHERE split_part(f.p_brand, '#', 1) = split_part(p.p_brand, '#', 1) AND f.p_size * 2 = p.p_size)",
    "slice_callees": "WITH f AS (SELECT l_orderkey AS source, l_suppkey AS k, MIN(l_linenumber) AS lo FROM lineitem GROUP BY ALL), s AS (SELECT DISTINCT l_orderkey AS source, l_suppkey AS k FROM lineitem WHERE l_linenumber = 1), c AS (SELECT DISTINCT source, k % 7 + 1 AS k FROM s) SELECT source, CAST(k AS VARCHAR) AS name, lo FROM f SEMI JOIN c USING (source, k) ANTI JOIN s USING (source, k) QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY lo, CAST(k AS VARCHAR)) <= 2",
    "tag_needs": f"WITH {_TAGS} SELECT p_partkey, concat_ws(',', CASE WHEN list_contains(t, 'STEEL') OR list_contains(t, 'BRASS') AND false THEN 'rust' END, CASE WHEN list_contains(t, 'STEEL') THEN 'weight' END, CASE WHEN list_contains(t, 'BRASS') THEN 'polish' END, CASE WHEN list_contains(t, 'BRASS') AND NOT list_contains(t, 'STEEL') THEN 'weight' END, CASE WHEN list_contains(t, 'TIN') AND NOT list_contains(t, 'STEEL') THEN 'rust' END) AS needed FROM tags",
    "tag_clamp": f"WITH {_TAGS}, e AS (SELECT p_partkey, UNNEST(t) AS x, generate_subscripts(t, 1) AS n FROM tags), m AS (SELECT p_partkey, CASE lower(x) WHEN 'tin' THEN 'soft' WHEN 'copper' THEN 'soft' ELSE lower(x) END AS x, n FROM e), k AS (SELECT p_partkey, x, MIN(n) AS n FROM m WHERE x IN ('soft', 'steel', 'brand') GROUP BY ALL), j AS (SELECT p_partkey, string_agg(x, ',' ORDER BY n) AS tags FROM k GROUP BY p_partkey) SELECT p_partkey, COALESCE(tags, '') AS tags FROM part LEFT JOIN j USING (p_partkey)",
    "table_text": f"WITH {_TAGS} SELECT p_partkey, CASE WHEN list_contains(t, 'STEEL') THEN 'T1' || chr(10) || 'a | b' || chr(10) || '1 | 2' || chr(10) || chr(10) ELSE '' END || 'T2' || chr(10) || 'c' || chr(10) || 'x' AS text FROM tags",
    "repair_tickets": "WITH i AS (SELECT l_orderkey, l_returnflag AS code, CAST(l_linenumber AS VARCHAR) AS detail, l_discount >= 0.08 AS specific FROM lineitem), s AS (SELECT *, BOOL_OR(specific) OVER (PARTITION BY l_orderkey, code) AS any_specific FROM i) SELECT l_orderkey, code, detail, COUNT(*) AS n FROM s WHERE specific OR NOT any_specific GROUP BY ALL",
    "open_ledger_rows": "WITH i AS (SELECT DISTINCT l_orderkey, l_returnflag AS item, l_linenumber FROM lineitem WHERE l_returnflag <> 'A'), s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_tax >= 0.04) SELECT l_orderkey, item, 'no_delta' AS category, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS lines FROM i JOIN s USING (l_orderkey, l_linenumber) GROUP BY ALL",
}

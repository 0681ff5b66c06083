"""Queries of the text, rule, log and state operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import texts as T
from marlstone.functions.labels import exclusive_layer, first_match, tag_score
from marlstone.functions.scans import brace_spans, matching_ratio
from marlstone.operators import ledger as L
from marlstone.operators import logs, plans, rules, spans, state
from marlstone.plans.surrogate import table

# Sample rules over the documents; no look-around, so that SQL can say them too.
RULES = [
    {"id": "license", "message": "names a license", "when": {"test_any": ["(?i)licensed under", "(?i)public license"]}},
    {"id": "shouting", "message": "has shouted words", "when": {"test": ["[A-Z]{4,}!!"], "test_not": ["\\|"]}},
    {"id": "table", "message": "is a table", "when": {"test_contains": [" | "], "source_any": ["src0", "src1"]}},
    {"id": "mail", "message": "has an address", "when": {"test": ["[a-z]+@[a-z]+\\.[a-z]+"]}},
    {"id": "plain", "message": "has none of these", "when": {"test_not_contains_any": ["|", "!!", "***", "@"]}},
]
CLASSES = [("compile", "(?i)\\bcompil|licensed"), ("env", "(?i)token|key|password"), ("contract", "(?i)@|\\+1")]
TRIGGERS = [("license", "legal"), ("token", "secrets"), ("@", "contact"), (" | ", "tables"), ("!!", "noise")]
UNIT, DEVICE = {"STEEL": 3, "BRASS": 1, "TIN": 2}, {"COPPER": 3, "NICKEL": 1, "TIN": 1}


def context_rows(spark, d):
    e = table(spark, d, "events").withColumn("hit", F.col("event_type") == "error")
    return spans.context_after(e, ["user_id"], "event_id", "hit", 3).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def log_class_first_match(spark, d):
    return table(spark, d, "documents").select("doc_id", first_match(F.coalesce("text", F.lit("")), CLASSES, "unknown").alias("class"))


def log_summary(spark, d):
    return logs.summarize(table(spark, d, "documents"), "doc_id", "text", {"table": "\\|", "shout": "!!"})


def log_error_lines(spark, d):
    """Logs made of each turn: an error line, and on odd turns a wide line with ten lines behind it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role").distinct()
    wide = F.concat(F.lit("what went wrong\n"), F.lit("\n".join(f"l{i}" for i in range(1, 11))))
    text = F.concat_ws("\n", F.lit("start"), F.concat(F.lit("error: "), F.col("turn").cast("string")), F.lit("ok"), F.when(F.col("turn") % 2 == 1, wide), F.lit(" again"), F.concat(F.lit("  error: "), F.col("turn").cast("string")))
    e = c.select(F.concat_ws("-", "conv_id", "turn", "role").alias("id"), text.alias("text"))
    return logs.error_lines(e, "id", "text").groupBy("id").agg(F.count("*").alias("lines"), F.max("n").alias("last"))


def brace_texts(spark, d):
    n = F.col("p_size").cast("string")
    text = F.concat(F.lit("x { "), n, F.lit(' } "{" /* { */ http://a '), F.when(F.col("p_size") > 25, "{ a { b } }").otherwise(""), F.lit(" // {\n { open"))
    p = table(spark, d, "part").select("p_partkey", text.alias("text"))
    return p.select("p_partkey", F.size(brace_spans("text")).alias("n"), F.try_element_at(brace_spans("text"), F.lit(1))["start"].alias("first"), F.try_element_at(brace_spans("text"), F.lit(1))["stop"].alias("stop"))


def rule_matches(spark, d):
    return rules.run_rules(table(spark, d, "documents"), RULES, ["doc_id"], "text", "source")


def first_seen_distinct(spark, d):
    c = table(spark, d, "conversations").withColumn("pos", F.col("conv_id") * 1000 + F.col("turn"))
    return L.first_seen(c.filter("text IS NOT NULL"), "text", "pos").select(F.md5("text").alias("text_md5"), "first_at", "n")


def _tags(spark, d):
    return table(spark, d, "part").withColumn("tags", F.split(F.concat_ws(" ", "p_type", "p_brand"), "[ #]"))


def layer_score(spark, d):
    p = _tags(spark, d)
    return p.select("p_partkey", tag_score(F.col("tags"), UNIT).alias("unit_score"), tag_score(F.col("tags"), DEVICE).alias("device_score"))


def layer_decision(spark, d):
    p = _tags(spark, d)
    return p.select("p_partkey", exclusive_layer(F.col("tags"), UNIT, DEVICE, ["COPPER"], ["STEEL"]).alias("layer"))


def trigger_select(spark, d):
    return rules.select_by_triggers(table(spark, d, "documents"), TRIGGERS, "doc_id", "text", "general", 2)


def longest_prefix(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    heads = table(spark, d, "supplier").join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.substring("p_name", F.lit(1), (F.col("s_nationkey") % 7 + 3).cast("int")).alias("head")).distinct()
    return spans.longest_prefix(p, "p_name", heads, "head", 9)


def keep_last_n(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role").distinct()
    return L.keep_last(c.withColumn("o", F.col("conv_id") * 1000 + F.col("turn")), ["role"], "o", 200).select("conv_id", "turn", "role")


def session_lock_state(spark, d):
    e = state.failure_lock(table(spark, d, "events"), "user_id", ["event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")
    return e.select("event_id", "user_id", "failures", "locked")


def last_good_fold(spark, d):
    e = state.last_good(table(spark, d, "events"), "user_id", ["event_id"], F.col("event_type") == "purchase", "value")
    return e.select("event_id", "user_id", "last_good")


def turn_fold(spark, d):
    f = state.fold_turns(table(spark, d, "conversations"), "conv_id", "turn", "text", "role")
    return f.select("conv_id", "role", "pieces", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5"))


def fence_json_extract(spark, d):
    wrapped = F.concat(F.lit("reply:\n```json\n"), "props", F.lit("\n```\nend {x}"))
    return table(spark, d, "events").select("event_id", T.first_json(wrapped, "k int")["k"].alias("k"))


def html_sections(spark, d):
    h = table(spark, d, "pages")
    heads = F.regexp_extract_all(F.col("html"), F.lit("<h[1-6]>([^<]*)</h[1-6]>"), F.lit(1))
    return h.select("page_id", F.size(heads).cast("long").alias("headings"), F.coalesce(F.try_element_at(heads, F.lit(1)), F.lit("")).alias("first"))


def name_functions(spark, d):
    c = table(spark, d, "customer")
    name = F.lower(F.translate("c_name", "#", "_"))
    dotted = F.concat_ws(".", F.lower("c_mktsegment"), F.lit("x"), name)
    return c.select(
        "c_custkey", T.camel_case(F.concat_ws("_", F.lower("c_mktsegment"), name)).alias("camel"), T.package_of(dotted).alias("package"), T.simple_name(dotted).alias("simple"),
        T.module_name(F.concat(F.lit(":"), F.lower("c_mktsegment"), F.lit(":x"))).alias("module"), T.source_key(F.lit("a.b"), F.col("c_name")).alias("key"), T.short_text(F.concat_ws("  \n ", "c_name", "c_mktsegment"), 20).alias("short"),
    )


def greedy_chunks(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("size"))
    return plans.greedy_chunks(li, "l_orderkey", "l_linenumber", "size", 3, 60)


def clamp_items(spark, d):
    li = table(spark, d, "lineitem")
    lines = lambda c: F.array_sort(F.collect_set(c))
    items = li.groupBy("l_orderkey", F.col("l_returnflag").alias("item")).agg(lines("l_linenumber").alias("lines"))
    allowed = li.filter("l_discount < 0.05 OR l_tax > 0.04").groupBy("l_orderkey").agg(lines("l_linenumber").alias("lines"))
    out = plans.clamp_items(items.filter("item <> 'N'"), allowed, "l_orderkey")
    return out.select("l_orderkey", "item", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def brace_spans_query(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(brace_spans("html")).alias("n"), F.try_element_at(brace_spans("html"), F.lit(1))["start"].alias("first"))


def fuzzy_match(spark, d):
    """Parts and the parts of their brand and size: the share of names that match well."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    first = p.groupBy("p_brand", "p_size").agg(F.min_by("p_name", "p_partkey").alias("other"))
    j = p.join(first, ["p_brand", "p_size"])
    return j.select("p_partkey", "other", matching_ratio("p_name", "other").alias("ratio"))


QUERIES = {
    "context_rows": context_rows, "log_class_first_match": log_class_first_match, "log_summary": log_summary, "log_error_lines": log_error_lines, "rule_matches": rule_matches,
    "first_seen_distinct": first_seen_distinct, "layer_score": layer_score, "layer_decision": layer_decision, "trigger_select": trigger_select, "longest_prefix": longest_prefix,
    "keep_last_n": keep_last_n, "session_lock_state": session_lock_state, "last_good_fold": last_good_fold, "turn_fold": turn_fold, "fence_json_extract": fence_json_extract,
    "html_sections": html_sections, "name_functions": name_functions, "greedy_chunks": greedy_chunks, "clamp_items": clamp_items, "brace_spans": brace_spans_query, "brace_texts": brace_texts, "fuzzy_match": fuzzy_match,
}


def _rule_sql() -> str:
    conditions = [
        "regexp_matches(text, '(?i)licensed under') OR regexp_matches(text, '(?i)public license')",
        "regexp_matches(text, '[A-Z]{4,}!!') AND NOT regexp_matches(text, '\\|')",
        "contains(text, ' | ') AND (contains(source, 'src0') OR contains(source, 'src1'))",
        "regexp_matches(text, '[a-z]+@[a-z]+\\.[a-z]+')",
        "NOT (contains(text, '|') OR contains(text, '!!') OR contains(text, '***') OR contains(text, '@'))",
    ]
    docs = "docs AS (SELECT doc_id, COALESCE(text, '') AS text, COALESCE(source, '') AS source FROM documents)"
    return f"WITH {docs} " + " UNION ALL ".join(f"SELECT doc_id, {n} AS rule_ord, '{r['id']}' AS rule, '{r['message']}' AS message FROM docs WHERE {c}" for n, (r, c) in enumerate(zip(RULES, conditions)))


_TAGS = "tags AS (SELECT p_partkey, regexp_split_to_array(p_type || ' ' || p_brand, '[ #]') AS t FROM part)"
_score = lambda w: " + ".join(f"{v} * len(list_filter(t, lambda x: x = '{k}'))" for k, v in w.items())
_RUN = "ROWS UNBOUNDED PRECEDING"

SQL = {
    "log_error_lines": "SELECT DISTINCT conv_id || '-' || turn || '-' || role AS id, CASE WHEN turn % 2 = 1 THEN CAST(10 AS BIGINT) ELSE 1 END AS lines, CASE WHEN turn % 2 = 1 THEN 12 ELSE 2 END AS last FROM conversations",
    "brace_texts": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS n, 2 AS first, 6 + LENGTH(CAST(p_size AS VARCHAR)) AS stop FROM part",
    "greedy_chunks": "WITH RECURSIVE o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM (SELECT l_orderkey, l_linenumber, CAST(MAX(l_quantity) AS INT) AS size FROM lineitem GROUP BY ALL)), g AS (SELECT l_orderkey, l_linenumber, size, rn, 0 AS chunk, 1 AS n, size AS total FROM o WHERE rn = 1 UNION ALL SELECT o.l_orderkey, o.l_linenumber, o.size, o.rn, CASE WHEN n + 1 > 3 OR total + o.size > 60 THEN chunk + 1 ELSE chunk END, CASE WHEN n + 1 > 3 OR total + o.size > 60 THEN 1 ELSE n + 1 END, CASE WHEN n + 1 > 3 OR total + o.size > 60 THEN o.size ELSE total + o.size END FROM g JOIN o ON o.l_orderkey = g.l_orderkey AND o.rn = g.rn + 1) SELECT l_orderkey, l_linenumber, size, chunk FROM g",
    "context_rows": "SELECT user_id, COUNT(*) AS n, MAX(event_id) AS last FROM (SELECT *, MAX((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING) AS near FROM events) WHERE near = 1 GROUP BY user_id",
    "log_class_first_match": "SELECT doc_id, CASE WHEN regexp_matches(COALESCE(text, ''), '(?i)\\bcompil|licensed') THEN 'compile' WHEN regexp_matches(text, '(?i)token|key|password') THEN 'env' WHEN regexp_matches(text, '(?i)@|\\+1') THEN 'contract' ELSE 'unknown' END AS class FROM documents",
    "log_summary": "WITH l AS (SELECT doc_id, UNNEST(regexp_split_to_array(text, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS n FROM documents) SELECT doc_id, COUNT(*) FILTER (contains(line, '|')) AS table_n, ARG_MIN(line, n) FILTER (contains(line, '|')) AS table_first, COUNT(*) FILTER (contains(line, '!!')) AS shout_n, ARG_MIN(line, n) FILTER (contains(line, '!!')) AS shout_first FROM l GROUP BY doc_id",
    "rule_matches": _rule_sql(),
    "first_seen_distinct": "SELECT md5(text) AS text_md5, MIN(conv_id * 1000 + turn) AS first_at, COUNT(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY text",
    "layer_score": f"WITH {_TAGS} SELECT p_partkey, CAST({_score(UNIT)} AS INT) AS unit_score, CAST({_score(DEVICE)} AS INT) AS device_score FROM tags",
    "layer_decision": f"WITH {_TAGS} SELECT p_partkey, CASE WHEN list_contains(t, 'COPPER') THEN 'instrumented' WHEN list_contains(t, 'STEEL') THEN 'unit' WHEN ({_score(DEVICE)}) < ({_score(UNIT)}) THEN 'instrumented' ELSE 'unit' END AS layer FROM tags",
    "trigger_select": "WITH h AS (SELECT doc_id, n, name FROM documents, (VALUES (0, 'license', 'legal'), (1, 'token', 'secrets'), (2, '@', 'contact'), (3, ' | ', 'tables'), (4, '!!', 'noise')) v(n, needle, name) WHERE contains(lower(COALESCE(text, '')), needle)), r AS (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS rank, name FROM h) SELECT doc_id, CAST(rank AS INT) AS rank, name FROM r WHERE rank < 2 UNION ALL SELECT doc_id, 0, 'general' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)",
    "longest_prefix": "WITH heads AS (SELECT DISTINCT left(p_name, CAST(s_nationkey % 7 + 3 AS INT)) AS head FROM part JOIN supplier ON s_suppkey = p_partkey), b AS (SELECT p_partkey, ARG_MAX(head, LENGTH(head)) AS prefix FROM part JOIN heads ON starts_with(p_name, head) GROUP BY p_partkey) SELECT p_partkey, p_name, prefix FROM part LEFT JOIN b USING (p_partkey)",
    "keep_last_n": "SELECT conv_id, turn, role FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) QUALIFY ROW_NUMBER() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn DESC) <= 200",
    "session_lock_state": f"WITH e AS (SELECT *, SUM((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id {_RUN}) AS epoch FROM events), f AS (SELECT event_id, user_id, CAST(SUM((event_type = 'error')::INT) OVER (PARTITION BY user_id, epoch ORDER BY event_id {_RUN}) AS BIGINT) AS failures FROM e) SELECT *, failures >= 2 AS locked FROM f",
    "last_good_fold": f"SELECT event_id, user_id, LAST_VALUE(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id {_RUN}) AS last_good FROM events",
    "turn_fold": "WITH f AS (SELECT conv_id, role, COUNT(*) AS pieces, string_agg(COALESCE(text, ''), '' ORDER BY turn, text) AS content FROM conversations GROUP BY ALL) SELECT conv_id, role, pieces, LENGTH(content) AS n_chars, md5(content) AS content_md5 FROM f",
    "fence_json_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "html_sections": "WITH h AS (SELECT page_id, regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1) AS h FROM pages) SELECT page_id, len(h) AS headings, COALESCE(h[1], '') AS first FROM h",
    "name_functions": "WITH c AS (SELECT *, lower(replace(c_name, '#', '_')) AS name, lower(c_mktsegment) AS seg FROM customer), p AS (SELECT *, string_split(seg || '_' || name, '_') AS parts FROM c) SELECT c_custkey, parts[1] || array_to_string(list_transform(parts[2:], lambda x: upper(left(x, 1)) || substr(x, 2)), '') AS camel, seg || '.x' AS package, name AS simple, seg || '/x' AS module, 'a/b/' || c_name AS key, CASE WHEN LENGTH(c_name || ' ' || c_mktsegment) > 20 THEN rtrim(left(c_name || ' ' || c_mktsegment, 17)) || '...' ELSE c_name || ' ' || c_mktsegment END AS short FROM p",
    "clamp_items": "WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.05 OR l_tax > 0.04), i AS (SELECT DISTINCT l_orderkey, l_returnflag AS item, l_linenumber FROM lineitem JOIN a USING (l_orderkey, l_linenumber) WHERE l_returnflag <> 'N'), r AS (SELECT * FROM i UNION ALL SELECT l_orderkey, 'rest', l_linenumber FROM a WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.l_orderkey = a.l_orderkey AND i.l_linenumber = a.l_linenumber)) SELECT l_orderkey, item, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS lines FROM r GROUP BY ALL",
}

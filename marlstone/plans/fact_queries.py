"""Queries of the lexer, the fuzzy join, the rule network, tickets, tags, versions and renderings, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.lexer import facts, names_of
from marlstone.operators import fuzzy, network, render, tags, versions
from marlstone.plans.surrogate import table
from marlstone.plans.text_queries import RULES

STAGES = [
    network.Stage("legal", RULES[:2], skip=("src1", "src2")),
    network.Stage("form", [{**RULES[2], "stop": True}, RULES[3]], ends=True),
    network.Stage("rest", [RULES[4], RULES[0], {"id": "short", "message": "begins small", "when": {"test": "^[a-z]", "flags": "I"}}]),
]
TAGS = [
    {"tag": "round", "any": [("member", "words", ["ring", "bolt"]), ("prefix", "words", ["gea"])]},
    {"tag": "cheap", "all": [("member", "types", ["ECONOMY"])], "none": [("suffix", "words", ["t"])]},
    {"tag": "red", "all": [("contains", "words", ["red"]), ("prefix", "brands", ["Brand"])]},
    {"tag": "few", "all": [("suffix", "brands", ["1", "2"])], "any": [("member", "types", ["SMALL", "LARGE"])]},
]
BUDGET, RADIUS = 3_000, 1


def fuzzy_join(spark, d):
    """Long names of parts against the short names of their brand."""
    p = table(spark, d, "part")
    names = p.select(F.col("p_brand").alias("kind"), F.concat_ws("_", F.lower("p_type"), "p_name").alias("name"))
    return fuzzy.unique_matches(names, p.select(F.col("p_brand").alias("kind"), F.col("p_name").alias("candidate")))


def plain_matches(spark, d):
    """Names of parts written in capitals against names written without spaces, of brands where these are unique."""
    p = table(spark, d, "part")
    names = p.select(F.col("p_brand").alias("kind"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"))
    index = p.select(F.col("p_brand").alias("kind"), F.when(F.col("p_size") > 25, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("candidate"))
    return fuzzy.unique_matches(names, index).filter("how = 'plain'").select("kind", "name", "candidate")


def stage_issues(spark, d):
    docs = table(spark, d, "documents")
    return network.Network(STAGES).run(docs, ["doc_id"], "text", "source", "source").select("doc_id", "stage_ord", "stage", "rule_ord", "rule")


def source_tickets(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    note = lambda *c: F.concat_ws(" ", *c)
    rules = li.select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("code"), note(F.lit("Line"), F.col("l_linenumber").cast("string"), "l_returnflag").alias("detail"), (F.col("l_discount") > 0.08).alias("specific"))
    logs = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("code"), note(F.lit("line"), F.col("o_custkey").cast("string"), F.lit("  n")).alias("detail"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 2 == 0).alias("specific"))
    return network.merged_tickets([("rules", rules), ("log", logs)], "key")


def tag_bits(spark, d):
    p = table(spark, d, "part")
    mask = tags.tag_mask(TAGS, {"words": F.split("p_name", " "), "types": F.split("p_type", " "), "brands": F.array("p_brand")})
    return p.select("p_partkey", mask.alias("mask")).select("p_partkey", "mask", F.array_join(tags.tags_of(F.col("mask"), TAGS), ",").alias("tags"))


def version_chain(spark, d):
    """Parts that refer to the part of a third of their key, in the scope of their brand; those of size 7 to themselves."""
    p = table(spark, d, "part").filter("p_partkey > 0")
    key = F.col("p_partkey").cast("string")
    to = F.when(F.col("p_size") == 7, key).when(F.col("p_partkey") > 20, F.floor(F.col("p_partkey") / 3).cast("string"))
    scope = F.when(F.col("p_size") < 30, "module").when(F.col("p_size") < 45, "common").otherwise("elsewhere")
    rows = p.select(F.lit("one").alias("project"), scope.alias("scope"), key.alias("key"), F.when(to.isNull(), F.col("p_brand")).alias("value"), to.alias("ref"))
    return versions.resolved_versions(rows, ["module", "common"]).select("key", "scope", "version", "steps")


def rendered_documents(spark, d):
    """The documents of each source and language within a budget; anchors are lines that begin with a capital and hold a comma."""
    lines = F.split("text", "\n")
    hits = F.transform(F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike("^[A-Z][^,]*,")), lambda i: i)
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(F.concat_ws("/", "source", "lang").alias("key"), "doc_id", lines.alias("lines"), hits.alias("anchors"))
    out = render.rendered_blocks(docs, "key", "doc_id", BUDGET, RADIUS)
    return out.select("key", "doc_id", "how", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def property_strings(spark, d):
    """The strings and unclosed ends that the lexer finds in the properties of events."""
    f = table(spark, d, "events").select("event_id", facts(F.col("props")).alias("f"))
    return f.select("event_id", F.array_join(names_of(F.col("f"), "string"), ",").alias("strings"), F.size(names_of(F.col("f"), "error")).alias("errors"))


QUERIES = {
    f.__name__: f for f in (fuzzy_join, plain_matches, stage_issues, source_tickets, tag_bits, version_chain, rendered_documents, property_strings)
}

_print = r"md5(lower(code) || '|' || trim(regexp_replace(regexp_replace(lower(COALESCE(detail, '')), '\d+', '#', 'g'), '\s+', ' ', 'g')))"
SQL = {
    "plain_matches": """
WITH n AS (SELECT DISTINCT p_brand AS kind, upper(replace(p_name, ' ', '_')) AS name FROM part),
c AS (SELECT DISTINCT p_brand AS kind, CASE WHEN p_size > 25 THEN replace(p_name, ' ', '') ELSE replace(p_name, ' ', '_') END AS candidate FROM part),
o AS (SELECT kind, lower(replace(candidate, '_', '')) AS plain, MIN(candidate) AS candidate FROM c GROUP BY ALL HAVING COUNT(*) = 1)
SELECT n.kind, name, candidate FROM n JOIN o ON o.kind = n.kind AND plain = lower(replace(name, '_', ''))""",
    "stage_issues": r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, COALESCE(source, '') AS s FROM documents),
m AS (
  SELECT doc_id, contains(s, 'src1') OR contains(s, 'src2') AS skip,
    regexp_matches(t, '(?i)licensed under') OR regexp_matches(t, '(?i)public license') AS license,
    regexp_matches(t, '[A-Z]{4,}!!') AND NOT regexp_matches(t, '\|') AS shouting,
    contains(t, ' | ') AND (contains(s, 'src0') OR contains(s, 'src1')) AS tab,
    regexp_matches(t, '[a-z]+@[a-z]+\.[a-z]+') AS mail,
    NOT (contains(t, '|') OR contains(t, '!!') OR contains(t, '***') OR contains(t, '@')) AS plain,
    regexp_matches(t, '(?i)^[a-z]') AS short FROM d)
SELECT doc_id, 0 AS stage_ord, 'legal' AS stage, 0 AS rule_ord, 'license' AS rule FROM m WHERE license AND NOT skip
UNION ALL SELECT doc_id, 0, 'legal', 1, 'shouting' FROM m WHERE shouting AND NOT skip
UNION ALL SELECT doc_id, 1, 'form', 0, 'table' FROM m WHERE tab
UNION ALL SELECT doc_id, 1, 'form', 1, 'mail' FROM m WHERE mail AND NOT tab
UNION ALL SELECT doc_id, 2, 'rest', 0, 'plain' FROM m WHERE plain AND NOT (tab OR mail)
UNION ALL SELECT doc_id, 2, 'rest', 1, 'license' FROM m WHERE license AND NOT (tab OR mail)
UNION ALL SELECT doc_id, 2, 'rest', 2, 'short' FROM m WHERE short AND NOT (tab OR mail)""",
    "source_tickets": f"""
WITH e AS (
  SELECT l_orderkey AS key, l_linestatus AS code, 'Line ' || l_linenumber || ' ' || l_returnflag AS detail, COALESCE(l_discount > 0.08, FALSE) AS specific, 0 AS o, 'rules' AS source FROM lineitem
  UNION ALL
  SELECT o_orderkey, o_orderstatus, 'line ' || o_custkey || '   n', COALESCE(CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 2 = 0 END, FALSE), 1, 'log' FROM orders),
h AS (SELECT DISTINCT key, code FROM e WHERE specific),
s AS (SELECT e.*, {_print} AS fingerprint FROM e LEFT JOIN h USING (key, code) WHERE specific OR h.key IS NULL)
SELECT key, code, fingerprint, FIRST(source ORDER BY o, source, detail, specific) AS source, FIRST(detail ORDER BY o, source, detail, specific) AS detail,
  FIRST(specific ORDER BY o, source, detail, specific) AS specific, COUNT(*) AS n FROM s GROUP BY key, code, fingerprint""",
    "tag_bits": """
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, string_split(p_type, ' ') AS t, p_brand AS b FROM part),
m AS (
  SELECT p_partkey,
    list_has_any(w, ['ring', 'bolt']) OR len(list_filter(w, lambda x: starts_with(x, 'gea'))) > 0 AS a,
    list_contains(t, 'ECONOMY') AND len(list_filter(w, lambda x: suffix(x, 't'))) = 0 AS c,
    len(list_filter(w, lambda x: contains(x, 'red'))) > 0 AND starts_with(b, 'Brand') AS r,
    (suffix(b, '1') OR suffix(b, '2')) AND list_has_any(t, ['SMALL', 'LARGE']) AS f FROM p)
SELECT p_partkey, CAST(a::INT + 2 * c::INT + 4 * r::INT + 8 * f::INT AS BIGINT) AS mask,
  concat_ws(',', CASE WHEN a THEN 'round' END, CASE WHEN c THEN 'cheap' END, CASE WHEN r THEN 'red' END, CASE WHEN f THEN 'few' END) AS tags FROM m""",
    "version_chain": """
WITH RECURSIVE e AS (
  SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_size < 30 THEN 'module' ELSE 'common' END AS scope,
    CASE WHEN p_size = 7 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey > 20 THEN CAST(p_partkey // 3 AS VARCHAR) END AS ref, p_brand FROM part WHERE p_partkey > 0 AND p_size < 45),
c AS (
  SELECT key, scope, CASE WHEN ref IS NULL THEN p_brand END AS version, ref, 0 AS steps FROM e
  UNION ALL SELECT c.key, c.scope, CASE WHEN e.ref IS NULL THEN e.p_brand END, e.ref, c.steps + 1 FROM c JOIN e ON e.key = c.ref WHERE c.version IS NULL AND c.steps < 32)
SELECT key, scope, version, steps FROM c WHERE version IS NOT NULL""",
    "rendered_documents": f"""
WITH d AS (SELECT concat_ws('/', source, lang) AS key, doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, SUM(LENGTH(text) + 1) OVER (PARTITION BY key ORDER BY doc_id) AS sofar FROM d),
w AS (SELECT *, {BUDGET} - COALESCE(MAX(CASE WHEN sofar <= {BUDGET} THEN sofar END) OVER (PARTITION BY key), 0) AS rest FROM s),
a AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^[A-Z][^,]*,')) AS hit FROM w WHERE sofar > {BUDGET}),
b AS (SELECT *, CASE WHEN len(hit) > 0 THEN hit ELSE [(len(l) + 1) // 2] END AS spots FROM a),
p AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: len(list_filter(spots, lambda x: abs(x - i) <= {RADIUS})) > 0) AS places FROM b),
t AS (
  SELECT key, doc_id, rest, array_to_string(list_transform(places, lambda i: CASE WHEN i > 1 AND NOT list_contains(places, i - 1) THEN '...' || chr(10) ELSE '' END || l[i]), chr(10))
    || CASE WHEN places[-1] < len(l) THEN chr(10) || '...' ELSE '' END AS short FROM p),
r AS (SELECT *, SUM(LENGTH(short) + 1) OVER (PARTITION BY key ORDER BY doc_id) AS sofar FROM t),
o AS (SELECT key, doc_id, 'whole' AS how, text FROM w WHERE sofar <= {BUDGET} UNION ALL SELECT key, doc_id, 'window', short FROM r WHERE sofar <= rest)
SELECT key, doc_id, how, LENGTH(text) AS chars, md5(text) AS text_md5 FROM o""",
    "property_strings": """
SELECT event_id, COALESCE(array_to_string(list_distinct(regexp_extract_all(props, '"([^"]*)"', 1)), ','), '') AS strings, 0 AS errors FROM events""",
}

"""Queries of sessions: replies from fragments and decisions on tool calls, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from marlstone.functions.fragments import LONG_PIECE, RESTARTS
from marlstone.operators import policy
from marlstone.operators.replies import fold_fragments
from marlstone.plans.surrogate import table

PLACES = policy.Places(project="/work/app", generator="/work/gen", plans="/work/gen/plans", module="/work/app/core")


def reply_fold(spark, d):
    """The events of a user and week as fragments of one reply."""
    e = table(spark, d, "events").select("user_id", F.date_trunc("week", "ts").cast("date").alias("week"), "event_id", F.col("event_type").alias("t"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    place = F.row_number().over(Window.partitionBy("user_id", "week").orderBy("event_id")) - 1
    k = F.col("k").cast("string")
    rows = e.select(
        "user_id", "week", place.cast("long").alias("seq"), (F.col("k") % 3).alias("index"),
        F.when(F.col("t").isin("click", "error"), "content").when(F.col("t") == "view", "reasoning").when((F.col("t") == "signup") & (F.col("k") > 60), "finish").otherwise("call").alias("kind"),
        F.when(F.col("t") == "click", F.repeat(F.lit("x"), F.col("k") % 7)).when(F.col("t") == "error", F.concat(F.lit("Wait "), k)).when(F.col("t") == "view", F.repeat(F.lit("y"), F.col("k"))).when(F.col("k") > 30, k).alias("piece"),
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("id"), k)).alias("call_id"), F.when(F.col("k") % 4 == 0, F.concat(F.lit("n"), k)).alias("name"),
    )
    calls = F.array_join(F.transform("calls", lambda c: F.concat_ws(":", c["index"], F.coalesce(c["id"], F.lit("-")), c["name"], c["arguments"])), ";")
    return fold_fragments(rows, ["user_id", "week"]).select("user_id", "week", F.md5("content").alias("content"), F.md5("reasoning").alias("reasoning"), calls.alias("calls"), "finish", "fragments", "complete")


def tool_decisions(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    user, t = F.col("user_id").cast("string"), F.col("event_type")
    test = F.concat(F.lit("/work/app/src/test/U"), user, F.lit(".kt"))
    path = (
        F.when(t == "click", test).when(t == "view", F.concat(F.lit("/work/app/src/main/../test/./U"), user, F.lit(".kt"))).when(t == "error", F.lit("/etc/x"))
        .when(t == "purchase", F.concat(F.lit("src/main/"), F.col("k"), F.lit(".kt"))).otherwise(F.concat(F.col("k"), F.lit(".plan.md")))
    )
    tool = F.element_at(F.array(*[F.lit(x) for x in ("Read", "Write", "Edit", "Glob", "Bash", "WebFetch", "Other")]), F.col("k") % 7 + 1)
    command = F.concat(F.element_at(F.array(F.lit("find "), F.lit("mkdir "), F.lit("mkdir -p ")), (F.col("user_id") % 3 + 1).cast("int")), path)
    v = policy.tool_decision(
        tool, path, command, PLACES, planning=F.col("user_id") % 2 == 0, exists=F.col("event_id") % 3 != 0, listed=F.when(F.col("event_id") % 5 == 0, test),
        paging=F.col("event_id") % 11 == 0, locked=F.col("event_id") % 13 == 0,
    )
    return e.select("event_id", tool.alias("tool"), v.alias("v")).select("event_id", "tool", "v.*")


QUERIES = {"reply_fold": reply_fold, "tool_decisions": tool_decisions}

_BEGINS = "|".join(r.replace(".", r"\.").replace("'", "''") for r in RESTARTS)
_grown = lambda pieces: f"""list_reduce({pieces}, lambda a, x: CASE WHEN starts_with(a, x) THEN a WHEN starts_with(x, a) THEN x
    ELSE a || CASE WHEN x[1] <> chr(10) AND (LENGTH(x) >= {LONG_PIECE} OR regexp_matches(x, '^\\s*({_BEGINS})')) THEN chr(10) ELSE '' END || x END, '')"""  # noqa: E731

SQL = {
    "reply_fold": f"""WITH e AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, event_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
  n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, week ORDER BY event_id) AS seq, MIN(CASE WHEN t = 'signup' AND k > 60 THEN event_id END) OVER (PARTITION BY user_id, week) AS stop FROM e),
  f AS (SELECT *, CASE WHEN t IN ('click', 'error') THEN 'content' WHEN t = 'view' THEN 'reasoning' WHEN t = 'signup' AND k > 60 THEN 'finish' ELSE 'call' END AS kind,
          CASE t WHEN 'click' THEN repeat('x', k % 7) WHEN 'error' THEN 'Wait ' || k WHEN 'view' THEN repeat('y', k) ELSE CASE WHEN k > 30 THEN CAST(k AS VARCHAR) END END AS piece
        FROM n WHERE stop IS NULL OR event_id <= stop),
  c AS (SELECT user_id, week, k % 3 AS i, ARG_MAX('id' || k, seq) FILTER (k % 5 = 0) AS id, COALESCE(string_agg('n' || k, '' ORDER BY seq) FILTER (k % 4 = 0), '') AS name, COALESCE(string_agg(piece, '' ORDER BY seq), '{{}}') AS args
        FROM f WHERE kind = 'call' GROUP BY ALL),
  j AS (SELECT user_id, week, string_agg(i || ':' || COALESCE(id, '-') || ':' || name || ':' || args, ';' ORDER BY i) AS calls FROM c GROUP BY ALL),
  g AS (SELECT user_id, week, COALESCE(list(piece ORDER BY seq) FILTER (kind = 'content'), []) AS content, COALESCE(list(piece ORDER BY seq) FILTER (kind = 'reasoning'), []) AS reasoning,
          MAX(piece) FILTER (kind = 'finish') AS finish, COUNT(*) AS fragments, BOOL_OR(kind = 'finish') AS complete FROM f GROUP BY ALL)
  SELECT user_id, week, md5({_grown('content')}) AS content, md5(trim({_grown('reasoning')}, ' ' || chr(10))) AS reasoning, COALESCE(calls, '') AS calls, finish, fragments, complete FROM g LEFT JOIN j USING (user_id, week)""",
    "tool_decisions": """WITH a AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, '/work/app/src/test/U' || user_id || '.kt' AS test FROM events),
  b AS (SELECT *, ['Read', 'Write', 'Edit', 'Glob', 'Bash', 'WebFetch', 'Other'][k % 7 + 1] AS tool, user_id % 2 = 0 AS planning, event_id % 3 <> 0 AS there, event_id % 5 = 0 AS listed, event_id % 13 = 0 AS locked,
          CASE event_type WHEN 'click' THEN test WHEN 'view' THEN '/work/app/src/main/../test/./U' || user_id || '.kt' WHEN 'error' THEN '/etc/x' WHEN 'purchase' THEN 'src/main/' || k || '.kt' ELSE k || '.plan.md' END AS asked FROM a),
  c AS (SELECT *, regexp_replace(replace(CASE WHEN starts_with(asked, '/') THEN asked ELSE '/work/app/' || asked END, '/./', '/'), '/[^/]+/\\.\\./', '/') AS spot, ends_with(asked, '.plan.md') AS plan FROM b),
  d AS (SELECT *, starts_with(spot, '/work/app/') AS here, planning AND plan AS planned FROM c),
  r AS (SELECT *, CASE tool WHEN 'WebFetch' THEN 'tool'
      WHEN 'Read' THEN CASE WHEN event_id % 11 = 0 THEN 'paging' WHEN NOT here THEN 'outside' WHEN locked THEN CASE WHEN there THEN '' ELSE 'locked' END WHEN listed OR there THEN '' WHEN plan THEN 'no plan yet' ELSE 'missing' END
      WHEN 'Glob' THEN CASE WHEN here THEN '' ELSE 'outside' END
      WHEN 'Bash' THEN CASE WHEN user_id % 3 = 1 OR (user_id % 3 = 2 AND NOT here) THEN 'folder' WHEN NOT here THEN 'outside' WHEN user_id % 3 = 0 AND locked AND starts_with(asked, '/') THEN 'locked' ELSE '' END
      WHEN 'Other' THEN ''
      ELSE CASE WHEN planned THEN CASE WHEN tool = 'Edit' AND NOT there THEN 'no plan yet' ELSE '' END WHEN contains(spot, '/src/test/') THEN '' ELSE 'not a test' END END AS reason FROM d),
  t AS (SELECT *, CASE WHEN tool IN ('Write', 'Edit') THEN CASE WHEN planned THEN '/work/gen/plans/' || asked ELSE spot END WHEN tool = 'Read' AND listed AND NOT locked THEN test ELSE asked END AS target FROM r)
  SELECT event_id, tool, CASE WHEN reason = '' THEN 'allow' ELSE 'deny' END AS permission, reason, CASE WHEN reason = '' THEN target ELSE asked END AS path, reason = '' AND target <> asked AS updated FROM t""",
}

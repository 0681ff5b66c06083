"""Keyed upserts and upkeep of ledgers; each gives the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlstone.functions.texts import head_and_tail, stripped


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], residual: str = "residual") -> DataFrame:
    """Rows of both by key (``reason``, ``category``). A present reason is replaced by a non-blank one if it
    is blank, if its category is ``residual``, or if the new one is longer."""
    j = old.select(*keys, "reason", "category").join(new.select(*keys, F.col("reason").alias("_r"), F.col("category").alias("_c")), keys, "full_outer")
    fresh = F.trim(F.coalesce("_r", F.lit(""))) != ""
    old_reason = F.coalesce("reason", F.lit(""))
    replace = F.col("category").isNull() & F.col("reason").isNull() | fresh & ((F.trim(old_reason) == "") | (F.col("category") == residual) | (F.length("_r") > F.length(old_reason)))
    replace = F.coalesce(replace, F.lit(False))
    return j.select(*keys, F.when(replace, F.col("_r")).otherwise(F.col("reason")).alias("reason"), F.coalesce("category", "_c").alias("category"))


def reconcile(ledger: DataFrame, evidence: DataFrame, key: str, lines: str = "lines") -> DataFrame:
    """The ledger without rows of which a line was attempted or covered by evidence that counts.

    Evidence (``key``, ``line``, ``accepted``, ``covered``) counts if it was accepted or something was covered.
    """
    fresh = evidence.filter("accepted OR covered").select(key, "line").distinct()
    hit = ledger.select("entry", key, F.explode(lines).alias("line")).join(fresh, [key, "line"], "left_semi").select("entry").distinct()
    return ledger.join(hit, "entry", "left_anti")


def match_either(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], on_any: list[Column], ids: tuple[str, str]) -> DataFrame:
    """Pairs of rows that meet on any of several equalities: one equi join each, united, each pair once."""
    out = None
    for condition in on_any:
        part = left.join(right, condition).select(*ids, *[F.col(a).alias(b) for a, b in pairs])
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(list(ids))


def keep_last(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place where each was first seen."""
    return rows.groupBy(value).agg(F.min(order).alias("first_at"), F.count("*").alias("n"))


def append_lessons(old: DataFrame, new: DataFrame, keys: list[str], order: str, n: int = 200) -> DataFrame:
    """The last ``n`` of old and new rows (a bounded store); a new row that repeats the keys of an older one is not added."""
    every = old.unionByName(new)
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    return first.orderBy(F.desc(order)).limit(n)


def by_id_then_fifo(calls: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses (``session``, ``name``, ``ref``, ``at``) matched to calls (``session``, ``name``, ``id``, ``at``): by id, the rest by name in order."""
    c, r = calls.select("session", "name", "id", F.col("at").alias("called")), responses.select("session", "name", "ref", F.col("at").alias("answered"))
    by_id = c.join(r.select("session", F.col("ref").alias("id"), "answered"), ["session", "id"])
    n = lambda d, o: d.withColumn("_n", F.row_number().over(Window.partitionBy("session", "name").orderBy(o)))
    rest_c = n(c.join(by_id.select("session", "called"), ["session", "called"], "left_anti"), "called")
    rest_r = n(r.join(by_id.select("session", "answered"), ["session", "answered"], "left_anti"), "answered")
    fifo = rest_c.join(rest_r.select("session", "name", "answered", "_n"), ["session", "name", "_n"])
    return by_id.select("session", "name", "called", "answered", F.lit("id").alias("by")).unionByName(fifo.select("session", "name", "called", "answered", F.lit("order").alias("by")))


def failure_snippet(text: Column) -> Column:
    """The head and tail of an output without white space at its ends, whole up to 800 characters."""
    return head_and_tail(stripped(F.coalesce(text, F.lit(""))), 400, 350, 800)


def upsert_reports(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both by key; the last new row of a key in ``order`` replaces the columns it has, the old row keeps its others.

    ``order`` is a column of ``new`` only and does not stay. Columns of either side are kept; those that a row lacks are null. Keys are compared null safe;
    repeated keys of ``old`` are all replaced. Repeats are folded before the shuffle.
    """
    values = [c for c in new.columns if c not in (*keys, order)]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(order, *values)).alias("_new")).select(*[F.col(k).alias("_k" + k) for k in keys], "_new")
    same = [F.col(k).eqNullSafe(F.col("_k" + k)) for k in keys]
    j = old.withColumn("_old", F.lit(True)).join(last.withColumn("_is", F.lit(True)), same, "full_outer")
    out = [F.when(F.col("_old").isNull(), F.col("_k" + k)).otherwise(F.col(k)).alias(k) for k in keys]
    out += [F.when(F.col("_is").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c) if c in old.columns else F.lit(None)).alias(c) for c in values]
    return j.select(*out, *[c for c in old.columns if c not in (*keys, *values)])

"""Spans of lines: owners, overlaps, merged windows and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BIN = 64


def narrowest_owner(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """For each point (``key``, ``at``) the narrowest span (``key``, ``name``, ``lo``, ``hi``) around it.

    Of equally narrow spans the first (``lo``, then ``name``) owns it; points outside all spans have no
    row. Spans meet points through bins of ``BIN`` lines, so that no pair of far ones is looked at.
    """
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN))))
    at = points.select(key, "at").distinct().withColumn("_bin", F.floor(F.col("at") / BIN))
    j = at.join(binned, [key, "_bin"]).filter("at BETWEEN lo AND hi")
    best = j.groupBy(key, "at").agg(F.min(F.struct(F.expr("hi - lo").alias("w"), "lo", "name", "hi")).alias("s"))
    return best.select(key, "at", F.col("s.name").alias("name"), F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left spans that overlap a right span of the same key."""
    r = right.select(F.col(key).alias("_k"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return left.join(r, (F.col(key) == F.col("_k")) & (F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo")), "left_semi")


def merged_windows(anchors: DataFrame, key: str, at: str, radius: int) -> DataFrame:
    """Windows of ``radius`` around the anchors of each key, joined where they touch."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    spans = anchors.select(key, F.greatest(F.col(at) - radius, F.lit(1)).alias("lo"), (F.col(at) + radius).alias("hi")).distinct()
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = spans.withColumn("_new", F.coalesce(F.col("lo") > before + 1, F.lit(True)).cast("int")).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("anchors")).drop("_g")


def context_after(rows: DataFrame, keys: list[str], order: str, hit: str, after: int) -> DataFrame:
    """Rows that hit and the ``after`` rows behind each, by key in order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-after, 0)
    return rows.withColumn("_near", F.max(F.col(hit).cast("int")).over(w)).filter("_near = 1").drop("_near")


def context_around(rows: DataFrame, keys: list[str], order: str, hit: str, pad: int = 3) -> DataFrame:
    """Rows that hit and the ``pad`` rows before and behind each, by key in order, with ``mark`` (``>>`` at a hit)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-pad, pad)
    near = rows.withColumn("_near", F.max(F.col(hit).cast("int")).over(w)).filter("_near = 1").drop("_near")
    return near.withColumn("mark", F.when(F.col(hit), F.lit(">>")).otherwise(F.lit("  ")))


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str, longest: int) -> DataFrame:
    """For each row the longest prefix of its text that the other table holds (null if none).

    Every head of at most ``longest`` characters is looked up by equality, so no text meets a prefix it does not start with;
    equal texts are looked up once. Sizes are estimated without the heads, so the join is told not to broadcast them.
    """
    texts = rows.select(F.col(text).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    heads = texts.withColumn("_head", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("_text"), F.lit(longest))), lambda n: F.substring(F.col("_text"), F.lit(1), n))))
    found = heads.hint("merge").join(prefixes.select(F.col(prefix).alias("_head")).distinct(), "_head")
    best = found.groupBy("_text").agg(F.max_by("_head", F.length("_head")).alias("prefix"))
    return rows.join(best, F.col(text) == F.col("_text"), "left").drop("_text")

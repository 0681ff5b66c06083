"""State over ordered events, as windows over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def failure_lock(events: DataFrame, key: str, order: list[str], failure: Column, reset: Column, limit: int = 2) -> DataFrame:
    """Adds ``failures`` since the last reset and ``locked`` (``limit`` failures at least) after each event."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(key, "_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("_epoch", F.sum(reset.cast("int")).over(w)).withColumn("failures", F.sum(failure.cast("int")).over(since))
    return out.withColumn("locked", F.col("failures") >= limit).drop("_epoch")


def last_good(rows: DataFrame, key: str, order: list[str], good: Column, value: str) -> DataFrame:
    """Adds ``last_good``: the value of the last good row up to and including each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("last_good", F.last(F.when(good, F.col(value)), ignorenulls=True).over(w))


def fold_turns(rows: DataFrame, key: str, order: str, text: str, by: str) -> DataFrame:
    """The texts of each key and kind joined in order, with their number."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return rows.groupBy(key, by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("content"), F.count("*").alias("pieces"))

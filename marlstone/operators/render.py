"""Blocks of lines rendered to a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def rendered_blocks(blocks: DataFrame, key: str, order: str, budget: int, radius: int) -> DataFrame:
    """The blocks of each key that fit into ``budget`` characters, in order: key, order, ``how`` and ``text``.

    ``blocks`` has the key, the order, ``lines`` (array) and ``anchors`` (places of lines from 1). Blocks are taken
    whole while their sum stays within the budget. Those behind are reduced to the lines within ``radius`` of an anchor,
    or of the middle where there is none inside, each gap shown as ``...``, and taken in a second pass while they fit into what is left. A
    block counts its line ends. Null and empty blocks are left out.
    """
    rows = blocks.filter(F.size("lines") > 0).select(key, order, "lines", "anchors")
    n = F.size("lines")
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = rows.withColumn("_text", F.array_join("lines", "\n")).withColumn("_sum", F.sum(F.length("_text") + 1).over(w))
    whole = whole.withColumn("_left", F.lit(budget) - F.coalesce(F.max(F.when(F.col("_sum") <= budget, F.col("_sum"))).over(Window.partitionBy(key)), F.lit(0)))
    taken = whole.filter(F.col("_sum") <= budget).select(key, order, F.lit("whole").alias("how"), F.col("_text").alias("text"))

    inside = F.filter(F.coalesce("anchors", F.array().cast("array<int>")), lambda a: (a >= 1) & (a <= n))
    at = F.when(F.size(inside) > 0, inside).otherwise(F.array(F.floor((n + 1) / 2).cast("int")))
    near = lambda i: F.exists(at, lambda a: F.abs(a - i) <= radius)
    places = F.filter(F.sequence(F.lit(1), n), near)
    # A gap mark stands before a line that does not follow the one shown before it, and at the end if lines are left.
    shown = F.transform(places, lambda i, k: F.concat(F.when((i > 1) & ~near(i - 1), F.lit("...\n")).otherwise(F.lit("")), F.element_at("lines", i)))
    text = F.concat(F.array_join(shown, "\n"), F.when(F.element_at(places, -1) < n, F.lit("\n...")).otherwise(F.lit("")))
    rest = whole.filter(F.col("_sum") > budget).withColumn("_short", text).withColumn("_sum", F.sum(F.length("_short") + 1).over(w))
    return taken.unionByName(rest.filter(F.col("_sum") <= F.col("_left")).select(key, order, F.lit("window").alias("how"), F.col("_short").alias("text")))

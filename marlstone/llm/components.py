"""Connected components by alternating large-star and small-star steps.

Each step is a minimum by node (partly computed before the shuffle) and a join with it. The edges of a node
with very many of them are dealt out by a salt in these joins, so that no task must hold them all. Every
round is written to the shared folder, and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import removed, saved_at

# A node is a hub from so many edges on; hubs are at most 2 * HUB_LIST, whatever the number of edges.
HUB_EDGES, HUB_LIST = 512, 100_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(edges: DataFrame, least: DataFrame, hubs: list) -> DataFrame:
    """Edges with the value ``m`` of their ``a``; those of hubs are salted by their ``b``."""
    if not hubs:
        return edges.join(least, "a")
    parts = F.broadcast(edges.sparkSession.createDataFrame([(r["a"], r["parts"]) for r in hubs], "a long, parts long"))
    some = edges.join(parts, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0).cast("long"))).drop("parts")
    each = least.join(parts, "a", "left").select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    return some.join(each, ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id that its edges reach) of every node of the edges (``a``, ``b``).

    Loops, repeated edges and edges with a null end are ignored, except that a loop makes its node a row.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    first, _ = saved_at(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now, path, before, limit = first.filter("a <> b"), None, None, HUB_EDGES
    while True:
        each = _both(now).groupBy("a").agg(F.count("*").alias("c"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"))
        hub = F.when(F.col("c") > limit, F.struct("a", F.floor(F.col("c") / limit + 1).alias("parts")))
        state = each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.sum("h").alias("h"), F.collect_list(hub).alias("hubs")).first()
        if (state["c"], state["h"]) == before or not state["c"]:
            break
        before, limit, hubs = (state["c"], state["h"]), max(limit, state["c"] // HUB_LIST), state["hubs"]
        # large star: of u's neighbours, those above u are tied to the least of all.
        both = _both(now)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        now = _with_least(both.filter("b > a"), least, hubs).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: u and its neighbours below it are tied to the least of them.
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        below = _with_least(now, least, hubs).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, new = saved_at(below.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        if path:
            removed(spark, path)
        path = new
    nodes = now.select(F.col("b").alias("id")).unionByName(first.filter("a = b").select(F.col("a").alias("id"))).distinct()
    top = nodes.join(now.select(F.col("a").alias("id")), "id", "left_anti")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(top.select("id", F.col("id").alias("component")))

"""Versions that refer to other keys, resolved along ranked scopes."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 32


def effective(definitions: DataFrame, scopes: list[str]) -> DataFrame:
    """Of each project and key the definition (``value`` or ``ref``) of the first scope that has one; others do not count."""
    rank = F.array_position(F.array(*map(F.lit, scopes)), F.col("scope"))
    known = definitions.filter(F.col("scope").isin(*scopes) & F.col("key").isNotNull() & (F.col("value").isNotNull() | F.col("ref").isNotNull()))
    return known.groupBy("project", "key").agg(F.min(F.struct(rank.alias("rank"), "scope", "value", "ref")).alias("d")).select("project", "key", "d.scope", "d.value", "d.ref")


def _kept(rows: DataFrame) -> DataFrame:
    """The rows, computed now and held in the folder of checkpoints that all executors share; without one on the executors' disks."""
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        if not (base := spark.conf.get("spark.checkpoint.dir", None)):
            return rows.localCheckpoint(True, StorageLevel.DISK_ONLY)
        spark.sparkContext.setCheckpointDir(base)
    return rows.checkpoint()


def resolved_versions(definitions: DataFrame, scopes: list[str], deepest: int = DEEPEST) -> DataFrame:
    """(``project``, ``key``, ``scope``, ``version``, ``steps``) of every key whose references end in a value.

    ``definitions`` has ``project``, ``scope``, ``key`` and either ``value`` or ``ref``, the key that has the value. A
    reference is looked up by the same ranking of scopes. Keys that are missing, go round in a circle or are more than
    ``deepest`` steps away have no row. A round looks every open reference up in what the rounds before have found, so
    that it comes twice as far; rounds run at once and are checkpointed.
    """
    bare = F.col("value").isNull()
    each = _kept(effective(definitions, scopes).select("project", "key", "scope", "value", F.when(bare, F.col("ref")).alias("ref"), bare.cast("int").alias("steps")))
    done, left = each.filter(~bare), each.filter(bare)
    for _ in range(deepest.bit_length()):
        to = done.union(left).select(F.col("project").alias("_project"), F.col("key").alias("_key"), F.col("value").alias("_value"), F.col("ref").alias("_ref"), F.col("steps").alias("_steps"))
        # Sizes are estimated from files, where keys take little room, so no side is to be broadcast.
        met = left.hint("merge").join(to, (F.col("project") == F.col("_project")) & (F.col("ref") == F.col("_key")))
        met = _kept(met.select("project", "key", "scope", F.col("_value").alias("value"), F.col("_ref").alias("ref"), (F.col("steps") + F.col("_steps")).alias("steps")).filter(F.col("steps") <= deepest))
        done, left = done.union(met.filter(~bare)), met.filter(bare)
        if left.isEmpty():
            break
    return done.select("project", "key", "scope", F.col("value").alias("version"), "steps")

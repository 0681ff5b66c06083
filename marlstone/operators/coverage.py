"""Probes, snapshots of engines, their merges, deltas and roll-ups.

A probe is one line of one source as one engine saw it: ``engine, module, package, source_name, line_no``
and the counts ``mi, ci, mb, cb`` (missed and covered instructions and branches).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlstone.functions.labels import improved, regressed
from marlstone.functions.numbers import ratio_pct

SOURCE = ["module", "package", "source_name"]


def with_states(probes: DataFrame) -> DataFrame:
    """Adds ``covered``, ``missed`` and ``branch_gap``; lines below 1 go."""
    return probes.filter("line_no > 0").withColumns(
        {"covered": F.col("ci") > 0, "missed": (F.col("mi") > 0) & (F.col("ci") == 0), "branch_gap": F.col("mb") > 0}
    )


def engine_snapshot(probes: DataFrame) -> DataFrame:
    """One row for each engine and source: counts and the sorted arrays of missed, covered and branch-gap lines."""
    lines = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("line_no"))))
    return with_states(probes).groupBy("engine", *SOURCE).agg(
        F.count_if("covered").alias("line_covered"),
        F.count_if("missed").alias("line_missed"),
        lines("missed").alias("missed_lines"),
        lines("covered").alias("covered_lines"),
        lines("branch_gap").alias("branch_lines"),
    )


def merged_missed(unit: Column, instrumented: Column, mode: str = "reference") -> Column:
    """Lines missed after merging two engines.

    ``documented`` is the intersection; ``reference`` equals the instrumented set. An engine without a
    report (null) leaves the other's lines.
    """
    both = instrumented if mode == "reference" else F.array_intersect(unit, instrumented)
    return F.array_sort(F.coalesce(F.when(unit.isNull(), instrumented).when(instrumented.isNull(), unit).otherwise(both), F.array().cast("array<int>")))


def merge_engines(snapshots: DataFrame, mode: str = "reference") -> DataFrame:
    """Full outer join of the unit and the instrumented snapshot of every source.

    An instrumented report without any hit leaves the unit values as they are.
    """
    cols = ["line_covered", "line_missed", "missed_lines", "covered_lines", "branch_lines"]
    side = lambda engine, p: snapshots.filter(F.col("engine") == engine).select(*SOURCE, *[F.col(c).alias(p + c) for c in cols])
    joined = side("unit", "u_").join(side("instrumented", "i_"), SOURCE, "full_outer")
    hit = F.when(F.coalesce("i_line_covered", F.lit(0)) > 0, F.col("i_missed_lines"))
    instrumented = F.when(F.col("u_missed_lines").isNull(), F.col("i_missed_lines")).otherwise(hit)
    return joined.withColumn("merged_missed", merged_missed(F.col("u_missed_lines"), instrumented, mode))


def best_snapshot(snapshots: DataFrame, keys: list[str], covered: str, order: str) -> DataFrame:
    """Of each key the row with the most covered; of several the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(covered), F.asc(order))
    return snapshots.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def union_lines(probes: DataFrame) -> DataFrame:
    """One row for each line of a source over all engines: covered if any engine covers it."""
    return with_states(probes).groupBy(*SOURCE, "line_no").agg(F.bool_or("covered").alias("covered"), F.bool_and("missed").alias("missed"), F.bool_or("branch_gap").alias("branch_gap"))


def module_coverage(probes: DataFrame) -> DataFrame:
    """Files, covered and missed lines (union of engines) and percentage by module."""
    lines = union_lines(probes)
    out = lines.groupBy("module").agg(F.countDistinct("package", "source_name").alias("files"), F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("missed"))
    return out.withColumn("line_pct", ratio_pct(F.col("covered"), F.col("missed")))


def module_rollup(lines: DataFrame) -> DataFrame:
    """Counts by module with a grand total (module ``TOTAL``); percentages are taken after the sums."""
    out = lines.rollup("module").agg(F.grouping_id().alias("g"), F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("missed"))
    return out.select(F.when(F.col("g") > 0, "TOTAL").otherwise(F.col("module")).alias("module"), "covered", "missed", ratio_pct(F.col("covered"), F.col("missed")).alias("line_pct"))


def coverage_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Line and branch sets before and after: what was resolved, what is newly missed, and the verdict.

    Accepted is what improved without a regression; a source that is missing on one side counts as empty there.
    """
    cols = ["missed_lines", "branch_lines", "line_covered", "line_missed"]
    side = lambda d, p: d.select(*keys, *[F.col(c).alias(p + c) for c in cols])
    j = side(before, "b_").join(side(after, "a_"), keys, "full_outer")
    none = F.array().cast("array<int>")
    j = j.select(*keys, *[F.coalesce(F.col(p + c), none if c.endswith("lines") else F.lit(0)).alias(p + c) for p in ("b_", "a_") for c in cols])
    minus = lambda x, y: F.array_sort(F.array_except(x, y))
    j = j.withColumns({
        "resolved_lines": minus(F.col("b_missed_lines"), F.col("a_missed_lines")), "new_missed_lines": minus(F.col("a_missed_lines"), F.col("b_missed_lines")),
        "resolved_branches": minus(F.col("b_branch_lines"), F.col("a_branch_lines")), "new_branches": minus(F.col("a_branch_lines"), F.col("b_branch_lines")),
    })
    counts = [F.col(c) for c in ("b_line_missed", "a_line_missed", "b_line_covered", "a_line_covered")]
    worse = regressed(F.size("new_missed_lines"), *counts) | (F.size("new_branches") > 0)
    better = improved(F.size("resolved_lines"), *counts) | (F.size("resolved_branches") > 0)
    return j.withColumns({"regressed": worse, "improved": better, "accepted": better & ~worse})


def element_union(elements: DataFrame, keys: list[str], owner: list[str]) -> DataFrame:
    """Distinct covered and all slots over engines. The covered slots of an owner are a prefix, so the largest engine has them all."""
    per_owner = elements.groupBy(*keys, *owner).agg(F.max("slots").alias("slots"), F.max("covered_slots").alias("covered"))
    out = per_owner.groupBy(*keys).agg(F.sum("covered").alias("covered"), F.sum("slots").alias("total"))
    return out.withColumn("pct", ratio_pct(F.col("covered"), F.col("total") - F.col("covered")))


def without_deferred(probes: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Probes that no ledger row defers."""
    return probes.join(ledger.select(*keys).distinct(), keys, "left_anti")


def zero_filled_counts(rows: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows of each value of the domain, 0 for values that do not occur."""
    all_values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return all_values.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))

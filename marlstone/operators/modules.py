"""Modules over two engines, and files with the state of their gaps.

Long tables, so that a module may have any number of files: ``counters`` (``engine``, ``module``, ``package``,
``source_name``, ``metric``, ``covered``, ``missed``), ``lines`` (``engine``, ``module``, ``package``, ``source_name``,
``line_no``, ``covered``) and ``elements`` (``engine``, ``module``, ``metric``, ``element``, ``covered``). A blank or
null module is ``(unknown)``; null counts are 0; a null element or line counts nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.labels import work_status
from marlstone.functions.numbers import capped_sum_pct, compact_ranges, ratio_pct
from marlstone.functions.sources import declares_only
from marlstone.operators.catalog import first_existing
from marlstone.operators.report import deferred_probes

ENGINES = ("unit", "instrumented")
METRICS = ("class", "method", "branch", "line", "instruction")
FILE = ["module", "package", "source_name"]


def _module() -> Column:
    return F.coalesce(F.nullif(F.col("module"), F.lit("")), F.lit("(unknown)")).alias("module")


def engine_sums(counters: DataFrame) -> DataFrame:
    """Files and the sums ``engine_metric_covered`` and ``engine_metric_missed`` by module; sums of a file meet first."""
    cell = lambda e, m, side: F.coalesce(F.sum(F.when((F.col("engine") == e) & (F.col("metric") == m), F.col(side))), F.lit(0)).alias(f"{e}_{m}_{side}")
    names = [(e, m, side) for e in ENGINES for m in METRICS for side in ("covered", "missed")]
    files = counters.withColumn("module", _module()).groupBy(*FILE).agg(*[cell(*n) for n in names])
    return files.groupBy("module").agg(F.count("*").alias("files"), *[F.sum("_".join(n)).alias("_".join(n)) for n in names])


def element_sums(elements: DataFrame) -> DataFrame:
    """``metric_elements_covered`` and ``metric_elements`` by module: elements over both engines, each once, covered if any engine covers it."""
    one = elements.filter("element IS NOT NULL").withColumn("module", _module()).groupBy("module", "metric", "element").agg(F.bool_or(F.coalesce("covered", F.lit(False))).alias("covered"))
    some = lambda m: F.col("metric") == m
    return one.groupBy("module").agg(*[F.count_if(some(m) & F.col("covered")).alias(f"{m}_elements_covered") for m in METRICS], *[F.count_if(some(m)).alias(f"{m}_elements") for m in METRICS])


def line_sums(lines: DataFrame) -> DataFrame:
    """``union_covered`` and ``union_lines`` by module: the lines of each file over both engines, each once."""
    one = lines.filter("line_no IS NOT NULL").withColumn("module", _module()).groupBy(*FILE, "line_no").agg(F.bool_or(F.coalesce("covered", F.lit(False))).alias("covered"))
    return one.groupBy("module").agg(F.count_if("covered").alias("union_covered"), F.count("*").alias("union_lines"))


def module_projection(counters: DataFrame, lines: DataFrame, elements: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """One row a module: files, 20 sums, a percentage for each engine and metric, and one over both engines for each metric.

    An engine that covers nothing has no percentage. A metric's percentage over both is the covered share of its
    elements, without elements the capped sum of the engines'; that of lines is the covered share of the union of each
    file's lines where there are lines. Files in ``generated`` (``module``, ``package``, ``source_name``) are left out of
    counters and lines. The three tables meet by module only, after their sums.
    """
    if generated is not None:
        gone = generated.select(*FILE).distinct()
        # Nulls in a key are equal here, as they are where the sums group them.
        same = lambda t: [t[c].eqNullSafe(gone[c]) for c in FILE]
        counters, lines = counters.join(gone, same(counters), "left_anti"), lines.join(gone, same(lines), "left_anti")
    out = engine_sums(counters).join(element_sums(elements), "module", "left").join(line_sums(lines), "module", "left")
    out = out.withColumns({f"{e}_{m}_pct": F.when(F.col(f"{e}_{m}_covered") > 0, ratio_pct(F.col(f"{e}_{m}_covered"), F.col(f"{e}_{m}_missed"))) for e in ENGINES for m in METRICS})
    union = ratio_pct(F.col("union_covered"), F.col("union_lines") - F.col("union_covered"))
    both = {}
    for m in METRICS:
        pct = F.coalesce(ratio_pct(F.col(f"{m}_elements_covered"), F.col(f"{m}_elements") - F.col(f"{m}_elements_covered")), capped_sum_pct(*[F.col(f"{e}_{m}_pct") for e in ENGINES]))
        both[f"combined_{m}_pct"] = F.coalesce(union, pct) if m == "line" else pct
    return out.withColumns(both).na.fill(0, [c for c in out.columns if "elements" in c or c.startswith("union")])


def file_states(files: DataFrame, ledger: DataFrame, catalog: DataFrame, candidates: list[Column]) -> DataFrame:
    """Files with their source, what is actionable in their gaps and their work state.

    ``files`` have ``id``, ``module``, ``source_name``, the arrays ``missed_lines`` and ``branch_lines`` and the counts
    ``line_covered``, ``line_missed``, ``branch_covered``, ``branch_missed``; ``ledger`` rows (``module``, ``source_name``,
    ``lines``, ``branches``, ``category``) defer probes; ``catalog`` (``path``, ``text``) holds the sources, looked up by the
    first of ``candidates`` that exists. A file without counters whose source declares only has nothing to run. A file
    without a source is not resolvable; null arrays are empty.
    """
    none = F.array().cast("array<int>")
    where = ["module", "source_name"]
    found = first_existing(files, "id", candidates, catalog).withColumnRenamed("resolved", "source_path")
    # Only a file without counters needs its source's text.
    empty = F.greatest(*[F.coalesce(c, F.lit(0)) for c in ("line_covered", "line_missed", "branch_covered", "branch_missed")]) <= 0
    texts = catalog.join(found.filter(empty & F.col("source_path").isNotNull()).select(F.col("source_path").alias("path")).distinct(), "path", "left_semi")
    quiet = texts.groupBy(F.col("path").alias("source_path")).agg(F.min("text").alias("_t")).select("source_path", declares_only(F.col("_t")).alias("_quiet"))
    j = found.join(quiet, "source_path", "left").join(deferred_probes(ledger, where), where, "left")
    rest = lambda a, b: F.array_sort(F.array_except(F.coalesce(F.col(a), none), F.coalesce(F.col(b), none)))
    j = j.withColumns({"source_resolvable": F.col("source_path").isNotNull(), "actionable_lines": rest("missed_lines", "deferred_lines"), "actionable_branches": rest("branch_lines", "deferred_branches"), "non_executable": empty & F.coalesce("_quiet", F.lit(False))})
    missed = F.coalesce("line_missed", F.lit(0)) + F.coalesce("branch_missed", F.lit(0))
    status = work_status(F.when(F.col("non_executable"), 0).otherwise(1), missed, F.col("source_resolvable"), F.size("actionable_lines") + F.size("actionable_branches"))
    return j.withColumns({"gap_work_status": status, "pending_lines": compact_ranges(F.col("actionable_lines")), "pending_branches": compact_ranges(F.col("actionable_branches"))}).drop("_quiet", "deferred_lines", "deferred_branches")


def with_source(files: DataFrame) -> DataFrame:
    """The files whose source was found."""
    return files.filter(F.coalesce("source_resolvable", F.lit(False)))

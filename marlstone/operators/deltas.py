"""Gaps before and after a run: what lines, branches and methods were resolved or newly missed, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.labels import improved, regressed
from marlstone.functions.numbers import compact_ranges

SETS = ("missed_lines", "branch_lines", "missed_methods", "branch_methods")
COUNTS = ("line_missed", "line_covered", "branch_missed", "branch_covered")


def gap_deltas(before: DataFrame, after: DataFrame, keys: list[str], bootstrap: bool = False) -> DataFrame:
    """One row for each key of either side, with both sides' counts and the differences of their sets, sorted.

    A gap has the arrays ``missed_lines``, ``branch_lines``, ``missed_methods`` and ``branch_methods`` and the counts
    ``line_missed``, ``line_covered``, ``branch_missed``, ``branch_covered``; null arrays are empty, null counts 0. Methods
    count as one set over both kinds. A key that is missing on a side has null differences; it is accepted only if
    ``bootstrap`` is set, nothing stood before and something is covered now. Else accepted is what improved (methods: by
    resolving one) without a regression. One row for each key on each side is expected.
    """
    side = lambda d, p: d.select(*keys, F.lit(True).alias(p + "here"), *[F.col(c).alias(p + c) for c in (*SETS, *COUNTS)])
    j = side(before, "b_").join(side(after, "a_"), keys, "full_outer")
    lines, texts = F.array().cast("array<int>"), F.array().cast("array<string>")
    j = j.withColumns({p + c: F.coalesce(p + c, lines if c.endswith("lines") else texts) for p in ("b_", "a_") for c in SETS} | {p + c: F.coalesce(p + c, F.lit(0)) for p in ("b_", "a_") for c in COUNTS})
    both = F.col("b_here") & F.col("a_here")
    methods = lambda p: F.array_union(p + "missed_methods", p + "branch_methods")
    pairs = {"lines": (F.col("b_missed_lines"), F.col("a_missed_lines")), "branches": (F.col("b_branch_lines"), F.col("a_branch_lines")), "methods": (methods("b_"), methods("a_"))}
    minus = lambda x, y: F.when(both, F.array_sort(F.array_except(x, y)))
    j = j.withColumns({f"resolved_{n}": minus(b, a) for n, (b, a) in pairs.items()} | {f"new_{n}": minus(a, b) for n, (b, a) in pairs.items()})
    counts = lambda m: [F.col(c) for c in (f"b_{m}_missed", f"a_{m}_missed", f"b_{m}_covered", f"a_{m}_covered")]
    worse = regressed(F.size("new_lines"), *counts("line")) | regressed(F.size("new_branches"), *counts("branch")) | (F.size("new_methods") > 0)
    better = improved(F.size("resolved_lines"), *counts("line")) | improved(F.size("resolved_branches"), *counts("branch")) | (F.size("resolved_methods") > 0)
    first = F.lit(bootstrap) & F.col("b_here").isNull() & ((F.col("a_line_covered") > 0) | (F.col("a_branch_covered") > 0))
    j = j.withColumns({"regressed": F.when(both, worse), "improved": F.when(both, better)})
    return j.withColumn("accepted", F.when(both, better & ~worse).otherwise(F.coalesce(first, F.lit(False)))).drop("b_here", "a_here")


def delta_text(resolved_lines: Column, resolved_branches: Column, resolved_methods: Column, missed_after: Column, before: tuple[Column, Column], after: tuple[Column, Column]) -> Column:
    """A delta as rows of text; ``before`` and ``after`` are the missed and covered lines. Without a delta one row says so."""
    # The sentences that readers of the summary look for.
    head, absent = "   Covered (Kover):", "     - coverage delta unavailable"
    pair = lambda p: F.format_string("(%d, %d)", *p)
    rows = F.concat_ws(
        "\n",
        F.concat(F.lit("     - resolved lines: "), compact_ranges(resolved_lines)),
        F.when(F.size(resolved_branches) > 0, F.concat(F.lit("     - resolved branch lines: "), compact_ranges(resolved_branches))),
        F.concat(F.lit("     - resolved methods: "), F.when(F.size(resolved_methods) > 0, F.array_join(resolved_methods, ", ")).otherwise("none")),
        F.concat(F.lit("     - remaining missed lines: "), compact_ranges(missed_after)),
        F.concat(F.lit("     - line missed/covered: "), pair(before), F.lit(" -> "), pair(after)),
    )
    return F.concat(F.lit(head + "\n"), F.when(resolved_lines.isNull(), absent).otherwise(rows))

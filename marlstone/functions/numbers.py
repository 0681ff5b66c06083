"""Numbers and sets of line numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_set(values: Column) -> Column:
    """The distinct integers of an array of texts in order; what is no integer is dropped."""
    # A cast that fails costs an exception, so only what looks like an integer is cast; one out of bounds is dropped then.
    like = F.filter(values, lambda x: x.rlike(r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*\z"))
    cast = F.transform(like, lambda x: x.try_cast("int"))
    return F.sort_array(F.array_distinct(F.filter(cast, lambda x: x.isNotNull())))


def compact_ranges(numbers: Column) -> Column:
    """Distinct integers as text such as ``1-3, 5``; an empty array is ``none``, a null one null."""
    n = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))
    # A range starts where the number before is missing, and ends where the next one is.
    starts = F.filter(n, lambda x: ~F.array_contains(n, x - 1))
    ends = F.filter(n, lambda x: ~F.array_contains(n, x + 1))
    text = F.zip_with(starts, ends, lambda a, z: F.when(a == z, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), z.cast("string"))))
    return F.when(F.size(n) == 0, "none").otherwise(F.array_join(text, ", "))


def ratio_pct(covered: Column, missed: Column) -> Column:
    """covered / (covered + missed) in per cent with one decimal, ties to even; null without a total."""
    total = covered + missed
    return F.when(total > 0, F.bround(covered / total * 100, 1))


def capped_sum_pct(left: Column, right: Column) -> Column:
    """The sum of two percentages, 100 at most; null only if both are."""
    both = F.bround(F.coalesce(left, F.lit(0.0)) + F.coalesce(right, F.lit(0.0)), 1)
    return F.when(left.isNotNull() | right.isNotNull(), F.least(F.lit(100.0), both))


def union_line_pct(covered_union: Column, universe: Column, left: Column, right: Column) -> Column:
    """Covered share of the union of lines; without lines the capped sum of the engines' percentages."""
    return F.coalesce(F.when(universe > 0, F.bround(covered_union / universe * 100, 1)), capped_sum_pct(left, right))


def line_map_pct(missed: Column, longest: Column) -> Column:
    """Each missed line as a percentage of the file's length, two decimals."""
    top = F.greatest(F.coalesce(longest, F.array_max(missed)), F.lit(1))
    return F.transform(missed, lambda n: F.bround(n * 100.0 / top, 2))


def merged_covered(total_left: Column, total_right: Column, merged_missed: Column) -> Column:
    """Lines covered after a merge: the larger total less the merged misses, 0 at least."""
    return F.greatest(F.lit(0), F.greatest(total_left, total_right) - merged_missed)


def credited(deferred: Column, missed: Column) -> Column:
    """Deferred lines that are still missed at most."""
    return F.least(F.greatest(deferred, F.lit(0)), F.greatest(missed, F.lit(0)))


def effective_pct(covered: Column, missed: Column, credit: Column) -> Column:
    """The share of lines covered or credited, in per cent."""
    total = covered + missed
    return F.when(total > 0, F.bround(100 * (covered + credit) / total, 1))


def pct_band(pct: Column) -> Column:
    """low below 60, medium up to 85, high above; null stays null."""
    return F.when(pct < 60, "low").when(pct <= 85, "medium").when(pct > 85, "high")

"""Labels and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The work states of a file, in order of precedence.
WORK_STATES = ("no_exec", "covered", "generated", "actionable", "deferred_only")


def gap_kind(mi: Column, ci: Column, mb: Column) -> Column:
    """line, branch or line_and_branch; null for a line without a gap."""
    line, branch = (mi > 0) & (ci == 0), mb > 0
    return F.when(line & branch, "line_and_branch").when(branch, "branch").when(mi > 0, "line")


def work_status(executable: Column, missed: Column, resolvable: Column, actionable: Column) -> Column:
    """The work state of a file from its counts."""
    return (
        F.when(executable <= 0, WORK_STATES[0]).when(missed <= 0, WORK_STATES[1]).when(~resolvable, WORK_STATES[2]).when(actionable > 0, WORK_STATES[3]).otherwise(WORK_STATES[4])
    )


def regressed(newly_missed: Column, missed_before: Column, missed_after: Column, covered_before: Column, covered_after: Column) -> Column:
    return (newly_missed > 0) | (missed_after > missed_before) | (covered_after < covered_before)


def improved(resolved: Column, missed_before: Column, missed_after: Column, covered_before: Column, covered_after: Column) -> Column:
    return (resolved > 0) | (missed_after < missed_before) | (covered_after > covered_before)


def first_match(text: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that the text matches."""
    out = F.lit(default)
    for label, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def tag_score(tags: Column, weights: dict[str, int]) -> Column:
    """The sum of the weights of the tags; tags without one count nothing."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.aggregate(tags, F.lit(0), lambda a, t: a + F.coalesce(F.try_element_at(table, t), F.lit(0)))


def exclusive_layer(tags: Column, unit: dict[str, int], device: dict[str, int], only_device: list[str], only_unit: list[str]) -> Column:
    """Hard rules first, then the layer with the strictly lower friction, else unit."""
    return (
        F.when(F.arrays_overlap(tags, F.array(*map(F.lit, only_device))), "instrumented")
        .when(F.arrays_overlap(tags, F.array(*map(F.lit, only_unit))), "unit")
        .when(tag_score(tags, device) < tag_score(tags, unit), "instrumented")
        .otherwise("unit")
    )


def missing_items(checks: dict[str, Column]) -> Column:
    """The names of the checks that do not hold, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def disposition(confirmed: Column, dismissed: Column) -> Column:
    """The state of a finding: dismissed before confirmed, else candidate."""
    return F.when(F.coalesce(dismissed, F.lit(False)), "dismissed").when(F.coalesce(confirmed, F.lit(False)), "confirmed").otherwise("candidate")


def cites(paths: Column, needles: list[str]) -> Column:
    """True if a cited path ends in one of the needles, at a folder."""
    return F.coalesce(F.exists(paths, lambda p: F.array_contains(F.transform(F.array(*map(F.lit, needles)), lambda n: (p == n) | p.endswith(F.concat(F.lit("/"), n))), True)), F.lit(False))


def marker_profile(text: Column, markers: dict[str, str], lines: int = 220, functions: int = 10, few: int = 4) -> Column:
    """Struct of the ``markers`` that a text has and whether it is ``complex``: many markers, lines or functions."""
    body = F.coalesce(text, F.lit(""))
    found = F.array_compact(F.array(*[F.when(body.rlike(p), n) for n, p in markers.items()]))
    n_lines, n_functions = F.size(F.split(body, "\n")), F.regexp_count(body, F.lit(r"\bfun\s"))
    return F.struct(found.alias("markers"), ((F.size(found) >= few) | (n_lines >= lines) | (n_functions >= functions)).alias("complex"))

"""The project report: files, modules, runs and their totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlstone.functions.numbers import ratio_pct

# Fixed value: the category whose lines are branch probes when a row has no branches.
BRANCH_CATEGORY = "kover_residual_branch"


def entry_probes(lines: Column, branches: Column, category: Column) -> tuple[Column, Column]:
    """Missed lines and branch lines of a ledger row; old rows of ``BRANCH_CATEGORY`` keep branch lines as lines."""
    none = F.array().cast("array<int>")
    lines, branches = F.coalesce(lines, none), F.coalesce(branches, none)
    old = (F.size(branches) == 0) & (F.trim(F.coalesce(category, F.lit(""))) == BRANCH_CATEGORY)
    return F.when(old, none).otherwise(lines), F.when(old, lines).otherwise(branches)


def deferred_probes(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The deferred lines and branch lines of each key, as sorted arrays, from ledger rows (``lines``, ``branches``, ``category``)."""
    a, b = entry_probes(F.col("lines"), F.col("branches"), F.col("category"))
    each = ledger.select(*keys, F.explode_outer(F.concat(F.transform(a, lambda x: F.struct(x.alias("n"), F.lit(False).alias("branch"))), F.transform(b, lambda x: F.struct(x.alias("n"), F.lit(True).alias("branch"))))).alias("p"))
    some = lambda branch: F.array_sort(F.collect_set(F.when(F.col("p.branch") == branch, F.col("p.n"))))
    return each.groupBy(*keys).agg(some(False).alias("deferred_lines"), some(True).alias("deferred_branches"))


def restricted(probes: Column, lines: Column) -> Column:
    """The probes that are among ``lines``; all of them where that is empty or null."""
    return F.when(F.coalesce(F.size(lines), F.lit(0)) <= 0, probes).otherwise(F.array_intersect(probes, lines))


def last_by_name(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Of rows with one name the last in ``order``."""
    w = Window.partitionBy(name).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def runs_with_snapshots(runs: DataFrame, snapshots: dict[str, DataFrame], name: str, order: str) -> DataFrame:
    """Runs with one struct column for each snapshot, matched on the file name alone (the last duplicate), null without a match."""
    out = runs
    for column, rows in snapshots.items():
        values = [c for c in rows.columns if c not in (name, order)]
        one = last_by_name(rows, name, order).select(name, F.struct(*values).alias(column))
        out = out.join(one, name, "left")
    return out


def run_order(accepted: str = "accepted", name: str = "source_name") -> list[Column]:
    """Accepted runs first, then by name."""
    return [F.desc(F.coalesce(F.col(accepted), F.lit(False))), F.asc(name)]


def user_order(column: str, descending: bool) -> Column:
    """A reader's sort: nulls last in both directions."""
    return F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)


def module_sums(files: DataFrame, sums: list[str], ratios: dict[str, tuple[str, str]], generated: str | None = None) -> DataFrame:
    """Files and the sums of the columns by module, with a percentage for each (covered, missed) pair of sums.

    Files flagged by the column ``generated`` are left out if it is given.
    """
    rows = files.filter(~F.coalesce(F.col(generated), F.lit(False))) if generated else files
    out = rows.groupBy("module").agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    return out.withColumns({name: ratio_pct(F.col(a), F.col(b)) for name, (a, b) in ratios.items()})


def deferred_tree(entries: DataFrame) -> DataFrame:
    """Entries (``module``, ``source_name``, ``category``, ``lines``) by module and file: rows, categories and distinct lines."""
    counts = entries.groupBy("module", "source_name", "category").agg(F.count("*").alias("n"))
    counts = counts.groupBy("module", "source_name").agg(F.sum("n").alias("entries"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    lines = entries.select("module", "source_name", F.explode("lines").alias("n")).distinct().groupBy("module", "source_name").agg(F.array_sort(F.collect_list("n")).alias("lines"))
    return counts.join(lines, ["module", "source_name"], "left")


def outcome_buckets(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items (``item``, ``line``, ``missed_after``, ``deferred``) of each key in buckets: attempted, covered and deferred lines, sorted."""
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("line"))))
    return items.groupBy(*keys).agg(some(F.lit(True)).alias("attempted"), some(~F.col("missed_after")).alias("covered"), some(F.col("deferred") & F.col("missed_after")).alias("deferred"))


def with_untouched(runs: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Runs (with ``status``) and the files with gaps that no run has, as ``untouched``."""
    rest = files.filter("line_missed > 0 OR branch_missed > 0").join(runs.select(name).distinct(), name, "left_anti")
    return runs.unionByName(rest.withColumn("status", F.lit("untouched")).select(*[c for c in [*files.columns, "status"] if c in runs.columns]), allowMissingColumns=True)


def file_status(accepted: Column, outcome: Column, open_lines: Column, open_branches: Column) -> Column:
    """completed, inprogress, rejected or untouched."""
    some = (F.size(open_lines) > 0) | (F.size(open_branches) > 0)
    return F.when(F.lower(F.trim(F.coalesce(outcome, F.lit("")))) == "untouched", "untouched").when(~F.coalesce(accepted, F.lit(False)), "rejected").when(some, "inprogress").otherwise("completed")


def status_note(status: Column, missed: Column, open_: Column, entries: Column, evidence: Column) -> Column:
    """What a reader is told of a file with ``missed`` gaps, ``open_`` ones and ledger ``entries``."""
    said = F.trim(F.coalesce(evidence, F.lit("")))
    done = F.when(missed == 0, "fully covered").when((open_ == 0) & (entries > 0), "what is left is deferred").otherwise("nothing actionable is left")
    return F.when(status == "completed", done).when(status == "inprogress", "lines or branches are still open").when(status == "rejected", F.coalesce(F.nullif(said, F.lit("")), F.lit("last run was not accepted"))).otherwise(said)


def run_note(evidence: Column, outcome: Column) -> Column:
    """``outcome: evidence``, or the one that is there."""
    return F.concat_ws(": ", F.nullif(F.trim(outcome), F.lit("")), F.nullif(F.trim(evidence), F.lit("")))


def searched(rows: DataFrame, query: str, columns: list[str], **allowed: list[str]) -> DataFrame:
    """Rows whose named columns are in the lists (an empty list allows all) and whose texts hold the query, case folded."""
    for column, values in allowed.items():
        rows = rows.filter(F.col(column).isin(*values)) if values else rows
    needle = query.strip().lower()
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle))) if needle else rows


def gap_text(missed: Column, branches: Column, methods: Column) -> Column:
    """A gap as one line of text; the arguments are range texts and an array of names."""
    return F.concat_ws("; ", F.concat(F.lit("lines "), missed), F.concat(F.lit("branches "), branches), F.when(F.size(methods) > 0, F.concat(F.lit("methods "), F.array_join(methods, ", "))))


def project_report(files: DataFrame, runs: DataFrame, entries: DataFrame) -> DataFrame:
    """The report's summary, one row.

    ``files`` (``module``, ``source_name``, ``line_covered``, ``line_missed``, ``branch_covered``, ``branch_missed``,
    ``status``, ``resolvable``) are counted where their source is resolvable, by module first; ``entries`` (``module``,
    ``source_name``, ``line``) credit missed lines of their module; ``runs`` have ``source_name``, ``accepted``, ``improved``.
    """
    here = files.filter("resolvable")
    modules = module_sums(here, ["line_covered", "line_missed", "branch_covered", "branch_missed"], {})
    deferred = entries.groupBy("module").agg(F.countDistinct("source_name", "line").alias("deferred"))
    modules = modules.join(deferred, "module", "left").withColumn("credited", F.least(F.coalesce("deferred", F.lit(0)), F.col("line_missed")))
    totals = modules.agg(F.count("*").alias("modules"), *[F.sum(c).alias(c) for c in ("files", "line_covered", "line_missed", "branch_covered", "branch_missed", "credited")])
    states = here.groupBy().pivot("status", ["covered", "actionable", "deferred_only", "no_exec"]).count().na.fill(0)
    run = runs.agg(F.count("*").alias("processed"), F.count_if("accepted").alias("accepted"), F.count_if("improved").alias("improved"))
    gaps = with_untouched(runs.select("source_name", F.lit("processed").alias("status")), here.select("source_name", "line_missed", "branch_missed"), "source_name")
    untouched = gaps.agg(F.count_if(F.col("status") == "untouched").alias("untouched"))
    one = F.lit(1).alias("_one")  # four tables of one row each
    out = reduce(lambda a, b: a.join(b.select(one, "*"), "_one"), (states, run, untouched), totals.select(one, "*")).drop("_one")
    total = F.col("line_covered") + F.col("line_missed")
    return out.withColumns({
        "acceptance_pct": ratio_pct(F.col("accepted"), F.col("processed") - F.col("accepted")), "line_pct": ratio_pct(F.col("line_covered"), F.col("line_missed")),
        "branch_pct": ratio_pct(F.col("branch_covered"), F.col("branch_missed")), "effective_pct": F.when(total > 0, F.bround(100 * (F.col("line_covered") + F.col("credited")) / total, 1)),
        "open_lines": F.col("line_missed") - F.col("credited"),
    })

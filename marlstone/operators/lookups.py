"""Lookups with precedence: cascades, pairings, ranked picks, budgets and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def cascade(rows: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """Adds ``value`` from the first source (unique by key) that has it, and ``found_in`` (its place from 1, 0 if none)."""
    names = [f"_v{n}" for n in range(len(sources))]
    out = reduce(lambda d, s: d.join(s[0].select(key, F.col(value).alias(s[1])), key, "left"), zip(sources, names), rows)
    place = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names, 1)], F.lit(0))
    return out.withColumns({value: F.coalesce(*names), "found_in": place}).drop(*names)


def fifo_pairs(calls: DataFrame, responses: DataFrame, keys: list[str], call: str, response: str) -> DataFrame:
    """Calls and responses of each key paired in order; what has no partner has null on its side."""
    n = lambda d, c: d.select(*keys, c, F.row_number().over(Window.partitionBy(*keys).orderBy(c)).alias("_n"))
    return n(calls, call).join(n(responses, response), [*keys, "_n"], "full_outer").drop("_n")


def best_ranked(rows: DataFrame, keys: list[str], value: str, preferred: list[str]) -> DataFrame:
    """Of each key the value that comes first in ``preferred``, else the smallest."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col(value)), F.lit(0).cast("long")), F.lit(len(preferred) + 1).cast("long"))
    return rows.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), F.col(value).alias(value))).alias("b")).select(*keys, f"b.{value}")


def within_budget(rows: DataFrame, keys: list[str], size: Column, budget: int, *order: Column) -> DataFrame:
    """Rows of each key in order while their sizes together fit the budget; adds ``used``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def majority(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The commonest value of each key; ``tie`` wins a tie in which it takes part, else the smallest value."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", (F.col(value) == tie).alias("t"))).alias("m"), F.collect_list(F.struct("n", value)).alias("all"))
    first = F.array_min(F.transform(F.filter("all", lambda x: x["n"] == F.col("m.n")), lambda x: x[value]))
    return best.select(*keys, F.when(F.col("m.t"), tie).otherwise(first).alias(value), F.col("m.n").alias("votes"))


def nearest_ancestor(paths: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """The deepest listed folder above each path; every ancestor is looked up by equality."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    exploded = paths.select(path, F.explode_outer(F.when(F.size(parts) > 1, above)).alias("_f"))
    hit = exploded.join(folders.select(F.col(folder).alias("_f")).distinct(), "_f")
    return paths.join(hit.groupBy(path).agg(F.max_by("_f", F.length("_f")).alias("ancestor")), path, "left")


def by_suffix(names: DataFrame, name: str, files: DataFrame, path: str) -> DataFrame:
    """Names (qualified) for which a file ends in their path: the last two parts are compared by equality."""
    tail = lambda c, sep: F.array_join(F.slice(F.split(c, sep), -2, 2), "/")
    stem = F.regexp_replace(F.col(path), "\\.[A-Za-z]+$", "")
    return names.join(files.select(tail(stem, "/").alias("_t")).distinct(), tail(F.col(name), "\\.") == F.col("_t"), "left_semi")


def callees(calls: DataFrame, functions: DataFrame, seeds: DataFrame, top: int = 4) -> DataFrame:
    """Functions (``source``, ``name``, ``lo``) that seed functions call in their own source, the first ``top`` by line, seeds left out."""
    own = calls.join(seeds.select("source", F.col("name").alias("caller")), ["source", "caller"], "left_semi")
    hit = functions.join(own.select("source", F.col("callee").alias("name")).distinct(), ["source", "name"], "left_semi").join(seeds.select("source", "name"), ["source", "name"], "left_anti")
    w = Window.partitionBy("source").orderBy("lo", "name")
    return hit.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top).drop("_n")


def tag_union(rows: DataFrame, tags: str, table: dict[str, list[str]]) -> DataFrame:
    """Adds ``needed``: the distinct items of all tags of a row, in the order of the table."""
    items = F.flatten(F.array(*[F.when(F.array_contains(tags, t), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for t, v in table.items()]))
    return rows.withColumn("needed", F.array_distinct(items))


def normal_tags(tags: Column, aliases: dict[str, str], allowed: list[str]) -> Column:
    """Lower-cased tags with aliases replaced; only allowed ones, each once."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    plain = F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, F.lower(F.trim(t))), F.lower(F.trim(t))))
    return F.array_distinct(F.filter(plain, lambda t: t.isin(*allowed)))


def render_tables(rows: DataFrame, tables: list[dict], tags: str, key: str) -> DataFrame:
    """The rows of the decision tables that apply to a row's tags as one text; a table without tags always applies."""
    parts = []
    for t in tables:
        lines = [" | ".join(t["columns"]), *(" | ".join(str(r.get(c, "")) for c in t["columns"]) for r in t["rows"])]
        applies = F.arrays_overlap(tags, F.array(*map(F.lit, t["when_any_tags"]))) if t.get("when_any_tags") else F.lit(True)
        parts.append(F.when(applies, F.lit("\n".join([t["title"], *lines]))))
    return rows.select(key, F.concat_ws("\n\n", *parts).alias("text"))


def tickets(issues: DataFrame, key: str) -> DataFrame:
    """Issues (``key``, ``code``, ``detail``, ``specific``) as tickets: a key with a specific issue shows no generic one of its code; equal ones show once."""
    w = Window.partitionBy(key, "code")
    seen = issues.withColumn("_s", F.max(F.col("specific").cast("int")).over(w)).filter("specific OR _s = 0")
    return seen.groupBy(key, "code", "detail").agg(F.count("*").alias("n"))


def ledger_rows(items: DataFrame, still_open: DataFrame, key: str, category: str) -> DataFrame:
    """Plan items (``key``, ``item``, ``lines``) that stay open as ledger rows: planned lines that are missed still."""
    j = items.join(still_open.select(key, F.col("lines").alias("_open")), key)
    left = j.withColumn("lines", F.array_sort(F.array_intersect("lines", "_open"))).filter(F.size("lines") > 0)
    return left.select(key, "item", "lines", F.lit(category).alias("category"))

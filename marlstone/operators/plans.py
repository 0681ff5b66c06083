"""Plan items: clamping, layers, tags, evidence, deferral and greedy chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def clamp_items(items: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Items (``key``, ``item``, ``lines``) cut to the allowed lines (``key``, ``lines``); emptied ones go, and
    allowed lines in no item become one more item, ``rest``."""
    allow = allowed.select(key, F.col("lines").alias("_allow"))
    cut = items.join(allow, key).withColumn("lines", F.array_sort(F.array_intersect("lines", "_allow"))).filter(F.size("lines") > 0)
    used = cut.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("_used"))
    left = allow.join(used, key, "left").select(key, F.lit("rest").alias("item"), F.array_sort(F.array_except("_allow", F.coalesce("_used", F.array().cast("array<int>")))).alias("lines"))
    return cut.select(key, "item", "lines").unionByName(left.filter(F.size("lines") > 0))


def exclusive_items(testable: DataFrame, deferred: DataFrame, key: str) -> DataFrame:
    """Testable items without the lines that any deferred item of the key has; emptied ones go."""
    gone = deferred.groupBy(key).agg(F.flatten(F.collect_list("lines")).alias("_gone"))
    j = testable.join(gone, key, "left")
    return j.withColumn("lines", F.array_sort(F.array_except("lines", F.coalesce("_gone", F.array().cast("array<int>"))))).filter(F.size("lines") > 0).drop("_gone")


def of_layer(items: DataFrame, layer: str) -> DataFrame:
    """Items of one layer; a blank layer is ``unit``."""
    return items.filter(F.coalesce(F.nullif(F.lower(F.trim("layer")), F.lit("")), F.lit("unit")) == layer)


def pending(entries: DataFrame, flag: str) -> DataFrame:
    """Entries that are not flagged yet; they keep their index."""
    return entries.filter(~F.coalesce(F.col(flag), F.lit(False)))


def tag_order(tag: Column, priority: list[str], default: str) -> tuple[Column, Column]:
    """The tag (``default`` if blank) and its place: listed ones first, in their order, then the others."""
    name = F.coalesce(F.nullif(F.lower(F.trim(tag)), F.lit("")), F.lit(default))
    place = F.array_position(F.array(*map(F.lit, priority)), name)
    return name, F.when(place > 0, place).otherwise(len(priority) + 1)


def split_items(items: DataFrame, max_lines: int) -> DataFrame:
    """Items cut to parts of at most ``max_lines`` of their ``lines``; adds ``part`` from 0."""
    parts = F.greatest(F.ceil(F.size("lines") / max_lines), F.lit(1)).cast("int")
    cut = items.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return cut.withColumn("lines", F.slice("lines", F.col("part") * max_lines + 1, F.lit(max_lines)))


def owner_of(methods: Column, enclosing: Column) -> Column:
    """The method that an item belongs to: its first one, else the enclosing function."""
    return F.coalesce(F.nullif(F.trim(F.try_element_at(methods, F.lit(1))), F.lit("")), enclosing, F.lit("<unknown>"))


def relabel_by_evidence(items: DataFrame, hits: DataFrame, keys: list[str], branch_hits: int = 1, line_hits: int = 2) -> DataFrame:
    """Items (``kind`` branch or line, ``exempt``) whose tests (``hits`` rows by key) cover them already become ``residual``.

    Branch items need ``branch_hits`` tests, line items ``line_hits``; exempt ones stay as they are.
    """
    n = hits.groupBy(*keys).agg(F.count("*").alias("_n"))
    j = items.join(n, keys, "left").withColumn("hits", F.coalesce("_n", F.lit(0))).drop("_n")
    enough = F.when(F.col("kind") == "branch", F.col("hits") >= branch_hits).otherwise(F.col("hits") >= line_hits)
    return j.withColumn("label", F.when(enough & ~F.coalesce(F.col("exempt"), F.lit(False)), "residual").otherwise("testable"))


def item_probes(lines: Column, branches: Column, category: Column, reason: Column) -> tuple[Column, Column]:
    """Missed lines and branch lines of a deferred item; without a list of branches, category and reason tell what its lines are."""
    none = F.array().cast("array<int>")
    as_branch = (F.trim(F.coalesce(category, F.lit(""))) == "kover_residual_branch") | F.lower(F.coalesce(reason, F.lit(""))).rlike("partial[- ]branch")
    own = F.array_sort(F.coalesce(lines, none))
    return F.when(branches.isNull() & as_branch, none).otherwise(own), F.when(branches.isNotNull(), F.array_sort(branches)).when(as_branch, own).otherwise(none)


def deferred_reason(reason: Column, category: Column, lines: Column, branches: Column) -> Column:
    """The reason of a deferred item; a blank one is made from its probes."""
    listed = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(name + " ["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]")))
    bits = F.coalesce(F.nullif(F.concat_ws(", ", listed("lines", lines), listed("branches", branches)), F.lit("")), F.lit("none"))
    made = F.concat(F.lit("Deferred ("), F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("not_unit_testable")), F.lit("): "), bits, F.lit(" marked not_testable by planner."))
    return F.coalesce(F.nullif(F.trim(reason), F.lit("")), made)


def defer_failures(items: DataFrame, tickets: DataFrame, key: str) -> DataFrame:
    """Items with ``label``: those with a ticket (``key``, ``code``) are deferred for the first code, others testable."""
    codes = tickets.groupBy(key).agg(F.min("code").alias("reason"))
    return items.join(codes, key, "left").withColumn("label", F.when(F.col("reason").isNotNull(), "deferred").otherwise("testable"))


def gap_items(gaps: DataFrame, reason: str, category: str, tag: str) -> DataFrame:
    """A plan from gaps (``source``, ``missed``, ``branches``): one item of lines and one of branches for each source that has them."""
    rows = lambda c, kind: gaps.filter(F.size(c) > 0).select("source", F.lit(kind).alias("kind"), F.col(c).alias("lines"), F.lit(reason).alias("reason"), F.lit(category).alias("category"), F.lit(tag).alias("tag"))
    return rows("missed", "line").unionByName(rows("branches", "branch"))


def greedy_chunks(items: DataFrame, key: str, order: str, size: str, max_items: int = 5, max_size: int = 30) -> DataFrame:
    """Items of each key put into chunks in order: a chunk closes before it would pass either limit.

    The state of a key is a few numbers, so rows stream by key and order; no group is held.
    """
    schema = f"`{key}` {dict(items.dtypes)[key]}, `{order}` {dict(items.dtypes)[order]}, `{size}` {dict(items.dtypes)[size]}, chunk int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, chunk, n, total = object(), 0, 0, 0
        for f in frames:
            out = []
            for k, s in zip(f[key], f[size]):
                if k != last:
                    last, chunk, n, total = k, 0, 0, 0
                elif n + 1 > max_items or total + s > max_size:
                    chunk, n, total = chunk + 1, 0, 0
                n, total = n + 1, total + s
                out.append(chunk)
            yield f.assign(chunk=out)

    return items.select(key, order, size).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def owner_chunks(items: DataFrame, key: str, tag: str, owner: str, order: str, max_items: int = 5, max_lines: int = 30, max_methods: int = 2) -> DataFrame:
    """Items (``key``, ``tag``, ``owner``, ``order``, ``lines``) of each key and tag put into chunks, owner by owner; adds ``part`` and ``chunk``, both from 0.

    Items of more than ``max_lines`` lines are cut first. Owners follow by their first line (0 without lines), then by
    name; an owner that would take the chunk past a limit of items, lines or owners begins the next. An owner past the
    limits alone has chunks of its own, filled item by item. Null or empty lines count as none and keep their item; a
    null owner is ``<unknown>``. Sizes of owners come from windows that spill; the state of a key is a few numbers.
    """
    rows = items.select(key, tag, F.coalesce(owner, F.lit("<unknown>")).alias(owner), order, F.coalesce("lines", F.array().cast("array<int>")).alias("lines"))
    cut = split_items(rows, max_lines).withColumn("_size", F.size("lines").cast("long"))
    w = Window.partitionBy(key, tag, owner)
    first = F.coalesce(F.min(F.array_min("lines")).over(w), F.lit(0))
    sized = cut.withColumns({"_first": first, "_items": F.count("*").over(w), "_lines": F.sum("_size").over(w)})
    kinds = dict(sized.dtypes)
    names = [key, tag, owner, order, "part", "lines"]
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", chunk int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last, alone = object(), object(), False
        chunk = n = total = owners = 0
        for f in frames:
            out = []
            for k, t, o, size, many, whole in zip(f[key], f[tag], f[owner], f["_size"], f["_items"], f["_lines"]):
                if (k, t) != group:
                    group, last, alone = (k, t), object(), False
                    chunk = n = total = owners = 0
                full = False
                if o != last:
                    big = many > max_items or whole > max_lines
                    full = alone or big or n + many > max_items or total + whole > max_lines or owners >= max_methods
                elif alone:
                    full = n + 1 > max_items or total + size > max_lines
                if n and full:
                    chunk, n, total, owners = chunk + 1, 0, 0, 0
                if o != last:
                    last, alone, owners = o, big, owners + 1
                n, total = n + 1, total + size
                out.append(chunk)
            yield f[names].assign(chunk=out)

    return sized.repartition(key, tag).sortWithinPartitions(key, tag, "_first", owner, order, "part").mapInPandas(run, schema)


def clamped_tags(items: DataFrame, tag: str, aliases: dict[str, str], allowed: list[str], public: Column, default: str = "plain_unit", invalid: str = "untagged_or_invalid_slice") -> DataFrame:
    """Items (``kind``, ``reason``, ``category``) with tags of the list; what fits nowhere is deferred.

    A tag is trimmed, lower-cased and replaced by its alias. A testable item with a tag outside ``allowed`` and ``default``
    gets ``default`` if it is ``public``; else it becomes ``not_testable`` with category ``invalid``, and that as its reason
    if it has none. Deferred items keep their tag, a blank one is ``default``.
    """
    table = F.create_map(*[F.lit(x) for kv in {"": "", **aliases}.items() for x in kv])
    plain = F.lower(F.trim(F.coalesce(F.col(tag), F.lit(""))))
    name = F.coalesce(F.try_element_at(table, plain), plain)
    testable, fits = F.col("kind") == "testable", name.isin(default, *allowed)
    lost = testable & ~fits & ~F.coalesce(public, F.lit(False))
    new_tag = F.when(testable, F.when(fits, name).otherwise(default)).otherwise(F.when(name == "", default).otherwise(name))
    return items.withColumns({
        "kind": F.when(lost, "not_testable").otherwise(F.col("kind")), "reason": F.when(lost, F.coalesce(F.nullif("reason", F.lit("")), F.lit(invalid))).otherwise(F.col("reason")),
        "category": F.when(lost, invalid).otherwise(F.col("category")), tag: new_tag,
    })

"""Plan documents: items from YAML front matter, else from the pipe tables of numbered sections."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marlstone.functions.numbers import int_set
from marlstone.functions.tables import cell, cell_places, number_cell, pipe_rows, section_of, sections, word_cell
from marlstone.functions.texts import front_matter, stripped

_TEXTS, _LISTS = ("approach", "fixture_hint", "reason", "category", "tag", "test_layer"), ("lines", "methods", "risks", "tc_ids", "branch_targets")
_ROW = "struct<" + ", ".join([f"{n}: string" for n in _TEXTS] + [f"{n}: array<string>" for n in _LISTS]) + ">"
FRONT = f"recipe_lane string, recipe_id string, testable array<{_ROW}>, not_testable array<{_ROW}>"
# The sections that hold the tables, today's number before the older one, and the category of an item without one.
TESTABLE_SECTIONS, DEFERRED_SECTIONS, DEFERRED = (3, 7), (4, 13), "not_unit_testable"
# The steps of a test case and the headers of both tables.
_STEPS = ("scenario", "given", "when", "then", "assertions")
_TEST_CELLS = {"lines": "kover lines", "branch": "branch target", "id": "id", "tag": "tag", **{n: n for n in _STEPS}}
_DEFERRED_CELLS = {"lines": "kover lines", "methods": "methods", "category": "category", "reason": "reason", "tag": "tag"}


# Texts of which the C parser of YAML gives what the Python one gives: the two differ in tabs, byte order marks and bare tags. Long ones could nest too deep for its stack.
_PLAIN_YAML = re.compile(r"[\n \"-~]{1,20000}")


def _as_json(text: str | None) -> str | None:
    """A YAML mapping as JSON with the fields of ``FRONT``; null for anything else."""
    import yaml

    try:
        fast = getattr(yaml, "CSafeLoader", None) if text and _PLAIN_YAML.fullmatch(text) else None
        meta = yaml.load(text, Loader=fast or yaml.SafeLoader) if text else None
    except (yaml.YAMLError, ValueError):
        return None
    if not isinstance(meta, dict):
        return None
    plain = lambda v: "" if v is None else str(v)
    many = lambda v: [str(x) for x in v if plain(x).strip()] if isinstance(v, list) else []
    rows = lambda v: [{**{n: plain(r.get(n)) for n in _TEXTS}, **{n: many(r.get(n)) for n in _LISTS}} for r in v if isinstance(r, dict)] if isinstance(v, list) else []
    return json.dumps({"recipe_lane": plain(meta.get("recipe_lane")), "recipe_id": plain(meta.get("recipe_id")), "testable": rows(meta.get("testable")), "not_testable": rows(meta.get("not_testable"))})


@F.pandas_udf(StringType())
def yaml_as_json(texts: pd.Series) -> pd.Series:
    return texts.map(_as_json)


def _item(kind: str, r: dict[str, Column]) -> Column:
    order = ("lines", "methods", "approach", "fixture_hint", "reason", "category", "tag", "tc_ids", "branch_targets", "test_layer")
    return F.struct(F.lit(kind).alias("kind"), *[r[n].alias(n) for n in order])


def _listed(text: Column, head: str, mark: str) -> Column:
    """What stands behind ``head`` between the marks; empty for a text that does not begin so."""
    parts = F.filter(F.transform(F.split(F.substring(text, F.lit(len(head) + 1), F.length(text)), mark), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.startswith(head), parts).otherwise(F.array().cast("array<string>"))


def _front_items(kind: str, rows: Column) -> Column:
    """Items of the front matter; older ones keep tickets and branches as heads of other fields."""
    text = lambda row, n: F.coalesce(row[n], F.lit(""))
    some = lambda row, n: F.coalesce(row[n], F.array().cast("array<string>"))
    made = lambda said, head, values, mark: F.when(said != "", said).when(F.size(values) > 0, F.concat(F.lit(head), F.array_join(values, mark))).otherwise("")
    either = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    lean = lambda r: F.struct(*[text(r, n).alias(n) for n in ("reason", "category", "tag")], *[some(r, n).alias(n) for n in _LISTS], *[stripped(text(r, n)).alias(n) for n in ("approach", "fixture_hint", "test_layer")])
    full = lambda r: F.struct(r.alias("r"), made(r["approach"], "branch: ", r["branch_targets"], "; ").alias("approach"), made(r["fixture_hint"], "tickets: ", r["tc_ids"], ", ").alias("fixture"))

    def item(x: Column) -> Column:
        r = x["r"]
        category = F.when(r["category"] == "", DEFERRED).otherwise(r["category"]) if kind == "not_testable" else r["category"]
        return _item(kind, {
            "lines": int_set(r["lines"]), "methods": r["methods"], "approach": x["approach"], "fixture_hint": x["fixture"], "reason": r["reason"], "category": category, "tag": r["tag"],
            "tc_ids": either(r["tc_ids"], _listed(x["fixture"], "tickets: ", ",")), "branch_targets": either(r["branch_targets"], _listed(x["approach"], "branch: ", ";")), "test_layer": F.lower(r["test_layer"]),
        })

    return F.transform(F.transform(F.transform(rows, lean), full), item)


def _table_rows(rows: Column, places: Column, names: dict[str, str]) -> Column:
    """The rows behind the first that list a line, as structs of their named cells and ``lines``."""
    texts = lambda r: [cell(r, places[n]).alias(n) for n in names if n != "lines"]
    named = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.struct(number_cell(cell(r, places["lines"])).alias("lines"), *texts(r)))
    return F.filter(named, lambda r: F.size(r["lines"]) > 0)


def _test_item(r: Column) -> Column:
    """An item of the table of test cases."""
    said = lambda n: F.when(r[n] == "", "N/A").otherwise(r[n])
    # Fixed value: the numbered steps of an approach.
    steps = F.concat_ws("\n", *[F.concat(F.lit(f"{k}. {name.capitalize()}: "), said(name)) for k, name in enumerate(_STEPS, 1)])
    none = F.array().cast("array<string>")
    return _item("testable", {
        "lines": r["lines"], "methods": none, "approach": F.concat(F.when(r["branch"] == "", "").otherwise(F.concat(F.lit("branch: "), r["branch"], F.lit("\n"))), steps),
        "fixture_hint": F.when(r["id"] == "", "").otherwise(F.concat(F.lit("tickets: "), r["id"])), "reason": F.lit(""), "category": F.lit(""), "tag": r["tag"],
        "tc_ids": F.when(r["id"] == "", none).otherwise(F.array(r["id"])), "branch_targets": none, "test_layer": F.lit(""),
    })


def _deferred_item(r: Column) -> Column:
    """An item of the table of deferred lines."""
    none = F.array().cast("array<string>")
    category = F.when(r["category"] == "", DEFERRED).otherwise(r["category"])
    # Fixed value: the reason of a row without one.
    made = F.concat(F.lit("Deferred ("), category, F.lit("): lines ["), F.array_join(r["lines"].cast("array<string>"), ", "), F.lit("] marked not_testable in Section 13."))
    return _item("not_testable", {
        "lines": r["lines"], "methods": word_cell(r["methods"]), "approach": F.lit(""), "fixture_hint": F.lit(""), "reason": F.when(r["reason"] == "", made).otherwise(r["reason"]), "category": category,
        "tag": r["tag"], "tc_ids": none, "branch_targets": none, "test_layer": F.lit(""),
    })


def parsed_plans(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``parsed``, ``fallback_reason``, ``body``, ``recipe_lane``, ``recipe_id`` and ``items`` of each document, in its order.

    Front matter that is a mapping gives the items, even if it has none; else the tables do: test cases first, then
    deferred lines, rows without a line number left out. A null or blank text is a missing plan; other columns are
    dropped; repeated documents give repeated rows.
    """
    d = documents.select(F.col(key), stripped(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    d = d.withColumn("_meta", F.from_json(yaml_as_json(F.nullif(front_matter(F.col("body")), F.lit(""))), FRONT))
    rest = F.regexp_replace("body", r"(?s)^---\s*\n.*?\n---\s*(?:\n|$)", "")
    section = lambda numbers: F.coalesce(*[section_of(F.col("_parts"), n) for n in numbers])
    # Columns and passes of their own hold what is used several times.
    d = d.withColumn("_parts", F.when(F.col("_meta").isNull(), sections(rest)))
    d = d.withColumns({"_a": pipe_rows(section(TESTABLE_SECTIONS)), "_b": pipe_rows(section(DEFERRED_SECTIONS))})
    d = d.withColumns({"_at": cell_places(F.col("_a"), _TEST_CELLS), "_bt": cell_places(F.col("_b"), _DEFERRED_CELLS)})
    tables = F.concat(F.transform(_table_rows(F.col("_a"), F.col("_at"), _TEST_CELLS), _test_item), F.transform(_table_rows(F.col("_b"), F.col("_bt"), _DEFERRED_CELLS), _deferred_item))
    front = F.concat(_front_items("testable", F.col("_meta.testable")), _front_items("not_testable", F.col("_meta.not_testable")))
    d = d.withColumn("items", F.when(F.col("_meta").isNotNull(), front).otherwise(tables))
    parsed = F.col("_meta").isNotNull() | (F.size("items") > 0)
    reason = F.when(parsed, "").when(F.col("body") == "", "missing markdown plan").otherwise("missing or invalid YAML frontmatter")
    return d.select(key, parsed.alias("parsed"), reason.alias("fallback_reason"), "body", F.coalesce("_meta.recipe_lane", F.lit("")).alias("recipe_lane"), F.coalesce("_meta.recipe_id", F.lit("")).alias("recipe_id"), "items")


def plan_items(plans: DataFrame, key: str) -> DataFrame:
    """The items of parsed plans as rows with their place ``pos``."""
    # The outer form adds no filter on the size of the items, which would parse the documents once more.
    return plans.select(key, F.posexplode_outer("items").alias("pos", "i")).filter("pos IS NOT NULL").select(key, "pos", "i.*")

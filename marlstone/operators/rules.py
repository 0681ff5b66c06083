"""Rules over texts, compiled to columns.

A rule is a mapping: ``id``, ``message`` and ``when``, a mapping of condition keys to lists or single values. All
conditions of a rule hold together; a rule without conditions matches every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(value) -> list:
    """Nothing, one value or a list of values as a list."""
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def _flags(when: dict) -> str:
    names = {"I": "i", "M": "m", "S": "s"}
    letters = "".join(names[f] for f in when.get("flags", []) if f in names)
    return f"(?{letters})" if letters else ""


def context_matches(wanted: dict, context: Column) -> Column:
    """Equality with a map column; keys ending in _true, _false or _any test truth, falsehood or membership."""
    out = F.lit(True)
    for key, value in wanted.items():
        if key.endswith("_true"):
            out = out & F.coalesce(F.try_element_at(context, F.lit(key[:-5])) == "true", F.lit(False))
        elif key.endswith("_false"):
            out = out & F.coalesce(F.try_element_at(context, F.lit(key[:-6])) != "true", F.lit(True))
        elif key.endswith("_any"):
            out = out & F.coalesce(F.try_element_at(context, F.lit(key[:-4])).isin(*as_list(value)), F.lit(False))
        else:
            out = out & F.coalesce(F.try_element_at(context, F.lit(key)) == str(value), F.lit(False))
    return out


def rule_column(when: dict, test: Column, source: Column, context: Column | None = None) -> Column:
    """The boolean column of one rule's conditions. Null texts count as empty."""
    test, source, mode = F.coalesce(test, F.lit("")), F.coalesce(source, F.lit("")), _flags(when)
    when = {k: v if k in ("ctx", "flags") else as_list(v) for k, v in when.items()}
    regex = lambda c, ps: [c.rlike(mode + p) for p in ps]
    holds = lambda c, ts: [F.contains(c, F.lit(t)) for t in ts]
    every = {
        "test": regex(test, when.get("test", [])), "test_all": regex(test, when.get("test_all", [])), "test_contains": holds(test, when.get("test_contains", [])),
        "source_all": holds(source, when.get("source_all", [])), "source_contains": holds(source, when.get("source_contains", [])),
    }
    some = {
        "test_any": regex(test, when.get("test_any", [])), "source": regex(source, when.get("source", [])),
        "test_contains_any": holds(test, when.get("test_contains_any", [])), "source_any": holds(source, when.get("source_any", [])),
    }
    none = [
        *regex(test, when.get("test_not", [])), *regex(source, when.get("source_not", [])),
        *holds(test, [*when.get("test_not_contains", []), *when.get("test_not_contains_any", [])]),
        *holds(source, [*when.get("source_not_any", []), *when.get("source_not_contains", [])]),
    ]
    out = F.lit(True)
    for conditions in every.values():
        for c in conditions:
            out = out & c
    for conditions in some.values():
        if conditions:
            any_ = conditions[0]
            for c in conditions[1:]:
                any_ = any_ | c
            out = out & any_
    for c in none:
        out = out & ~c
    if when.get("ctx") and context is not None:
        out = out & context_matches(when["ctx"], context)
    return out


def run_rules(docs: DataFrame, rules: list[dict], keys: list[str], test: str, source: str | None = None, context: str | None = None) -> DataFrame:
    """One row for each rule that a document matches: keys, ``rule_ord``, ``rule``, ``message``.

    All rules are columns of one pass over the documents; a matching rule with ``stop`` hides those behind it.
    """
    hits, stopped = [], F.lit(False)
    for n, rule in enumerate(rules):
        match = rule_column(rule.get("when", {}), F.col(test), F.col(source) if source else F.lit(""), F.col(context) if context else None) & ~stopped
        hits.append(F.when(match, F.struct(F.lit(n).alias("rule_ord"), F.lit(rule["id"]).alias("rule"), F.lit(rule.get("message", "")).alias("message"))))
        if rule.get("stop"):
            stopped = stopped | match
    return docs.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("r")).select(*keys, "r.*")


def select_by_triggers(docs: DataFrame, triggers: list[tuple[str, str]], key: str, text: str, default: str, top: int) -> DataFrame:
    """The first ``top`` names whose needle a text holds (case folded), in the order of the triggers; ``default`` if none."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(needle.lower())), F.lit(name)) for needle, name in triggers])))
    chosen = F.slice(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default))), 1, top)
    return docs.select(key, F.posexplode(chosen).alias("rank", "name"))


def ranked_selection(docs: DataFrame, key: str, text: str, tags: str, by_tag: dict[str, str], by_needle: list[tuple[tuple[str, ...], str]], top: int, default: str | None = None, pin: str | None = None) -> DataFrame:
    """The first ``top`` names of a row with their ``rank`` from 0: those of its tags in their order, then those of needles in the rules' order.

    A needle may stand in the text or in a tag, case folded. Tags are trimmed. A row whose column ``pin`` is one of the names
    has that name first. ``default`` stands for a row that selects nothing; without it such a row is left out. Null texts
    and tags hold nothing; one pass, no shuffle.
    """
    own = F.filter(F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    table = F.create_map(*[F.lit(x) for kv in by_tag.items() for x in kv]) if by_tag else F.lit(None).cast("map<string,string>")
    d = docs.withColumns({"_tags": own, "_hay": F.lower(F.concat_ws("\n", F.coalesce(F.col(text), F.lit("")), F.array_join(own, " ")))})
    found = [F.when(F.exists(F.array(*map(F.lit, (n.lower() for n in needles))), lambda n: F.contains(F.col("_hay"), n)), F.lit(name)) for needles, name in by_needle]
    names = sorted({*by_tag.values(), *(name for _, name in by_needle), *([default] if default else [])})
    pinned = F.array(F.when(F.col(pin).isin(*names), F.col(pin))) if pin else F.array().cast("array<string>")
    chosen = F.array_distinct(F.array_compact(F.concat(pinned, F.transform("_tags", lambda t: F.try_element_at(table, t)), F.array(*found).cast("array<string>"))))
    if default:
        chosen = F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.lit(default)))
    return d.select(key, F.posexplode(F.slice(chosen, 1, top)).alias("rank", "name"))

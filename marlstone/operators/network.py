"""Ordered stages of rules over shared conditions.

All distinct conditions of all rules become one array of booleans, computed in one pass; rules and stages are logic over
its places. Stages have an order, may be skipped for some paths, hide their own later rules behind a matching rule with
``stop``, and hide all later stages behind a match if they ``end`` the run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.rules import as_list, context_matches

# Condition key: (text, by pattern, how its values combine).
KEYS = {
    "test": ("test", True, "all"), "test_all": ("test", True, "all"), "test_any": ("test", True, "any"), "test_not": ("test", True, "none"),
    "test_contains": ("test", False, "all"), "test_contains_any": ("test", False, "any"), "test_not_contains": ("test", False, "none"), "test_not_contains_any": ("test", False, "none"),
    "source": ("source", True, "any"), "source_not": ("source", True, "none"), "source_all": ("source", False, "all"), "source_contains": ("source", False, "all"),
    "source_any": ("source", False, "any"), "source_not_any": ("source", False, "none"), "source_not_contains": ("source", False, "none"),
}


@dataclass
class Stage:
    """Rules (``id``, ``when``, ``message``, ``stop``) under a name; ``skip`` holds parts of paths that the stage does not judge."""

    name: str
    rules: list[dict]
    skip: tuple[str, ...] = ()
    ends: bool = False


@dataclass
class Network:
    """The distinct conditions of some stages and their places."""

    stages: list[Stage]
    places: dict[tuple, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for stage in self.stages:
            for part in stage.skip:
                self.place(("path", False, part, ""))
            for rule in stage.rules:
                for key, values in rule.get("when", {}).items():
                    if key in KEYS:
                        for v in as_list(values):
                            self.place(self.condition(key, v, rule["when"]))

    def condition(self, key: str, value: str, when: dict) -> tuple:
        text, pattern, _ = KEYS[key]
        letters = {c.lower() for f in as_list(when.get("flags")) for c in f if c in "IMS"}
        flags = "".join(sorted(letters)) if pattern else ""
        return text, pattern, value, flags

    def place(self, condition: tuple) -> int:
        return self.places.setdefault(condition, len(self.places))

    def conditions(self, texts: dict[str, Column]) -> Column:
        """All distinct conditions as one array; null texts count as empty."""
        out = []
        for text, pattern, value, flags in self.places:
            c = F.coalesce(texts.get(text, F.lit("")), F.lit(""))
            out.append(c.rlike((f"(?{flags})" if flags else "") + value) if pattern else F.contains(c, F.lit(value)))
        return F.array(*out) if out else F.array().cast("array<boolean>")

    def match(self, when: dict, met: Column, context: Column | None) -> Column:
        out = F.lit(True)
        for key, values in when.items():
            if key not in KEYS:
                continue
            places = [met[self.places[self.condition(key, v, when)]] for v in as_list(values)]
            how = KEYS[key][2]
            if how == "any" and places:
                some = places[0]
                for p in places[1:]:
                    some = some | p
                out = out & some
            for p in places if how != "any" else []:
                out = out & (p if how == "all" else ~p)
        if when.get("ctx") and context is not None:
            out = out & context_matches(when["ctx"], context)
        return out

    def run(self, docs: DataFrame, keys: list[str], test: str, source: str | None = None, path: str | None = None, context: str | None = None) -> DataFrame:
        """One row for each issue: keys, ``stage_ord``, ``stage``, ``rule_ord``, ``rule``, ``message``."""
        texts = {n: F.col(c) for n, c in (("test", test), ("source", source), ("path", path)) if c}
        more = [F.col(context).alias("_context")] if context else []
        met = docs.select(*keys, self.conditions(texts).alias("_met"), *more)
        hits, ended = [], F.lit(False)
        for n, stage in enumerate(self.stages):
            skipped, stopped, any_ = ended, F.lit(False), F.lit(False)
            for part in stage.skip:
                skipped = skipped | F.col("_met")[self.places[("path", False, part, "")]]
            for m, rule in enumerate(stage.rules):
                match = self.match(rule.get("when", {}), F.col("_met"), F.col("_context") if context else None)
                shown = F.struct(F.lit(n).alias("stage_ord"), F.lit(stage.name).alias("stage"), F.lit(m).alias("rule_ord"), F.lit(str(rule.get("id", m))).alias("rule"), F.lit(rule.get("message", "")).alias("message"))
                hits.append(F.when(match & ~stopped & ~skipped, shown))
                stopped = stopped | match if rule.get("stop") else stopped
                any_ = any_ | match
            if stage.ends:
                ended = ended | (any_ & ~skipped)
        if not hits:
            return met.select(*keys, F.explode(F.array().cast("array<struct<stage_ord:int,stage:string,rule_ord:int,rule:string,message:string>>")).alias("h")).select(*keys, "h.*")
        return met.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(*keys, "h.*")


def undeclared_calls(calls: DataFrame, owners: DataFrame, declared: DataFrame) -> DataFrame:
    """Calls (``doc``, ``variable``, ``name``) on variables of known types (``doc``, ``variable``, ``type``) that the type (``type``, ``name``) does not declare.

    Types of which nothing is declared are not judged.
    """
    typed = calls.join(owners.select("doc", "variable", "type").distinct(), ["doc", "variable"])
    judged = typed.join(declared.select("type").distinct(), "type", "left_semi")
    return judged.join(declared.select("type", "name").distinct(), ["type", "name"], "left_anti").select("doc", "variable", "type", "name").distinct()


def calls_out_of_context(calls: DataFrame, special: DataFrame, spans: DataFrame) -> DataFrame:
    """Calls (``doc``, ``name``, ``line``) of special functions (``name``) that no span (``doc``, ``lo``, ``hi``) of their document holds."""
    own = calls.join(special.select("name").distinct(), "name", "left_semi")
    lines = spans.select("doc", F.explode(F.sequence("lo", "hi")).alias("line")).distinct()
    return own.join(lines, ["doc", "line"], "left_anti").select("doc", "name", "line").distinct()


def still_open(issues: DataFrame, satisfied: DataFrame, keys: list[str]) -> DataFrame:
    """Issues without those that the present state satisfies, by ``keys``; null keys are never satisfied."""
    return issues.join(satisfied.select(*keys).distinct(), keys, "left_anti")


def fingerprint(code: Column, detail: Column) -> Column:
    """What two tickets agree in if they say the same: the code and the detail without case, numbers and spacing."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(detail, F.lit(""))), r"\d+", "#"), r"\s+", " "))
    return F.md5(F.concat_ws("|", F.lower(code), plain).cast("binary"))


def merged_tickets(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Tickets (``key``, ``code``, ``detail``, ``specific``) of several sources as one list.

    Equal fingerprints show once, with the first source that has them and how many there were. A specific ticket
    hides the generic ones of its key and code in all sources. Null specific is generic.
    """
    parts = [df.select(key, "code", "detail", F.coalesce("specific", F.lit(False)).alias("specific"), F.lit(n).alias("source_ord"), F.lit(name).alias("source")) for n, (name, df) in enumerate(sources)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("fingerprint", fingerprint(F.col("code"), F.col("detail")))
    hiding = every.filter("specific").select(key, "code").distinct().withColumn("specific", F.lit(False))
    shown = every.join(hiding, [key, "code", "specific"], "left_anti")
    return shown.groupBy(key, "code", "fingerprint").agg(F.min(F.struct("source_ord", "source", "detail", "specific")).alias("_t"), F.count("*").alias("n")).select(key, "code", "fingerprint", "_t.source", "_t.detail", "_t.specific", "n")

"""Checks of plans that give tickets: rules over texts, lanes and layers, compiled to one pass over the plans."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.texts import stripped


@dataclass(frozen=True)
class PlanRule:
    """A ticket ``code`` for texts that hold one of ``words`` (as whole words) and none of ``unless``.

    ``lanes`` are the lanes it holds for, ``lane_heads`` and ``lane_parts`` what a lane begins with or holds (all that are
    given must hold). With a ``layer`` the rule looks at the testable items of that layer, else at the plan's text.
    ``private`` looks for asserted private members instead of words.
    """

    code: str
    message: str
    hint: str = ""
    words: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    lanes: tuple[str, ...] = ()
    lane_heads: tuple[str, ...] = ()
    lane_parts: tuple[str, ...] = ()
    layer: str = ""
    private: bool = False


# Private members that no plan may name, and the codes and words of the rules.
PRIVATE_MEMBERS = ("binding", "viewModel", "adapter", "presenter")
PRIVATE_READ = "getDeclaredField"
PLAIN_LANES = ("robolectric_non_hilt", "plain_jvm")
RULES = (
    PlanRule("plan_private_field_assert", "the plan asserts private fields", "assert public members only", private=True),
    PlanRule("plan_placeholder_host", "the plan names a placeholder host", "use the host of the module", words=("HostActivity",), lane_heads=("hilt_",)),
    PlanRule("plan_placeholder_host", "the plan names a placeholder host", "use the plain host", words=("HostActivity",), lane_heads=("!hilt_",)),
    PlanRule("plan_wrong_harness_lane", "a plain lane uses an injected host", "leave hosts and annotations of injection out", words=("HiltTestActivity", "@HiltAndroidTest", "HiltAndroidRule", "HiltTestApplication", "@BindValue"), lanes=PLAIN_LANES),
    PlanRule("plan_wrong_harness_lane", "an injected fragment lane attaches without its host", "attach to the host of the lane", words=("launchFragmentInContainer",), unless=("HostActivity",), lane_heads=("hilt_",), lane_parts=("hilt_fragment",)),
    PlanRule("plan_layer_harness_mismatch", "an instrumented item names a unit harness", "follow the layer of the item", words=("RobolectricTestRunner", "@Config(application"), layer="instrumented"),
    PlanRule("plan_layer_harness_mismatch", "a unit item names an instrumented harness", "follow the layer of the item", words=("ActivityScenario.launch", "@HiltAndroidTest"), lane_parts=("plain_jvm",), layer="unit"),
)


def holds_word(text: Column, words: tuple[str, ...]) -> Column:
    """True if one of the words stands in the text and no letter, digit or underscore continues it."""
    one = lambda w: (r"(?<!\w)" if w[0].isalnum() else "") + re.escape(w) + (r"(?!\w)" if w[-1].isalnum() else "")
    return text.rlike("|".join(map(one, words))) if words else F.lit(False)


def asserts_private(text: Column) -> Column:
    """True if a checking call takes a private member, one of ``PRIVATE_MEMBERS`` is reached, or fields are read by name."""
    arguments = F.regexp_extract_all(text, F.lit(r"(?:assert|verify)\w*\s*\(([^)\n]*)"), F.lit(1))
    reached = holds_word(text, tuple("._" + m for m in PRIVATE_MEMBERS))
    return F.exists(arguments, lambda a: a.rlike(r"\._[A-Za-z_]")) | reached | text.rlike(re.escape(PRIVATE_READ) + r"\s*\(")


def _lane_fits(rule: PlanRule, lane: Column) -> Column:
    heads = [~lane.startswith(h[1:]) if h.startswith("!") else lane.startswith(h) for h in rule.lane_heads]
    fits = F.lit(True)
    for c in [*heads, *[F.contains(lane, F.lit(p)) for p in rule.lane_parts], *([lane.isin(*rule.lanes)] if rule.lanes else [])]:
        fits = fits & c
    return fits


def _ticket(code: str, message: str | Column, hint: str, lines: Column | None = None, severity: str = "error") -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), text.alias("message"), F.lit(hint).alias("hint"), (F.array().cast("array<int>") if lines is None else lines).alias("lines"))


def plan_tickets(plans: DataFrame, key: str, rules: tuple[PlanRule, ...] = RULES) -> DataFrame:
    """Tickets of plans (``key``, ``body``, ``items`` of ``plan_documents``, ``recipe_lane``, ``allow``): ``key``, ``pos``, ``code`` and the rest.

    A plan without text (its body, else what its items say) and without testable items has the one ticket ``plan_empty``.
    Testable items with lines outside ``allow`` (null or empty allows all) have a ticket with those lines. Tickets stand
    in the order of the rules of plans, then lines, then the rules of items; equal ones are not merged. Null texts, lanes
    and arrays are empty.
    """
    blank = F.lit("")
    items = F.coalesce(F.col("items"), F.array().cast(plans.schema["items"].dataType))
    said = F.array_join(F.flatten(F.transform(items, lambda i: F.array(i["approach"], i["fixture_hint"], i["reason"]))), "\n")
    body = F.when(stripped(F.coalesce("body", blank)) != "", F.col("body")).otherwise(said)
    p = plans.select(key, body.alias("_text"), F.filter(items, lambda i: i["kind"] == "testable").alias("_items"), F.coalesce("recipe_lane", blank).alias("_lane"), F.coalesce("allow", F.array().cast("array<int>")).alias("_allow"))
    text, lane = F.col("_text"), F.col("_lane")

    def fires(rule: PlanRule, where: Column) -> Column:
        found = asserts_private(where) if rule.private else holds_word(where, rule.words) & ~holds_word(where, rule.unless)
        return found & _lane_fits(rule, lane)

    whole = F.array_compact(F.array(*[F.when(fires(r, text), _ticket(r.code, r.message, r.hint)) for r in rules if not r.layer]))
    strange = F.transform(F.col("_items"), lambda i: F.when(F.size("_allow") > 0, F.array_except(i["lines"], F.col("_allow"))))
    outside = F.transform(F.filter(strange, lambda x: F.size(x) > 0), lambda x: _ticket("plan_lines_outside_delta", "testable lines outside of the allowed ones", "keep missed lines only", x))
    of_item = lambda i: F.concat_ws("\n", i["approach"], i["fixture_hint"])
    each = F.flatten(F.transform("_items", lambda i: F.array_compact(F.array(*[F.when((F.lower(F.trim(i["test_layer"])) == r.layer) & fires(r, of_item(i)), _ticket(r.code, r.message, r.hint)) for r in rules if r.layer]))))
    empty = (stripped(text) == "") & (F.size("_items") == 0)
    every = F.when(empty, F.array(_ticket("plan_empty", "the plan is empty", ""))).otherwise(F.concat(whole, outside, each))
    return p.select(key, F.posexplode(every).alias("pos", "t")).select(key, "pos", "t.*")

"""Facts that patterns can tell about source texts, build files and task lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.lexer import facts, names_of

# Types whose getInstance says nothing, and receivers that are no project objects.
COMMON_INSTANCES = "MessageDigest KeyGenerator KeyPairGenerator Cipher Mac SecureRandom Calendar Currency Locale Logger Executors".split()
COMMON_RECEIVERS = (
    "BuildConfig Bundle Dispatchers Intent Log R Result System Unit Uri UUID TextUtils View Collections Arrays Objects String Integer Boolean Long Math File Paths Files"
    " Pattern Locale TimeUnit Duration Instant JSONObject JSONArray CarUi Navigation NavDeepLinkRequest FirebaseAnalytics FirebaseInstallations FirebaseCrashlytics"
    " FirebaseAuth FirebaseMessaging FirebaseApp Robolectric Shadows ShadowLooper ArgumentMatchers Mockito Matchers"
).split()
# How the names of build tasks begin and end, by kind in order of precedence.
TASK_KINDS = [
    ("unit_test", [("test", "UnitTest")]),
    ("android_test", [("connected", "AndroidTest")]),
    ("jacoco", [("create", "CoverageReport"), ("jacoco", "Report")]),
]
ANY_CASE = ("jacoco",)
LISTED_TASKS = {"android_test": ("connected", "AndroidTest", 1), "compile_android_test": ("compile", "AndroidTestKotlin", 1), "unit_test": ("test", "UnitTest", 0)}


def quoted_after(word: str) -> str:
    """A pattern for the first quoted value that a build text gives to a word, with or without a sign between them."""
    return rf"(?<!\w){word}[ \t]*[=(]?[ \t]*[\"']([^\"'\n]+)[\"']"


NAMESPACE_PATTERNS = (quoted_after("namespace"),)


def found_all(text: Column, pattern: str, group: int = 1) -> Column:
    """The distinct matches of a group in order; none for a null text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)))


def import_names(text: Column) -> Column:
    """Imported names in order, each once; wildcards keep their ``.*``, aliases are left out."""
    return found_all(text, r"(?m)^\s*import\s+([A-Za-z_]\w*(?:\.\w+)*(?:\.\*)?)")


def declared_names(text: Column) -> Column:
    """Names of top-level classes, interfaces, objects and functions: those that begin a line."""
    return found_all(text, r"(?m)^(?:(?:public|internal|private|open|abstract|sealed|data|enum|suspend|inline)\s+)*(?:class|interface|object|fun)\s+([A-Za-z_]\w*)")


def without_line_comments(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)//[^\n]*$", "")


def declares_only(text: Column) -> Column:
    """True for a source with an interface and nothing that runs: no object or enum class, no function with a body."""
    body = without_line_comments(text)
    bodies = F.regexp_extract_all(body, F.lit(r"\bfun\b[^{;\n]*\{([^}]*)\}"), F.lit(1))
    return body.rlike(r"\binterface\b") & ~body.rlike(r"\b(object|enum\s+class)\b") & ~F.exists(bodies, lambda b: F.regexp_replace(b, r"\s+", "") != "")


def instance_types(text: Column) -> Column:
    """Types on which ``getInstance`` is called, without those of the platform."""
    return F.array_except(names_of(facts(text), "instance"), F.array(*map(F.lit, COMMON_INSTANCES)))


def receiver_types(text: Column) -> Column:
    """Capitalised receivers of member accesses, without those of the platform."""
    return F.array_except(names_of(facts(text), "receiver"), F.array(*map(F.lit, COMMON_RECEIVERS)))


def static_mock_types(text: Column) -> Column:
    """Map of variables that hold mocked statics to the simple name of the mocked type; the last one of a name counts."""
    kind = lambda f: F.substring_index(F.substring_index(f["detail"], "<", 1), ".", -1)
    mocks = F.filter(facts(text), lambda f: (f["kind"] == "property") & (kind(f) == "MockedStatic") & F.contains(f["detail"], F.lit("<")))
    inner = lambda f: F.substring_index(F.substring_index(F.regexp_replace(f["detail"], ">$", ""), "<", -1), ".", -1)
    pairs = F.transform(mocks, lambda f: F.struct(f["name"].alias("name"), inner(f).alias("type")))
    step = lambda held, p: F.map_concat(F.map_filter(held, lambda k, _: k != p["name"]), F.map_from_arrays(F.array(p["name"]), F.array(p["type"])))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), step)


def first_scalar(texts: list[Column], patterns: tuple[str, ...] | list[str]) -> Column:
    """The first group of the first pattern that matches, text by text; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), p, 1), F.lit("")) for t in texts for p in patterns])


def listed_tasks(listing: Column, kind: str) -> Column:
    """Task names that begin the lines of a listing, in order, each once."""
    start, end, between = LISTED_TASKS[kind]
    words = F.transform(F.split(F.coalesce(listing, F.lit("")), "\\r?\\n"), lambda x: F.regexp_extract(F.trim(x), r"^\w+", 0))
    fits = lambda w: w.startswith(start) & w.endswith(end) & (F.length(w) >= len(start) + len(end) + between) & ~F.contains(w, F.lit("_"))
    return F.array_distinct(F.filter(words, fits))


def task_kind(task: Column) -> Column:
    """The bucket of a build task; what matches nothing is ``other``."""
    name, out = F.regexp_extract(task, "[A-Za-z0-9]*$", 0), F.lit("other")
    for kind, ends in reversed(TASK_KINDS):
        fold = F.lower if kind in ANY_CASE else (lambda c: c)
        for start, end in ends:
            head = F.substring(name, F.lit(1), F.greatest(F.length(name) - len(end), F.lit(0)))
            out = F.when(fold(name).endswith(fold(F.lit(end))) & F.contains(fold(head), fold(F.lit(start))), kind).otherwise(out)
    return out


def tasks_by_kind(tasks: Column) -> Column:
    """Struct of the non-blank tasks of each kind, in order."""
    named = F.filter(F.transform(tasks, lambda t: F.trim(t)), lambda t: t != "")
    of = lambda kind: F.filter(named, lambda t: task_kind(t) == kind).alias(kind)
    return F.struct(*[of(k) for k in (*[k for k, _ in TASK_KINDS], "other")])


def test_path(source: Column, root: str, test_root: str, suffix: str = "Test") -> Column:
    """``root/a/Foo.kt`` as ``test_root/a/FooTest.kt``; null for a source outside ``root``."""
    rest = F.substring(source, F.lit(len(root.rstrip("/")) + 2), F.length(source))
    named = F.regexp_replace(rest, r"^(.*?)(\.[^./]*)?$", f"$1{suffix}$2")
    return F.when(source.startswith(root.rstrip("/") + "/"), F.concat(F.lit(test_root.rstrip("/") + "/"), named))


def mocking_lane(test: Column, mockk: str = r"\bio\.mockk\b|\bmockk\s*[<(]", mockito: str = r"\borg\.mockito\b|\bMockito\s*\.") -> Column:
    """``mockk`` or ``mockito`` if an existing test uses just that one, else ``open``."""
    text = F.coalesce(test, F.lit(""))
    a, b = text.rlike(mockk), text.rlike(mockito)
    return F.when(a & ~b, "mockk").when(b & ~a, "mockito").otherwise("open")


def sdk_level(least: Column, compiled: Column, installed: list[int]) -> Column:
    """The highest installed level from ``least`` to ``compiled`` (to ``least`` alone where that is null); null if there is none."""
    fits = F.filter(F.array(*map(F.lit, installed)), lambda x: (x >= least) & (x <= F.coalesce(compiled, least)))
    return F.when(least.isNotNull(), F.array_max(fits))


def sdk_status(least: Column, compiled: Column, installed: list[int]) -> Column:
    """Struct of ``selected``, ``ok`` and ``reason`` of a module's levels."""
    level = sdk_level(least, compiled, installed)
    upper = F.when(compiled.isNotNull(), F.concat(F.lit(" and <= compileSdk "), compiled.cast("string"))).otherwise("")
    missing = F.concat(F.lit("no installed platform >= minSdk "), least.cast("string"), upper)
    reason = F.when(least.isNull(), "minSdk unknown").when(F.lit(not installed), "no platform root").when(level.isNull(), missing).otherwise("")
    return F.struct(level.alias("selected"), level.isNotNull().alias("ok"), reason.alias("reason"))


def attached_before(text: Column, attach: str, reset: str, use: str) -> Column:
    """True if a ``use`` stands behind an ``attach`` without a ``reset`` between them."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({use})|({reset})|({attach})"), F.lit(0))
    # 1 after an attach, 0 after a reset, 2 for good once it was used while attached.
    step = lambda a, t: F.when(a == 2, 2).when(t.rlike(f"^(?:{use})$"), F.when(a == 1, 2).otherwise(a)).when(t.rlike(f"^(?:{reset})$"), 0).otherwise(1)
    return F.aggregate(tokens, F.lit(0), step) == 2


def line_slices(text: Column, spans: Column) -> Column:
    """The lines of each span (``lo``, ``hi``, from 1) of a text, spans in order, joined by a blank line."""
    lines = F.split(text, "\n")
    return F.array_join(F.transform(spans, lambda s: F.array_join(F.slice(lines, s["lo"], F.greatest(s["hi"] - s["lo"] + 1, F.lit(0))), "\n")), "\n\n")


def legacy_fields(approach: Column, fixture: Column, tickets: Column, branches: Column) -> Column:
    """Struct of ``tickets`` and ``branches`` of a plan row; empty ones are taken from prefixed texts (``tickets: ``, ``branch: ``)."""
    parts = lambda t, prefix, sep: F.when(t.startswith(prefix), F.filter(F.transform(F.split(F.substring(t, F.lit(len(prefix) + 1), F.length(t)), sep), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    own = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    pick = lambda a, other: F.when(F.size(own(a)) > 0, own(a)).otherwise(F.coalesce(other, F.array().cast("array<string>")))
    return F.struct(pick(tickets, parts(fixture, "tickets: ", ",")).alias("tickets"), pick(branches, parts(approach, "branch: ", ";")).alias("branches"))


def kept_sections(text: Column, na: str = r"(?i)^[-*\s]*n/?a\.?\s*$") -> Column:
    """Markdown sections without lines that say ``N/A``; sections of which no line but table rules remains go."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), "\\n(?=## )"), lambda p: p.startswith("## "))
    lines = F.transform(parts, lambda p: F.filter(F.split(p, "\n"), lambda x: ~x.rlike(na)))
    some = F.filter(lines, lambda a: F.exists(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^\|[-| ]+\|$")))
    return F.array_join(F.transform(some, lambda a: F.rtrim(F.array_join(a, "\n"))), "\n\n")


def first_acceptable(candidates: Column, pattern: str) -> Column:
    """The first candidate that matches the pattern, null if none does."""
    return F.try_element_at(F.filter(candidates, lambda c: c.rlike(pattern)), F.lit(1))

"""Texts, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of generated sources.
GENERATED_PACKAGES = ("dagger/hilt/internal", "hilt_aggregated_deps")
GENERATED_FOLDER, GENERATED_TAIL = "build/generated", "/databinding"
GENERATED_NAMES = ("BuildConfig", "R", "Manifest")
GENERATED_HEADS = ("R$", "_", "Hilt_")
GENERATED_ENDS = ("Binding", "BindingImpl", "_MembersInjector", "_GeneratedInjector", "_Factory")


def source_key(package: Column, name: Column) -> Column:
    """``a.b`` and ``F.kt`` as ``a/b/F.kt``."""
    return F.concat_ws("/", F.nullif(F.translate(package, ".", "/"), F.lit("")), name)


def module_name(module: Column) -> Column:
    """``:feature:x``, ``feature:x`` and ``/feature/x/`` as ``feature/x``."""
    return F.btrim(F.translate(F.trim(module), ":", "/"), F.lit("/"))


def module_of_report(path: Column, root: str) -> Column:
    """The folder of a report below ``root`` before its first ``build`` folder, or without one its own folder.

    ``.`` is the root itself; of a report that is not below ``root`` the whole path of its folder.
    """
    plain = F.regexp_replace(path, "^file:/+", "/")
    head = "/" + root.strip("/") + "/" if root.strip("/") else "/"
    parts = F.split(F.substring(plain, F.lit(len(head) + 1), F.length(plain)), "/")
    build = F.array_position(parts, "build").cast("int")
    below = F.array_join(F.slice(parts, F.lit(1), F.when(build > 0, build - 1).otherwise(F.size(parts) - 1)), "/")
    return F.when(plain.startswith(head), F.coalesce(F.nullif(below, F.lit("")), F.lit("."))).otherwise(F.regexp_replace(plain, "/[^/]*$", ""))


def is_generated(package: Column, name: Column) -> Column:
    """True for sources that tools wrote."""
    folder, stem = F.translate(package, ".", "/"), F.regexp_replace(F.regexp_replace(name, "\\.kt$", ""), "\\.java$", "")
    found = stem.isin(*GENERATED_NAMES) | folder.contains(GENERATED_FOLDER) | folder.endswith(GENERATED_TAIL)
    for p in GENERATED_PACKAGES:
        found = found | folder.startswith(p)
    for p in GENERATED_HEADS:
        found = found | stem.startswith(p)
    for s in GENERATED_ENDS:
        found = found | stem.endswith(s)
    return F.coalesce(found, F.lit(False))


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def fenced_blocks(text: Column) -> Column:
    """The bodies of the fenced code blocks of a text, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?s)```[A-Za-z0-9_+-]*[ \\t]*\\n(.*?)```"), F.lit(1)), stripped))


def brace_slice(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is no such pair."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1))


def json_candidates(text: Column) -> Column:
    """Texts that may be one JSON object: the fenced blocks first, then the brace slice."""
    return F.array_distinct(F.array_compact(F.concat(fenced_blocks(text), F.array(brace_slice(text)))))


def first_json(text: Column, schema: str) -> Column:
    """The first candidate that parses by ``schema``, as a struct."""
    parsed = F.transform(json_candidates(text), lambda c: F.from_json(c, schema))
    return F.try_element_at(F.filter(parsed, lambda p: p.isNotNull()), F.lit(1))


def short_text(text: Column, limit: int) -> Column:
    """White space as single spaces, cut to ``limit`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, F.lit(1), F.lit(limit - 3))), F.lit("..."))).otherwise(flat)


def head_and_tail(text: Column, head: int, tail: int, limit: int) -> Column:
    """The text, or if longer than ``limit`` its head and tail."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, F.lit(1), F.lit(head)), F.lit("\n...\n"), F.substring(text, -tail, tail))).otherwise(text)


def front_matter(text: Column) -> Column:
    """The block between leading ``---`` lines, empty if there is none."""
    return F.regexp_extract(text, "(?s)^---\\s*\\n(.*?)\\n---\\s*(?:\\n|$)", 1)


def headed_sections(text: Column) -> Column:
    """Markdown sections as structs of ``heading`` and ``body``."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), "\\n(?=#{1,6} )"), lambda p: F.ltrim(p).startswith("#"))
    return F.transform(parts, lambda p: F.struct(stripped(F.regexp_extract(p, "^#+ ([^\\n]*)", 1)).alias("heading"), stripped(F.regexp_replace(p, "^#+ [^\\n]*\\n?", "")).alias("body")))


def camel_case(name: Column) -> Column:
    """``snake_case_name`` as ``snakeCaseName``."""
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def package_of(qualified: Column) -> Column:
    """The package of a qualified name, empty if there is none."""
    return F.when(F.instr(qualified, ".") > 0, F.substring(qualified, F.lit(1), F.length(qualified) - F.length(F.substring_index(qualified, ".", -1)) - 1)).otherwise("")


def simple_name(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def task_variant(task: Column) -> Column:
    """The build variant of a unit-test task name: ``:app:testDebugUnitTest`` gives ``Debug``."""
    return F.nullif(F.regexp_extract(task, "(?:^|:)test([A-Z]\\w*)UnitTest$", 1), F.lit(""))


def flag(value: Column) -> Column:
    """A tolerant boolean: true, yes, y, 1 and on in any case."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "yes", "y", "1", "on"), F.lit(False))


def succeeded_last(text: Column, success: str, failure: str) -> Column:
    """True if the last ``success`` stands after the last ``failure``."""
    last = lambda what: F.when(F.instr(text, what) > 0, F.length(text) - F.instr(F.reverse(text), what[::-1])).otherwise(-1)
    return last(success) > last(failure)


def fingerprint(*fields: Column) -> Column:
    """md5 of the fields as one JSON object."""
    return F.md5(F.to_json(F.struct(*fields)))

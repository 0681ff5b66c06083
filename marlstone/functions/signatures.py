"""Shapes of types from listings of their public signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a type is called in a listing, and how each way to reach it is replaced in a test.
KINDS = ("class", "interface", "enum")
SEAMS = {"object": "mockkObject", "constructor": "mockkConstructor", "static": "mockkStatic"}


# Patterns of a line behind ``public``, its words one space apart. The optional words are never given back: one that is left out is no name.
_HEAD = rf"^(?:final )?+({'|'.join(KINDS)}) "
_STATIC = r"^static (?:final )?+[^ ]* (\w+)\("
_MADE = r"^(?:protected )?+(?:private )?+(?:final )?+([\w.$]+)\(([^)]*)\);?\z"


def short_parameters(parameters: Column) -> Column:
    """Parameters in brackets, each as its last word without a package."""
    last = lambda p: F.substring_index(F.translate(F.trim(p), "\t\n\x0b\f\r", "     "), " ", -1)
    each = F.transform(F.split(parameters, ","), lambda p: F.rtrim(F.substring_index(last(p), ".", -1), F.lit(";")))
    return F.concat(F.lit("("), F.array_join(F.filter(each, lambda p: p != ""), ", "), F.lit(")"))


def signature_lines(text: Column) -> Column:
    """The public lines of a listing as structs: ``kind`` and ``type`` of a head, ``static`` name, or constructor ``name`` and ``parameters``.

    Each step is a pass over the lines of its own, so that what several fields need is computed once.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^public\s"))
    words = F.transform(lines, lambda x: F.substring(F.regexp_replace(x, r"\s+", " "), 8, 2**31 - 1))

    def found(line: Column) -> Column:
        static = F.when(line.startswith("static "), F.regexp_extract(line, _STATIC, 1)).otherwise("")
        return F.struct(line.alias("line"), F.regexp_extract(line, _HEAD, 1).alias("kind"), static.alias("static"), F.regexp_extract(line, _MADE, 1).alias("name"))

    def parsed(x: Column) -> Column:
        head, static = x["kind"] != "", (x["kind"] == "") & (x["static"] != "")
        made = (x["kind"] == "") & (x["static"] == "") & (x["name"] != "")
        last = F.rtrim(F.substring_index(x["line"], " ", -1), F.lit("{"))
        return F.struct(
            F.when(head, x["kind"]).alias("kind"), F.when(head, last).alias("type"), F.when(static, x["static"]).alias("static"),
            F.when(made, x["name"]).alias("name"), F.when(made, short_parameters(F.regexp_extract(x["line"], _MADE, 2))).alias("parameters"),
        )

    return F.transform(F.transform(words, found), parsed)


def seam(kind: Column, constructors: Column, statics: Column) -> Column:
    """How a test reaches a type: ``object``, ``static`` where it has static functions and no constructor, else ``constructor``."""
    return F.when((F.size(constructors) > 0) & (F.size(statics) > 0), "constructor").when(kind == "object", "object").when((F.size(statics) > 0) & (F.size(constructors) == 0), "static").otherwise("constructor")


def type_shape(lines: Column, simple: Column) -> Column:
    """Struct of a type's ``fqcn``, ``kind``, ``constructors``, ``statics``, ``seam`` and ``mock`` from its ``signature_lines``.

    Constructors of other types than ``simple`` (null or empty allows all) are left out, and so are lower-case names
    without a package. The last head of several counts; one whose bracket stands apart, as listings write it, leaves the name
    asked for. Null for a listing with neither a head nor a member.
    """
    want = F.coalesce(simple, F.lit(""))
    short = lambda x: F.substring_index(x["name"], ".", -1)
    mine = lambda x: x["name"].isNotNull() & ((want == "") | (short(x) == want) | (x["name"] == want)) & (short(x).rlike(r"^\p{Lu}") | F.contains(x["name"], F.lit(".")))
    made = F.transform(F.filter(lines, mine), lambda x: x["parameters"])
    statics = F.array_distinct(F.transform(F.filter(lines, lambda x: x["static"].isNotNull()), lambda x: x["static"]))
    found = F.struct(F.try_element_at(F.filter(lines, lambda x: x["kind"].isNotNull()), F.lit(-1)).alias("last"), made.alias("made"), statics.alias("statics"), want.alias("want"))

    def shape(x: Column) -> Column:
        kind = F.coalesce(x["last"]["kind"], F.lit("class"))
        fqcn = F.coalesce(F.nullif(x["last"]["type"], F.lit("")), x["want"])
        how = F.struct(fqcn.alias("fqcn"), kind.alias("kind"), x["made"].alias("constructors"), x["statics"].alias("statics"), seam(kind, x["made"], x["statics"]).alias("seam"))
        nothing = (F.size(x["made"]) == 0) & (F.size(x["statics"]) == 0) & x["last"].isNull()
        return F.when(~nothing, how)

    mock = lambda how: F.coalesce(*[F.when(how == k, v) for k, v in SEAMS.items()])
    # Arrays of one element carry what is used several times.
    shapes = F.transform(F.transform(F.array(found), shape), lambda s: F.when(s.isNotNull(), F.struct(*[s[n].alias(n) for n in ("fqcn", "kind", "constructors", "statics", "seam")], mock(s["seam"]).alias("mock"))))
    return F.element_at(shapes, 1)

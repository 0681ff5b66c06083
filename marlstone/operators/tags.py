"""Tags from facts: set predicates of a table compiled to one bit mask a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 63


def _holds(kind: str, values: Column, wanted: list[str]) -> Column:
    """Whether any value is one of, begins with, ends with or contains any of the wanted texts."""
    values = F.coalesce(values, F.array().cast("array<string>"))
    if kind == "member":
        return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))
    test = {"prefix": lambda v, w: v.startswith(w), "suffix": lambda v, w: v.endswith(w), "contains": lambda v, w: F.contains(v, F.lit(w))}[kind]

    def one(v: Column) -> Column:
        out = test(v, wanted[0])
        for w in wanted[1:]:
            out = out | test(v, w)
        return out

    return F.exists(values, one)


def tag_mask(table: list[dict], facts: dict[str, Column]) -> Column:
    """A long whose bit ``i`` says that the predicates of ``table[i]`` hold.

    An entry has a ``tag`` and lists ``all``, ``any`` and ``none`` of predicates (kind, fact, wanted texts), kind one of
    member, prefix, suffix and contains; facts are array columns, null ones empty. Nulls within facts match nothing.
    """
    if len(table) > MOST:
        raise ValueError(f"more than {MOST} tags in one table")
    mask = F.lit(0).cast("long")
    for i, entry in enumerate(table):
        holds = lambda p: F.coalesce(_holds(p[0], F.array_compact(facts[p[1]]), list(p[2])), F.lit(False))
        ok = F.lit(True)
        for p in entry.get("all", []):
            ok = ok & holds(p)
        some = [holds(p) for p in entry.get("any", [])]
        if some:
            either = some[0]
            for s in some[1:]:
                either = either | s
            ok = ok & either
        for p in entry.get("none", []):
            ok = ok & ~holds(p)
        mask = mask.bitwiseOR(F.when(ok, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return mask


def tags_of(mask: Column, table: list[dict]) -> Column:
    """The tags of a mask, in the order of the table."""
    names = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(e["tag"]).alias("tag")) for i, e in enumerate(table)])
    return F.transform(F.filter(names, lambda t: t["bit"].bitwiseAND(mask) != 0), lambda t: t["tag"])

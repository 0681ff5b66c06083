"""Pipe tables in documents: numbered sections, rows, cells by header name, cells that list numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.numbers import int_set


def sections(body: Column) -> Column:
    """The parts of a text in front of and from each heading ``## number. title``."""
    return F.split(F.concat(F.lit("\n"), F.coalesce(body, F.lit(""))), r"\n(?=##\s+\d+\.\s+\S)")


def section_of(parts: Column, number: int) -> Column:
    """The last of the ``sections`` with that number, heading included; null if there is none."""
    mine = F.filter(parts, lambda p: p.rlike(rf"^##\s+0*{number}\.\s+\S"))
    return F.try_element_at(mine, F.lit(-1))


def numbered_section(body: Column, number: int) -> Column:
    """The text of the last section headed ``## number. title``, heading included; null if there is none."""
    return section_of(sections(body), number)


def pipe_rows(text: Column) -> Column:
    """The rows of the pipe tables of a text as arrays of trimmed cells; rules between head and body are left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    inner = F.transform(F.filter(lines, lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 2)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.transform(F.filter(inner, lambda x: ~x.rlike(r"^[-: |]*$")), lambda x: F.transform(F.split(x, r"\|"), lambda x: F.trim(x)))


def cell_places(rows: Column, names: dict[str, str]) -> Column:
    """Struct with the place of each name's last header, case folded, in the first of the rows; null where there is none."""
    backward = F.transform(F.slice(rows, 1, 1), lambda header: F.reverse(F.transform(header, F.lower)))
    place = lambda header, name: (F.size(header) - F.nullif(F.array_position(header, name), F.lit(0)) + 1).cast("int")
    return F.try_element_at(F.transform(backward, lambda header: F.struct(*[place(header, v).alias(k) for k, v in names.items()])), F.lit(1))


def cell(row: Column, place: Column) -> Column:
    """A row's cell at a place; empty where there is none."""
    return F.coalesce(F.try_element_at(row, place), F.lit(""))


def number_cell(text: Column) -> Column:
    """The distinct integers that a cell lists, in order; what is no integer is dropped."""
    return int_set(F.split(F.coalesce(text, F.lit("")), r"[,;\s]+"))


def word_cell(text: Column) -> Column:
    """The words that a cell lists between commas, semicolons or slashes."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;/]+"), lambda x: F.trim(x)), lambda x: x != "")

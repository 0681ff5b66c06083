"""Helpers that built-in expressions cannot give: balanced braces and the matching ratio."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# A string (to its quote or the line's end), a comment (not the slashes of an address), or a brace.
_TOKEN = re.compile(r'"(?:\\.|[^"\\\n])*"?|(?<!:)//[^\n]*|/\*.*?(?:\*/|\Z)|[{}]', re.S)


def brace_spans_of(text: str | None) -> list[tuple[int, int]]:
    """Top-level ``{...}`` spans (start, stop) outside strings and comments; an unclosed one is left out."""
    out, depth, start = [], 0, 0
    for m in _TOKEN.finditer(text or ""):
        token = m.group()
        if token == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif token == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append((start, m.end()))
    return out


def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "stop": z} for a, z in brace_spans_of(t)])


def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def brace_spans(text: str | Column) -> Column:
    """The top-level brace spans of a text column."""
    return F.pandas_udf(_spans, "array<struct<start: int, stop: int>>")(text)


def matching_ratio(left: str | Column, right: str | Column) -> Column:
    """The ratio of Python's sequence matcher; null if a side is null."""
    return F.pandas_udf(_ratio, "double")(left, right)

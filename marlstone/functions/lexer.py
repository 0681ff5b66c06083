"""Facts of source texts from one pass of a lexer: no parser, no syntax tree.

Strings (with templates), raw strings, characters, nested comments and back-quoted names are told apart, so that
braces and names inside them count as text. What the tokens say is emitted as typed rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT = "struct<kind: string, name: string, detail: string, line: int, depth: int>"
KINDS = (
    "package import annotation class interface object function suspend parameter property injected supertype call receiver instance string error".split()
)
_PLAIN = re.compile(r"(?P<space>\s+)|(?P<note>//[^\n]*)|(?P<name>`[^`\n]*`|[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>.)", re.S)
_CHAR = re.compile(r"'(?:\\u[0-9A-Fa-f]{4}|\\.|[^'\\\n])'")
_WORDS = frozenset("if else for while when do try catch finally return throw in is as by where constructor init get set this super null true false typeof break continue".split())
_MODIFIERS = frozenset(
    "public private internal protected open abstract sealed data enum annotation inline value inner override final suspend operator infix tailrec external const lateinit vararg noinline crossinline reified companion expect actual fun".split()
)
_DECLARES = frozenset("class interface object fun val var".split())


def _string(text: str, at: int) -> int:
    """The end of a string that begins at ``at``; template expressions may hold strings of their own."""
    i, n = at + 1, len(text)
    while i < n and text[i] != "\n":
        if text[i] == "\\":
            i += 2
        elif text[i] == '"':
            return i + 1
        elif text.startswith("${", i):
            depth, i = 1, i + 2
            while i < n and depth and text[i] != "\n":
                if text[i] == '"':
                    i = _string(text, i)
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
        else:
            i += 1
    return min(i, n)


def tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, value, line): names, numbers, signs, strings (without quotes) and ``open`` for what is never closed."""
    i, line, n = 0, 1, len(text)
    while i < n:
        kind, end = "", i
        if text.startswith('"""', i):
            stop = text.find('"""', i + 3)
            while stop >= 0 and text.startswith('"', stop + 3):
                stop += 1
            end = n if stop < 0 else stop + 3
            kind, value = ("open", "string") if stop < 0 else ("string", text[i + 3 : stop])
        elif text[i] == '"':
            end = _string(text, i)
            closed = end - i >= 2 and text[end - 1] == '"'
            kind, value = ("string", text[i + 1 : end - 1]) if closed else ("open", "string")
        elif text[i] == "'" and (m := _CHAR.match(text, i)):
            end, value = m.end(), ""
        elif text.startswith("/*", i):
            depth, end = 1, i + 2
            while end < n and depth:
                if text.startswith("/*", end) or text.startswith("*/", end):
                    depth += 1 if text[end] == "/" else -1
                    end += 2
                else:
                    end += 1
            if depth:
                kind, value = "open", "comment"
        else:
            m = _PLAIN.match(text, i)
            end, kind, value = m.end(), m.lastgroup, m.group().strip("`")
            kind = "" if kind in ("space", "note") else kind
        if kind:
            yield kind, value, line
        line += text.count("\n", i, end)
        i = end


class _Reader:
    """Walks over the tokens of one text and collects its facts."""

    def __init__(self, text: str):
        self.t = [*tokens(text), ("end", "", -1)]
        self.out: list[tuple[str, str, str | None, int, int]] = []
        self.depth = 0
        self.declared: set[int] = set()  # places of function names, which are no calls

    def value(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) and self.t[i][0] in ("name", "sign") else ""

    def add(self, kind: str, name: str, i: int, detail: str | None = None) -> None:
        self.out.append((kind, name, detail, self.t[i][2], self.depth))

    def path(self, i: int) -> tuple[str, int]:
        """A dotted name, perhaps with a star at its end, and where it ends."""
        parts = []
        while self.t[i][0] == "name" or self.value(i) == "*":
            parts.append(self.value(i))
            i += 1
            if self.value(i) != ".":
                break
            i += 1
        return ".".join(parts), i

    def type_at(self, i: int) -> tuple[str, int]:
        """A type with its arguments as text."""
        name, i = self.path(i)
        if self.value(i) == "<":
            deep, start = 0, i
            while self.t[i][0] != "end":
                deep += (self.value(i) == "<") - (self.value(i) == ">")
                i += 1
                if not deep:
                    break
            name += "".join(self.value(k) for k in range(start, i))
        return name, i

    def closed(self, i: int, left: str, right: str) -> int:
        deep = 0
        while self.t[i][0] != "end":
            deep += (self.value(i) == left) - (self.value(i) == right)
            i += 1
            if not deep:
                break
        return i

    def before(self, i: int) -> tuple[set[str], set[str]]:
        """The modifiers and annotations in front of a declaration."""
        words, notes = set(), set()
        k = i - 1
        while k >= 0:
            v = self.value(k)
            if v in _MODIFIERS:
                words.add(v)
            elif v == ")" and self.t[k][0] == "sign":  # the arguments of an annotation
                deep = 1
                while k > 0 and deep:
                    k -= 1
                    deep += (self.value(k) == ")") - (self.value(k) == "(")
            elif self.t[k][0] == "name" and (self.value(k - 1) in ("@", ":", ".")):
                notes.add(v)
            elif v not in ("@", ":", "."):
                break
            k -= 1
        return words, notes

    def declaration(self, i: int) -> None:
        word, k = self.value(i), i + 1
        if word == "fun":
            if self.value(k) == "interface":
                return
            if self.value(k) == "<":
                k = self.closed(k, "<", ">")
            name, k = self.path(k)
            name = name.rsplit(".", 1)[-1]
            if not name:
                return
            self.declared.add(k - 1)
            self.add("function", name, i)
            if "suspend" in self.before(i)[0]:
                self.add("suspend", name, i)
            if self.value(k) == "(":
                stop = self.closed(k, "(", ")")
                while k < stop:
                    if self.t[k][0] == "name" and self.value(k + 1) == ":" and self.value(k - 1) != "@":
                        self.add("parameter", self.value(k), k, self.type_at(k + 2)[0])
                    k += 1
            return
        if self.t[k][0] != "name":
            return
        name = self.value(k)
        if word in ("val", "var"):
            kind = self.type_at(k + 2)[0] if self.value(k + 1) == ":" else None
            self.add("property", name, i, kind)
            words, notes = self.before(i)
            if "lateinit" in words and "Inject" in notes:
                self.add("injected", name, i, kind)
            return
        self.add(word, name, i)
        k += 1
        while self.value(k) in ("<", "(", "@", "private", "internal", "constructor", "protected") or self.value(k - 1) == "@":
            v = self.value(k)
            k = self.closed(k, v, ">" if v == "<" else ")") if v in ("<", "(") else k + 1
        if self.value(k) == ":":
            k += 1
            while self.t[k][0] == "name" and self.value(k) not in ("where", "by"):
                kind, stop = self.type_at(k)
                self.add("supertype", kind.split("<")[0].rsplit(".", 1)[-1], i, name)
                k = self.closed(stop, "(", ")") if self.value(stop) == "(" else stop
                if self.value(k) == "by":
                    k = self.path(k + 1)[1]
                if self.value(k) != ",":
                    break
                k += 1

    def read(self) -> list[tuple[str, str, str | None, int, int]]:
        i, skip = 0, -1
        while self.t[i][0] != "end":
            kind, v, line = self.t[i]
            first = i == 0 or self.t[i - 1][2] != line
            if kind == "open":
                self.add("error", "unclosed " + v, i)
            elif kind == "string":
                self.add("string", v, i)
            elif kind == "sign" and v in "{}":
                if v == "}":
                    if not self.depth:
                        self.add("error", "unopened brace", i)
                    self.depth = max(0, self.depth - 1)
                else:
                    self.depth += 1
            elif kind == "sign" and v == "@" and self.t[i + 1][0] == "name":
                k = i + 3 if self.value(i + 2) == ":" else i + 1
                name, skip = self.path(k)
                self.add("annotation", name.rsplit(".", 1)[-1], i)
            elif kind == "name" and v in ("package", "import") and first and self.depth == 0:
                name, k = self.path(i + 1)
                if name:
                    self.add(v, name, i, self.value(k + 1) if self.value(k) == "as" else None)
                    i = k
                    continue
            elif kind == "name" and v in _DECLARES and self.value(i - 1) not in (":", "."):
                self.declaration(i)
            elif kind == "name" and i >= skip:
                self.use(i, v)
            i += 1
        if self.depth:
            self.add("error", "unclosed brace", len(self.t) - 2)
        return self.out

    def use(self, i: int, v: str) -> None:
        member, following = self.value(i - 1) == ".", self.value(i + 1)
        if following == "." and not member and v[:1].isupper() and self.t[i + 2][0] == "name":
            self.add("receiver", v, i)
        if following == "<" and self.value(stop := self.closed(i + 1, "<", ">")) == "(" and stop - i < 12:
            following = "("
        if following in ("(", "{") and v not in _WORDS and i not in self.declared and self.value(i - 1) not in _DECLARES and self.value(i - 1) != ":":
            if following == "(" or member:
                owner = self.value(i - 2) if member and self.t[i - 2][0] == "name" else None
                self.add("call", v, i, owner)
                if v == "getInstance" and owner and following == "(":
                    self.add("instance", owner, i)


def facts_of(text: str | None) -> list[tuple[str, str, str | None, int, int]]:
    """(kind, name, detail, line, depth of braces) of a text, in order; a null text has none."""
    return _Reader(text or "").read()


def _facts(texts: pd.Series) -> pd.Series:
    keys = ("kind", "name", "detail", "line", "depth")
    return texts.map(lambda t: [dict(zip(keys, f)) for f in facts_of(t)])


def facts(text: str | Column) -> Column:
    """The facts of a text column as an array; none for null and empty texts."""
    return F.pandas_udf(_facts, f"array<{FACT}>")(text)


def facts_table(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each fact of each text: keys, ``pos`` in the text's order, and the fact; texts without facts have none."""
    return texts.select(*keys, F.posexplode(facts(F.col(text))).alias("pos", "f")).select(*keys, "pos", "f.*")


def names_of(all_facts: Column, kind: str) -> Column:
    """The distinct names of one kind of facts, in order."""
    return F.array_distinct(F.transform(F.filter(all_facts, lambda f: f["kind"] == kind), lambda f: f["name"]))

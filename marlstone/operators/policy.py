"""Decisions on requests as columns, and what sessions have read."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Command words that are refused, those that are allowed, tools and places.
NETWORK_WORDS = "curl wget nc ncat netcat socat pip pip3 npm yarn pnpm ssh scp sftp ftp apt-get dnf yum brew aria2c httpie telnet".split()
NETWORK_PHRASES = ["git clone", "git fetch", "git pull", "git push", "docker pull"]
INTERPRETERS = "python python3 perl ruby node lua php bash sh zsh ksh dash chmod chown mkfifo dd eval sudo".split()
ALLOWED = (
    "./gradlew gradlew ls find cat head tail wc pwd echo which type grep egrep fgrep rg ugrep mkdir stat file basename dirname realpath readlink "
    "true false printf sort uniq tr cut tee xargs awk sed test [ bfs"
).split()
SEARCHES = "find bfs grep ugrep rg".split()
REFUSED_TOOLS = ["WebSearch", "WebFetch", "NotebookEdit"]
DEVICES = ["/dev/null", "/dev/stdout", "/dev/stderr"]
TEST_FOLDERS = ["/src/test/", "/src/androidTest/"]
MAIN_FOLDER = "/src/main/"
BUILD_FILES = ["build.gradle.kts", "build.gradle"]
PLAN_SUFFIX = ".plan.md"


def _word(words: list[str]) -> str:
    """A pattern for any of the words (or phrases) on its own."""
    return r"(?i)(?<![\w-])(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words) + r")(?![\w-])"


NETWORK = _word(NETWORK_WORDS + NETWORK_PHRASES)
DESTRUCTIVE = _word(INTERPRETERS) + r"|\brm\s+(?:-[a-z]*[rf]|--recursive)"
_PATHS = r"(?:^|[\s=\"'>])(/[^\s\"';|&]*)"


@dataclass(frozen=True)
class Places:
    """Where a session may go: its project, the module it owns, the generator's own folder, its plans, and the home whose keys stay closed."""

    project: str
    generator: str
    plans: str
    module: str | None = None
    home: str = "/root"

    @property
    def roots(self) -> list[str]:
        return list(dict.fromkeys(p for p in (self.generator, self.project, self.module) if p))


def resolved(path: Column, base: str) -> Column:
    """The absolute path (a relative one begins at ``base``) without ``.``, ``..`` and double slashes."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path))
    none = F.array().cast("array<string>")
    parts = F.aggregate(F.split(full, "/"), none, lambda kept, p: F.when(p.isin("", "."), kept).when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, p)))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def below(path: Column, roots: list[str]) -> Column:
    """True for a path that is one of the roots or below it."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r.rstrip("/")) | path.startswith(r.rstrip("/") + "/")
    return out


def _segments(text: Column) -> Column:
    """The commands between ``;``, ``&``, ``|``, back quotes and line ends."""
    return F.filter(F.transform(F.split(text, r"[;&|`\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def _makes_folder(segment: Column, roots: list[str]) -> Column:
    """True for ``mkdir`` with ``-p`` and at least one folder, all below the roots."""
    words = F.slice(F.filter(F.split(segment, r"\s+"), lambda w: w != ""), F.lit(2), F.lit(1_000_000))
    folders = F.filter(words, lambda w: ~w.startswith("-"))
    return F.exists(words, lambda w: w.isin("-p", "--parents")) & (F.size(folders) > 0) & F.forall(folders, lambda w: below(resolved(w, roots[0]), roots))


def command_decision(command: Column, roots: list[str]) -> Column:
    """Struct of ``permission`` and ``reason`` of a shell command, the first reason that holds; null and blank are ``empty``.

    Every segment must begin with an allowed word, ``mkdir`` have ``-p`` and folders below the roots (relative ones begin
    at the first), and every absolute path, its ``..`` resolved, lie below a root or be a standard device.
    """
    text = F.trim(F.coalesce(command, F.lit("")))
    first = lambda s: F.regexp_extract(s, r"^(?:\w+=\S*\s+)*(\S+)", 1)
    paths = F.regexp_extract_all(text, F.lit(_PATHS), F.lit(1))
    fine = lambda p: p.isin(*DEVICES) | below(resolved(p, "/"), roots)
    reason = (
        F.when(text == "", "empty").when(text.rlike(NETWORK), "network").when(text.rlike(DESTRUCTIVE), "denied")
        .when(F.exists(_segments(text), lambda s: ~first(s).isin(*ALLOWED)), "not allowed")
        .when(F.exists(_segments(text), lambda s: (first(s) == "mkdir") & ~_makes_folder(s, roots)), "folder")
        .when(F.exists(paths, lambda p: ~fine(p)), "outside").otherwise("")
    )
    return F.struct(F.when(reason == "", "allow").otherwise("deny").alias("permission"), reason.alias("reason"))


def open_path(path: Column, places: Places) -> Column:
    """True for an absolute path below a root that is neither a system setting nor a key of the home."""
    return ~below(path, ["/etc", places.home.rstrip("/") + "/.ssh"]) & below(path, places.roots)


def tool_decision(tool: Column, path: Column, command: Column, places: Places, *, planning: Column, exists: Column, listed: Column, paging: Column, locked: Column) -> Column:
    """Struct of ``permission``, ``reason``, ``path`` (as the tool should use it) and ``updated`` for a call of a tool.

    ``planning`` tells the phase, ``exists`` whether the path is a file, ``listed`` the file known under its name (or null),
    ``paging`` whether a read asks for a part, ``locked`` whether the session may search only in its module. Reads take the listed file; writes go to tests, build files
    and the generator, while planning also to plans (an edit only of one that exists). Flags that are null count as false,
    a null path or command as empty; a tool that no rule names is allowed.
    """
    no = F.lit(False)
    planning, exists, paging, locked = (F.coalesce(c, no) for c in (planning, exists, paging, locked))
    tool, asked = F.coalesce(tool, F.lit("")), F.trim(F.coalesce(path, F.lit("")))
    full, name = resolved(asked, places.project), F.substring_index(asked, "/", -1)
    known, empty, is_plan = F.nullif(F.trim(listed), F.lit("")), asked == "", name.endswith(PLAN_SUFFIX)
    here = open_path(full, places)
    read = (
        F.when(paging, "paging").when(empty, "empty").when(~here, "outside").when(locked, F.when(exists, "").otherwise("locked"))
        .when(known.isNotNull(), F.when(open_path(resolved(known, places.project), places), "").otherwise("outside"))
        .when(exists, "").when(is_plan, "no plan yet").otherwise("missing")
    )
    plan = resolved(asked, places.plans)
    for_plan = planning & is_plan
    tested = F.lit(False)
    for folder in TEST_FOLDERS:
        tested = tested | F.contains(full, F.lit(folder))
    may = ~F.contains(full, F.lit(MAIN_FOLDER)) & (tested | F.substring_index(full, "/", -1).isin(*BUILD_FILES) | below(full, [places.generator]))
    written = F.when(empty, "empty").when(for_plan, F.when(~below(plan, [places.plans]), "not a plan").when((tool == "Edit") & ~exists, "no plan yet").otherwise("")).when(may, "").otherwise("not a test")
    shell = command_decision(command, places.roots)["reason"]
    paths = F.regexp_extract_all(F.coalesce(command, F.lit("")), F.lit(_PATHS), F.lit(1))
    astray = F.exists(paths, lambda p: ~below(resolved(p, "/"), [places.module])) if places.module else no
    shell = F.when((shell == "") & locked & command.rlike(_word(SEARCHES)) & astray, "locked").otherwise(shell)
    reason = (
        F.when(tool.isin(*REFUSED_TOOLS), "tool").when(tool == "Read", read).when(tool.isin("Write", "Edit"), written)
        .when(tool.isin("Glob", "Grep"), F.when(empty | here, "").otherwise("outside")).when(tool == "Bash", shell).otherwise("")
    )
    target = F.when(tool.isin("Write", "Edit"), F.when(for_plan, plan).otherwise(full)).when((tool == "Read") & ~locked & known.isNotNull(), resolved(known, places.project)).otherwise(asked)
    allowed = reason == ""
    return F.struct(F.when(allowed, "allow").otherwise("deny").alias("permission"), reason.alias("reason"), F.when(allowed, target).otherwise(asked).alias("path"), (allowed & (target != asked)).alias("updated"))


def path_decision(path: Column, roots: list[str], suffix: str | None = None) -> Column:
    """``allow`` for a path below a root (or with the suffix), else ``deny``; an empty path is denied."""
    p = F.trim(F.coalesce(path, F.lit("")))
    fine = below(p, roots) | (p.endswith(suffix) if suffix else F.lit(False))
    return F.when((p != "") & ~F.contains(p, F.lit("/../")) & fine, "allow").otherwise("deny")


def hit_counts(events: DataFrame, path: str, order: str) -> DataFrame:
    """Each event with the number of hits of its path so far."""
    return events.withColumn("hits", F.count("*").over(Window.partitionBy(path).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def read_map(events: DataFrame, session: str, path: str, order: str, kind: str, mtime: str) -> DataFrame:
    """The time of change last read of each path of a session; a path that was ``written`` after its last read is not in it."""
    last = events.filter(F.col(kind).isin("read", "written")).groupBy(session, path).agg(F.max_by(F.struct(kind, mtime), order).alias("_l"))
    return last.filter(F.col(f"_l.{kind}") == "read").select(session, path, F.col(f"_l.{mtime}").alias(mtime))

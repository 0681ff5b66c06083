"""Decisions on tool calls: commands, reads and writes of a project, a generator and its plans."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators.policy import Places, command_decision, resolved, tool_decision

P = Places(project="/p", generator="/g", plans="/g/plans", module="/p/app", home="/root")
CALL = "tool string, path string, command string, planning boolean, exists boolean, listed string, paging boolean, locked boolean"


@pytest.fixture
def decide(spark):
    def run(*calls):
        rows = [tuple({"tool": None, "path": None, "command": None, "planning": None, "exists": None, "listed": None, "paging": None, "locked": None, **c}.values()) for c in calls]
        c = {n: F.col(n) for n in ("planning", "exists", "listed", "paging", "locked")}
        out = spark.createDataFrame(rows, CALL).coalesce(1).select(tool_decision(F.col("tool"), F.col("path"), F.col("command"), P, **c).alias("v"))
        return [tuple(r["v"]) for r in out.collect()]

    return run


def test_resolved(spark):
    paths = ["/a/./b//c/../d", "x/../../y", "..", "/../..", "a"]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").coalesce(1).select(resolved(F.col("p"), "/p/q")).collect()] == ["/a/b/d", "/p/y", "/p", "/", "/p/q/a"]


def test_commands(spark):
    fine = ["./gradlew test", "gradlew assembleDebug", "ls -la", "pwd", "echo hello", "which gradlew", "find /p -name '*.kt'", "cat /p/A.kt", "mkdir -p /p/src/test", "grep -n Foo /p/A.kt", "rg Foo /g/x 2>/dev/null", "A=1 ls /p/x/../y"]
    bad = {
        "curl https://example.com": "network", "nc -zv 127.0.0.1 80": "network", "scp a host:b": "network", "pip install x": "network", "npm install": "network", "git  clone x": "network", "python3 -c 'print(1)'": "denied",
        "bash -c 'ls'": "denied", "rm -rf /tmp/x": "denied", "rm --recursive x": "denied", "cat /etc/passwd": "outside", "ls /tmp": "outside", "ls /p/../tmp": "outside", "cat x > /tmp/y": "outside", "make": "not allowed", "ls `make`": "not allowed",
        "ls && make": "not allowed", "mkdir /p/x": "folder", "mkdir -p": "folder", "mkdir -p /p/x /tmp/y": "folder", "mkdir -p ../x": "folder", " ": "empty", None: "empty",
    }
    rows = [(c,) for c in fine + list(bad)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "c string").select("c", command_decision(F.col("c"), P.roots)["reason"]).collect()}
    assert got == {**dict.fromkeys(fine, ""), **bad}


def test_reads(decide):
    got = decide(
        {"tool": "Read", "path": "/p/A.kt", "exists": True}, {"tool": "Read", "path": "A.kt", "exists": True}, {"tool": "Read", "path": "/etc/passwd", "exists": True}, {"tool": "Read", "path": "/root/.ssh/id_rsa", "exists": True},
        {"tool": "Read", "path": "/g/data/rules.yaml", "exists": True}, {"tool": "Read", "path": "/p/A.kt", "exists": True, "paging": True}, {"tool": "Read"}, {"tool": "Read", "path": "/p/B.kt"}, {"tool": "Read", "path": "/p/x.plan.md"},
        {"tool": "Read", "path": "/p/B.kt", "listed": "/p/c/B.kt"}, {"tool": "Read", "path": "/p/B.kt", "listed": "/tmp/B.kt"}, {"tool": "Read", "path": "/p/B.kt", "listed": "/p/c/B.kt", "locked": True}, {"tool": "Read", "path": "/p/../tmp/x", "exists": True},
    )
    assert [v[1] for v in got] == ["", "", "outside", "outside", "", "paging", "empty", "missing", "no plan yet", "", "outside", "locked", "outside"]
    assert got[9] == ("allow", "", "/p/c/B.kt", True) and got[0] == ("allow", "", "/p/A.kt", False)


def test_writes_and_other_tools(decide):
    got = decide(
        {"tool": "Write", "path": "/p/src/test/A.kt"}, {"tool": "Write", "path": "src/androidTest/A.kt"}, {"tool": "Write", "path": "/p/src/main/A.kt"}, {"tool": "Write", "path": "/p/src/test/../main/A.kt"}, {"tool": "Edit", "path": "/p/build.gradle.kts"},
        {"tool": "Write", "path": "/g/x"}, {"tool": "Write", "path": ""}, {"tool": "Write", "path": "a.plan.md", "planning": True}, {"tool": "Edit", "path": "a.plan.md", "planning": True}, {"tool": "Edit", "path": "a.plan.md", "planning": True, "exists": True},
        {"tool": "Write", "path": "/p/a.plan.md", "planning": True}, {"tool": "Write", "path": "a.plan.md"}, {"tool": "Write", "path": "../a.plan.md", "planning": True}, {"tool": "WebFetch"}, {"tool": "Glob"}, {"tool": "Grep", "path": "/tmp"},
        {"tool": "Bash", "command": "grep a /p/x", "locked": True}, {"tool": "Bash", "command": "grep a /p/app/x", "locked": True}, {"tool": "Bash", "command": "ls /p/x", "locked": True}, {"tool": "Task"}, {},
    )
    assert [v[1] for v in got] == ["", "", "not a test", "not a test", "", "", "empty", "", "no plan yet", "", "not a plan", "not a test", "not a plan", "tool", "", "outside", "locked", "", "", "", ""]
    assert got[1] == ("allow", "", "/p/src/androidTest/A.kt", True) and got[7] == ("allow", "", "/g/plans/a.plan.md", True) and got[3][2] == "/p/src/test/../main/A.kt"

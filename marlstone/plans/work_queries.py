"""Queries of the source-fact, catalog, policy and plan operators, and the SQL that gives the same rows.

Source texts, listings and paths are built from columns of the benchmark tables; the SQL says what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import sources as X
from marlstone.functions.labels import cites, disposition, marker_profile
from marlstone.functions.texts import front_matter
from marlstone.operators import catalog as G
from marlstone.operators import ledger as L
from marlstone.operators import plans as P
from marlstone.operators import policy as Y
from marlstone.operators import spans as S
from marlstone.plans.surrogate import table

INSTALLED = [10, 20, 30, 40]
ROOTS = ["/work/app", "/work/gen"]
PRIORITY = ["large", "small"]


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _joined(array):
    return F.array_join(array, ",")


def _ints(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


def _kind():
    return F.lower(F.translate("p_type", " ", "_"))


def source_facts(spark, d):
    n = _s("p_size")
    body = F.when(F.col("p_size") > 25, " run() ").otherwise("  ")
    text = _text("package a\nimport x.", _kind(), "\nimport x.", _kind(), " as q\nimport y.*\ninterface I", n, " {\n  fun f() {", body, "} // object\n}\nval v = K", n, ".getInstance(1) + Cipher.getInstance(2)\nvar m: MockedStatic<b.T", n, "> = z\n")
    return table(spark, d, "part").select(
        "p_partkey", _joined(X.import_names(text)).alias("imports"), _joined(X.declared_names(text)).alias("declared"), X.declares_only(text).alias("no_exec"),
        _joined(X.instance_types(text)).alias("instances"), _joined(X.receiver_types(text)).alias("receivers"), F.try_element_at(X.static_mock_types(text), F.lit("m")).alias("mocked"),
    )


def build_facts(spark, d):
    name = F.translate("p_brand", "#", "")
    kinds = X.tasks_by_kind(F.array(F.lit(":app:testDebugUnitTest"), _text("connected", name, "AndroidTest"), F.lit(" "), _text(":create", name, "coverageReport"), _text(":kover", name)))
    listing = _text("Tasks\n", "connected", name, "AndroidTest - runs\n", "connected", name, "AndroidTest - again\r\nxconnectedAAndroidTest\n")
    build = F.when(F.col("p_size") < 10, "none").when(F.col("p_size") < 30, _text('android { namespace = "n.', name, '" }')).otherwise(_text("namespace '", name, "'"))
    compiled = F.when(F.col("p_size") > 15, F.col("p_size") + 5)
    status = X.sdk_status(F.col("p_size"), compiled, INSTALLED)
    return table(spark, d, "part").select(
        "p_partkey", _joined(kinds["unit_test"]).alias("unit"), _joined(kinds["android_test"]).alias("device"), _joined(kinds["jacoco"]).alias("reports"), _joined(kinds["other"]).alias("others"),
        _joined(X.listed_tasks(listing, "android_test")).alias("listed"), X.first_scalar([build], X.NAMESPACE_PATTERNS).alias("namespace"), status["selected"].alias("level"), status["reason"].alias("reason"),
    )


def test_names(spark, d):
    text = F.when(F.col("p_size") < 10, "import io.mockk.every").when(F.col("p_size") < 20, "import org.mockito.Mockito").when(F.col("p_size") < 30, "io.mockk.x org.mockito.y")
    source = _text(F.when(F.col("p_size") < 25, "root/").otherwise("other/"), "a/", _kind(), ".kt")
    return table(spark, d, "part").select("p_partkey", X.test_path(source, "root", "test/unit").alias("path"), X.mocking_lane(text).alias("lane"))


def attach_state(spark, d):
    step = F.element_at(F.array(*map(F.lit, ["val f = A()", "x.commitNow()", "f.arguments = b", "f.other"])), (F.col("turn") % 4 + 1).cast("int"))
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", step.alias("step")).alias("s")).distinct()
    c = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["step"]), "\n").alias("text"))
    return c.select("conv_id", X.attached_before(F.col("text"), r"\.commitNow\(", r"val f\s*=", r"f\.arguments\s*=").alias("late"))


def section_text(spark, d):
    size = _s("p_size")
    plan = _text("---\nid: ", size, "\n---\n## 1. A\n- N/A\nkeep ", size, "\n## 2. B\n n/a \n|---|--|\n## 3. C\nlast")
    fields = X.legacy_fields(_text("branch: l", size, "; r"), F.when(F.col("p_size") < 25, _text("tickets: T1, ", size)).otherwise("none"), F.array().cast("array<string>"), F.when(F.col("p_size") < 9, F.array(F.lit("own"))))
    picked = X.first_acceptable(F.array(F.lit("x"), _text("## ", size), F.lit("## 0")), "^## ")
    lines = X.line_slices(_text("a\nb\n", size, "\nd"), F.array(F.struct(F.lit(3).alias("lo"), F.lit(4).alias("hi")), F.struct(F.lit(1).alias("lo"), F.lit(1).alias("hi"))))
    return table(spark, d, "part").select("p_partkey", front_matter(plan).alias("front"), X.kept_sections(plan).alias("sections"), _joined(fields["tickets"]).alias("tickets"), _joined(fields["branches"]).alias("branches"), picked.alias("picked"), lines.alias("lines"))


def _files(spark, d):
    name = _text("S", _s(F.col("s_suppkey") % 50))
    package = _text("p", _s("s_nationkey"))
    return table(spark, d, "supplier").select(package.alias("package"), name.alias("name"), F.array(name, _text("D", _s("s_suppkey"))).alias("declared"), F.concat_ws("/", F.lit("src"), package, _text(_s("s_suppkey"), ".kt")).alias("path"))


def import_files(spark, d):
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, "*").when(F.col("c_custkey") % 2 == 0, _text("S", _s(F.col("c_custkey") % 60))).otherwise(_text("D", _s(F.col("c_custkey") % 90)))
    sources = c.select(_s("c_custkey").alias("source"), F.concat_ws(".", _text("p", _s("c_nationkey")), name).alias("fqcn"))
    return G.resolved_imports(sources, _files(spark, d), 2)


def catalog_match(spark, d):
    names = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, _text("p", _s("c_nationkey"), ".S", _s(F.col("c_custkey") % 60))).when(F.col("c_custkey") % 3 == 1, _text("S", _s(F.col("c_custkey") % 60))).otherwise(_text("p", _s("c_nationkey"), ".S", _s(F.col("c_custkey") % 60), ".Inner")).alias("name"))
    return G.catalog_lookup(names, "name", _files(spark, d).select(F.concat_ws(".", "package", "name").alias("entry"), "path"))


def called_imports(spark, d):
    li = table(spark, d, "lineitem")
    calls = li.select(_s("l_orderkey").alias("source"), _text("N", _s(F.col("l_suppkey") % 20)).alias("callee"), F.col("l_linenumber").alias("line"))
    imports = li.select(_s("l_orderkey").alias("source"), _text("q.N", _s(F.col("l_partkey") % 20)).alias("fqcn")).distinct()
    return G.called_imports(calls, imports, 2).select("source", "fqcn", "line", "rank")


def new_imports(spark, d):
    o = table(spark, d, "orders")
    rows = lambda status: o.filter(F.col("o_orderstatus") == status).select(_s("o_custkey").alias("source"), _text("g.", F.substring("o_orderpriority", 1, 1)).alias("fqcn"))
    generated = table(spark, d, "region").select(_text("g.", _s(F.col("r_regionkey") + 1)).alias("fqcn"))
    return G.new_generated_imports(rows("O"), rows("F"), generated)


def object_references(spark, d):
    li = table(spark, d, "lineitem").select(_s("l_orderkey").alias("source"), _s(F.col("l_suppkey") % 40).alias("name"))
    project = table(spark, d, "supplier").filter("s_acctbal > 5000").select(_s("s_suppkey").alias("name")).distinct()
    local = table(spark, d, "orders").select(_s("o_orderkey").alias("source"), _s(F.col("o_custkey") % 40).alias("name"))
    return G.referenced_objects(li, project, local)


def resource_names(spark, d):
    used = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, _text("res_", _s(F.col("c_custkey") % 40))).otherwise(_text("Res", _s(F.col("c_custkey") % 40))).alias("name"))
    index = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, _text("res_", _s(F.col("s_suppkey") % 30))).otherwise(_text("r_es", _s(F.col("s_suppkey") % 30))).alias("entry"))
    return G.rewritten_names(used, "name", index, "entry")


def sibling_tests(spark, d):
    c = table(spark, d, "customer").select(_s("c_nationkey").alias("folder"), _text("F", _s(F.col("c_custkey") % 13), F.when(F.col("c_acctbal") > 5000, "More").otherwise(""), "Test").alias("stem"))
    targets = table(spark, d, "supplier").select(_s("s_nationkey").alias("folder"), _text("F", _s(F.col("s_suppkey") % 13)).alias("stem")).distinct()
    return G.sibling_tests(c, targets)


def last_written(spark, d):
    return G.verified_index(table(spark, d, "events"), ["user_id", "event_type"], "value", "event_id")


def evidence_labels(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return G.having_evidence(rows, ["s_nationkey"], table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey")), "state", "confirmed", "dismissed")


def package_files(spark, d):
    files = _files(spark, d).select("name", "package", "path", F.col("path").alias("pos"))
    wanted = table(spark, d, "customer").select(_text("S", _s(F.col("c_custkey") % 60)).alias("name"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(_text("p", _s("c_nationkey"))).alias("package")).distinct()
    return G.package_match(files, wanted)


def existing_paths(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    path = lambda n: F.concat_ws("/", F.lit("src"), _text("p", _s("c_nationkey")), _text(_s(F.col("c_custkey") % n), ".kt"))
    return G.first_existing(rows, "c_custkey", [path(30), path(25)], _files(spark, d)).select("c_custkey", "resolved")


def hit_functions(spark, d):
    li = table(spark, d, "lineitem")
    functions = li.groupBy(_s("l_orderkey").alias("source"), _s(F.col("l_suppkey") % 9).alias("name")).agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    lines = li.filter("l_returnflag = 'R'").select(_s("l_orderkey").alias("source"), F.col("l_linenumber").alias("at"))
    names = table(spark, d, "orders").select(_s("o_orderkey").alias("source"), _s(F.col("o_custkey") % 9).alias("name"))
    return G.hit_functions(functions, lines, names)


def calling_blocks(spark, d):
    li = table(spark, d, "lineitem").select(_s("l_orderkey").alias("source"), F.col("l_linenumber").alias("block"), _s("l_linenumber").alias("label"), _text("run { m", _s(F.col("l_suppkey") % 5), "(1); m", _s(F.col("l_partkey") % 5), " (2) }").alias("text")).distinct()
    names = table(spark, d, "orders").select(_s("o_orderkey").alias("source"), F.explode(F.array(_text("m", _s(F.col("o_custkey") % 5)), F.lit("m1"))).alias("name"))
    one = li.groupBy("source", "block", "label").agg(F.min("text").alias("text"))
    return G.calling_blocks(one, names)


def command_policy(spark, d):
    e = table(spark, d, "events")
    path = F.when(F.col("user_id") % 2 == 0, "/work/app/x").otherwise("/etc/x")
    command = F.when(F.col("event_type") == "click", _text("A=1 ls ", path)).when(F.col("event_type") == "error", "curl http://x").when(F.col("event_type") == "purchase", _text("cat ", path, " | rm -rf y")).when(F.col("event_type") == "signup", " ").otherwise(_text("grep a ", path, " && make"))
    v = Y.command_decision(command, ROOTS)
    return e.select("event_id", v["permission"].alias("permission"), v["reason"].alias("reason"), Y.path_decision(path, ROOTS).alias("path"), Y.path_decision(_text(path, ".plan.md"), ROOTS, ".plan.md").alias("plan"))


def path_hits(spark, d):
    return Y.hit_counts(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id")


def read_paths(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.get_json_object("props", "$.k").alias("path"), "event_id", F.when(F.col("event_type") == "purchase", "written").otherwise("read").alias("kind"), "value")
    return Y.read_map(e, "session", "path", "event_id", "kind", "value")


def layer_items(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, " ").when(F.col("p_size") < 20, "Unit").otherwise("device").alias("layer"), F.when(F.col("p_size") > 5, F.col("p_size") > 15).alias("done"))
    return P.pending(P.of_layer(p, "unit"), "done").select("p_partkey", "layer")


def tag_slices(spark, d):
    p = table(spark, d, "part")
    name, place = P.tag_order(F.when(F.col("p_size") < 5, " ").otherwise(F.substring_index("p_name", " ", 1)), PRIORITY, "plain")
    items = p.select("p_partkey", name.alias("tag"), place.cast("int").alias("place"), F.sequence(F.lit(1), F.col("p_size")).alias("lines"), P.owner_of(F.when(F.col("p_size") > 9, F.array(F.col("p_brand"))), F.when(F.col("p_size") > 7, F.lit("f"))).alias("owner"))
    return P.split_items(items, 30).select("p_partkey", "tag", "place", "part", "owner", F.size("lines").alias("n"), F.element_at("lines", 1).alias("first"))


def residual_labels(spark, d):
    items = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "branch").otherwise("line").alias("kind"), (F.col("o_orderpriority") == "5-LOW").alias("exempt"))
    hits = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.relabel_by_evidence(items, hits, ["o_orderkey"]).select("o_orderkey", "hits", "label")


def deferred_items(spark, d):
    p = table(spark, d, "part")
    lines, category = F.array(F.lit(9), F.col("p_size")), F.when(F.col("p_size") < 10, "kover_residual_branch").when(F.col("p_size") < 20, " ").otherwise("late")
    branches, reason = F.when(F.col("p_size") > 40, F.array(F.lit(3))), F.when(F.col("p_size") > 45, "given").when(F.col("p_size") > 30, " ")
    a, b = P.item_probes(lines, branches, category, reason)
    return p.select("p_partkey", _ints(a).alias("lines"), _ints(b).alias("branches"), P.deferred_reason(reason, category, a, b).alias("reason"))


def ticketed_items(spark, d):
    items = table(spark, d, "orders").select("o_orderkey")
    tickets = table(spark, d, "lineitem").filter("l_discount > 0.08").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("code"))
    return P.defer_failures(items, tickets, "o_orderkey")


def gap_plan(spark, d):
    li = table(spark, d, "lineitem")
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_linenumber"))))
    gaps = li.groupBy(F.col("l_orderkey").alias("source")).agg(some(F.col("l_returnflag") == "N").alias("missed"), some(F.col("l_returnflag") == "R").alias("branches"))
    return P.gap_items(gaps, "not run", "skip", "plain").select("source", "kind", _ints(F.col("lines")).alias("lines"), "reason", "category", "tag")


def lesson_store(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return L.append_lessons(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"), ["user_id", "event_type"], "event_id", 50)


def id_pairs(spark, d):
    e = table(spark, d, "events")
    calls = e.filter("event_type = 'click'").select(F.col("user_id").alias("session"), (F.col("event_id") % 3).alias("name"), F.col("event_id").alias("id"), F.col("event_id").alias("at"))
    answers = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("session"), (F.col("event_id") % 3).alias("name"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") - 10).alias("ref"), F.col("event_id").alias("at"))
    return L.by_id_then_fifo(calls, answers)


def finding_labels(spark, d):
    p = table(spark, d, "part")
    text = _text("fun a() {}\n", F.when(F.col("p_size") > 10, "bind()\n").otherwise(""), F.when(F.col("p_size") > 20, "launch {\n").otherwise(""), F.repeat(F.lit("fun b() {}\n"), F.col("p_size") - 30))
    profile = marker_profile(text, {"binding": r"\bbind\(", "coroutine": r"\blaunch\s*\{"}, functions=10, few=3)
    state = disposition(F.when(F.col("p_size") > 5, F.col("p_size") > 30), F.col("p_size") > 40)
    return p.select("p_partkey", _joined(profile["markers"]).alias("markers"), profile["complex"].alias("complex"), state.alias("state"), cites(F.array(_text("/r/a/", _s("p_size"), ".kt"), F.lit("x")), ["a/7.kt", "8.kt", "t.kt"]).alias("cited"))


def marked_context(spark, d):
    e = table(spark, d, "events").withColumn("hit", F.col("event_type") == "error")
    return S.context_around(e, ["user_id"], "event_id", "hit", 3).select("user_id", "event_id", "mark")


QUERIES = {f.__name__: f for f in (
    source_facts, build_facts, test_names, attach_state, section_text, import_files, catalog_match, called_imports, new_imports, object_references, resource_names, sibling_tests, last_written,
    evidence_labels, package_files, existing_paths, hit_functions, calling_blocks, command_policy, path_hits, read_paths, layer_items, tag_slices, residual_labels, deferred_items, ticketed_items,
    gap_plan, lesson_store, id_pairs, finding_labels, marked_context,
)}

_KIND = "lower(replace(p_type, ' ', '_'))"
_FILES = "files AS (SELECT 'p' || s_nationkey AS package, 'S' || (s_suppkey % 50) AS name, 'D' || s_suppkey AS other, 'src/p' || s_nationkey || '/' || s_suppkey || '.kt' AS path FROM supplier)"
_NL = "chr(10)"
_RUN = "ROWS UNBOUNDED PRECEDING"

SQL = {
    "source_facts": f"SELECT p_partkey, 'x.' || {_KIND} || ',y.*' AS imports, 'I' || p_size AS declared, p_size <= 25 AS no_exec, 'K' || p_size AS instances, 'K' || p_size || ',Cipher' AS receivers, 'T' || p_size AS mocked FROM part",
    "build_facts": "WITH b AS (SELECT *, replace(p_brand, '#', '') AS n, (SELECT MAX(x) FROM (VALUES (10), (20), (30), (40)) v(x) WHERE x >= p_size AND x <= CASE WHEN p_size > 15 THEN p_size + 5 ELSE p_size END) AS level FROM part) SELECT p_partkey, ':app:testDebugUnitTest' AS unit, 'connected' || n || 'AndroidTest' AS device, ':create' || n || 'coverageReport' AS reports, ':kover' || n AS others, 'connected' || n || 'AndroidTest' AS listed, CASE WHEN p_size < 10 THEN NULL WHEN p_size < 30 THEN 'n.' || n ELSE n END AS namespace, level, CASE WHEN level IS NOT NULL THEN '' ELSE 'no installed platform >= minSdk ' || p_size || CASE WHEN p_size > 15 THEN ' and <= compileSdk ' || (p_size + 5) ELSE '' END END AS reason FROM b",
    "test_names": f"SELECT p_partkey, CASE WHEN p_size < 25 THEN 'test/unit/a/' || {_KIND} || 'Test.kt' END AS path, CASE WHEN p_size < 10 THEN 'mockk' WHEN p_size < 20 THEN 'mockito' ELSE 'open' END AS lane FROM part",
    "attach_state": f"WITH t AS (SELECT DISTINCT conv_id, turn, role FROM conversations), s AS (SELECT *, turn % 4 AS k, LAST_VALUE(CASE WHEN turn % 4 < 2 THEN turn % 4 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role {_RUN}) AS state FROM t) SELECT conv_id, COALESCE(BOOL_OR(k = 2 AND state = 1), false) AS late FROM s GROUP BY conv_id",
    "section_text": f"SELECT p_partkey, 'id: ' || p_size AS front, '## 1. A' || {_NL} || 'keep ' || p_size || {_NL} || {_NL} || '## 3. C' || {_NL} || 'last' AS sections, CASE WHEN p_size < 25 THEN 'T1,' || p_size ELSE '' END AS tickets, CASE WHEN p_size < 9 THEN 'own' ELSE 'l' || p_size || ',r' END AS branches, '## ' || p_size AS picked, p_size || {_NL} || 'd' || {_NL} || {_NL} || 'a' AS lines FROM part",
    "import_files": f"WITH {_FILES}, s AS (SELECT CAST(c_custkey AS VARCHAR) AS source, 'p' || c_nationkey AS package, CASE WHEN c_custkey % 7 = 0 THEN '*' WHEN c_custkey % 2 = 0 THEN 'S' || (c_custkey % 60) ELSE 'D' || (c_custkey % 90) END AS name FROM customer), decl AS (SELECT package, name AS n, path FROM files UNION SELECT package, other, path FROM files), w AS (SELECT package, n FROM (SELECT DISTINCT package, n FROM decl) QUALIFY ROW_NUMBER() OVER (PARTITION BY package ORDER BY n) <= 2), e AS (SELECT source, package, name AS n FROM s WHERE name <> '*' UNION SELECT source, package, w.n FROM s JOIN w USING (package) WHERE name = '*') SELECT source, package || '.' || n AS fqcn, MIN(path) AS path FROM e JOIN decl USING (package, n) GROUP BY ALL",
    "catalog_match": f"WITH {_FILES}, c AS (SELECT DISTINCT package || '.' || name AS entry, path FROM files), n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'p' || c_nationkey || '.S' || (c_custkey % 60) WHEN 1 THEN 'S' || (c_custkey % 60) ELSE 'p' || c_nationkey || '.S' || (c_custkey % 60) || '.Inner' END AS name FROM customer), m AS (SELECT c_custkey, entry, path, CASE WHEN name = entry THEN 0 WHEN ends_with(entry, '.' || name) THEN 1 ELSE 2 END AS found_by FROM n JOIN c ON name = entry OR ends_with(entry, '.' || name) OR starts_with(name, entry || '.')), b AS (SELECT * FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY found_by, CASE WHEN found_by = 2 THEN -LENGTH(entry) ELSE 0 END, entry, path) = 1) SELECT c_custkey, name, entry, path, found_by FROM n LEFT JOIN b USING (c_custkey)",
    "called_imports": "WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey % 20 AS k FROM lineitem), m AS (SELECT o, k, MIN(l_linenumber) AS line FROM i JOIN lineitem ON l_orderkey = o AND l_suppkey % 20 = k GROUP BY ALL), r AS (SELECT CAST(o AS VARCHAR) AS source, 'q.N' || k AS fqcn, line, CAST(ROW_NUMBER() OVER (PARTITION BY o ORDER BY line, 'q.N' || k) AS INT) AS rank FROM m) SELECT * FROM r WHERE rank <= 2",
    "new_imports": "WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS source, 'g.' || left(o_orderpriority, 1) AS fqcn, o_orderstatus AS s FROM orders) SELECT DISTINCT source, fqcn FROM o WHERE s = 'O' AND fqcn IN (SELECT 'g.' || (r_regionkey + 1) FROM region) AND (source, fqcn) NOT IN (SELECT (source, fqcn) FROM o WHERE s = 'F')",
    "object_references": "WITH l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey % 40 AS n FROM lineitem) SELECT CAST(o AS VARCHAR) AS source, CAST(n AS VARCHAR) AS name FROM l WHERE n IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) OR EXISTS (SELECT 1 FROM orders WHERE o_orderkey = o AND o_custkey % 40 = n)",
    "resource_names": "WITH u AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'res_' ELSE 'Res' END || (c_custkey % 40) AS name FROM customer), e AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'res_' ELSE 'r_es' END || (s_suppkey % 30) AS entry FROM supplier), o AS (SELECT lower(replace(entry, '_', '')) AS p, MIN(entry) AS one FROM e GROUP BY 1 HAVING COUNT(*) = 1) SELECT c_custkey, name, COALESCE(entry, one) AS fixed FROM u LEFT JOIN e ON name = entry LEFT JOIN o ON p = lower(replace(name, '_', ''))",
    "sibling_tests": "WITH f AS (SELECT DISTINCT c_nationkey AS k, 'F' || (c_custkey % 13) || CASE WHEN c_acctbal > 5000 THEN 'More' ELSE '' END || 'Test' AS test FROM customer), t AS (SELECT DISTINCT s_nationkey AS k, 'F' || (s_suppkey % 13) AS stem FROM supplier) SELECT CAST(k AS VARCHAR) AS folder, stem, test FROM t JOIN f USING (k) WHERE starts_with(test, stem) AND test <> stem || 'Test'",
    "last_written": "SELECT user_id, event_type, ARG_MAX(value, event_id) AS value FROM events GROUP BY ALL",
    "evidence_labels": "SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) THEN 'confirmed' ELSE 'dismissed' END AS state FROM supplier",
    "package_files": f"WITH {_FILES}, w AS (SELECT DISTINCT 'S' || (c_custkey % 60) AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'p' || c_nationkey END AS package FROM customer) SELECT w.name, w.package, MIN(path) AS path FROM w JOIN files f ON f.name = w.name AND w.package IN ('', f.package) GROUP BY ALL",
    "existing_paths": f"WITH {_FILES}, c AS (SELECT c_custkey, 'src/p' || c_nationkey || '/' || (c_custkey % 30) || '.kt' AS a, 'src/p' || c_nationkey || '/' || (c_custkey % 25) || '.kt' AS b FROM customer) SELECT c_custkey, CASE WHEN a IN (SELECT path FROM files) THEN a WHEN b IN (SELECT path FROM files) THEN b END AS resolved FROM c",
    "hit_functions": "WITH f AS (SELECT l_orderkey AS o, l_suppkey % 9 AS n, MIN(l_linenumber) AS lo, MAX(l_linenumber) AS hi FROM lineitem GROUP BY ALL) SELECT CAST(o AS VARCHAR) AS source, CAST(n AS VARCHAR) AS name, lo, hi FROM f WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o AND l_returnflag = 'R' AND l_linenumber BETWEEN lo AND hi) OR EXISTS (SELECT 1 FROM orders WHERE o_orderkey = o AND o_custkey % 9 = n)",
    "calling_blocks": "WITH b AS (SELECT l_orderkey AS o, l_linenumber AS block, MIN('run { m' || (l_suppkey % 5) || '(1); m' || (l_partkey % 5) || ' (2) }') AS text FROM lineitem GROUP BY ALL), m AS (SELECT *, regexp_extract_all(text, '(m\\d)', 1) AS c FROM b) SELECT CAST(o AS VARCHAR) AS source, block, CAST(block AS VARCHAR) AS label, CASE WHEN c[1] IN ('m1', 'm' || (o_custkey % 5)) THEN c[1] ELSE c[2] END AS method FROM m JOIN orders ON o_orderkey = o WHERE c[1] IN ('m1', 'm' || (o_custkey % 5)) OR c[2] IN ('m1', 'm' || (o_custkey % 5))",
    "command_policy": "WITH r AS (SELECT event_id, user_id % 2 = 0 AS fine, CASE event_type WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN '' ELSE 'outside' END WHEN 'error' THEN 'network' WHEN 'purchase' THEN 'denied' WHEN 'signup' THEN 'empty' ELSE 'not allowed' END AS reason FROM events) SELECT event_id, CASE WHEN reason = '' THEN 'allow' ELSE 'deny' END AS permission, reason, CASE WHEN fine THEN 'allow' ELSE 'deny' END AS path, 'allow' AS plan FROM r",
    "path_hits": f"SELECT event_id, user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id {_RUN}) AS hits FROM events",
    "read_paths": "WITH l AS (SELECT user_id AS session, json_extract_string(props, '$.k') AS path, ARG_MAX(event_type, event_id) AS t, ARG_MAX(value, event_id) AS value FROM events GROUP BY ALL) SELECT session, path, value FROM l WHERE t <> 'purchase'",
    "layer_items": "SELECT p_partkey, CASE WHEN p_size < 10 THEN ' ' ELSE 'Unit' END AS layer FROM part WHERE p_size <= 15",
    "tag_slices": "WITH t AS (SELECT *, CASE WHEN p_size < 5 THEN 'plain' ELSE split_part(p_name, ' ', 1) END AS tag FROM part), x AS (SELECT *, UNNEST(range(0, (p_size + 29) // 30)) AS part FROM t) SELECT p_partkey, tag, CASE tag WHEN 'large' THEN 1 WHEN 'small' THEN 2 ELSE 3 END AS place, CAST(part AS INT) AS part, CASE WHEN p_size > 9 THEN p_brand WHEN p_size > 7 THEN 'f' ELSE '<unknown>' END AS owner, CAST(LEAST(30, p_size - 30 * part) AS INT) AS n, CAST(30 * part + 1 AS INT) AS first FROM x",
    "residual_labels": "WITH h AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey, COALESCE(n, 0) AS hits, CASE WHEN o_orderpriority <> '5-LOW' AND COALESCE(n, 0) >= CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END THEN 'residual' ELSE 'testable' END AS label FROM orders LEFT JOIN h ON l_orderkey = o_orderkey",
    "deferred_items": "WITH p AS (SELECT p_partkey, p_size AS s, LEAST(9, p_size) || ',' || GREATEST(9, p_size) AS l FROM part), q AS (SELECT *, CASE WHEN s < 10 THEN '' ELSE l END AS lines, CASE WHEN s > 40 THEN '3' WHEN s < 10 THEN l ELSE '' END AS branches FROM p) SELECT p_partkey, lines, branches, CASE WHEN s > 45 THEN 'given' ELSE 'Deferred (' || CASE WHEN s < 10 THEN 'kover_residual_branch' WHEN s < 20 THEN 'not_unit_testable' ELSE 'late' END || '): ' || concat_ws(', ', CASE WHEN lines <> '' THEN 'lines [' || replace(lines, ',', ', ') || ']' END, CASE WHEN branches <> '' THEN 'branches [' || replace(branches, ',', ', ') || ']' END) || ' marked not_testable by planner.' END AS reason FROM q",
    "ticketed_items": "WITH t AS (SELECT l_orderkey, MIN(l_returnflag) AS reason FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) SELECT o_orderkey, reason, CASE WHEN reason IS NULL THEN 'testable' ELSE 'deferred' END AS label FROM orders LEFT JOIN t ON l_orderkey = o_orderkey",
    "gap_plan": "WITH l AS (SELECT DISTINCT l_orderkey AS source, CASE l_returnflag WHEN 'N' THEN 'line' ELSE 'branch' END AS kind, l_linenumber AS n FROM lineitem WHERE l_returnflag IN ('N', 'R')) SELECT source, kind, string_agg(n, ',' ORDER BY n) AS lines, 'not run' AS reason, 'skip' AS category, 'plain' AS tag FROM l GROUP BY ALL",
    "lesson_store": "SELECT user_id, event_type, MIN(event_id) AS event_id FROM events GROUP BY ALL ORDER BY event_id DESC LIMIT 50",
    "id_pairs": "WITH c AS (SELECT user_id AS session, event_id % 3 AS name, event_id AS called FROM events WHERE event_type = 'click'), a AS (SELECT user_id AS session, event_id % 3 AS name, CASE WHEN event_id % 4 = 0 THEN event_id - 10 END AS ref, event_id AS answered FROM events WHERE event_type = 'purchase'), i AS (SELECT session, c.name, called, answered FROM c JOIN a USING (session) WHERE ref = called), rc AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session, name ORDER BY called) AS n FROM c WHERE called NOT IN (SELECT called FROM i)), ra AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session, name ORDER BY answered) AS n FROM a WHERE answered NOT IN (SELECT answered FROM i)) SELECT *, 'id' AS \"by\" FROM i UNION ALL SELECT session, name, called, answered, 'order' FROM rc JOIN ra USING (session, name, n)",
    "finding_labels": "SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 10 THEN 'binding' END, CASE WHEN p_size > 20 THEN 'coroutine' END) AS markers, p_size - 29 >= 10 AS complex, CASE WHEN p_size > 40 THEN 'dismissed' WHEN p_size > 30 THEN 'confirmed' ELSE 'candidate' END AS state, p_size IN (7, 8) AS cited FROM part",
    "marked_context": "WITH e AS (SELECT *, MAX((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM events) SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN '>>' ELSE '  ' END AS mark FROM e WHERE near = 1",
}

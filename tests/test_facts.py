"""The lexer's facts against sources worked out by hand, and the columns that rest on them."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import sources
from marlstone.functions.lexer import KINDS, facts_of, facts_table

SOURCE = '''package a.b
import x.Y
import x.Z as Q
import w.*
// import no.Comment
/* object No { /* nested } */ still */
@HiltAndroidTest
@Config(sdk = [33], manifest = "a { b")
class Model<T : Any>(private val repo: Repo<T>, n: Int) : Base<T>(n), Face by other {
    @Inject lateinit var dep: dagger.Lazy<Dep>
    private var mock: org.m.MockedStatic<b.Target> = mockStatic()
    val text = "braces { ${repo.map { "in } side" }} } \\" end"
    val raw = """object Raw { "quoted" }"""
    val sign = '{'
    suspend fun load(id: Long, vararg names: List<String>): Int {
        Cache.getInstance(id).put(id)
        return helper<Int>(1) + Cipher.getInstance("AES").run { 2 }
    }
    fun `odd name`() = Unit
    companion object Made
}
object Single
interface Face { fun <R> go(r: R) }
'''


def of(kind, text=SOURCE):
    return [(f[1], f[2]) if f[2] else f[1] for f in facts_of(text) if f[0] == kind]


def test_thirteen_collections():
    assert of("package") == ["a.b"] and of("import") == ["x.Y", ("x.Z", "Q"), "w.*"]
    assert of("annotation") == ["HiltAndroidTest", "Config", "Inject"]
    assert of("class") == ["Model"] and of("object") == ["Made", "Single"] and of("interface") == ["Face"]
    assert of("function") == ["load", "odd name", "go"] and of("suspend") == ["load"]
    assert of("parameter") == [("id", "Long"), ("names", "List<String>"), ("r", "R")]
    assert of("property") == [("repo", "Repo<T>"), ("dep", "dagger.Lazy<Dep>"), ("mock", "org.m.MockedStatic<b.Target>"), "text", "raw", "sign"]
    assert of("injected") == [("dep", "dagger.Lazy<Dep>")]
    assert of("supertype") == [("Base", "Model"), ("Face", "Model")]
    assert of("receiver") == ["Cache", "Cipher"] and of("instance") == ["Cache", "Cipher"]
    assert of("call") == ["mockStatic", ("getInstance", "Cache"), "put", "helper", ("getInstance", "Cipher"), "run"]
    assert of("string")[:1] == ["a { b"] and of("string")[2] == 'object Raw { "quoted" }' and of("error") == []


def test_lines_depths_and_errors():
    assert [f[3:] for f in facts_of("class A {\n\n  object B\n}")] == [(1, 0), (3, 1)]
    assert of("error", "class A {") == ["unclosed brace"] and of("error", "}") == ["unopened brace"]
    assert of("error", 'val a = "x') == ["unclosed string"] and of("error", '"""x') == ["unclosed string"] and of("error", "/* /* */") == ["unclosed comment"]
    assert facts_of(None) == facts_of("") == facts_of("// only { a comment") == []
    assert of("receiver", "a.B.c(); this.X.y; B.c; B . d; x.b") == ["B", "B"] and of("class", "val k = A::class.java") == []
    assert len(facts_of("Cache.getInstance(1)\n" * 20_000)) == 60_000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab{}()<>"\'/*\\$`@:. \n', max_size=60))
def test_any_text_is_read(text):
    assert all(f[0] in KINDS and f[3] >= 1 and f[4] >= 0 for f in facts_of(text))


def test_columns(spark):
    texts = spark.createDataFrame([(1, SOURCE, "x"), (2, None, "x"), (3, "", "x"), (4, "var m: MockedStatic<A>\nvar m: q.MockedStatic<c.B>\nval n: MockedStatic", "x")], "id int, text string, kind string")
    got = texts.select("id", sources.instance_types(F.col("text")).alias("i"), sources.receiver_types(F.col("text")).alias("r"), sources.static_mock_types(F.col("text")).alias("m")).orderBy("id").collect()
    assert [(r["i"], r["r"], r["m"]) for r in got] == [(["Cache"], ["Cache", "Cipher"], {"mock": "Target"}), ([], [], {}), ([], [], {}), ([], [], {"m": "B"})]
    rows = facts_table(texts, ["id"], "text").filter("kind = 'suspend'").collect()
    assert [(r["id"], r["name"], r["line"]) for r in rows] == [(1, "load", 15)]
    assert facts_table(texts.limit(0), ["id"], "text").collect() == []


def test_tasks_and_namespaces(spark):
    tasks = ["testUnitTest", ":app:testDebugUnitTest", "xtestUnitTest", "UnitTest", "connectedAndroidTest", ":a:CREATEcoverageReport", "jacocoReport", "test-UnitTest", "koverReport"]
    row = spark.range(1).select(*[sources.task_kind(F.lit(t)).alias(str(i)) for i, t in enumerate(tasks)]).first()
    assert list(row) == ["unit_test"] * 3 + ["other", "android_test", "jacoco", "jacoco", "other", "other"]
    listing = "connectedAAndroidTest - x\nconnectedAndroidTest\n testUnitTest\nconnectedB_AndroidTest\nconnectedCAndroidTests"
    a, b = spark.range(1).select(sources.listed_tasks(F.lit(listing), "android_test"), sources.listed_tasks(F.lit(listing), "unit_test")).first()
    assert (a, b) == (["connectedAAndroidTest"], ["testUnitTest"])
    builds = ['namespace = "a.b"', "namespace 'c'", 'mynamespace = "no"\nnamespace("d")', "namespace = x"]
    got = spark.range(1).select(*[sources.first_scalar([F.lit(t)], sources.NAMESPACE_PATTERNS).alias(str(i)) for i, t in enumerate(builds)]).first()
    assert list(got) == ["a.b", "c", "d", None]

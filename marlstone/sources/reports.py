"""Coverage and test reports (XML) as tables of probes, counters and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.texts import is_generated, module_of_report
from marlstone.operators.coverage import engine_snapshot, merge_engines

_COUNTER = "struct<_type: string, _missed: bigint, _covered: bigint>"
PACKAGE = (
    f"_name string, class array<struct<_name: string, _sourcefilename: string, method: array<struct<_name: string, _desc: string, counter: array<{_COUNTER}>>>, counter: array<{_COUNTER}>>>,"
    f" sourcefile array<struct<_name: string, line: array<struct<_nr: int, _mi: int, _ci: int, _mb: int, _cb: int>>, counter: array<{_COUNTER}>>>, _corrupt_record string"
)
# Where the engines put their reports below a module.
LAYOUTS = {
    "unit": ("build/reports/kover", "build/reports/unit-coverage"),
    "instrumented": ("build/reports/instrumented-coverage", "build/reports/coverage/androidTest", "build/reports/jacoco", "build/outputs/code_coverage"),
}
FAILURE = "struct<_message: string, _VALUE: string>"
TESTCASE = f"_name string, _classname string, failure {FAILURE}, error {FAILURE}"


def read_packages(spark: SparkSession, paths: list[str] | str, engine: str, root: str = "/") -> DataFrame:
    """The package elements of coverage reports with ``path``, ``engine`` and ``module``. Malformed files give no rows.

    A file is taken only if its whole ``report`` element can be read.
    """
    raw = spark.read.format("xml").option("rowTag", "package").option("mode", "PERMISSIVE").option("recursiveFileLookup", True).schema(PACKAGE)
    rows = raw.load(paths).withColumn("path", F.col("_metadata.file_path")).filter("_corrupt_record IS NULL AND _name IS NOT NULL").drop("_corrupt_record")
    whole = spark.read.format("xml").option("rowTag", "report").option("mode", "PERMISSIVE").option("recursiveFileLookup", True).schema("_name string, _corrupt_record string")
    whole = whole.load(paths).withColumn("path", F.col("_metadata.file_path")).groupBy("path").agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad"), F.count("_name").alias("named")).filter("bad = 0 AND named >= 0").select("path")
    rows = rows.join(whole, "path", "left_semi")
    return rows.withColumns({"engine": F.lit(engine), "module": module_of_report(F.col("path"), root)})


def probes(packages: DataFrame, include_generated: bool = False) -> DataFrame:
    """One row for each line of each source file; generated sources are left out unless asked for."""
    files = packages.select("engine", "module", "path", F.col("_name").alias("package"), F.explode("sourcefile").alias("f"))
    if not include_generated:
        files = files.filter(~is_generated(F.col("package"), F.col("f._name")))
    lines = files.select("engine", "module", "path", "package", F.col("f._name").alias("source_name"), F.explode("f.line").alias("l"))
    counts = [F.coalesce(F.col(f"l._{c}"), F.lit(0)).alias(c) for c in ("mi", "ci", "mb", "cb")]
    return lines.select("engine", "module", "path", "package", "source_name", F.col("l._nr").alias("line_no"), *counts).filter("line_no > 0")


def counters(packages: DataFrame) -> DataFrame:
    """One row for each counter of each source file."""
    files = packages.select("engine", "module", "path", F.col("_name").alias("package"), F.explode("sourcefile").alias("f"))
    c = files.select("engine", "module", "path", "package", F.col("f._name").alias("source_name"), F.explode("f.counter").alias("c"))
    return c.select("engine", "module", "path", "package", "source_name", F.lower("c._type").alias("metric"), F.coalesce("c._missed", F.lit(0)).alias("missed"), F.coalesce("c._covered", F.lit(0)).alias("covered"))


def elements(packages: DataFrame) -> DataFrame:
    """Slots of every class and method: how many there are and how many are covered, by metric and owner."""
    classes = packages.select("engine", "module", F.col("_name").alias("package"), F.explode("class").alias("k"))
    owned = classes.select("engine", "module", "package", F.col("k._sourcefilename").alias("source_name"), F.col("k._name").alias("class"), F.explode("k.method").alias("m"))
    c = owned.select("engine", "module", "package", "source_name", F.concat_ws("#", "class", "m._name", "m._desc").alias("owner"), F.explode("m.counter").alias("c"))
    return c.select("engine", "module", "package", "source_name", "owner", F.lower("c._type").alias("metric"), (F.col("c._missed") + F.col("c._covered")).alias("slots"), F.col("c._covered").alias("covered_slots"))


def missed_methods(packages: DataFrame, counter: str = "LINE") -> DataFrame:
    """The methods with missed lines (or branches) of each source."""
    e = elements(packages).filter((F.col("metric") == counter.lower()) & (F.col("slots") > F.col("covered_slots")))
    return e.groupBy("engine", "module", "package", "source_name").agg(F.array_sort(F.collect_set(F.element_at(F.split("owner", "#"), 2))).alias("methods"))


def test_failures(spark: SparkSession, paths: list[str] | str, stem: str, limit: int = 5, chars: int = 400) -> DataFrame:
    """Failed test cases of reports whose name holds ``stem``, at most ``limit`` (a report for readers), messages cut."""
    rows = spark.read.format("xml").option("rowTag", "testcase").option("recursiveFileLookup", True).schema(TESTCASE).load(paths)
    rows = rows.withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1)).filter(F.col("file").startswith("TEST-") & F.contains("file", F.lit(stem)))
    bad = rows.withColumn("f", F.coalesce("failure", "error")).filter("f IS NOT NULL")
    return bad.select("file", F.col("_name").alias("test"), F.substring("f._message", 1, chars).alias("message"), F.substring("f._VALUE", 1, chars).alias("trace")).orderBy("file", "test").limit(limit)


def list_reports(spark: SparkSession, root: str, layouts: dict[str, tuple[str, ...]] = LAYOUTS) -> DataFrame:
    """The XML files below ``root`` that lie in a folder of a layout: ``engine``, ``module``, ``path``, ``modified``, ``length``.

    A listing only: no file is opened. A file that several ways lead to counts once, by its path without ``.`` and ``..``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(root)
    rows = files.select(plain_path(F.col("path")).alias("path"), F.col("modificationTime").alias("modified"), "length").dropDuplicates(["path"])
    engine = F.coalesce(*[F.when(F.contains("path", F.lit(f"/{folder}/")), F.lit(name)) for name, folders in layouts.items() for folder in folders])
    return rows.withColumn("engine", engine).filter("engine IS NOT NULL").select("engine", module_of_report(F.col("path"), root).alias("module"), "path", "modified", "length")


def plain_path(path: Column) -> Column:
    """A path without its scheme's slashes doubled, and without ``.`` and ``..``."""
    out = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), r"(?<!:)/+(\./+)*", "/")
    for _ in range(4):  # so many steps up in a row
        out = F.regexp_replace(out, r"/(?!\.\./)[^/]+/\.\./", "/")
    return out


def latest_reports(listing: DataFrame) -> DataFrame:
    """The latest report of each engine and module; of equally old ones that with the last path."""
    return listing.groupBy("engine", "module").agg(F.max(F.struct("modified", "path", "length")).alias("r")).select("engine", "module", "r.*")


def read_latest(spark: SparkSession, root: str, layouts: dict[str, tuple[str, ...]] = LAYOUTS) -> DataFrame:
    """The packages of the latest report of each engine and module; no other report is opened.

    The paths, one for each engine and module, are known to the driver, as those of any table are.
    """
    chosen: dict[str, list[str]] = {}
    for r in latest_reports(list_reports(spark, root, layouts)).collect():
        chosen.setdefault(r["engine"], []).append(r["path"])
    out = None
    for engine, paths in sorted(chosen.items()):
        rows = read_packages(spark, sorted(paths), engine, root)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], PACKAGE).drop("_corrupt_record").withColumns({c: F.lit(None).cast("string") for c in ("path", "engine", "module")}).limit(0)


def latest_gaps(spark: SparkSession, root: str, mode: str = "reference") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The merged, the unit and the instrumented snapshot of every source, from the latest report of each engine and module."""
    snapshot = engine_snapshot(probes(read_latest(spark, root)))
    return merge_engines(snapshot, mode), snapshot.filter("engine = 'unit'"), snapshot.filter("engine = 'instrumented'")

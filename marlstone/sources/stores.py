"""JSON stores, text catalogs and versioned tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_ENTRY = "source string, source_name string, module string, reason string, category string, evidence string, recorded_at string, lines array<int>, branches array<int>, methods array<string>, model_processed boolean"
RUN = "source string, source_name string, test_file string, module string, outcome string, failure_stage string, evidence string, updated_at string, accepted boolean, gradle_passed boolean, kover_improved boolean, duration_seconds double, validation_issues array<string>"


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in fields.split(", "))) + ">"


def read_ledger(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The entries of ledger documents with their places; documents of another shape give no rows."""
    rows = spark.read.schema(f"schema_version string, entries array<{_struct(LEDGER_ENTRY)}>").json(paths, multiLine=True)
    return rows.select(F.coalesce("schema_version", F.lit("1")).alias("schema_version"), F.posexplode("entries").alias("pos", "e")).select("schema_version", "pos", "e.*")


def read_runs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The run records of a store keyed by source path."""
    rows = spark.read.schema(f"sources map<string, {_struct(RUN)}>").json(paths, multiLine=True)
    return rows.select(F.explode("sources").alias("key", "r")).select("key", "r.*")


def read_lessons(spark: SparkSession, paths: list[str] | str, tags: list[str], limit: int) -> DataFrame:
    """The first ``limit`` lessons that have no tags or share one with ``tags`` (case folded); no tags asked for take all."""
    lesson = "struct<summary: string, notes: string, tags: array<string>>"
    rows = spark.read.schema(f"generation_lessons array<{lesson}>").json(paths, multiLine=True).select(F.posexplode("generation_lessons").alias("pos", "l")).select("pos", "l.*")
    wanted = F.array(*[F.lit(t.lower()) for t in tags]) if tags else F.array().cast("array<string>")
    low = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    return rows.filter((F.size(low) == 0) | (F.size(wanted) == 0) | F.arrays_overlap(low, wanted)).orderBy("pos").limit(limit)


def documented_entries(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Entries of API documents (lists under ``api_index`` and ``api``): ``path``, ``part``, ``pos``, the names and the entry's ``json``.

    Other keys are not read; a document of another shape gives no rows.
    """
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "api_index array<string>, api array<string>").alias("d"))
    each = [rows.select("path", F.lit(n).alias("part"), F.posexplode(f"d.{part}").alias("pos", "json")) for n, part in enumerate(("api_index", "api"))]
    name = lambda f: F.nullif(F.trim(F.get_json_object("json", f"$.{f}")), F.lit("")).alias(f)
    return each[0].unionByName(each[1]).select("path", "part", "pos", name("class"), name("qualified_name"), "json")


def documented_names(entries: DataFrame) -> DataFrame:
    """The names of documented types with the document they are in: both names of each entry, each pair once."""
    return entries.select("path", F.explode(F.array_compact(F.array("qualified_name", "class"))).alias("name")).distinct()


def read_texts(spark: SparkSession, paths: list[str] | str, pattern: str = "*", skip: tuple[str, ...] = ("build", ".git", ".gradle")) -> DataFrame:
    """Whole text files with path, name and time; files below a skipped folder are left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(paths, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return rows.filter(~F.col("path").rlike("/(" + "|".join(s.replace(".", "\\.") for s in skip) + ")/"))


def source_catalog(texts: DataFrame) -> DataFrame:
    """Sources by class name; a name that occurs again gets ``@path`` behind it."""
    from pyspark.sql import Window

    stem = F.regexp_replace("name", "\\.[^.]+$", "")
    n = F.row_number().over(Window.partitionBy(stem).orderBy("path"))
    return texts.withColumn("class_name", F.when(n == 1, stem).otherwise(F.concat(stem, F.lit("@"), "path")))


def search_lines(texts: DataFrame, pattern: str) -> DataFrame:
    """The lines of the texts that match, with path and line number."""
    lines = texts.select("path", F.posexplode(F.split("text", "\\r?\\n")).alias("n", "line"))
    return lines.filter(F.col("line").rlike(pattern)).select("path", (F.col("n") + 1).alias("line_no"), "line")


def load_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules from a JSON file (a list under ``rules``); a small dimension that is compiled to columns."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    rules = json.loads(text or "{}").get("rules", [])
    return [{"id": str(r.get("id", n)), **{k: v for k, v in r.items() if k != "id"}} for n, r in enumerate(rules)]


def write_version(table: DataFrame, folder: str, version: int) -> str:
    """Write the next version of a table beside the earlier ones, which stay readable."""
    path = f"{folder.rstrip('/')}/v{version:06d}"
    table.write.mode("errorifexists").parquet(path)
    return path


def write_json_document(table: DataFrame, path: str, stamp: bool = True) -> None:
    """One JSON object a row, with ``updated_at`` if asked for."""
    out = table.withColumn("updated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")) if stamp else table
    out.write.mode("overwrite").json(path)

"""YAML documents as a table, and tables as one JSON document: Python data sources.

Files are reached by their URI through Arrow's file systems (local paths, ``file``, ``hdfs``, ``s3``).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

TABLE = "id string, title string, columns array<string>, when_any_tags array<string>, rows array<map<string, string>>"
RULES = "rules array<string>"


def _located(uri: str):
    """The file system of a URI or local path, and the path within it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return fs.LocalFileSystem(), uri


@dataclass
class _File(InputPartition):
    path: str


class _YamlReader(DataSourceReader):
    def __init__(self, path: str):
        self.uri = path

    def partitions(self) -> list[_File]:
        """One partition for each file with a YAML suffix, in the order of paths."""
        from pyarrow import fs

        system, path = _located(self.uri)
        found = system.get_file_info(path)
        every = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted(f.path for f in every if f.type == fs.FileType.File and f.path.endswith((".yaml", ".yml")))
        return [_File(f) for f in files] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple[str, int, str]]:
        """The documents of a file as JSON; a file that is no YAML gives none."""
        import yaml

        if not partition.path:
            return
        system, _ = _located(self.uri)
        with system.open_input_stream(partition.path) as f:
            raw = f.read()
        try:
            docs = [d for d in yaml.safe_load_all(raw.decode()) if d is not None]
        except (yaml.YAMLError, UnicodeDecodeError):
            return
        for n, d in enumerate(docs):
            yield partition.path, n, json.dumps(d, default=str, ensure_ascii=False)


class YamlSource(DataSource):
    """``path``, ``ord`` and the document as JSON, of all YAML files below a path."""

    @classmethod
    def name(cls) -> str:
        return "yaml_documents"

    def schema(self) -> str:
        return "path string, ord int, document string"

    def reader(self, schema) -> _YamlReader:
        return _YamlReader(self.options["path"])


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class _DocumentWriter(DataSourceWriter):
    """Tasks write parts beside the target; the commit joins them in the order of partitions and moves the whole into place."""

    def __init__(self, uri: str, key: str):
        self.uri, self.key = uri, key
        self.parts = f"{uri.rstrip('/')}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = _located(self.parts)
        system.create_dir(folder, recursive=True)
        path, n = f"{folder}/{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}", 0
        with system.open_output_stream(path) as out:
            for row in iterator:
                record = row.asDict(recursive=True)
                line = json.dumps(str(record[self.key]), ensure_ascii=False) + ": " + json.dumps(record, sort_keys=True, default=str, ensure_ascii=False)
                out.write((",\n" * (n > 0) + line).encode())
                n += 1
        return _Part(context.partitionId(), path, n)

    def commit(self, messages: list) -> None:
        system, target = _located(self.uri)
        whole = f"{target.rstrip('/')}.new-{uuid.uuid4().hex}"
        system.create_dir(posixpath.dirname(whole) or ".", recursive=True)
        with system.open_output_stream(whole) as out:
            out.write(b"{")
            some = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
            for n, m in enumerate(some):
                out.write(b",\n" if n else b"\n")
                with system.open_input_stream(m.path) as part:
                    while block := part.read(1 << 20):
                        out.write(block)
            out.write(b"\n}\n")
        system.move(whole, target)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, folder = _located(self.parts)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class DocumentSink(DataSource):
    """Writes a table as one JSON object of records by a key."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def writer(self, schema, overwrite: bool) -> _DocumentWriter:
        return _DocumentWriter(self.options["path"], self.options["key"])


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``ord`` and ``document`` (JSON) of the YAML files below a path; malformed files give no rows."""
    spark.dataSource.register(YamlSource)
    return spark.read.format("yaml_documents").option("path", path).load()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of YAML files (a list, or a mapping with a list ``rules``): ``file``, ``rule_ord`` and ``rule`` (JSON); entries that are no mappings are left out."""
    docs = read_yaml(spark, path)
    rules = F.coalesce(F.from_json("document", RULES)["rules"], F.when(F.col("document").startswith("["), F.from_json("document", "array<string>")))
    each = docs.select(F.element_at(F.split("path", "/"), -1).alias("file"), "ord", F.posexplode(rules).alias("rule_ord", "rule"))
    return each.filter(F.col("rule").startswith("{")).select("file", "ord", "rule_ord", "rule")


def rules_by_file(rules: DataFrame) -> dict[str, list[dict]]:
    """The rules as mappings, by file in order: a small dimension that is compiled to columns."""
    out: dict[str, list[dict]] = {}
    for r in rules.orderBy("file", "ord", "rule_ord").collect():
        out.setdefault(r["file"], []).append(json.loads(r["rule"]))
    return out


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Decision tables of YAML files: ``id`` (or the file's name), ``title``, ``columns``, ``when_any_tags`` and ``rows``.

    Documents without columns are no tables.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.ya?ml$", "")
    t = read_yaml(spark, path).select(stem.alias("stem"), F.from_json("document", TABLE).alias("t"))
    named = t.select(F.coalesce("t.id", "stem").alias("id"), F.coalesce("t.title", "t.id", F.lit("DECISION TABLE")).alias("title"), "t.columns", "t.when_any_tags", "t.rows")
    return named.filter(F.size("columns") > 0)


def table_texts(tables: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Each table as Markdown (``id``, ``text``); with ``tags``, tables that ask for some must share one with them."""
    cell = lambda v: F.replace(F.regexp_replace(F.coalesce(v, F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("/"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(F.filter(F.coalesce("rows", F.array().cast("array<map<string,string>>")), lambda r: r.isNotNull()), lambda r: line(F.transform("columns", lambda c: cell(F.try_element_at(r, c)))))
    head = F.array(F.concat(F.lit("## "), F.trim("title")), line(F.col("columns")), line(F.transform("columns", lambda c: F.lit("---"))))
    asked = F.coalesce("when_any_tags", F.array().cast("array<string>"))
    rows = tables if tags is None else tables.filter((F.size(asked) == 0) | F.arrays_overlap(asked, F.array(*[F.lit(t.strip()) for t in tags]).cast("array<string>")))
    return rows.select("id", F.array_join(F.concat(head, body), "\n").alias("text"))


def write_document(table: DataFrame, path: str, key: str) -> None:
    """The table as one JSON object at ``path``: records by ``key`` in its order, their fields sorted.

    The document appears whole or not at all; a failed task leaves the old one. Records of equal keys all stay, readers see the last. A null
    key is ``None``.
    """
    table.sparkSession.dataSource.register(DocumentSink)
    rows = table.repartitionByRange(F.col(key).cast("string"), key).sortWithinPartitions(F.col(key).cast("string"))
    rows.write.format("json_document").mode("overwrite").option("path", path).option("key", key).save()

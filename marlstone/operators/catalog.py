"""Names, imports and files: resolution by ranked equi joins with a file catalog.

A catalog has a row for each file: ``path``, ``package``, ``name`` (the file's stem) and, where contents are
needed, ``text`` or ``declared`` (an array of declared names).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlstone.functions.texts import package_of, simple_name


def _ranked(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Of the first part that has a key, the smallest value."""
    every = reduce(lambda a, b: a.unionByName(b), [p.select(*keys, value, F.lit(n).alias("found_by")) for n, p in enumerate(parts)])
    return every.groupBy(*keys).agg(F.min(F.struct("found_by", value)).alias("_b")).select(*keys, f"_b.{value}", "_b.found_by")


def first_existing(rows: DataFrame, key: str, candidates: list[Column], files: DataFrame) -> DataFrame:
    """Adds ``resolved``: the first of the candidate paths that is in the catalog, null if none is."""
    each = rows.select(key, F.posexplode(F.array(*candidates)).alias("_n", "path"))
    hit = each.join(files.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.min_by("path", "_n").alias("resolved"))
    return rows.join(hit, key, "left")


def by_name(names: DataFrame, files: DataFrame) -> DataFrame:
    """Files of qualified names (``fqcn``): by conventional path (package and stem), else by declaration; the first path of several."""
    n = names.select("fqcn").distinct().withColumns({"package": package_of(F.col("fqcn")), "name": simple_name(F.col("fqcn"))})
    conventional = n.join(files.select("package", "name", "path"), ["package", "name"])
    declared = n.join(files.select("package", F.explode("declared").alias("name"), "path"), ["package", "name"])
    return _ranked([conventional, declared], ["fqcn"], "path")


def resolved_imports(sources: DataFrame, files: DataFrame, fan_out: int = 24) -> DataFrame:
    """``source``, ``fqcn`` and ``path`` of imports (``source``, ``fqcn``).

    A wildcard stands for the declarations of its package, the first ``fan_out`` of them by name (a feature of
    the listing, not a limit on work).
    """
    wild = sources.filter(F.col("fqcn").endswith(".*")).withColumn("package", F.expr("substring(fqcn, 1, length(fqcn) - 2)"))
    inside = files.select("package", F.explode("declared").alias("name")).distinct()
    inside = inside.withColumn("_n", F.row_number().over(Window.partitionBy("package").orderBy("name"))).filter(F.col("_n") <= fan_out)
    named = wild.join(inside, "package").select("source", F.concat_ws(".", "package", "name").alias("fqcn"))
    every = sources.filter(~F.col("fqcn").endswith(".*")).select("source", "fqcn").unionByName(named).distinct()
    return every.join(by_name(every, files).select("fqcn", "path"), "fqcn").select("source", "fqcn", "path")


def catalog_lookup(names: DataFrame, name: str, catalog: DataFrame) -> DataFrame:
    """For each name the catalog entry (``entry``, ``path``) that equals it, else ends in ``.name``, else is its longest prefix.

    ``found_by`` is 0, 1 or 2. Endings and prefixes are exploded and met by equality.
    """
    n, c = names.select(F.col(name).alias("_name")).distinct(), catalog.select("entry", "path").distinct()
    parts = F.split("entry", "\\.")
    exact = n.join(c, n["_name"] == c["entry"])
    tails = c.select("*", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))).alias("_name"))
    suffix = n.join(tails, "_name")
    own = F.split("_name", "\\.")
    heads = n.select("*", F.explode(F.when(F.size(own) > 1, F.transform(F.sequence(F.lit(1), F.size(own) - 1), lambda i: F.array_join(F.slice(own, F.lit(1), i), ".")))).alias("entry"))
    prefix = heads.join(c, "entry")
    rank = lambda d, by, order: d.select("_name", F.lit(by).alias("found_by"), order.alias("_o"), "entry", "path")
    every = rank(exact, 0, F.lit(0)).unionByName(rank(suffix, 1, F.lit(0))).unionByName(rank(prefix, 2, -F.length("entry")))
    best = every.groupBy("_name").agg(F.min(F.struct("found_by", "_o", "entry", "path")).alias("b"))
    return names.join(best.select(F.col("_name").alias(name), "b.entry", "b.path", "b.found_by"), name, "left")


def called_imports(calls: DataFrame, imports: DataFrame, top: int) -> DataFrame:
    """Imports (``source``, ``fqcn``) whose simple name their source calls (``source``, ``callee``, ``line``), once each, the first ``top`` by line (a report)."""
    hit = imports.withColumn("callee", simple_name(F.col("fqcn"))).join(calls, ["source", "callee"]).groupBy("source", "fqcn").agg(F.min("line").alias("line"))
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("line", "fqcn"))).filter(F.col("rank") <= top)


def new_generated_imports(test_imports: DataFrame, source_imports: DataFrame, generated: DataFrame) -> DataFrame:
    """Imports of tests that name generated types and that the source does not have; all are (``source``, ``fqcn``)."""
    return test_imports.join(generated.select("fqcn"), "fqcn", "left_semi").join(source_imports.select("source", "fqcn"), ["source", "fqcn"], "left_anti").select("source", "fqcn").distinct()


def referenced_objects(receivers: DataFrame, project: DataFrame, local: DataFrame) -> DataFrame:
    """Receivers (``source``, ``name``) that are objects of the project (``name``) or of their own source (``source``, ``name``)."""
    return receivers.join(project.select("name"), "name", "left_semi").select("source", "name").unionByName(receivers.join(local.select("source", "name"), ["source", "name"], "left_semi").select("source", "name")).distinct()


def hit_functions(functions: DataFrame, lines: DataFrame, names: DataFrame) -> DataFrame:
    """Functions (``source``, ``name``, ``lo``, ``hi``) that hold one of the lines (``source``, ``at``) or are named (``source``, ``name``), once each."""
    at = lines.select(F.col("source").alias("_s"), "at")
    inside = functions.join(at, (F.col("source") == F.col("_s")) & F.col("at").between(F.col("lo"), F.col("hi")), "left_semi")
    return inside.unionByName(functions.join(names.select("source", "name"), ["source", "name"], "left_semi")).distinct()


def calling_blocks(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """Blocks (``source``, ``block``, ``label``, ``text``) that call a method of their source (``source``, ``name``), with the method called first."""
    calls = blocks.select("source", "block", "label", F.posexplode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("pos", "name"))
    return calls.join(names.select("source", "name").distinct(), ["source", "name"]).groupBy("source", "block", "label").agg(F.min_by("name", "pos").alias("method"))


def rewritten_names(names: DataFrame, name: str, index: DataFrame, entry: str) -> DataFrame:
    """Adds ``fixed``: the name if the index has it, else the one entry that equals it without underscores and case, else null."""
    plain = lambda c: F.lower(F.regexp_replace(c, "_", ""))
    entries = index.select(F.col(entry).alias("_e")).distinct()
    one = entries.groupBy(plain(F.col("_e")).alias("_p")).agg(F.min("_e").alias("_only"), F.count("*").alias("_c")).filter("_c = 1")
    out = names.withColumn("_p", plain(F.col(name))).join(entries, F.col(name) == F.col("_e"), "left").join(one, "_p", "left")
    return out.withColumn("fixed", F.coalesce("_e", "_only")).drop("_e", "_p", "_only", "_c")


def sibling_tests(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Tests beside each target (``folder``, ``stem``): files of its folder whose stem begins with ``stem`` and ends in ``Test``, the target's own test left out."""
    f = files.select("folder", F.col("stem").alias("test"))
    hit = targets.join(f, "folder").filter(F.col("test").startswith(F.col("stem")) & F.col("test").endswith("Test") & (F.col("test") != F.concat("stem", F.lit("Test"))))
    return hit.select("folder", "stem", "test").distinct()


def verified_index(writes: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value of each key that was written last."""
    return writes.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def having_evidence(rows: DataFrame, keys: list[str], evidence: DataFrame, label: str, found: str, missing: str) -> DataFrame:
    """Rows with ``label`` set to ``found`` where the evidence has their keys, else to ``missing``."""
    hit = evidence.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, keys, "left").withColumn(label, F.when(F.col("_hit"), found).otherwise(missing)).drop("_hit")


def package_match(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (``name``, ``package``) the first file in ``pos`` of that package; without a package the first with that name."""
    same = wanted.filter("package <> ''").join(files, ["name", "package"])
    any_ = wanted.filter("package = ''").join(files.drop("package"), "name")
    every = same.select("name", "package", "path", "pos").unionByName(any_.select("name", "package", "path", "pos"))
    return every.groupBy("name", "package").agg(F.min_by("path", "pos").alias("path"))


def documented_entry(names: DataFrame, entries: DataFrame) -> DataFrame:
    """``fqcn`` and the entry (``path``, ``part``, ``pos``) that documents it: the first of that very name, else the last whose simple name is the same.

    Entries have ``class`` and ``qualified_name``; the class is the name where it is there. One equi join on the simple name; the candidates of a
    name meet in a partial maximum. Null and repeated names give nothing more.
    """
    name = F.coalesce(F.nullif(F.trim("class"), F.lit("")), F.nullif(F.trim("qualified_name"), F.lit("")))
    known = entries.select(name.alias("_name"), "path", "part", "pos").filter("_name IS NOT NULL").withColumn("_simple", simple_name(F.col("_name")))
    asked = names.select("fqcn").filter("fqcn IS NOT NULL").distinct().withColumn("_simple", simple_name(F.col("fqcn")))
    exact = F.col("_name") == F.col("fqcn")
    # A document that holds the very name wins; within one kind of match, the place decides.
    place = F.struct(exact.alias("e"), F.when(exact, -F.col("part")).otherwise(F.col("part")).alias("a"), F.when(exact, -F.col("pos")).otherwise(F.col("pos")).alias("b"), F.col("path").alias("c"))
    best = asked.join(known, "_simple").groupBy("fqcn").agg(F.max_by(F.struct("path", "part", "pos", exact.alias("exact")), place).alias("_b"))
    return best.select("fqcn", "_b.*")

"""Unique fuzzy matches of names, as a similarity join.

A name meets the candidates of its kind that share a letter of its prefix: letters are told apart by how often they
occurred before in the name and put in one global order, rare ones first. Two names whose ratio reaches the cutoff share
so many letters that their prefixes have one in common, whatever the order. Lengths and the number of shared letters
then bound the ratio; what is left is decided by the sequence matcher in Arrow batches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scans import matching_ratio

CUTOFF = 0.55
REFERENCE = r"(?<![\w.])R\.(\w+)\.(\w+)"


def plain_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "_", ""))


def letters(name: Column) -> Column:
    """The letters of a name with their number among equal ones, those with high numbers first."""
    one = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)))
    count = lambda c, i: F.size(F.filter(F.slice(one, F.lit(1), i + 1), lambda x: x == c))
    numbered = F.transform(one, lambda c, i: F.struct((-count(c, i)).alias("n"), c.alias("c")))
    return F.transform(F.array_sort(numbered), lambda x: F.concat(x["c"], x["n"].cast("string")))


def _sided(names: DataFrame, name: str, side: str, cutoff: float) -> DataFrame:
    rows = names.select("kind", F.col(name).alias(side), letters(F.col(name)).alias(f"{side}_letters"))
    # A partner shares cutoff / (2 - cutoff) of the letters at least, for it is no shorter than that.
    least = F.ceil(F.size(f"{side}_letters") * F.lit(cutoff / (2 - cutoff)) - 1e-9).cast("int")
    prefix = F.slice(f"{side}_letters", F.lit(1), F.size(f"{side}_letters") - F.greatest(least, F.lit(1)) + 1)
    return rows.withColumn(f"{side}_prefix", prefix)


def similar_pairs(names: DataFrame, candidates: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(``kind``, ``name``, ``candidate``, ``ratio``) of distinct names and candidates of a kind whose ratio reaches ``cutoff``.

    Null and empty names match nothing; rows of a null kind meet nobody.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff")
    some = lambda rows, c: rows.select("kind", c).filter((F.length(c) > 0) & F.col("kind").isNotNull()).distinct()
    left = _sided(some(names, "name"), "name", "name", cutoff).withColumn("letter", F.explode("name_prefix"))
    right = _sided(some(candidates, "candidate"), "candidate", "candidate", cutoff).withColumn("letter", F.explode("candidate_prefix"))
    met = left.join(right, ["kind", "letter"])
    n, m = F.size("name_letters"), F.size("candidate_letters")
    shared = F.size(F.array_intersect("name_letters", "candidate_letters"))
    met = met.filter((2 * F.least(n, m) >= cutoff * (n + m) - 1e-9) & (F.element_at(F.array_intersect("name_prefix", "candidate_prefix"), 1) == F.col("letter")))
    met = met.filter(2 * shared >= cutoff * (n + m) - 1e-9).select("kind", "name", "candidate")
    return met.withColumn("ratio", matching_ratio("candidate", "name")).filter(F.col("ratio") >= cutoff)


def unique_matches(names: DataFrame, candidates: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(``kind``, ``name``, ``candidate``, ``how``) of each distinct name with one match among the candidates of its kind.

    ``plain``: the only candidate that is equal without underscores and case. ``fuzzy``: of names without such a one,
    the only candidate whose ratio reaches ``cutoff``. A name with two or more has no match; so have null and empty names.
    """
    own = names.select("kind", "name").filter("kind IS NOT NULL AND name <> ''").distinct()
    index = candidates.select("kind", "candidate").filter("kind IS NOT NULL AND candidate <> ''").distinct()
    once = index.groupBy("kind", plain_name(F.col("candidate")).alias("plain")).agg(F.count("*").alias("n"), F.min("candidate").alias("candidate")).filter("n = 1")
    plain = own.withColumn("plain", plain_name(F.col("name"))).join(once, ["kind", "plain"]).select("kind", "name", "candidate", F.lit("plain").alias("how"))
    rest = own.join(plain, ["kind", "name"], "left_anti")
    near = similar_pairs(rest, index, cutoff).groupBy("kind", "name").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate")).filter("n = 1")
    return plain.unionByName(near.select("kind", "name", "candidate", F.lit("fuzzy").alias("how")))


def corrected_references(texts: DataFrame, key: str, text: str, index: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``texts`` with the references ``R.kind.name`` that the index (``kind``, ``name``) lacks put right where it has one match.

    Adds ``corrections``, how many different ones; keys tell the rows apart. Other columns stay.
    """
    found = texts.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(REFERENCE), F.lit(0)))).alias("reference"))
    found = found.select("key", "reference", F.split("reference", r"\.")[1].alias("kind"), F.split("reference", r"\.")[2].alias("name"))
    known = index.select("kind", "name").distinct()
    unknown = found.join(known, ["kind", "name"], "left_anti")
    matched = unknown.join(unique_matches(unknown, known.withColumnRenamed("name", "candidate"), cutoff), ["kind", "name"])
    edits = matched.groupBy("key").agg(F.collect_list(F.struct("reference", F.concat_ws(".", F.lit("R"), "kind", "candidate").alias("to"))).alias("edits"))  # as many as a text has
    joined = texts.join(edits, texts[key] == edits["key"], "left").drop(edits["key"])
    # Corrected names are in the index, so no edit meets what another one has written.
    step = lambda t, e: F.regexp_replace(t, F.concat(F.lit(r"(?<![\w.])\Q"), e["reference"], F.lit(r"\E(?!\w)")), e["to"])
    edited = F.when(F.col("edits").isNotNull(), F.aggregate("edits", F.col(text), step)).otherwise(F.col(text))
    return joined.withColumn(text, edited).withColumn("corrections", F.coalesce(F.size("edits"), F.lit(0))).drop("edits")


def least_shared(length: int, cutoff: float = CUTOFF) -> int:
    """The letters that a name of this length shares at least with any partner at the cutoff."""
    return max(1, math.ceil(length * cutoff / (2 - cutoff) - 1e-9))

"""Text logs: lines, classes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlstone.functions.texts import stripped
from marlstone.operators.spans import context_after

# What an error line holds, and what a wide one does.
ERROR_LINE = r"(?i)(error|exception|failed|failure|caused by)"
WIDE_LINE = r"(?i)(caused by|what went wrong)"
# Fixed value: the line between the errors and the end of an output.
TAIL_HEADING = "---- GRADLE OUTPUT TAIL ----"


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The lines of each text with their places from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\\r?\\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def error_lines(docs: DataFrame, key: str, text: str, after: int = 8) -> DataFrame:
    """Error lines and the lines behind wide ones; of equal lines of a text the first."""
    lines = lines_of(docs, key, text).withColumns({"hit": F.col("line").rlike(ERROR_LINE), "wide": F.col("line").rlike(WIDE_LINE)})
    near = context_after(lines, [key], "n", "wide", after).select(key, "n").withColumn("near", F.lit(True))
    kept = lines.join(near, [key, "n"], "left").filter("hit OR near")
    w = Window.partitionBy(key, F.trim("line")).orderBy("n")
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(key, "n", "line")


def summarize(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """For each text and pattern the number of matching lines and the first of them."""
    lines = lines_of(docs, key, text)
    aggs = [a for name, p in patterns.items() for a in (F.count_if(F.col("line").rlike(p)).alias(f"{name}_n"), F.min_by(F.when(F.col("line").rlike(p), F.col("line")), F.when(F.col("line").rlike(p), F.col("n"))).alias(f"{name}_first"))]
    return lines.groupBy(key).agg(*aggs)


def filtered_output(docs: DataFrame, key: str, text: str, errors: str = ERROR_LINE, wide: str = WIDE_LINE, after: int = 8, kept: int = 300, tail: int = 160, limit: int = 30_000, quiet: int = 12_000) -> DataFrame:
    """``key`` and ``filtered``: what a reader needs of each output, of at most ``limit`` characters, its end first to stay.

    Lines that match ``errors``, and behind those that match ``wide`` too the next ``after`` other lines; the last ``kept``
    of them, a heading, and the last ``tail`` lines of the output. Of equal lines the first stays, blank ones all do. An
    output without any such line gives its last ``quiet`` characters; a null one is empty. A key stands for one output.
    Outputs without errors are not shuffled; of the others one shuffle by key, and at most ``kept`` and ``tail`` lines meet.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\r?\\n\\z", "")
    d = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_whole"), F.split(body, "\\r?\\n").alias("_lines"))
    loud = F.exists("_lines", lambda x: x.rlike(errors))
    still = d.filter(~loud).select(key, F.right("_whole", F.lit(quiet)).alias("filtered"))
    lines = d.filter(loud).select(key, F.posexplode("_lines").alias("n", "line")).withColumn("hit", F.col("line").rlike(errors))
    w = Window.partitionBy(key).orderBy("n")
    # A wide line begins a stretch; its first lines that are no errors are near it.
    stretch = lines.withColumn("_s", F.sum((F.col("hit") & F.col("line").rlike(wide)).cast("int")).over(w))
    others = F.sum((~F.col("hit")).cast("int")).over(Window.partitionBy(key, "_s").orderBy("n"))
    useful = stretch.withColumn("use", F.col("hit") | (F.col("_s") > 0) & (others <= after))
    back = Window.partitionBy(key).orderBy(F.desc("n"))
    placed = useful.withColumns({"_u": F.sum(F.col("use").cast("int")).over(back), "_t": F.row_number().over(back)})
    places = F.array_compact(F.array(F.when(F.col("use") & (F.col("_u") <= kept), F.lit(0)), F.when(F.col("_t") <= tail, F.lit(1))))
    few = placed.filter((F.col("use") & (F.col("_u") <= kept)) | (F.col("_t") <= tail)).select(key, F.explode(places).alias("place"), "n", "line")
    part = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("place") == k, F.struct("n", "line")))), lambda x: x["line"])
    g = few.groupBy(key).agg(part(0).alias("a"), part(1).alias("b"))
    g = g.select(key, F.concat("a", F.array(F.lit(""), F.lit(TAIL_HEADING)), "b").alias("rows"))
    g = g.withColumn("_keys", F.transform("rows", stripped))
    first = F.filter(F.arrays_zip("rows", "_keys"), lambda x, i: (x["_keys"] == "") | (F.array_position(F.col("_keys"), x["_keys"]) == i + 1))
    return still.unionByName(g.select(key, F.right(F.array_join(F.transform(first, lambda x: x["rows"]), "\n"), F.lit(limit)).alias("filtered")))

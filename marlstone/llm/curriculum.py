"""Mixing of sources to target weights by a curriculum whose weights change with time.

A source's weight over training time, which runs from 0 to 1, is a broken line; its integral is the source's share
of the mix. The targets are these shares of a number of words, stopped at some multiple of what a source has, the
excess shared again by weight. A source's documents come in the order of a hash, as often as its target asks for;
the words taken before a document are a share of its source's demand, and the time at which the integrated
schedule has met that share is the document's position. Training order is a range sort by position.

All steps are DataFrame operations. Running sums are taken within buckets of the hash order, and over the sums of
buckets, so that a source of any size is dealt over many tasks; documents that agree in id and text share a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import saved

WORD = r"([^\x20\x09-\x0D]+)"
BUCKET_ROWS = 4_000
Shape = Sequence[tuple[float, float]]
# (time, weight): a source that fades, one that grows and one that is even, with integrals 5, 2 and 1.
SHAPES: tuple[Shape, ...] = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)))
SHARE, MOST = 1.5, 2
SEGMENTS = "shape int, weight double, segments array<struct<t: double, h: double, w: double, v: double, a: double, z: double>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), 1)


def integrated(shape: Shape) -> tuple[float, list[tuple[float, ...]]]:
    """The integral of a broken line and its segments: begin, length, weights at both ends, integral before and after."""
    times, weights = [t for t, _ in shape], [w for _, w in shape]
    if len(shape) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(weights) < 0:
        raise ValueError(f"a schedule needs rising times from 0 to 1 and weights of 0 at least: {shape}")
    done, out = 0.0, []
    for (t, w), (u, v) in zip(shape, shape[1:]):
        area = (u - t) * (w + v) / 2
        out.append((t, u - t, w, v, done, done + area))
        done += area
    return done, out


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with their ``number`` from 0, by code point, null last."""
    null = F.col("source").isNull()
    rows = sources.repartitionByRange(null, "source").sortWithinPartitions(null, "source")
    rows = saved(rows.withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    before, base = 0, []
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one row for each partition
        base.append((r["part"], before))
        before += r["n"]
    base = F.broadcast(rows.sparkSession.createDataFrame(base, "part long, before long"))
    return rows.withColumn("part", part).join(base, "part").withColumn("number", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "place", "before")


def level(sources: DataFrame, share: float, most: float) -> float:
    """The words for each unit of weight at which the targets, stopped at ``most`` times the sizes, reach their sum or all stop."""
    size, weight = F.col("source_size").cast("double"), F.col("weight")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    now, before = 0.0, None
    while True:
        # A source that has stopped stays so, for the level only rises.
        stops = (size * most <= weight * now) if before is not None else F.lit(False)
        r = sources.agg(
            F.count(F.when(stops, 1)).alias("n"),
            F.coalesce(F.sum(F.when(stops, size * most)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~stops, weight)), F.lit(0.0)).alias("free"),
        ).first()
        if r["n"] == before or not r["free"]:
            return now if r["free"] else float("inf")
        before, now = r["n"], (share * total - r["held"]) / r["free"]


def position(share: Column, weight: Column, segments: Column) -> Column:
    """The time at which the integrated schedule has met a share of its whole."""
    met = share * weight
    s = F.coalesce(F.get(F.filter(segments, lambda s: s["z"] > met), F.lit(0)), F.element_at(segments, -1))
    r = met - s["a"]
    step = F.lit(2.0) * r / (s["w"] + F.sqrt(s["w"] * s["w"] + F.lit(2.0) * r * (s["v"] - s["w"]) / s["h"]))
    return s["t"] + F.when(r <= 0, F.lit(0.0)).otherwise(F.least(step, s["h"]))


def mix(
    docs: DataFrame,
    shapes: Sequence[Shape] = SHAPES,
    named: dict[str, int] | None = None,
    share: float = SHARE,
    most: int = MOST,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """What a mix takes of every document, and when.

    Source number ``i``, by code point with null last, follows ``shapes[i % len(shapes)]`` unless ``named`` gives
    its shape. All targets together are ``share`` times the words of all sources; a target is at most ``most``
    times its source's words. Returns one row per row: the key, the columns ``carry``, ``size`` (words
    ``[^\\x20\\x09-\\x0D]+``), ``source`` and ``source_size``, ``target`` (of the source), ``taken`` (words, repeats
    counted) and ``uses``: for each time that the document is taken ``copy`` from 0, ``words`` and ``position``. A
    document is taken whole but for the last use of each source, which ends where the target does.

    A null or empty text has no words and is never taken; a null source is a source; null and repeated keys are rows
    like others; an empty table gives no rows; other columns are ignored. Where all schedules that could take
    more have weight 0, the targets stay below their sum. Two runs over the same rows agree.
    """
    spark = docs.sparkSession
    kinds = F.broadcast(spark.createDataFrame([(k, *integrated(s)) for k, s in enumerate(shapes)], SEGMENTS))  # as many as the caller names
    order = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary"))
    own = [F.col(key).alias("key"), *(F.col(c).alias(f"with_{i}") for i, c in enumerate(carry))]
    rows = saved(docs.select(*own, F.col(source).cast("string").alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), order.alias("at")), "sizes")

    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    shape = F.pmod("number", F.lit(len(shapes))).cast("int")
    if named:
        shape = F.coalesce(F.create_map(*(F.lit(x) for pair in named.items() for x in pair))[F.col("source")], shape)
    sources = saved(sources.withColumn("shape", shape).join(kinds, "shape"), "schedules")
    sources = sources.withColumn("target", F.least(F.col("source_size").cast("double") * most, F.col("weight") * level(sources, share, most)))
    # Infinite only where nothing is left to share; no weight, no target.
    sources = sources.withColumn("target", F.when(F.col("weight") > 0, F.col("target")).otherwise(0.0))

    count = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-count // BUCKET_ROWS))
    bucket = F.shiftright(F.conv(F.substring("at", 1, 8), 16, 10).cast("long") * parts, 32)
    facts = sources.select(F.col("source").alias("name"), "number", "source_size", "target", "weight", "segments")
    dealt = rows.join(facts.select("name", "number"), F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("bucket", bucket)
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = dealt.groupBy("number", "bucket").agg(F.sum("size").alias("bucket_size"))
    begins = begins.select("number", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("begin")).join(facts.drop("name"), "number")
    within = Window.partitionBy("number", "bucket").orderBy("at", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(begins, ["number", "bucket"])

    def use(copy: int) -> Column:
        at = F.col("begin") + F.col("ahead") + F.lit(copy) * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - at))
        when = position(at / F.col("target"), F.col("weight"), F.col("segments"))
        return F.when(words > 0, F.struct(F.lit(copy).alias("copy"), words.alias("words"), when.alias("position")))

    uses = F.filter(F.array(*(use(k) for k in range(most))), lambda u: u.isNotNull())
    out = dealt.withColumn("uses", uses)
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["words"])
    return out.select(F.col("key").alias(key), *(F.col(f"with_{i}").alias(c) for i, c in enumerate(carry)), "size", F.col("source").alias("source"), "source_size", "target", taken.alias("taken"), "uses")


def in_training_order(mixed: DataFrame, key: str = "doc_id", text: str | None = None) -> DataFrame:
    """The uses of a mix, range-sorted by position; with ``text``, a column that the mix carries, a use in part has its first words."""
    rows = mixed.withColumn("use", F.explode("uses"))
    if text:
        part = F.array_join(F.slice(words_of(F.col(text)), F.lit(1), F.col("use.words").cast("int")), " ")
        rows = rows.withColumn(text, F.when(F.col("use.words") < F.col("size"), part).otherwise(F.col(text)))
    rows = rows.select(key, *([text] if text else []), "source", "use.copy", "use.words", "use.position")
    return rows.repartitionByRange("position", key, "copy").sortWithinPartitions("position", key, "copy")


def op13_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``, sorted by first position, those never taken last; nulls and repeated rows as ``mix`` says."""
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", F.get("uses", F.lit(0))["position"].alias("position"))
    order = [F.col("position").isNull(), "position", "doc_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || COALESCE(text, '')) AS hash FROM documents),
s AS (SELECT source, SUM(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (
  SELECT source, CAST(n AS DOUBLE) AS n, [5, 2, 1][1 + i % 3]::DOUBLE AS w, [7.5, 1, 1][1 + i % 3]::DOUBLE AS w0, [2.5, 3, 1][1 + i % 3]::DOUBLE AS w1 FROM s),
o AS (
  SELECT *, COALESCE(SUM(2 * n) OVER (ORDER BY 2 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    SUM(w) OVER (ORDER BY 2 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, 1.5 * SUM(n) OVER () AS whole FROM w),
v AS (SELECT FIRST((whole - held) / free ORDER BY 2 * n / w, source) AS level FROM o WHERE (whole - held) / free * w < 2 * n),
t AS (SELECT source, n, w, w0, w1, LEAST(2 * n, w * COALESCE(level, 2 * n / w)) AS target FROM o, v),
c AS (
  SELECT d.doc_id, d.size, t.*, COALESCE(SUM(size) OVER (PARTITION BY d.source ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (
  SELECT *, GREATEST(0, LEAST(size, FLOOR(target) - ahead)) AS u0, GREATEST(0, LEAST(size, FLOOR(target) - (ahead + n))) AS u1,
    (ahead + CASE WHEN FLOOR(target) > ahead THEN 0 ELSE n END) / target * w AS met FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target, CAST(u0 + u1 AS BIGINT) AS taken,
  CASE WHEN u0 + u1 > 0 THEN CASE WHEN met <= 0 THEN 0.0 ELSE LEAST(2.0 * met / (w0 + sqrt(w0 * w0 + 2.0 * met * (w1 - w0) / 1.0)), 1.0) END END AS position
FROM u"""

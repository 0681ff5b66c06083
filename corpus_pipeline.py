"""A training-data pipeline over ``documents``: filter, deduplicate and pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of ``documents``. Nulls, empty tables and repeated rows are handled as the stages'
operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import language_id, ngram_join, packing, quality, suffix_dedup
from marlstone.llm.shared import saved

LANGUAGE_SCORE = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality score of ``quality.THRESHOLD`` at least; labels come from the table ``labels``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter(F.col("score") >= quality.THRESHOLD).select(docs.columns)


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that can be told with a score of ``LANGUAGE_SCORE`` at least."""
    found = language_id.identify(docs, language_id.fit(docs))
    return found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LANGUAGE_SCORE)).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word n-grams at 0.8; null ids stay."""
    groups = ngram_join.ngram_components(docs, size=5, threshold=80)
    copies = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated strings of 100 bytes and more; documents of which nothing remains go."""
    done = suffix_dedup.remove_repeats(docs)
    done = done.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    changed = F.col("n_removed") > 0
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1,024 ids; one row for each piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_identification),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", sequence_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and
reread as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontamination, edited, language_id, packing, simhash, suffix_dedup
from cadenza.llm._shared import small_batches, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def in_small_batches(stage: Stage) -> Stage:
    """The stage, in a session that sends whole texts to Python by ``BATCH_ROWS``."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects."""
    docs = docs.select(*COLUMNS)
    return language_id.identify(docs, language_id.learned(docs)).filter("not rejected").select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash group stays: the one with the smallest doc_id."""
    return simhash.representatives(docs.select(*COLUMNS), 3, 2)


@in_small_batches
def singled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``deduplicated``, then without the edited copies (Jaccard of 5-word shingles of 0.8 or more) of a document with a smaller doc_id."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kept = written(deduplicated(spark, docs, sf_dir).withColumn("_key", key), "single")
    copies = edited.edited_copies(kept.select(F.col("_key").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return kept.join(copies, F.col("_key") == F.col("key"), "left_anti").select(*COLUMNS)


@in_small_batches
def trimmed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 200 bytes or more that occur more than once; a character cut in two goes too."""
    found = suffix_dedup.remove_repeats(docs, 200, keep=["lang", "source"], as_text=True)
    found = found.select("doc_id", F.col("kept").alias("text"), "rest.*")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@in_small_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens; one row per piece, with its ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", singled),
    ("suffix_array_dedup", trimmed),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]
#: Language ID and packing can't be said in SQL; the tests hold the operators against brute force, and the stages against the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""Training-data pipeline: quality, near duplicates, decontamination, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs; all but the last return the columns of ``documents``.

Cases, in every stage: a null text counts as empty (and stays null), null and repeated ids and repeated rows are rows of their own
(near duplicates: copies, of which one row stays), long texts are taken whole, an empty table gives an empty table, and
columns beside those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import common, decontam, neardup, pieces, pii, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the classifier, fitted on the labels of those not held out, scores under 0.3."""
    docs = docs.select(COLUMNS)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).filter("score >= 0.3").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each class of near duplicates."""
    docs = docs.select(COLUMNS)
    return neardup.leave_one(docs, neardup.near_duplicates(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out contaminated documents."""
    found = decontam.benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.filter("not contaminated").select(COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return pii.mask_pii(docs.select(COLUMNS), pii.fit_pii(docs)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Merge-dropout pieces of each text, checked by decoding."""
    return pieces.round_trip(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("sentencepiece", encode),
]

#: The classifier and the segmentations can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.materialize(docs)
    return docs

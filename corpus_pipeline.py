"""The corpus pipeline: quality classifier, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's documents. All but the last return the
columns of documents; the last returns the place of every piece in its training sequence.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows and extra columns of any name, and gives no rows for an empty table. What becomes of
such rows follows from the operators: a null text is judged, packed and searched as an empty one; texts without words are one group of near copies and are not mixed; a null
id or source is one of its own; of rows equal in id and text one stays after the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockweave.functions.runtime import materialize
from stockweave.llm import knn_quality, mixing, packing, secrets, setsketch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote takes for good."""
    return knn_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    SimHash fingerprints that differ in at most two bits meet in pigeonhole blocks, and their links are checked exactly. Texts of similarity 0.8 can differ in more
    bits than blocks can meet; sketches find the links that are left."""
    return setsketch.keep_one(docs, percent=80, near=2)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in a text masked."""
    masked = secrets.mask(docs, secrets.scan(docs)[1])
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents in their source's share, some of them twice."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_stage), ("near_duplicates", near_duplicate_stage), ("secret_scan", secret_stage), ("source_mixing", mixing_stage),
          ("best_fit_packing", packing_stage)]
ORACLE_SQL = None  # the classifier, XXH64 and the tokenizer are beyond SQL; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

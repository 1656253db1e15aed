"""The training-data pipeline over documents: each stage works on what the one before it kept.

Returns of all but the last stage have the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import classifier, linededup, mixing, neardup, packing, queries
from logweave.llm.common import materialize


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.keep_good(docs, classifier.fit(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur before, in the same or another document, equal or within a few edits."""
    return _sized(linededup.without_duplicates(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are similar by 0.8 or more."""
    return neardup.keep_one(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return _sized(mixing.mixed_documents(docs, share=1.5, max_epochs=2.0, seed=queries.MIX_SEED))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, queries._vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup), ("source mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each gives is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer can't be expressed in SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None

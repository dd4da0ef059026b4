"""A corpus pipeline: good, clean, distinct documents, mixed to weights and packed into windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All stages but the last return the columns of ``documents``.

Defined results, in every stage.  Null and empty texts: scored by the classifiers as texts without
features, one class of near copies, size 0 and so no place in the mix, the end id alone in the packing.
Null ids and sources: values like others.  Repeated rows: each is scored; near copies of each other; one
stays.  Ties: as the operators say.  An empty table: an empty table.  Very long texts are read whole.
Further columns of any name travel along as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import dedup, mixing, packing, quality, toxicity
from strandline.llm._scratch import Scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, _labels(spark, sf_dir)))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return dedup.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as their source's target says."""
    return mixing.mixed_rows(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("minhash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("packing", sequence_packing),
]

#: Learned stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs

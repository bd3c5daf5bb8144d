"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import mixing, neardup, packing, quality, secrets
from riskloom.llm.queries import vocabulary
from riskloom.llm.util import Scratch

#: Shares of all tokens after mixing: less of what reads as toxic, nothing asked of what the first stage rejects.
TARGETS = {"clean": 0.97, "low": 0.0, "toxic": 0.03}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep(docs, quality.fit(docs, _labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, Jaccard of 0.8 or more)."""
    return neardup.keep_one(docs, words=5, num=4, den=5)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that the scan finds are replaced in the texts; n_chars follows."""
    return secrets.redact(docs)


def domain_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with the rate that brings expected domain tokens to TARGETS, none more than once."""
    return mixing.thin(docs, _labels(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), TARGETS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_redaction),
    ("mixing sources to target weights", domain_mixing),
    ("best-fit packing", sequence_packing),
]

#: Models and tokenizers take part in the stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.cut(docs, f"stage{i}")
    return docs

"""The corpus pipeline: quality filter, exact and near deduplication, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents,
under whatever names and in their order. Null texts count as empty and are kept or dropped like empty ones, null ids
and sources are values of their own, repeated rows are rows, texts are read whole, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import exact_dedup, mixing, pieces, quality, simhash
from pointloom.llm.common import read_table, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts share one score, and so their fate."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal without white space; of all without text, and of repeated rows, one.

    The longest stays, then that of the smallest id; a null id counts as the largest.
    """
    return exact_dedup.kept_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; texts without words are one group.

    Rows without an id stay only where no row of their group has one; rows that share an id share their fate.
    """
    return simhash.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it; one without words no time. A null source is the last one."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of every row of the mixture; an empty text has no ids."""
    return pieces.encode(docs, ["doc_id", "source"])


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: Classifier, components and sampling have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; what a stage returns is written and read again."""
    folder = scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

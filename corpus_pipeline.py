"""Corpus pipeline: quality, near-duplicates, benchmark passages, mix, shards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from outletlens.llm import decontamination, minhash_dedup, mixing, quality, sharding
from outletlens.llm.common import table
from outletlens.session import fs_delete, own, owned_tables, scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted_rows(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return minhash_dedup.one_per_class(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the shares of their weights: the rows the mix takes, repeats included."""
    return mixing.mixed_rows(docs)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every row that is left."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", make_shards),
]

# learned models and signatures are beyond SQL: the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again. A stage's folder goes when the next
    one's is there, and what a stage wrote on its way with its end; the last one's belongs to
    the caller's ``owned_tables``, if it has opened any."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch_path(spark, "pipeline", uuid.uuid4().hex)
        with owned_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            fs_delete(spark, before)
        before = path
    own(before)
    return docs

"""The corpus pipeline: documents through the stages of STAGES, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, kd_shards, mixing, simhash_dedup, toxicity
from tessera.llm.common import release, table, tables, written


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from these documents and the labels, scores 0.7 or more go."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2 in turn and share 150 % of the words; a document stands as often as it is taken."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes: the documents with shard and slot."""
    return kd_shards.kd_shards(docs, shards=8)


STAGES = [("toxicity", detoxify), ("simhash near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix_sources), ("sharding", shard)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), tables()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)  # what the stage wrote on the way, and its own input
    return STAGES[-1][1](spark, docs, sf_dir)

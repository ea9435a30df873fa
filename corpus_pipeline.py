"""A training corpus from raw documents: reject, deduplicate, decontaminate, mix, shard.

Every stage takes any documents: null ids, texts, sources and languages, empty and very
long texts, repeated rows, empty tables and extra columns of any name. What each makes
of them is said at its operator in ``scriba.llm``; all but the last give back the columns
they got, in their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriba.llm import decontamination, minhash, mixing, quality, sharding
from scriba.llm.common import materialise, passing
from scriba.sources.tables import read_table


def reject(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; without labels, all. Null and empty texts are judged by their style. ``quality.keep_good``."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; of rows that repeat it, that of the least text. ``minhash.drop_near_duplicates``."""
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none. ``decontamination.decontaminate``."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice; a null source is a source. ``mixing.repeated``."""
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it; columns of these names are replaced. ``sharding.shard``."""
    return sharding.shard(docs).drop("size", "text_crc32")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("reject", reject), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The classifier and the sampled splitters have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each on the written result of the one before; a stage's own tables go once its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with passing(spark, name):
            docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "source", "lang", F.length("text").cast("long").alias("n_chars"), F.crc32("text").alias("text_crc32"), "shard", "slot")

"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriba.llm import byte_bpe, collocations, decontamination, edit_embedding, guess_cost, language_codes, minhash, mixing, quality, quotes, sharding, token_alignment, warc
from scriba.sources.tables import read_table


def op1_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.fingerprint_classes(edit_embedding.neighbour_fingerprints(read_table(spark, sf_dir, "documents")))


def op2_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_codes.identify(read_table(spark, sf_dir, "documents"))


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_hash_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(read_table(spark, sf_dir, "conversations"))


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator on messages that do quote: the table's own have no quote marks."""
    read_table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return quotes.conversations(spark.sql(f"WITH {quotes.REPLIES.replace('chr(10), 1)', 'chr(10), 1)')} SELECT * FROM quoted"))


def op9_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read_table(spark, sf_dir, "pages"))


def op10_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guess_cost.scan(read_table(spark, sf_dir, "documents"))


def op11_pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_edit_embedding, op2_language_codes, op3_superminhash, op4_hash_mixing, op5_site_quality, op6_spaced_seeds, op7_sampled_splitters, op8_quotation_linking, quoted_replies, op9_capture_index, op10_guess_cost, op11_pair_keys, op12_byte_bpe, op13_collocations)}
ORACLES: dict[str, str] = {"op3_superminhash": minhash.ORACLE, "op4_hash_mixing": mixing.ORACLE, "op8_quotation_linking": quotes.ORACLE, "quoted_replies": quotes.ORACLE_OF_REPLIES, "op9_capture_index": warc.ORACLE, "op13_collocations": collocations.ORACLE}

"""The registered queries of the operators, each on its whole table, with oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import (decontamination, linededup, mixing, neighbours, periodicity, quoting, repair, scoring, sharding, simhash,
                           tokencounts, toxicity, warc)
from riskweave.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with one line left of each group of like lines."""
    return linededup.clean_documents(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through web archives and back."""
    return warc.page_captures(table(spark, sf_dir, "pages"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows of each twentieth vector."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op7_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages in reply order without quotes."""
    return quoting.conversations(table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the targets of their sources."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return scoring.score_documents(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of all documents."""
    return tokencounts.count_documents(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of all damaged conversations."""
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents."""
    return periodicity.run_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontamination, op3_line_dedup, op4_sharding, op5_warc, op6_neighbours,
                                   op7_quoting, op8_toxicity, op9_mixing, op10_lm_scoring, op11_token_counts,
                                   op12_conversation_repair, op13_periodic_runs)}
ORACLES = {"op4_sharding": sharding.oracle(), "op7_quoting": quoting.ORACLE, "op9_mixing": mixing.ORACLE}

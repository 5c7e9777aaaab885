"""Registered queries of the operators and their SQL where SQL can say it.

Each query applies its operator with production parameters to the whole table
and derives the digest columns from what the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from spendlens.llm import (chat_events, decontaminate, html_consensus, importance,
                           jaccard_join, periodic_runs, pivot_topk, ppm, prefix_bpe, quality_fm,
                           sharding, token_files, toxicity_fm)
from spendlens.llm.common import shared_folder, table
from spendlens.llm.oracle import ORACLE

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract(table(spark, sf_dir, "pages"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.digests(table(spark, sf_dir, "documents"), MULTI_RANKS,
                              public_tokenizers.PATTERN)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, BYTE_BPE_JSON)
    return token_files.read_back(spark, path)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.search(table(spark, sf_dir, "embeddings"))


def op8_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)],
                                  "conv_id long, turn long, role string, text string")
    log = chat_events.turn_events(turns.unionByName(extra))
    return chat_events.conversation_digests(chat_events.render(chat_events.fold(log)))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), class_col="lang")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"),
                                table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"), rewrite=periodic_runs.echo)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_html_consensus, op2_quality_fm, op3_prefix_bpe, op4_token_files, op5_jaccard_join,
    op6_toxicity_fm, op7_pivot_topk, op8_chat_events, op9_ppm, op10_decontaminate, op11_periodic_runs,
    op12_importance_resampling, op13_stratified_sharding)}

__all__ = ["ORACLE", "QUERIES"]

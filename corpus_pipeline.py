"""Corpus cleaning pipeline over ``documents``: toxicity, quality, near
duplicates, benchmark decontamination, tokens.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir), works on
all that its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.  SQL can express neither the fitted models nor the
tokenizer, so ``ORACLE_SQL`` is None and the tests compare each stage with a
plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.llm import (decontaminate, jaccard_join, prefix_bpe, quality_fm, queries,
                           toxicity_fm)
from spendlens.llm.common import table, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores 0.7 or more go."""
    return toxicity_fm.keep_clean(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.3 go."""
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of smallest id stays."""
    return jaccard_join.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a hit benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the digest of what they decode to."""
    return prefix_bpe.encode_documents(docs, queries.MULTI_RANKS,
                                       queries.public_tokenizers.PATTERN,
                                       decoded_sha_col="decoded_sha256")


STAGES = [
    ("toxicity", not_toxic),
    ("quality", good),
    ("near duplicates", distinct),
    ("decontamination", decontaminated),
    ("byte-level BPE", tokenized),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; intermediate tables go to the shared
    folder, so a lost executor repeats one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "pipeline")
    return docs

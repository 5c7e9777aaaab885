"""Keyword scoring (substring matching against a keyword table).

A keyword table is an ordered ``{category: [keyword, ...]}``.  Matching is a
projection: one ``contains`` per keyword on lower-cased text, so no join or
cross product with the table is needed.  Scores are materialised as columns in
their own projection before the arg-max, so the ~90 ``contains`` calls run once
per row (Catalyst keeps a projection separate when collapsing it would copy
non-trivial expressions into several branches).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import occurrences


def score_columns(lower_text: Column, table: dict[str, list[str]]) -> dict[str, Column]:
    """Per category: number of its keywords that occur in the text (0 for NULL)."""
    t = F.coalesce(lower_text, F.lit(""))
    return {cat: sum((t.contains(kw).cast("int") for kw in kws), F.lit(0))
            for cat, kws in table.items()}


def with_best_category(df: DataFrame, lower_text: Column, table: dict[str, list[str]],
                       best_col: str, score_col: str) -> DataFrame:
    """Add ``best_col`` (first category in table order with the strict maximum
    score; NULL when no keyword hit) and ``score_col`` (that score)."""
    names = {cat: f"__kw_{i}" for i, cat in enumerate(table)}
    scored = df.withColumns({names[c]: s for c, s in score_columns(lower_text, table).items()})
    top = F.greatest(*[F.col(n) for n in names.values()])
    scored = scored.withColumn(score_col, top)
    chain = None
    for cat, n in names.items():
        hit = F.col(n) == F.col(score_col)
        chain = F.when(hit, F.lit(cat)) if chain is None else chain.when(hit, F.lit(cat))
    return scored.withColumn(best_col, F.when(F.col(score_col) >= 1, chain)) \
        .drop(*names.values())


def any_keyword(lower_text: Column, keywords: list[str]) -> Column:
    return F.greatest(*[lower_text.contains(k).cast("int") for k in keywords])


def keyword_occurrences(lower_text: Column, keywords: list[str]) -> Column:
    return sum((occurrences(lower_text, k) for k in keywords), F.lit(0))

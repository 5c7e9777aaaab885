"""Toxicity: factorisation machine over hashed terms (see ``fm``).

A term is a run of letters, digits and other non-ASCII characters, lower-cased, or
one of its beginnings (insults are inflected); the machine sees which terms a
document has, and learns pairwise interactions
(an insult with a mention of a group) that additive weights miss.  The only
statistics are the logarithms of the numbers of words and distinct words.

Edge cases: NULL and empty texts are scored without terms; repeated rows are
scored each; without labelled rows every score is 0.5; extra columns pass
through ``score`` and ``keep_clean``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from spendlens.llm import fm
from spendlens.llm.common import held_out, under_plain_names

PARAMS = fm.FitParams()
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
N_STATS = 2
PREFIXES = (4, 5, 6)

#: ASCII characters that are no letter or digit become blanks.
_TERM_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))


def describe(text: str, _meta: int | None = None) -> tuple[set[bytes], list[float]]:
    terms = text.lower().encode().translate(_TERM_BYTES).split()
    kinds = set(terms)
    return kinds, [math.log1p(len(terms)), math.log1p(len(kinds))]


def stems(term: bytes) -> tuple[bytes, ...]:
    """The term and its beginnings: insults are inflected."""
    return (term, *(b"%s*" % term[:n] for n in PREFIXES if len(term) > n))


def fit(docs: DataFrame, labels: DataFrame, params: fm.FitParams = PARAMS) -> fm.Model:
    """Model of ``labels.toxic`` from rows outside the held-out fold."""
    train = docs.select("doc_id", "text", F.lit(None).cast("long").alias("meta"))
    return fm.fit(train, labels, "toxic", held_out("doc_id", FOLDS, HELD_OUT), describe, N_STATS,
                  params, stems)


def score(docs: DataFrame, model: fm.Model, score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 (higher: toxic likelier)."""
    return fm.score(docs, model, describe, score_col)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents the classifier does not call toxic, columns as they came."""
    def kept(rows: DataFrame) -> DataFrame:
        return score(rows, fit(rows, labels), "_fm_toxic").where(F.col("_fm_toxic") < threshold)

    return under_plain_names(docs, ("doc_id", "text"), kept)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

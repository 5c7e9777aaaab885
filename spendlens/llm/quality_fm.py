"""Quality classifier: factorisation machine over hashed words, structure
statistics and metadata, scored in linear time (see ``fm``).

Words are the blank-separated strings, ASCII lower-cased, as a set.  Statistics
describe the whole text: length, shares of character classes, words and lines,
repetition, word ends; metadata is the row's ``n_chars``.

Edge cases: NULL and empty texts are scored from statistics of zero; a NULL
``n_chars`` counts as the text's own length; repeated rows are scored each;
without labelled rows every score is 0.5; extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from spendlens.llm import fm
from spendlens.llm.common import held_out, under_plain_names

PARAMS = fm.FitParams()
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGIT = b"0123456789"
_SYMBOL = b"$%&*#@^~=+<>\\_"
_BRACKET = b"(){}[]"
_HIGH = bytes(range(0x80, 0x100))
_SINGLE = (b"!", b"?", b"|", b".", b",", b"\n", b"/", b":", b";", b"-", b"'", b'"')
N_STATS = 16 + len(_SINGLE)


def describe(text: str, n_chars: int | None) -> tuple[set[bytes], list[float]]:
    raw = text.encode()
    lower = raw.lower().split()
    words, size, n = set(lower), len(raw), len(lower)
    lines = raw.split(b"\n")
    per_byte, per_word = 1 / max(size, 1), 1 / max(n, 1)

    def share(kinds: bytes) -> float:
        return (size - len(raw.translate(None, kinds))) * per_byte

    ends = sum(not (w[-1] >= 0x80 or 0x61 <= w[-1] <= 0x7A) for w in words)
    clean = sum(map(bytes.isalnum, words))
    return words, [
        math.log1p(size), math.log1p(n), math.log1p(n_chars if n_chars is not None else len(text)),
        share(_UPPER), share(_LOWER), share(_DIGIT), share(_SYMBOL), share(_BRACKET), share(_HIGH),
        size * per_word / 10, len(words) * per_word, len(set(lines)) / len(lines),
        math.log1p(size / len(lines)), ends / max(len(words), 1), clean / max(len(words), 1),
        math.log1p(max(map(len, words), default=0)),
        *(raw.count(c) * per_byte for c in _SINGLE)]


def fit(docs: DataFrame, labels: DataFrame, params: fm.FitParams = PARAMS) -> fm.Model:
    """Model of ``labels.quality`` from rows outside the held-out fold."""
    train = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("meta"))
    return fm.fit(train, labels, "quality", held_out("doc_id", FOLDS, HELD_OUT), describe,
                  N_STATS, params)


def score(docs: DataFrame, model: fm.Model, score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 (higher: quality 1 likelier)."""
    return fm.score(docs, model, describe, score_col, meta_col="n_chars")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents the classifier keeps, columns as they came."""
    def kept(rows: DataFrame) -> DataFrame:
        return score(rows, fit(rows, labels), "_fm_quality").where(
            F.col("_fm_quality") >= threshold)

    return under_plain_names(docs, ("doc_id", "text", "n_chars"), kept)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = docs.select("doc_id", "text", "n_chars")
    scored = score(rows, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

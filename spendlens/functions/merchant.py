"""Merchant and payment-mode extraction from bank descriptions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import WHITESPACE_RUN

U = "(?U)"  # Python's Unicode \s and \d in Java patterns


def py_strip(c: Column) -> Column:
    """``str.strip()``: all leading/trailing whitespace, not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def extract_merchant(description: Column,
                     skip_words: list[str] = K.MERCHANT_SKIP_WORDS) -> Column:
    """Rules on the upper-cased description, first that applies wins:
    UPI handle (``@...`` suffix removed), POS merchant, IMPS/NEFT/RTGS
    beneficiary, else first word of A-Z letters longer than two that is not a
    bank prefix; NULL or nothing found -> ``unknown``.  Result lower-cased."""
    d = F.upper(description)
    upi_p, pos_p, bank_p = (U + K.UPI_PATTERN, U + K.POS_PATTERN, U + K.BANK_TRANSFER_PATTERN)
    upi = F.regexp_replace(F.regexp_extract(d, upi_p, 1), K.UPI_SUFFIX_PATTERN, "")
    pos = py_strip(F.regexp_extract(d, pos_p, 2))
    bank = py_strip(F.regexp_extract(d, bank_p, 1))
    letters = F.transform(F.split(d, WHITESPACE_RUN), lambda w: F.regexp_replace(w, "[^A-Z]", ""))
    skip = F.array(*[F.lit(w) for w in skip_words])
    first_word = F.get(
        F.filter(letters, lambda w: (F.char_length(w) > 2) & ~F.array_contains(skip, w)), 0)
    picked = (F.when(description.isNull(), F.lit("UNKNOWN"))
              .when(d.rlike(upi_p), upi)
              .when(d.rlike(pos_p), pos)
              .when(d.rlike(bank_p), bank)
              .otherwise(F.coalesce(first_word, F.lit("UNKNOWN"))))
    return F.lower(picked)


def transaction_mode(description: Column, strict_reference: bool = False) -> Column:
    """First payment mode whose key occurs in the upper-cased description.

    ``strict_reference=True`` reproduces the original behaviour, which searched
    lower-case keys in upper-cased text and so always answered ``other``."""
    d = F.upper(description)
    chain = F.when(description.isNull(), F.lit("unknown"))
    for key, label in K.TRANSACTION_MODES:
        needle = key if strict_reference else key.upper()
        chain = chain.when(d.contains(needle), F.lit(label))
    return chain.otherwise(F.lit("other"))

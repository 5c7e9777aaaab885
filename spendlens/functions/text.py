"""Column expressions over description text.  All JVM-side, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's Unicode ``\w`` and ``\s`` written as explicit Java classes.
WORD_CLASS = r"\p{L}\p{N}_"
NOT_KEPT = r"(?U)[^" + WORD_CLASS + r"\s/-]"
WHITESPACE_RUN = r"(?U)\s+"
TOKEN = r"(?U)[" + WORD_CLASS + r"]{2,}"


def standardize_text(c: Column) -> Column:
    """lower; characters other than word chars, whitespace, '/' and '-' become a
    space; whitespace runs collapse to one space; trimmed.  NULL stays NULL."""
    kept = F.regexp_replace(F.lower(c), NOT_KEPT, " ")
    return F.trim(F.regexp_replace(kept, WHITESPACE_RUN, " "))


def words(c: Column) -> Column:
    """Whitespace tokens (``str.split()``): no empty strings."""
    return F.filter(F.split(c, WHITESPACE_RUN), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words (a regex count, no lambda)."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def char_count(c: Column) -> Column:
    return F.char_length(c)


def avg_word_length(c: Column) -> Column:
    """Mean word length = non-whitespace characters / words (0 without words)."""
    n = word_count(c)
    letters = F.char_length(F.regexp_replace(c, WHITESPACE_RUN, ""))
    return F.when(n > 0, letters / n).otherwise(F.lit(0.0))


def as_python_text(c: Column) -> Column:
    """``str(x)`` of a pandas cell: a missing value prints as ``nan``."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal (``str.count``).  The
    allocation-free ``contains`` gates the replace: most keywords are absent."""
    removed = F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))
    return F.when(text.contains(needle), (removed / F.lit(len(needle))).cast("int")) \
        .otherwise(F.lit(0))


def tokens(c: Column) -> Column:
    """Word tokens of two or more word characters, on lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 0)


def english_stop_words() -> list[str]:
    """Spark ML's default English stop-word list (the parameter value used for
    the stop-word TF-IDF), read from the MLlib jar so that no JVM is needed."""
    import glob
    import os
    import zipfile

    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = "org/apache/spark/ml/feature/stopwords/english.txt"
            if name in z.namelist():
                return [w.strip() for w in z.read(name).decode("utf-8").splitlines() if w.strip()]
    from pyspark.ml.feature import StopWordsRemover
    return list(StopWordsRemover.loadDefaultStopWords("english"))

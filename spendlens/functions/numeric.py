"""Numeric coercion with ``errors='coerce'`` semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# A plain decimal or scientific number, optional sign, surrounding blanks.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def coerce_numeric(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double; text that is not a number becomes NULL
    (``'1,200'`` and ``'12d'`` included, where a bare cast would be lenient)."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, NumericType):
        return c.cast("double")
    s = c.cast("string")
    return F.when(s.rlike(NUMBER), F.trim(s).cast("double"))

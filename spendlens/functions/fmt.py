"""Number-to-text formatting with Python ``format(x, '.Nf')`` rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_fixed(x: Column, digits: int) -> Column:
    """``f"{x:.{digits}f}"``.  Java's formatter rounds an exact binary tie
    (e.g. 2.5 at 0 digits, 12.25 at 1) half-up where Python rounds half-even;
    exact ties are resolved to the even neighbour first, everything else is
    left to ``format_string``."""
    x = x.cast("double")
    scale = float(10 ** digits)
    y = x * F.lit(scale)
    f = F.floor(y).cast("double")
    tie = ((y - f) == 0.5) & ((y / F.lit(scale)) == x)
    even = F.when(F.pmod(f, F.lit(2.0)) == 0, f).otherwise(f + 1) / F.lit(scale)
    return F.format_string(f"%.{digits}f", F.when(tie, even).otherwise(x))

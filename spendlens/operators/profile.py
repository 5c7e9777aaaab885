"""Dataset profile and chart-data operators (one pass each, no driver loops)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import constants as K
from .passes import summed


def dataset_summary(df: DataFrame) -> DataFrame:
    """A1: rows, column count, amount min/max/mean and NULLs per column, in one
    aggregate (the category counts are ``category_counts``)."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")]
    if "amount" in df.columns:
        a = F.col("amount").cast("double")
        aggs += [F.min(a).alias("amount_min"), F.max(a).alias("amount_max"),
                 F.avg(a).alias("amount_mean")]
    aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"nulls_{c}") for c in df.columns]
    return df.agg(*aggs)


def category_counts(df: DataFrame, column: str = "category") -> DataFrame:
    """Value counts, most frequent first (NULL excluded)."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column))


def category_share(df: DataFrame, column: str = "category") -> DataFrame:
    """Row share per category; the window runs over the grouped rows."""
    c = category_counts(df, column)
    return c.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(1))))


def preview(df: DataFrame, order_cols: list[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in a total order (top-k, not a global sort)."""
    return df.orderBy(*order_cols).limit(n)


def null_counts(df: DataFrame) -> DataFrame:
    """NULLs per column, long form ``(column_name, nulls)``: one aggregate, then
    ``stack`` over the single result row."""
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return wide.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, nulls)")


def upload_profile(df: DataFrame, synonyms: dict = K.UPLOAD_PROFILE_SYNONYMS) -> DataFrame:
    """Row count plus plan-time facts about the columns."""
    cols = df.columns
    has_desc = any(c in cols for c in K.UPLOAD_DESCRIPTION_NAMES)
    facts = {
        "n_columns": F.lit(len(cols)),
        "has_description": F.lit("Yes" if has_desc else "No"),
        "has_labels": F.lit("Yes" if "category" in cols else "No"),
    }
    for std, variants in synonyms.items():
        found = [c for c in cols if c.lower() in variants]
        facts[f"detected_{std}"] = F.lit(", ".join(found) if found else None).cast("string")
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select("total_rows", *[
        v.alias(k) for k, v in facts.items()])


# ------------------------------------------------------------------ chart data
def amount_histogram(df: DataFrame, column: str = "amount", bins: int = 20) -> DataFrame:
    """Equal-width bins between min and max (the max falls in the last
    bin).  The bounds come from a one-row aggregate joined on a constant key,
    so no window over all rows is needed."""
    x = F.col(column).cast("double")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).withColumn("__k", F.lit(1))
    j = df.select(x.alias("x")).where(F.col("x").isNotNull()).withColumn("__k", F.lit(1)) \
        .join(F.broadcast(bounds), "__k")
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return (j.withColumn("bin", b).groupBy("bin")
            .agg(F.count(F.lit(1)).alias("count"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
            .select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins)
                    .alias("bin_start"), "count"))


def amount_box(df: DataFrame, column: str = "amount", by: str = "category",
               exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Min, q1, median, q3, max per group.  ``exact`` gives the linearly
    interpolated quantiles (like pandas) through ``exact_quantiles``, which
    never buffers a whole group; ``exact=False`` is one ``percentile_approx``."""
    from .quantiles import exact_quantiles
    x = F.col(column).cast("double")
    rows = df.where(F.col(by).isNotNull() & x.isNotNull())
    g = rows.groupBy(by).agg(F.min(x).alias("min"), F.max(x).alias("max"))
    if exact:
        q = exact_quantiles(rows, column, [0.25, 0.5, 0.75], [by]).select(
            by, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    else:
        pq = F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy)
        q = rows.groupBy(by).agg(pq.alias("__q")).select(
            by, F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"),
            F.col("__q")[2].alias("q3"))
    return g.join(q, by).select(by, "min", "q1", "median", "q3", "max")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation ``(col_a, col_b, corr)`` of every pair of numeric
    columns over the rows in which neither is NULL; NULL where it is undefined.

    One pass adds up the moment matrix of all columns per partition (numbers of
    common rows, sums, squares and products by pair), after one aggregate that centres
    the columns, so the plan does not grow with the number of pairs."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    centre = [m or 0.0 for m in df.agg(*(F.avg(c) for c in x)).first()] if cols else []
    d = len(cols)

    def moments(batches):
        total = np.zeros((4, d, d))
        for b in batches:
            if not b.num_rows:
                continue
            here = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns], 1)
            v = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)
            v = np.where(here, v - np.array(centre), 0.0)
            here = here.astype(float)
            for i, (p, q) in enumerate(((here, here), (v, here), (v * v, here), (v, v))):
                total[i] += p.T @ q
        return total

    n, s, ss, sp = summed(df.select(*(c.alias(f"c{i}") for i, c in enumerate(x))), moments, (4, d, d)) \
        if cols else np.zeros((4, 0, 0))
    with np.errstate(all="ignore"):
        var = ss - s * s / n  # of row i's column over the rows shared with column j
        corr = (sp - s * s.T / n) / np.sqrt(var * var.T)
        floor = 1e-12 * np.abs(ss)
        corr = np.where((var > floor) & (var.T > floor.T) & np.isfinite(corr), corr, np.nan)
    np.fill_diagonal(corr, 1.0)
    rows = [(a, b, None if np.isnan(corr[i, j]) else float(corr[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def monthly_trend(df: DataFrame, date_col: str = "date", amount_col: str = "amount") -> DataFrame:
    """Sum of amounts (all signs) per calendar month ``yyyy-MM``."""
    m = F.date_format(F.col(date_col).cast("date"), "yyyy-MM")
    return (df.where(F.col(date_col).isNotNull()).groupBy(m.alias("month"))
            .agg(F.sum(amount_col).alias("amount")).orderBy("month"))


def distinct_count(df: DataFrame, column: str = "category") -> DataFrame:
    """Number of distinct non-NULL values."""
    return df.agg(F.countDistinct(column).alias("n_distinct"))

"""Spending insights over a transaction DataFrame ``(category, amount, merchant, ...)``.

Every rule is one grouped aggregate (partial aggregation before the shuffle,
so a category or merchant holding a third of all rows is pre-reduced per task)
or a join of such an aggregate back to the rows.  Fixed lookup tables
(benchmarks, tips) are 8-row literals and are broadcast.  Message texts follow
Python ``format`` rounding (see ``functions.fmt``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.fmt import py_fixed

INSIGHT_COLUMNS = ["category", "metric_type", "message", "severity", "recommendation",
                   "savings_potential"]

# ---------------------------------------------------------------- FIXED VALUES
# Insight texts; {c} = category or merchant.
MSG_OVERSPENDING = "⚠️ Spending {pct}% on {c} (recommended: {ideal}%)"
REC_OVERSPENDING = ("Reduce {c} spending by {excess}%. Try cooking at home, using public "
                    "transport, or finding cheaper alternatives.")
MSG_MODERATE = "ℹ️ {c} is at {pct}% (slightly above ideal)"
REC_MODERATE = "Monitor {c} spending to stay within budget."
MSG_FREQUENT_SMALL = "📝 {n} small transactions in {c} (avg ₹{avg})"
REC_FREQUENT_SMALL = "Consider reducing frequency of small {c} purchases. Monthly total: ₹{total}"
MSG_TOP_MERCHANT = "🏪 Top spending at {c}: ₹{total} ({n} visits)"
REC_TOP_MERCHANT = "Review if {c} spending aligns with your budget priorities."
MSG_SUBSCRIPTION = "📺 {n} subscription services costing ₹{total}/month"
REC_SUBSCRIPTION = "Review unused subscriptions. Cancel those you don't use regularly."
MSG_ANOMALY = "🔍 Unusually high {c} expense: ₹{amount} (typical: ₹{mean})"
REC_ANOMALY = "Verify if this was a planned expense or if there's a billing error."
# ------------------------------------------------------------ end FIXED VALUES


def _text(template: str, **parts) -> F.Column:
    """Fill ``template`` with Column parts via ``concat`` (no Python per row)."""
    out, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        if head:
            out.append(F.lit(head))
        out.append(parts[key].cast("string"))
    if rest:
        out.append(F.lit(rest))
    return F.concat(*out)


def expense_filter(expense_sign: int = 1) -> F.Column:
    """Expenses are positive amounts unless ``expense_sign=-1``."""
    return (F.col("amount") > 0) if expense_sign > 0 else (F.col("amount") < 0)


def expenses(df: DataFrame, expense_sign: int = 1) -> DataFrame:
    """C15 (and C16 with ``expense_sign=-1``)."""
    return df.where(expense_filter(expense_sign))


def income(df: DataFrame, expense_sign: int = 1) -> DataFrame:
    return df.where(expense_filter(-expense_sign))


def _amount():
    return F.col("amount").cast("double")


# ------------------------------------------------------------------ A2, A3
def total_spending(df: DataFrame, expense_sign: int = 1) -> DataFrame:
    return expenses(df, expense_sign).agg(
        F.coalesce(F.sum(F.col("amount")).cast("double"), F.lit(0.0)).alias("total_spending"))


def category_rollup(df: DataFrame, expense_sign: int = 1) -> DataFrame:
    """One grouped pass per category (NULL category included): expense sum /
    count / mean / sample sd and the all-sign count / sum.  Every
    category-level rule derives from it, so a statement is aggregated once."""
    exp = expense_filter(expense_sign)
    a = F.when(exp, F.col("amount"))
    return df.groupBy("category").agg(
        F.sum(a).alias("exp_sum"),
        F.count(a).alias("exp_n"),
        F.avg(a.cast("double")).alias("exp_mean"),
        F.stddev_samp(a.cast("double")).alias("exp_std"),
        F.count(F.lit(1)).alias("all_n"),
        F.sum("amount").alias("all_sum"))


def _category_spend(df: DataFrame, expense_sign: int = 1,
                    rollup: DataFrame | None = None) -> DataFrame:
    r = rollup if rollup is not None else category_rollup(df, expense_sign)
    g = r.where(F.col("exp_n") > 0).select(
        "category", F.col("exp_sum").alias("__sum"), F.col("exp_n").alias("num_transactions"),
        F.col("exp_std").alias("std_dev"))
    # Window over the grouped result (one row per category), never the raw rows;
    # the exact (decimal) sums are added before the cast to double.
    total = F.sum("__sum").over(Window.partitionBy(F.lit(1))).cast("double")
    return (g.withColumn("total_all", total)
            .withColumn("total_spent", F.col("__sum").cast("double"))
            .where(F.col("category").isNotNull()))


def spend_by_category(df: DataFrame, expense_sign: int = 1,
                      rollup: DataFrame | None = None) -> DataFrame:
    """Per category of expenses: total_spent, avg_transaction, num_transactions,
    std_dev (sample; NULL for one row) and pct_of_total, where the total counts
    every expense, also those without a category."""
    g = _category_spend(df, expense_sign, rollup)
    return g.select("category", "total_spent",
                    (F.col("total_spent") / F.col("num_transactions")).alias("avg_transaction"),
                    "num_transactions", "std_dev",
                    (F.col("total_spent") / F.col("total_all") * 100).alias("pct_of_total"))


def benchmarks_df(spark: SparkSession, table: dict = K.BENCHMARKS) -> DataFrame:
    return spark.createDataFrame([(c, float(i), float(w)) for c, (i, w) in table.items()],
                                 "category string, ideal_pct double, warning_pct double")


def tips_df(spark: SparkSession, table: dict = K.CATEGORY_TIPS) -> DataFrame:
    return spark.createDataFrame(list(table.items()), "category string, tip string")


# ------------------------------------------------------------------ A7
def overspending(df: DataFrame, monthly_income: float | None = None, expense_sign: int = 1,
                 benchmarks: dict = K.BENCHMARKS, rollup: DataFrame | None = None) -> DataFrame:
    """Categories above their benchmark share of the reference amount (income
    when given and non-zero, else total spending).  Inner join with the
    benchmark table: categories without a benchmark give no insight."""
    spark = df.sparkSession
    stats = _category_spend(df, expense_sign, rollup)
    bench = F.broadcast(benchmarks_df(spark, benchmarks))
    j = stats.join(bench, "category")
    ref = F.lit(float(monthly_income)) if monthly_income else F.col("total_all")
    j = j.withColumn("ref", ref)
    pct = F.when(F.col("ref") > 0, F.col("total_spent") / F.col("ref")).otherwise(F.lit(0.0))
    j = j.withColumn("p", pct)
    high = F.col("p") > F.col("warning_pct")
    medium = F.col("p") > F.col("ideal_pct")
    c = F.col("category")
    message = F.when(high, _text(MSG_OVERSPENDING, pct=py_fixed(F.col("p") * 100, 1), c=c,
                                 ideal=py_fixed(F.col("ideal_pct") * 100, 0))) \
        .otherwise(_text(MSG_MODERATE, c=c, pct=py_fixed(F.col("p") * 100, 1)))
    rec = F.when(high, _text(REC_OVERSPENDING, c=c,
                             excess=py_fixed((F.col("p") - F.col("ideal_pct")) * 100, 1))) \
        .otherwise(_text(REC_MODERATE, c=c))
    savings = F.when(high, F.greatest(F.lit(0.0), F.col("total_spent")
                                      - F.col("ref") * F.col("ideal_pct")))
    return (j.where(medium)
            .select(c, F.when(high, F.lit("overspending")).otherwise(F.lit("moderate_spending"))
                    .alias("metric_type"),
                    message.alias("message"),
                    F.when(high, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
                    rec.alias("recommendation"),
                    savings.cast("double").alias("savings_potential"),
                    F.col("total_spent").alias("__sort")))


# ------------------------------------------------------------------ A4
def frequent_small(df: DataFrame, expense_sign: int = 1,
                   min_count: int = K.FREQUENT_SMALL_MIN_COUNT,
                   max_mean: float = K.FREQUENT_SMALL_MAX_MEAN,
                   min_total: float = K.FREQUENT_SMALL_MIN_TOTAL,
                   savings_rate: float = K.FREQUENT_SMALL_SAVINGS,
                   rollup: DataFrame | None = None) -> DataFrame:
    r = rollup if rollup is not None else category_rollup(df, expense_sign)
    g = r.where(F.col("category").isNotNull() & (F.col("exp_n") > 0)).select(
        "category", F.col("exp_n").alias("n"), F.col("exp_sum").cast("double").alias("total"))
    g = g.withColumn("mean", F.col("total") / F.col("n"))
    c = F.col("category")
    return (g.where((F.col("n") > min_count) & (F.col("mean") < max_mean)
                    & (F.col("total") > min_total))
            .select(c, F.lit("frequent_small").alias("metric_type"),
                    _text(MSG_FREQUENT_SMALL, n=F.col("n"), c=c,
                          avg=py_fixed(F.col("mean"), 0)).alias("message"),
                    F.lit("medium").alias("severity"),
                    _text(REC_FREQUENT_SMALL, c=c, total=py_fixed(F.col("total"), 0))
                    .alias("recommendation"),
                    (F.col("total") * savings_rate).alias("savings_potential"),
                    F.col("total").alias("__sort")))


# ------------------------------------------------------------------ A5
def merchant_totals(df: DataFrame, expense_sign: int = 1) -> DataFrame:
    return (expenses(df, expense_sign).where(F.col("merchant").isNotNull())
            .groupBy("merchant")
            .agg(F.sum("amount").cast("double").alias("total"), F.count(F.lit(1)).alias("n"))
            .where(F.col("merchant") != "unknown"))


def top_merchants(df: DataFrame, expense_sign: int = 1, k: int = K.TOP_MERCHANTS) -> DataFrame:
    """Top-k merchants by spend (ties: merchant name).  The limit is the
    feature; Spark runs it as a per-partition top-k then a k-row merge."""
    t = merchant_totals(df, expense_sign).orderBy(F.desc("total"), F.asc("merchant")).limit(k)
    m = F.col("merchant")
    return t.select(m.alias("category"), F.lit("top_merchant").alias("metric_type"),
                    _text(MSG_TOP_MERCHANT, c=m, total=py_fixed(F.col("total"), 0),
                          n=F.col("n")).alias("message"),
                    F.lit("low").alias("severity"),
                    _text(REC_TOP_MERCHANT, c=m).alias("recommendation"),
                    F.lit(None).cast("double").alias("savings_potential"),
                    F.col("total").alias("__sort"))


# ------------------------------------------------------------------ A6
def subscription_fatigue(df: DataFrame, category: str = "subscription",
                         min_count: int = K.SUBSCRIPTION_MIN_COUNT,
                         savings_rate: float = K.SUBSCRIPTION_SAVINGS,
                         rollup: DataFrame | None = None) -> DataFrame:
    """Rows labelled ``subscription`` (any sign): more than ``min_count`` -> one insight."""
    r = rollup if rollup is not None else category_rollup(df.where(F.col("category") == category))
    g = r.where(F.col("category") == category).select(
        F.col("all_n").alias("n"),
        F.coalesce(F.col("all_sum").cast("double"), F.lit(0.0)).alias("total"))
    return g.where(F.col("n") > min_count).select(
        F.lit(category).alias("category"), F.lit("subscription_fatigue").alias("metric_type"),
        _text(MSG_SUBSCRIPTION, n=F.col("n"), total=py_fixed(F.col("total"), 0)).alias("message"),
        F.lit("medium").alias("severity"), F.lit(REC_SUBSCRIPTION).alias("recommendation"),
        (F.col("total") * savings_rate).alias("savings_potential"),
        F.col("total").alias("__sort"))


# ------------------------------------------------------------------ A8
def category_moments(df: DataFrame, expense_sign: int = 1,
                     rollup: DataFrame | None = None) -> DataFrame:
    r = rollup if rollup is not None else category_rollup(df, expense_sign)
    return r.where(F.col("category").isNotNull() & (F.col("exp_n") > 0)).select(
        "category", F.col("exp_n").alias("n"), F.col("exp_mean").alias("mean"),
        F.col("exp_std").alias("std"))


def anomalies(df: DataFrame, expense_sign: int = 1, z: float = K.ANOMALY_Z,
              min_count: int = K.ANOMALY_MIN_COUNT, rollup: DataFrame | None = None) -> DataFrame:
    """Expenses above mean + z * sample sd of their category (n >= 3, sd != 0).
    The per-category moments are a grouped aggregate joined back on category,
    not a window: a window would sort a hot category in a single task."""
    m = category_moments(df, expense_sign, rollup).where(
        (F.col("n") >= min_count) & (F.col("std") != 0))
    e = expenses(df, expense_sign).select("category", _amount().alias("amt"))
    j = e.join(m, "category").where(F.col("amt") > F.col("mean") + z * F.col("std"))
    c = F.col("category")
    return j.select(c, F.lit("anomaly").alias("metric_type"),
                    _text(MSG_ANOMALY, c=c, amount=py_fixed(F.col("amt"), 0),
                          mean=py_fixed(F.col("mean"), 0)).alias("message"),
                    F.lit("low").alias("severity"), F.lit(REC_ANOMALY).alias("recommendation"),
                    F.lit(None).cast("double").alias("savings_potential"),
                    F.col("amt").alias("__sort"))


# ------------------------------------------------------------------ A9
def all_insights(df: DataFrame, monthly_income: float | None = None,
                 expense_sign: int = 1, **thresholds) -> DataFrame:
    """Concatenation of the five rules, ordered by severity, then rule order.
    The category rollup (one row per category) is computed once and cached;
    only the anomaly join and the merchant totals read the rows again."""
    rollup = category_rollup(df, expense_sign).cache()
    parts = [
        overspending(df, monthly_income, expense_sign, rollup=rollup),
        frequent_small(df, expense_sign, rollup=rollup, **thresholds.get("frequent_small", {})),
        top_merchants(df, expense_sign) if "merchant" in df.columns else None,
        subscription_fatigue(df, rollup=rollup, **thresholds.get("subscription", {})),
        anomalies(df, expense_sign, rollup=rollup, **thresholds.get("anomalies", {})),
    ]
    out = None
    for rule_no, p in enumerate(parts):
        if p is None:
            continue
        p = p.withColumn("__rule", F.lit(rule_no))
        out = p if out is None else out.unionByName(p)
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1) \
        .when(F.col("severity") == "low", 2).otherwise(3)
    return (out.orderBy(rank, "__rule", F.desc("__sort"), "category")
            .select(*INSIGHT_COLUMNS))


# ------------------------------------------------------------------ A10
def summary_stats(df: DataFrame, expense_sign: int = 1) -> DataFrame:
    """One row of dashboard figures, from one grouped pass (per category:
    expense sum/count/max and income sum) folded by a tiny global aggregate."""
    is_exp = expense_filter(expense_sign)
    is_inc = expense_filter(-expense_sign)
    g = df.groupBy("category").agg(
        F.sum(F.when(is_exp, F.col("amount"))).cast("double").alias("exp_sum"),
        F.count(F.when(is_exp, F.lit(1))).alias("exp_n"),
        F.max(F.when(is_exp, _amount())).alias("exp_max"),
        F.sum(F.when(is_inc, F.col("amount"))).cast("double").alias("inc_sum"))
    named = F.col("category").isNotNull() & (F.col("exp_n") > 0)
    total = F.coalesce(F.sum("exp_sum"), F.lit(0.0))
    n = F.sum("exp_n")
    inc = F.abs(F.coalesce(F.sum("inc_sum"), F.lit(0.0)))
    top = F.min(F.when(named, F.struct((-F.col("exp_sum")).alias("k"), F.col("category"))))
    mode = F.min(F.when(named, F.struct((-F.col("exp_n")).alias("k"), F.col("category"))))
    return g.agg(
        total.alias("total_spent"),
        n.alias("num_transactions"),
        F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("avg_transaction"),
        top["category"].alias("top_category"),
        inc.alias("total_income"),
        (inc - total).alias("net_savings"),
        F.coalesce(F.max("exp_max"), F.lit(0.0)).alias("highest_expense"),
        mode["category"].alias("most_frequent_category"))


# ------------------------------------------------------------------ A11 + tips
def category_tips(df: DataFrame, expense_sign: int = 1, tips: dict = K.CATEGORY_TIPS) -> DataFrame:
    """Spend per category with its saving tip (left join to the fixed table)."""
    stats = spend_by_category(df, expense_sign).select("category", "total_spent")
    return stats.join(F.broadcast(tips_df(df.sparkSession, tips)), "category", "left")


def analyze_spending(df: DataFrame, monthly_income: float | None = None,
                     expense_sign: int = 1) -> tuple[DataFrame, DataFrame]:
    """(insights, summary).  The rules read the input several times; a caller that gives a
    costly plan persists it first, and releases it afterwards."""
    return all_insights(df, monthly_income, expense_sign), summary_stats(df, expense_sign)


def with_category_source(df: DataFrame) -> DataFrame | None:
    """Insights need ``category``; fall back to ``predicted_category``."""
    if "category" in df.columns:
        return df
    if "predicted_category" in df.columns:
        return df.withColumn("category", F.col("predicted_category"))
    return None

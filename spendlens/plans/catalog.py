"""Registered queries: one per inventory operator, each with its DuckDB oracle.

Each query reads the shared parquet tables of ``sf_dir`` (or data Spark derives
from them) in full.  Fractional outputs are doubles rounded to 6 places in
both engines so that float summation order cannot change the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DecimalType, DoubleType, FloatType, TimestampNTZType,
                               TimestampType)

from .. import constants as K
from ..operators import clean as C
from ..operators import insights as I
from ..scratch import Scratch
from ..sources.tables import TXN_CTE, table, txn
from . import sqlfrag as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fractional columns -> double rounded to ``digits``; dates and timestamps
    -> ISO text (both engines print them alike)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType, DecimalType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        elif isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def txm(spark, sf_dir) -> DataFrame:
    """txn with the extracted merchant (the input of the insight rules)."""
    return C.add_merchant(txn(spark, sf_dir))


def R(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


# =========================================================== scans, profile
register("training_projection", TXN_CTE + "SELECT description, " + R("amount")
         + " AS amount, category FROM txn")(
    lambda spark, d: rounded(txn(spark, d).select(*K.REQUIRED_COLUMNS)))


@register("dataset_summary", TXN_CTE + """
SELECT count(*) AS n_rows, 5 AS n_columns, {mn} AS amount_min, {mx} AS amount_max,
       {avg} AS amount_mean,
       CAST(count(*) - count(txn_id) AS BIGINT) AS nulls_txn_id,
       CAST(count(*) - count(date) AS BIGINT) AS nulls_date,
       CAST(count(*) - count(description) AS BIGINT) AS nulls_description,
       CAST(count(*) - count(amount) AS BIGINT) AS nulls_amount,
       CAST(count(*) - count(category) AS BIGINT) AS nulls_category
FROM txn""".format(mn=R("min(amount)"), mx=R("max(amount)"),
                   avg=R("avg(CAST(amount AS DOUBLE))")))
def _dataset_summary(spark, d):
    from ..operators.profile import dataset_summary
    return rounded(dataset_summary(txn(spark, d)))


@register("category_counts", TXN_CTE + """
SELECT category, count(*) AS count FROM txn WHERE category IS NOT NULL GROUP BY category""")
def _category_counts(spark, d):
    from ..operators.profile import category_counts
    return category_counts(txn(spark, d))


@register("preview_top10", TXN_CTE + "SELECT txn_id, CAST(date AS VARCHAR) AS date, description, "
          + R("amount") + " AS amount, category FROM txn ORDER BY txn_id LIMIT 10")
def _preview(spark, d):
    from ..operators.profile import preview
    return rounded(preview(txn(spark, d), ["txn_id"], 10))


@register("null_counts", TXN_CTE + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM txn"
    for c in ["txn_id", "date", "description", "amount", "category"]))
def _null_counts(spark, d):
    from ..operators.profile import null_counts
    return null_counts(txn(spark, d))


@register("upload_profile", TXN_CTE + """
SELECT count(*) AS total_rows, 5 AS n_columns, 'Yes' AS has_description, 'Yes' AS has_labels,
       'description' AS detected_description, 'amount' AS detected_amount,
       'category' AS detected_category, 'date' AS detected_date FROM txn""")
def _upload_profile(spark, d):
    from ..operators.profile import upload_profile
    return upload_profile(txn(spark, d))


@register("category_fallback", TXN_CTE + """
SELECT category, count(*) AS n, {s} AS total FROM txn GROUP BY category""".format(
    s=R("sum(amount)")))
def _category_fallback(spark, d):
    df = I.with_category_source(txn(spark, d).withColumnRenamed("category", "predicted_category"))
    return rounded(df.groupBy("category").agg(F.count(F.lit(1)).alias("n"),
                                              F.sum("amount").alias("total")))


# =========================================================== cleaning
@register("coerce_amount", """
SELECT event_id,
  CAST(CASE WHEN regexp_matches(a, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
       THEN trim(a) END AS DOUBLE) AS value_num,
  CAST(CASE WHEN regexp_matches(b, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
       THEN trim(b) END AS DOUBLE) AS k_num,
  CAST(CASE WHEN regexp_matches(props, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
       THEN trim(props) END AS DOUBLE) AS props_num
FROM (SELECT event_id, CAST(value AS VARCHAR) AS a,
             regexp_extract(props, ':(.*)}', 1) AS b, props FROM events)""")
def _coerce_amount(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.col("value").cast("string").alias("a"),
        F.regexp_extract("props", ":(.*)}", 1).alias("b"), "props")
    for src, dst in (("a", "value_num"), ("b", "k_num"), ("props", "props_num")):
        e = e.withColumn(dst, C.coerce_numeric(e, src))
    return e.select("event_id", "value_num", "k_num", "props_num")


def _statement(spark, d) -> DataFrame:
    """txn as a bank statement with separate Debit / Credit columns."""
    t = txn(spark, d)
    return t.select(F.col("txn_id"), F.col("description").alias("Narration"),
                    F.when(F.col("amount") > 0, F.col("amount")).alias("Debit"),
                    F.when(F.col("amount") < 0, -F.col("amount")).alias("Credit"),
                    F.col("date").alias("Txn Date"), F.col("category").alias("Category"))


STATEMENT_SQL = TXN_CTE + """, st AS (SELECT txn_id,
  CAST(CASE WHEN amount > 0 THEN amount ELSE 0 END AS DOUBLE) AS debit,
  CAST(CASE WHEN amount < 0 THEN -amount ELSE 0 END AS DOUBLE) AS credit FROM txn)
"""


@register("debit_credit_merge", STATEMENT_SQL + """
SELECT txn_id, round(credit - debit, 6) AS amount,
  CASE WHEN debit > 0 THEN 'expense' WHEN credit > 0 THEN 'income' ELSE 'unknown' END
    AS transaction_type
FROM st""")
def _debit_credit(spark, d):
    df, _ = C.standardize_columns(_statement(spark, d))
    df = C.extract_amount(df)
    return rounded(df.select("txn_id", "amount", "transaction_type"))


@register("transaction_type", STATEMENT_SQL + """
SELECT CASE WHEN debit > 0 THEN 'expense' WHEN credit > 0 THEN 'income' ELSE 'unknown' END
    AS transaction_type, count(*) AS n
FROM st GROUP BY 1""")
def _txn_type(spark, d):
    df, _ = C.standardize_columns(_statement(spark, d))
    return C.extract_amount(df).groupBy("transaction_type").agg(F.count(F.lit(1)).alias("n"))


register("extract_merchant", TXN_CTE + "SELECT txn_id, " + S.merchant("description")
         + " AS merchant FROM txn")(
    lambda spark, d: C.add_merchant(txn(spark, d)).select("txn_id", "merchant"))

register("transaction_mode", TXN_CTE + "SELECT txn_id, " + S.mode("description")
         + " AS transaction_mode FROM txn")(
    lambda spark, d: C.add_transaction_mode(txn(spark, d)).select("txn_id", "transaction_mode"))

register("transaction_mode_strict", TXN_CTE + "SELECT txn_id, " + S.mode("description", True)
         + " AS transaction_mode FROM txn")(
    lambda spark, d: C.add_transaction_mode(txn(spark, d), strict_reference=True)
    .select("txn_id", "transaction_mode"))

register("drop_nulls", TXN_CTE + "SELECT txn_id, description, category FROM txn "
         "WHERE txn_id IS NOT NULL AND date IS NOT NULL AND description IS NOT NULL "
         "AND amount IS NOT NULL AND category IS NOT NULL")(
    lambda spark, d: C.drop_nulls(txn(spark, d)).select("txn_id", "description", "category"))

register("standardize_text", TXN_CTE + "SELECT txn_id, " + S.std_text("description")
         + " AS description FROM txn")(
    lambda spark, d: C.standardize_description(txn(spark, d))
    .select("txn_id", "description"))

register("relabel_keywords", TXN_CTE + ", s AS (SELECT txn_id, " + S.std_text("description")
         + " AS description, category FROM txn)\nSELECT txn_id, description, "
         + S.relabel("description", "category") + " AS category FROM s")(
    lambda spark, d: C.relabel_keywords(C.standardize_description(txn(spark, d)))
    .select("txn_id", "description", "category"))


@register("dedupe_first", TXN_CTE + """
SELECT txn_id, CAST(date AS VARCHAR) AS date, description, {a} AS amount, category FROM (
  SELECT *, row_number() OVER (PARTITION BY description, date ORDER BY txn_id) AS rn FROM txn)
WHERE rn = 1""".format(a=R("amount")))
def _dedupe(spark, d):
    return rounded(C.dedupe_first(txn(spark, d), ["description", "date"], ["txn_id"]))


CLEAN_SQL = TXN_CTE + """, c1 AS (
  SELECT txn_id, date, description, amount, category, {m} AS merchant, {mode} AS transaction_mode
  FROM txn WHERE description IS NOT NULL AND amount IS NOT NULL),
c2 AS (SELECT txn_id, date, {std} AS description, amount, category, merchant, transaction_mode
  FROM c1),
c3 AS (SELECT txn_id, date, description, amount, {rl} AS category, merchant, transaction_mode
  FROM c2),
cleaned AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY description, amount, date ORDER BY txn_id) AS rn FROM c3) WHERE rn = 1)
""".format(m=S.merchant("description"), mode=S.mode("description"),
           std=S.std_text("description"), rl=S.relabel("description", "category"))


def _cleaned(spark, d) -> DataFrame:
    df, _ = C.clean(txn(spark, d), order_cols=["txn_id"])
    return df


@register("clean_pipeline", CLEAN_SQL + "SELECT txn_id, CAST(date AS VARCHAR) AS date, "
          "description, " + R("amount")
          + " AS amount, category, merchant, transaction_mode FROM cleaned")
def _clean_pipeline(spark, d):
    return rounded(_cleaned(spark, d))


@register("cleaning_report", CLEAN_SQL + """
SELECT (SELECT count(*) FROM txn) AS original_rows, count(*) AS cleaned_rows,
  (SELECT count(*) FROM txn) - count(*) AS removed_rows,
  """ + ",\n  ".join(f"CAST(count(*) - count({c}) AS BIGINT) AS nulls_{c}" for c in
                     ["txn_id", "date", "description", "amount", "category", "merchant",
                      "transaction_mode"]) + " FROM cleaned")
def _cleaning_report(spark, d):
    return C.cleaning_report(txn(spark, d), _cleaned(spark, d))


# =========================================================== insights
EXP = "(SELECT * FROM txm WHERE amount > 0)"

SPEND_SQL = S.TXN_M + """, g AS (
  SELECT category, sum(amount) AS s, count(amount) AS n, stddev_samp(CAST(amount AS DOUBLE)) AS sd
  FROM {e} GROUP BY category),
gt AS (SELECT *, sum(s) OVER () AS total FROM g),
spend AS (SELECT category, CAST(s AS DOUBLE) AS total_spent, CAST(s AS DOUBLE) / n AS avg_transaction,
  n AS num_transactions, sd AS std_dev, CAST(s AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS pct_of_total,
  CAST(total AS DOUBLE) AS total_all FROM gt WHERE category IS NOT NULL)
""".format(e=EXP)


@register("spend_by_category", SPEND_SQL + """
SELECT category, {a} AS total_spent, {b} AS avg_transaction, num_transactions,
  {c} AS std_dev, {d} AS pct_of_total FROM spend""".format(
    a=R("total_spent"), b=R("avg_transaction"), c=R("std_dev"), d=R("pct_of_total")))
def _spend_by_category(spark, d):
    return rounded(I.spend_by_category(txm(spark, d)))


def _over_sql(ref: str) -> str:
    return SPEND_SQL + """, j AS (
  SELECT s.category, s.total_spent, b.ideal_pct, b.warning_pct, {ref} AS ref
  FROM spend s JOIN {bench} ON s.category = b.bcat),
p AS (SELECT *, CASE WHEN ref > 0 THEN total_spent / ref ELSE 0 END AS p FROM j)
SELECT category,
  CASE WHEN p > warning_pct THEN 'overspending' ELSE 'moderate_spending' END AS metric_type,
  CASE WHEN p > warning_pct THEN concat('⚠️ Spending ', {p1}, '% on ', category,
        ' (recommended: ', {i0}, '%)')
       ELSE concat('ℹ️ ', category, ' is at ', {p1}, '% (slightly above ideal)') END AS message,
  CASE WHEN p > warning_pct THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN p > warning_pct THEN concat('Reduce ', category, ' spending by ', {e1},
        '%. Try cooking at home, using public transport, or finding cheaper alternatives.')
       ELSE concat('Monitor ', category, ' spending to stay within budget.') END
    AS recommendation,
  CASE WHEN p > warning_pct THEN round(greatest(0, total_spent - ref * ideal_pct), 6) END
    AS savings_potential
FROM p WHERE p > ideal_pct""".format(
        ref=ref, bench=S.BENCH_SQL,
        p1=S.py_fixed("p * 100", 1), i0=S.py_fixed("ideal_pct * 100", 0),
        e1=S.py_fixed("(p - ideal_pct) * 100", 1))


register("overspending", _over_sql("s.total_all"))(
    lambda spark, d: rounded(I.overspending(txm(spark, d)).drop("__sort")))

OVERSPEND_INCOME = 2_000_000.0
register("overspending_income", _over_sql(repr(OVERSPEND_INCOME)))(
    lambda spark, d: rounded(I.overspending(txm(spark, d), OVERSPEND_INCOME).drop("__sort")))

# Thresholds chosen so the rules fire on the test statement (amounts up to 4,900).
SMALL_MAX_MEAN = 2500.0
ANOMALY_Z_TEST = 1.5


def _frequent_small_sql(max_mean: float) -> str:
    return S.TXN_M + """, g AS (SELECT category, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total,
  CAST(sum(amount) AS DOUBLE) / count(amount) AS mean
  FROM {e} WHERE category IS NOT NULL GROUP BY category)
SELECT category, 'frequent_small' AS metric_type,
  concat('📝 ', n, ' small transactions in ', category, ' (avg ₹', {m0}, ')') AS message,
  'medium' AS severity,
  concat('Consider reducing frequency of small ', category, ' purchases. Monthly total: ₹', {t0})
    AS recommendation,
  round(total * 0.3, 6) AS savings_potential
FROM g WHERE n > 10 AND mean < {mm} AND total > 500""".format(
        e=EXP, m0=S.py_fixed("mean", 0), t0=S.py_fixed("total", 0), mm=repr(max_mean))


register("frequent_small", _frequent_small_sql(SMALL_MAX_MEAN))(
    lambda spark, d: rounded(I.frequent_small(txm(spark, d), max_mean=SMALL_MAX_MEAN)
                             .drop("__sort")))
register("frequent_small_default", _frequent_small_sql(100.0))(
    lambda spark, d: rounded(I.frequent_small(txm(spark, d)).drop("__sort")))


@register("top_merchants", S.TXN_M + """, g AS (
  SELECT merchant, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n FROM {e}
  WHERE merchant IS NOT NULL AND merchant <> 'unknown' GROUP BY merchant
  ORDER BY total DESC, merchant LIMIT 5)
SELECT merchant AS category, 'top_merchant' AS metric_type,
  concat('🏪 Top spending at ', merchant, ': ₹', {t0}, ' (', n, ' visits)') AS message,
  'low' AS severity,
  concat('Review if ', merchant, ' spending aligns with your budget priorities.')
    AS recommendation, CAST(NULL AS DOUBLE) AS savings_potential FROM g""".format(
    e=EXP, t0=S.py_fixed("total", 0)))
def _top_merchants(spark, d):
    return rounded(I.top_merchants(txm(spark, d)).drop("__sort"))


@register("subscription_fatigue", S.TXN_M + """, g AS (
  SELECT count(*) AS n, coalesce(CAST(sum(amount) AS DOUBLE), 0) AS total
  FROM txm WHERE category = 'subscription')
SELECT 'subscription' AS category, 'subscription_fatigue' AS metric_type,
  concat('📺 ', n, ' subscription services costing ₹', {t0}, '/month') AS message,
  'medium' AS severity,
  'Review unused subscriptions. Cancel those you don''t use regularly.' AS recommendation,
  round(total * 0.4, 6) AS savings_potential FROM g WHERE n > 5""".format(
    t0=S.py_fixed("total", 0)))
def _subscription(spark, d):
    return rounded(I.subscription_fatigue(txm(spark, d)).drop("__sort"))


def _anomaly_sql(z: float) -> str:
    return S.TXN_M + """, m AS (
  SELECT category, count(*) AS n, avg(CAST(amount AS DOUBLE)) AS mean,
         stddev_samp(CAST(amount AS DOUBLE)) AS sd
  FROM {e} WHERE category IS NOT NULL GROUP BY category)
SELECT x.category, 'anomaly' AS metric_type,
  concat('🔍 Unusually high ', x.category, ' expense: ₹', {a0}, ' (typical: ₹', {m0}, ')')
    AS message,
  'low' AS severity,
  'Verify if this was a planned expense or if there''s a billing error.' AS recommendation,
  CAST(NULL AS DOUBLE) AS savings_potential
FROM {e} x JOIN m ON x.category = m.category
WHERE m.n >= 3 AND m.sd <> 0 AND CAST(x.amount AS DOUBLE) > m.mean + {z} * m.sd""".format(
        e=EXP, a0=S.py_fixed("x.amount", 0), m0=S.py_fixed("m.mean", 0), z=repr(z))


register("anomalies", _anomaly_sql(ANOMALY_Z_TEST))(
    lambda spark, d: rounded(I.anomalies(txm(spark, d), z=ANOMALY_Z_TEST).drop("__sort")))
register("anomalies_default", _anomaly_sql(K.ANOMALY_Z))(
    lambda spark, d: rounded(I.anomalies(txm(spark, d)).drop("__sort")))


def _all_insights_sql() -> str:
    parts = [_over_sql("s.total_all"), _frequent_small_sql(SMALL_MAX_MEAN),
             ORACLE["top_merchants"], ORACLE["subscription_fatigue"],
             _anomaly_sql(ANOMALY_Z_TEST)]
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


register("all_insights", _all_insights_sql())(
    lambda spark, d: rounded(I.all_insights(
        txm(spark, d), frequent_small={"max_mean": SMALL_MAX_MEAN},
        anomalies={"z": ANOMALY_Z_TEST})))


@register("summary_stats", S.TXN_M + """, e AS (SELECT * FROM txm WHERE amount > 0),
i AS (SELECT * FROM txm WHERE amount < 0),
cs AS (SELECT category, sum(amount) AS s, count(*) AS n FROM e WHERE category IS NOT NULL
  GROUP BY category)
SELECT coalesce(CAST((SELECT sum(amount) FROM e) AS DOUBLE), 0) AS total_spent,
  (SELECT count(*) FROM e) AS num_transactions,
  round(coalesce((SELECT avg(CAST(amount AS DOUBLE)) FROM e), 0), 6) AS avg_transaction,
  (SELECT category FROM cs ORDER BY s DESC, category LIMIT 1) AS top_category,
  abs(coalesce(CAST((SELECT sum(amount) FROM i) AS DOUBLE), 0)) AS total_income,
  round(abs(coalesce(CAST((SELECT sum(amount) FROM i) AS DOUBLE), 0))
    - coalesce(CAST((SELECT sum(amount) FROM e) AS DOUBLE), 0), 6) AS net_savings,
  coalesce(CAST((SELECT max(amount) FROM e) AS DOUBLE), 0) AS highest_expense,
  (SELECT category FROM cs ORDER BY n DESC, category LIMIT 1) AS most_frequent_category""")
def _summary_stats(spark, d):
    return rounded(I.summary_stats(txm(spark, d)))


@register("category_tips", SPEND_SQL + """
SELECT s.category, {t} AS total_spent, tp.tip FROM spend s
LEFT JOIN {tips} ON s.category = tp.tcat""".format(
    t=R("s.total_spent"),
    tips=S.TIPS_SQL))
def _category_tips(spark, d):
    return rounded(I.category_tips(txm(spark, d)))


# The flagship: the cleaned, relabelled statement's spend per category.
@register("clean_spend_by_category", CLEAN_SQL.replace(TXN_CTE, TXN_CTE, 1) + """
, g AS (SELECT category, sum(amount) AS s, count(amount) AS n,
  stddev_samp(CAST(amount AS DOUBLE)) AS sd FROM cleaned WHERE amount > 0 GROUP BY category),
gt AS (SELECT *, sum(s) OVER () AS total FROM g)
SELECT category, {a} AS total_spent, {b} AS avg_transaction, n AS num_transactions,
  {c} AS std_dev, {d} AS pct_of_total FROM gt WHERE category IS NOT NULL""".format(
    a=R("s"), b=R("CAST(s AS DOUBLE) / n"), c=R("sd"),
    d=R("CAST(s AS DOUBLE) / CAST(total AS DOUBLE) * 100")))
def _clean_spend(spark, d):
    return rounded(I.spend_by_category(_cleaned(spark, d)))


# =========================================================== labelling
from ..operators import label as L  # noqa: E402
from ..operators import profile as P  # noqa: E402


def _labelled(spark, d) -> DataFrame:
    """txn with a merchant name in map spelling (first letter upper-cased)."""
    t = C.add_merchant(txn(spark, d))
    return t.withColumn("merchant", F.concat(F.upper(F.substring("merchant", 1, 1)),
                                             F.expr("substr(merchant, 2)")))


_DESC_BEST, _DESC_SCORE = S.best(S.scores("lower(coalesce(description, 'nan'))",
                                          K.CLEANER_KEYWORDS))
LABEL_SQL = TXN_CTE + """, txl AS (SELECT txn_id, description, category,
  concat(upper(substr(m, 1, 1)), substr(m, 2)) AS merchant FROM (SELECT *, {m} AS m FROM txn)),
sc AS (SELECT txl.*, {b} AS desc_category, {s} AS desc_score FROM txl),
lk AS (SELECT sc.*, mm.m_category AS merchant_category FROM sc LEFT JOIN {mm}
  ON sc.merchant = mm.mname),
rc AS (SELECT lk.*, CASE
  WHEN merchant_category IS NOT NULL AND desc_category IS NOT NULL THEN
    CASE WHEN merchant_category = desc_category THEN merchant_category
         WHEN desc_score <= 1 THEN merchant_category ELSE desc_category END
  WHEN merchant_category IS NOT NULL THEN merchant_category
  WHEN desc_category IS NOT NULL AND desc_score >= 1 THEN desc_category END AS new_label FROM lk),
fx AS (SELECT rc.*, coalesce(new_label IS NOT NULL AND new_label IS DISTINCT FROM category, false)
  AS differs FROM rc)
""".format(m=S.merchant("description"), b=_DESC_BEST, s=_DESC_SCORE, mm=S.MERCHANT_MAP_SQL)

register("desc_category_score", LABEL_SQL + "SELECT txn_id, desc_category, desc_score FROM sc")(
    lambda spark, d: L.desc_category_score(_labelled(spark, d))
    .select("txn_id", "desc_category", "desc_score"))

register("merchant_lookup", LABEL_SQL + "SELECT txn_id, merchant, merchant_category FROM lk")(
    lambda spark, d: L.merchant_lookup(_labelled(spark, d))
    .select("txn_id", "merchant", "merchant_category"))

register("reconcile_labels", LABEL_SQL + "SELECT txn_id, new_label FROM rc")(
    lambda spark, d: L.proposed_labels(_labelled(spark, d)).select("txn_id", "new_label"))

register("repair_labels", LABEL_SQL + """SELECT txn_id,
  CASE WHEN differs THEN new_label ELSE category END AS category, differs AS corrected FROM fx""")(
    lambda spark, d: L.repair_labels(_labelled(spark, d)).select("txn_id", "category", "corrected"))

register("repair_ratio_0", LABEL_SQL + "SELECT txn_id, category, false AS corrected FROM fx")(
    lambda spark, d: L.repair_labels(_labelled(spark, d), fix_ratio=0.0)
    .select("txn_id", "category", "corrected"))

register("repair_ratio_1", LABEL_SQL + """SELECT count(*) AS rows,
  CAST(sum(CASE WHEN differs THEN 1 ELSE 0 END) AS BIGINT) AS corrected FROM fx""")(
    lambda spark, d: L.repair_summary(L.repair_labels(_labelled(spark, d), fix_ratio=1.0)))

# Seeded partial repair: the draw is an MD5 of the row key, which SQL can repeat.
register("repair_ratio_075", LABEL_SQL + """SELECT count(*) AS rows,
  CAST(sum(CASE WHEN differs AND CAST('0x' || substr(md5(concat(txn_id, ':42')), 1, 6) AS INT)
    / 16777216.0 < 0.75 THEN 1 ELSE 0 END) AS BIGINT) AS corrected FROM fx""")(
    lambda spark, d: L.repair_summary(L.repair_labels(_labelled(spark, d), fix_ratio=0.75,
                                                      key_col="txn_id")))

register("label_distribution", LABEL_SQL + """SELECT stage, category, count(*) AS count FROM (
  SELECT 'before' AS stage, category FROM fx UNION ALL
  SELECT 'after' AS stage, CASE WHEN differs THEN new_label ELSE category END FROM fx)
GROUP BY stage, category""")(
    lambda spark, d: L.label_distribution(_labelled(spark, d),
                                          L.repair_labels(_labelled(spark, d))))


# =========================================================== chart data
register("category_share", TXN_CTE + """SELECT category, count(*) AS count,
  round(count(*) / sum(count(*)) OVER (), 6) AS share FROM txn WHERE category IS NOT NULL
GROUP BY category""")(lambda spark, d: rounded(P.category_share(txn(spark, d))))

register("amount_histogram", TXN_CTE + """, x AS (SELECT CAST(amount AS DOUBLE) AS x FROM txn
  WHERE amount IS NOT NULL),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
h AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 20)), 19) END
  AS INTEGER) AS bin, lo, hi FROM x, b)
SELECT bin, round(min(lo) + bin * (min(hi) - min(lo)) / 20, 6) AS bin_start, count(*) AS count
FROM h GROUP BY bin""")(lambda spark, d: rounded(P.amount_histogram(txn(spark, d))))

register("amount_box", TXN_CTE + """SELECT category, {mn} AS min,
  {q1} AS q1, {q2} AS median, {q3} AS q3, {mx} AS max
FROM txn WHERE category IS NOT NULL AND amount IS NOT NULL GROUP BY category""".format(
    mn=R("min(amount)"), mx=R("max(amount)"),
    q1=R("quantile_cont(CAST(amount AS DOUBLE), 0.25)"),
    q2=R("quantile_cont(CAST(amount AS DOUBLE), 0.5)"),
    q3=R("quantile_cont(CAST(amount AS DOUBLE), 0.75)")))(
    lambda spark, d: rounded(P.amount_box(txn(spark, d))))

CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _corr_sql() -> str:
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            v = (f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)" if a != b
                 else "1.0")
            src = "" if a == b else " FROM lineitem"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {v} AS corr{src}")
    return "\nUNION ALL\n".join(parts)


register("correlation_matrix", _corr_sql())(
    lambda spark, d: rounded(P.correlation_matrix(table(spark, d, "lineitem"), CORR_COLS)))

register("monthly_trend", """SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 6) AS amount
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")(
    lambda spark, d: rounded(P.monthly_trend(
        table(spark, d, "orders").select(F.col("o_orderdate").alias("date"),
                                         F.col("o_totalprice").cast("decimal(18,2)")
                                         .alias("amount")))))

register("monthly_trend_txn", TXN_CTE + """SELECT strftime(date, '%Y-%m') AS month,
  round(CAST(sum(amount) AS DOUBLE), 6) AS amount FROM txn WHERE date IS NOT NULL GROUP BY 1""")(
    lambda spark, d: rounded(P.monthly_trend(txn(spark, d))))

register("distinct_categories", TXN_CTE + "SELECT count(DISTINCT category) AS n_distinct FROM txn")(
    lambda spark, d: P.distinct_count(txn(spark, d)))


# =========================================================== features
from ..functions.text import english_stop_words  # noqa: E402
from ..operators import features as FE  # noqa: E402
from ..operators import tfidf as TF  # noqa: E402

_T = "coalesce(description, 'nan')"
_LOWT = f"lower({_T})"


def _text_stats_sql() -> str:
    ws = S.words(_T)
    return TXN_CTE + f"""SELECT txn_id, {S.word_count(_T)} AS word_count,
  length({_T}) AS char_count,
  round(CASE WHEN len({ws}) > 0 THEN list_sum(list_transform({ws}, lambda w: length(w)))
    / len({ws}) ELSE 0 END, 6) AS avg_word_length FROM txn"""


def _flag_sql(kws) -> str:
    return "greatest(" + ", ".join(f"CAST(contains({_LOWT}, {S.q(k)}) AS INTEGER)"
                                   for k in kws) + ")"


def _count_sql(kws) -> str:
    return "(" + " + ".join(
        f"CAST((length({_LOWT}) - length(replace({_LOWT}, {S.q(k)}, ''))) / {len(k)} AS INTEGER)"
        for k in kws) + ")"


register("text_stats", _text_stats_sql())(
    lambda spark, d: rounded(FE.text_features(txn(spark, d)).select(
        "txn_id", "word_count", "char_count", "avg_word_length")))

register("keyword_flags", TXN_CTE + "SELECT txn_id, " + ", ".join(
    f"{_flag_sql(v)} AS has_{c}_keyword" for c, v in K.FEATURE_KEYWORDS.items()) + " FROM txn")(
    lambda spark, d: FE.text_features(txn(spark, d)).select(
        "txn_id", *[f"has_{c}_keyword" for c in K.FEATURE_KEYWORDS]))

register("keyword_counts", TXN_CTE + "SELECT txn_id, " + ", ".join(
    f"{_count_sql(v)} AS {c}_keyword_count" for c, v in K.FEATURE_KEYWORDS.items())
    + " FROM txn")(
    lambda spark, d: FE.text_features(txn(spark, d)).select(
        "txn_id", *[f"{c}_keyword_count" for c in K.FEATURE_KEYWORDS]))

register("log_amount", TXN_CTE + "SELECT txn_id, round(coalesce(ln(1 + abs(CAST(amount AS DOUBLE)))"
         ", 0), 6) AS log_amount FROM txn")(
    lambda spark, d: rounded(txn(spark, d).select(
        "txn_id", FE.log_amount(F.col("amount")).alias("log_amount"))))

AMT_STATS_SQL = TXN_CTE + """, st AS (SELECT quantile_cont(CAST(amount AS DOUBLE), 0.5) AS med,
  quantile_cont(CAST(amount AS DOUBLE), 0.75) AS q75, avg(CAST(amount AS DOUBLE)) AS mean,
  stddev_pop(CAST(amount AS DOUBLE)) AS sd, min(CAST(amount AS DOUBLE)) AS mn,
  max(CAST(amount AS DOUBLE)) AS mx FROM txn),
ac AS (SELECT txn.*, CASE WHEN CAST(amount AS DOUBLE) <= med THEN 'small'
  WHEN CAST(amount AS DOUBLE) <= q75 THEN 'medium' ELSE 'large' END AS amount_category
  FROM txn, st)
"""


def _amount_cat(spark, d) -> DataFrame:
    t = txn(spark, d)
    st = FE.AmountStats.fit(t)
    return t.withColumn("amount_category", FE.amount_category(F.col("amount"), st.median, st.q75))


register("amount_category", AMT_STATS_SQL + "SELECT txn_id, amount_category FROM ac")(
    lambda spark, d: _amount_cat(spark, d).select("txn_id", "amount_category"))

register("amount_dummies", AMT_STATS_SQL + """SELECT txn_id,
  CAST(amount_category = 'large' AS INTEGER) AS amount_large,
  CAST(amount_category = 'medium' AS INTEGER) AS amount_medium,
  CAST(amount_category = 'small' AS INTEGER) AS amount_small FROM ac""")(
    lambda spark, d: _amount_cat(spark, d).select(
        "txn_id", *[v.alias(k) for k, v in FE.amount_dummies(F.col("amount_category")).items()]))


def _scaled(spark, d, how):
    t = txn(spark, d)
    st = FE.AmountStats.fit(t)
    c = (FE.standard_scale(F.col("amount"), st.mean, st.std_pop) if how == "std"
         else FE.minmax_scale(F.col("amount"), st.min, st.max))
    return rounded(t.select("txn_id", c.alias("amount_scaled")))


register("standard_scale", AMT_STATS_SQL + """SELECT txn_id,
  round((CAST(amount AS DOUBLE) - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS amount_scaled
FROM txn, st""")(lambda spark, d: _scaled(spark, d, "std"))

register("minmax_scale", AMT_STATS_SQL + """SELECT txn_id,
  round(CASE WHEN mx > mn THEN (CAST(amount AS DOUBLE) - mn) / (mx - mn) ELSE 0 END, 6)
    AS amount_scaled FROM txn, st""")(lambda spark, d: _scaled(spark, d, "minmax"))

register("fixed_bins", TXN_CTE + """, x AS (SELECT txn_id, coalesce(CAST(amount AS DOUBLE), 0) AS a
  FROM txn)
SELECT txn_id, CAST(a < 100 AS INTEGER) AS amt_small,
  CAST(a >= 100 AND a < 500 AS INTEGER) AS amt_medium,
  CAST(a >= 500 AND a < 1000 AS INTEGER) AS amt_large, CAST(a >= 1000 AS INTEGER) AS amt_xl
FROM x""")(lambda spark, d: txn(spark, d).select(
    "txn_id", *[v.alias(k) for k, v in FE.fixed_bins(F.col("amount")).items()]))


def _merchant_onehot(spark, d):
    t = C.add_merchant(txn(spark, d))
    top = FE.top_values(t, "merchant", 15)
    # the window runs over the 15-row top list only
    ranked = top.withColumn("onehot_index", F.row_number().over(
        Window.orderBy(F.desc("n"), F.asc("merchant"))) - 1).drop("n")
    return t.join(F.broadcast(ranked), "merchant", "left").select(
        "txn_id", "merchant",
        F.coalesce(F.col("onehot_index").cast("long"), F.lit(-1).cast("long")).alias("onehot_index"))


register("merchant_onehot", TXN_CTE + """, tm AS (SELECT txn_id, {m} AS merchant FROM txn),
top AS (SELECT merchant, count(*) AS n FROM tm WHERE merchant IS NOT NULL GROUP BY merchant
  ORDER BY n DESC, merchant LIMIT 15),
rk AS (SELECT merchant, row_number() OVER (ORDER BY n DESC, merchant) - 1 AS onehot_index FROM top)
SELECT tm.txn_id, tm.merchant, coalesce(rk.onehot_index, -1) AS onehot_index FROM tm LEFT JOIN rk
  ON tm.merchant = rk.merchant""".format(m=S.merchant("description")))(_merchant_onehot)

TFIDF_A = TF.TfidfParams(max_features=100, min_df=1, max_df=1.0, sublinear_tf=True)
TFIDF_B = TF.TfidfParams(max_features=100, min_df=2, max_df=0.95, sublinear_tf=False,
                         stop_words=tuple(english_stop_words()))


def _tfidf_sql(p: TF.TfidfParams, final: str) -> str:
    toks = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
    if p.stop_words:
        stop = "[" + ", ".join(S.q(w) for w in p.stop_words) + "]"
        toks = f"list_filter({toks}, lambda w: NOT list_contains({stop}, w))"
    lo = f"{int(p.min_df)}" if p.min_df >= 1 else f"{p.min_df} * n"
    hi = f"{p.max_df} * n" if p.max_df <= 1.0 else f"{p.max_df}"
    tf = "(1 + ln(c.tf))" if p.sublinear_tf else "CAST(c.tf AS DOUBLE)"
    return f"""WITH toks AS (SELECT doc_id, {toks} AS t FROM documents),
terms AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)),
  lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM toks),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
nd AS (SELECT count(doc_id) AS n FROM documents),
st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY term),
kept AS (SELECT st.*, nd.n FROM st, nd WHERE df >= {lo} AND df <= {hi}
  ORDER BY total DESC, term LIMIT {p.max_features}),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df,
  ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM kept),
w AS (SELECT c.doc_id, c.term, v.idx, {tf} * v.idf AS w FROM counts c JOIN vocab v
  ON c.term = v.term),
wn AS (SELECT doc_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
{final}"""


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


register("tfidf_vocab", _tfidf_sql(TFIDF_A, "SELECT term, idx AS \"index\", df, round(idf, 6) AS idf "
                                            "FROM vocab"))(
    lambda spark, d: rounded(TF.fit_vocabulary(_docs(spark, d), "doc_id", "text", TFIDF_A)))


def _weights(spark, d, p):
    vocab, w = TF.tfidf_long(_docs(spark, d), "doc_id", "text", p)
    return rounded(w.select(F.col("doc").alias("doc_id"), "term", "weight"))


register("tfidf_weights_sublinear", _tfidf_sql(
    TFIDF_A, "SELECT doc_id, term, round(weight, 6) AS weight FROM wn"))(
    lambda spark, d: _weights(spark, d, TFIDF_A))

register("tfidf_weights_df_filtered", _tfidf_sql(
    TFIDF_B, "SELECT doc_id, term, round(weight, 6) AS weight FROM wn"))(
    lambda spark, d: _weights(spark, d, TFIDF_B))

register("tfidf_vocab_df_filtered", _tfidf_sql(
    TFIDF_B, "SELECT term, idx AS \"index\", df, round(idf, 6) AS idf FROM vocab"))(
    lambda spark, d: rounded(TF.fit_vocabulary(_docs(spark, d), "doc_id", "text", TFIDF_B)))


# =========================================================== split, metrics
from ..operators import metrics as M  # noqa: E402
from ..operators import split as SP  # noqa: E402

CLASSES = sorted(K.FEATURE_KEYWORDS)   # alphabetical = label index order


def _rule_predictions(spark, d) -> DataFrame:
    """(txn_id, label, prediction, probability): a keyword-count model whose
    class probabilities are (count + 1) / (total + K), argmax first in index
    order.  Deterministic, so metric queries have an exact SQL oracle."""
    t = FE.text_features(txn(spark, d))
    counts = [F.col(f"{c}_keyword_count") for c in CLASSES]
    total = sum(counts, F.lit(0))
    probs = F.array(*[(c + F.lit(1.0)) / (total + F.lit(float(len(CLASSES)))) for c in counts])
    t = t.select("txn_id", F.col("category").alias("label"), probs.alias("probability"))
    pos = F.array_position(F.col("probability"), F.array_max("probability"))
    return t.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in CLASSES]),
                                                   pos.cast("int")))


def _pred_sql() -> str:
    cnt = {c: _count_sql(K.FEATURE_KEYWORDS[c]) for c in CLASSES}
    total = " + ".join(f"c_{c}" for c in CLASSES)
    probs = ", ".join(f"(c_{c} + 1.0) / ({total} + {float(len(CLASSES))}) AS p_{c}"
                      for c in CLASSES)
    g = "greatest(" + ", ".join(f"p_{c}" for c in CLASSES) + ")"
    pred = "CASE " + " ".join(f"WHEN p_{c} = {g} THEN {S.q(c)}" for c in CLASSES) + " END"
    return TXN_CTE + f""", cn AS (SELECT txn_id, category AS label, {", ".join(
        f"{v} AS c_{c}" for c, v in cnt.items())} FROM txn),
pp AS (SELECT txn_id, label, {probs} FROM cn),
pred AS (SELECT *, {pred} AS prediction FROM pp)
"""


PRED_SQL = _pred_sql()

register("label_index", TXN_CTE + """SELECT category, row_number() OVER (ORDER BY category) - 1
  AS label_index FROM (SELECT DISTINCT category FROM txn WHERE category IS NOT NULL)""")(
    lambda spark, d: SP.label_index(txn(spark, d)))

SIZES_SQL = TXN_CTE + """, c AS (SELECT category, count(*) AS n FROM txn GROUP BY category),
t AS (SELECT *, sum(n) OVER () AS nn, CAST(ceil(0.2 * sum(n) OVER ()) AS BIGINT) AS tt FROM c),
e AS (SELECT *, n * tt / nn AS ex, CAST(floor(n * tt / nn) AS BIGINT) AS base FROM t),
l AS (SELECT *, tt - sum(base) OVER () AS lft,
  row_number() OVER (ORDER BY ex - base DESC, category) AS rk FROM e),
sizes AS (SELECT category, n, base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS n_test FROM l)
"""

register("stratified_sizes", SIZES_SQL + "SELECT category, n, n_test, n - n_test AS n_train FROM sizes")(
    lambda spark, d: SP.stratified_sizes(txn(spark, d)))

register("stratified_split", SIZES_SQL + """SELECT category, n_test AS test_rows,
  n - n_test AS train_rows FROM sizes""")(
    lambda spark, d: SP.stratified_split(txn(spark, d), "txn_id").groupBy("category").agg(
        F.count_if(F.col("is_test")).alias("test_rows"),
        F.count_if(~F.col("is_test")).alias("train_rows")))



def _draw_sql(seed: int) -> str:
    return f"CAST('0x' || substr(md5(concat(txn_id, ':{seed}')), 1, 8) AS BIGINT)"


# Which rows, not only how many: the draw is one that SQL can repeat.
register("stratified_split_rows", SIZES_SQL + f""", r AS (SELECT txn_id, category,
  row_number() OVER (PARTITION BY category ORDER BY {_draw_sql(42)} % {SP.HASH_BUCKETS},
    {_draw_sql(42)}, txn_id) AS rk FROM txn WHERE category IS NOT NULL)
SELECT txn_id, r.category, r.rk <= s.n_test AS is_test
FROM r JOIN sizes s ON r.category = s.category""")(
    lambda spark, d: SP.stratified_split(
        txn(spark, d), "txn_id", draw=SP.md5_draw("txn_id", 42)).select(
        "txn_id", "category", "is_test"))

register("cv_fold_rows", TXN_CTE + f"""SELECT txn_id, category, CAST((row_number() OVER (
  PARTITION BY category ORDER BY {_draw_sql(43)} % {SP.HASH_BUCKETS}, {_draw_sql(43)}, txn_id) - 1)
  % 5 AS INTEGER) AS fold FROM txn WHERE category IS NOT NULL""")(
    lambda spark, d: SP.with_folds(
        txn(spark, d), "txn_id", draw=SP.md5_draw("txn_id", 43)).select(
        "txn_id", "category", "fold"))

register("class_weights", TXN_CTE + """SELECT category, n, round(sum(n) OVER () / (count(*) OVER ()
  * n), 6) AS weight FROM (SELECT category, count(*) AS n FROM txn GROUP BY category)""")(
    lambda spark, d: rounded(SP.class_weights(txn(spark, d))))

register("cv_fold_sizes", TXN_CTE + """, c AS (SELECT category, count(*) AS n FROM txn GROUP BY category)
SELECT category, CAST(f AS INTEGER) AS fold, CAST((n + 5 - 1 - f) // 5 AS BIGINT) AS rows
FROM c, range(0, 5) r(f) WHERE (n + 5 - 1 - f) // 5 > 0""")(
    lambda spark, d: SP.with_folds(txn(spark, d), "txn_id").groupBy("category", "fold").agg(
        F.count(F.lit(1)).alias("rows")))

register("accuracy", PRED_SQL + """SELECT round(avg(CAST(label = prediction AS DOUBLE)), 6)
  AS accuracy FROM pred""")(lambda spark, d: rounded(M.accuracy(_rule_predictions(spark, d))))

PER_CLASS_SQL = PRED_SQL + """, pc AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY ALL),
sup AS (SELECT label AS class, sum(n) AS support FROM pc GROUP BY 1),
prd AS (SELECT prediction AS class, sum(n) AS predicted FROM pc GROUP BY 1),
tp AS (SELECT label AS class, n AS tp FROM pc WHERE label = prediction),
cls AS (SELECT coalesce(s.class, p.class) AS class, coalesce(s.support, 0) AS support,
  coalesce(p.predicted, 0) AS predicted FROM sup s FULL JOIN prd p ON s.class = p.class),
m0 AS (SELECT c.class, coalesce(tp.tp, 0) AS tp, support, predicted FROM cls c
  LEFT JOIN tp ON c.class = tp.class),
m1 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM m0),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0 END AS f1 FROM m1)
"""

register("weighted_prf", PER_CLASS_SQL + """SELECT
  round(sum(precision * support) / sum(support), 6) AS precision,
  round(sum(recall * support) / sum(support), 6) AS recall,
  round(sum(f1 * support) / sum(support), 6) AS f1,
  round(sum(tp) / sum(support), 6) AS accuracy FROM m""")(
    lambda spark, d: rounded(M.weighted_prf(_rule_predictions(spark, d))))

register("classification_report", PER_CLASS_SQL + """
SELECT class AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM m""")(
    lambda spark, d: rounded(M.classification_report(_rule_predictions(spark, d))))

register("confusion_matrix_full", PRED_SQL + """, names AS (
  SELECT DISTINCT label FROM pred)
SELECT t.label AS true_label, p.label AS predicted_label, count(x.label) AS count
FROM names t CROSS JOIN names p
LEFT JOIN pred x ON x.label = t.label AND x.prediction = p.label GROUP BY ALL""")(
    lambda spark, d: M.confusion_matrix(_rule_predictions(spark, d), zeros=True))

register("confusion_matrix", PRED_SQL + """SELECT label AS true_label, prediction AS predicted_label,
  count(*) AS count FROM pred WHERE prediction IN (SELECT DISTINCT label FROM pred)
GROUP BY ALL""")(lambda spark, d: M.confusion_matrix(_rule_predictions(spark, d)))


def _roc(spark, d):
    p = _rule_predictions(spark, d)
    z = p.select("label", F.explode(F.arrays_zip(
        F.array(*[F.lit(c) for c in CLASSES]).alias("class"),
        F.col("probability").alias("score"))).alias("z"))
    rows = z.select(F.col("z.class").alias("class"),
                    (F.col("label") == F.col("z.class")).cast("int").alias("label"),
                    F.col("z.score").alias("score"))
    return rounded(M.roc_auc(rows))


register("roc_auc", PRED_SQL + """, rows AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS class, CAST(label = '{c}' AS INTEGER) AS y, p_{c} AS score FROM pred"
    for c in CLASSES) + """),
g AS (SELECT class, score, sum(y) AS pos, sum(1 - y) AS neg FROM rows GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g
  WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c2 AS (SELECT *, coalesce(lag(tp) OVER (PARTITION BY class ORDER BY score DESC), 0) AS tp0,
  coalesce(lag(fp) OVER (PARTITION BY class ORDER BY score DESC), 0) AS fp0 FROM c)
SELECT class, round(sum((fp - fp0) * (tp + tp0) / 2.0) / (max(tp) * max(fp)), 6) AS auc,
  CAST(max(tp) AS BIGINT) AS positives, CAST(max(fp) AS BIGINT) AS negatives
FROM c2 GROUP BY class""")(_roc)

MODEL_ORDER = ["keyword_features", "keyword_cleaner"]


def _model_long(spark, d):
    p = _rule_predictions(spark, d).select(F.lit("keyword_features").alias("model"), "txn_id",
                                           "label", "prediction")
    rc = L.desc_category_score(txn(spark, d)).select(
        F.lit("keyword_cleaner").alias("model"), "txn_id", F.col("category").alias("label"),
        F.coalesce("desc_category", F.lit("unknown")).alias("prediction"))
    return p.unionByName(rc)


MODELS_SQL = PRED_SQL + """, lng AS (SELECT 'keyword_features' AS model, label, prediction FROM pred
  UNION ALL SELECT 'keyword_cleaner', category, coalesce({b}, 'unknown') FROM txn),
cmp AS (SELECT model, avg(CAST(label = prediction AS DOUBLE)) AS accuracy,
  CASE model WHEN 'keyword_features' THEN 1 ELSE 2 END AS train_order FROM lng GROUP BY model)
""".format(b=_DESC_BEST)

register("model_comparison", MODELS_SQL + """SELECT model, round(accuracy, 6) AS accuracy,
  CAST(train_order AS BIGINT) AS train_order FROM cmp""")(
    lambda spark, d: rounded(M.compare_models(_model_long(spark, d), MODEL_ORDER)))

register("best_model", MODELS_SQL + """SELECT model, round(accuracy, 6) AS accuracy,
  CAST(train_order AS BIGINT) AS train_order FROM cmp ORDER BY accuracy DESC, train_order
LIMIT 1""")(lambda spark, d: rounded(M.best_model(M.compare_models(_model_long(spark, d),
                                                                    MODEL_ORDER))))


# =========================================================== models (invariant checks)
from pyspark.ml.functions import array_to_vector  # noqa: E402

from . import models as MD  # noqa: E402


def _embeddings(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>"))
                    .alias("features"), F.col("label").cast("double").alias("label"),
                    F.col("label").cast("string").alias("category"))


def _emb_split(spark, d, nonneg: bool = False):
    """Train and test rows; scaling and class weights are fitted on train only."""
    split = SP.stratified_split(_embeddings(spark, d), "vec_id", "category")
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    if nonneg:
        train, test = MD.nonnegative(train, test)
    return SP.with_class_weights(train, "category"), test


def _fit_predict(name: str, weighted: bool = False, nonneg: bool = False,
                 registry: str = "single"):
    def q(spark, d):
        train, test = _emb_split(spark, d, nonneg)
        out = MD.fit_predict(train, test, name, weight_col="weight" if weighted else None,
                             registry=registry)
        return out.select("vec_id", "label", F.col("prediction").cast("double").alias("prediction"))
    return q


for _n, _name, _w, _nn in [("lr", "logistic_regression", True, False),
                           ("rf", "random_forest", True, False),
                           ("dt", "decision_tree", True, False),
                           ("gbt", "gradient_boosting", False, False),
                           ("nb", "naive_bayes", False, True),
                           ("svm", "svm", True, False),
                           ("ensemble", "ensemble", True, False)]:
    register(f"fit_predict_{_n}")(_fit_predict(
        _name, _w, _nn, "bakeoff" if _name in MD.BAKEOFF else "single"))


@register("train_all")
def _train_all(spark, d):
    """M13 + M28: the bake-off set fitted on one split, compared in one pass."""
    train, test = _emb_split(spark, d)
    parts = []
    with Scratch(spark) as keep:
        train, n = MD.fit_table(train, keep)
        for name in list(MD.BAKEOFF) + ["ensemble"]:
            p = MD.fit_predict(train, test, name, weight_col="weight", n_rows=n, registry="bakeoff")
            parts.append(p.select(F.lit(name).alias("model"), "label",
                                  F.col("prediction").cast("double").alias("prediction")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return rounded(M.compare_models(long, list(MD.BAKEOFF) + ["ensemble"]))


@register("cross_validate")
def _cross_validate(spark, d):
    """M11 on the whole statement: a row per fold, with the folds' mean and spread."""
    p = MD.cross_validation(txn(spark, d), "logistic_regression", 5)
    return rounded(MD.fold_metrics(p).select(
        "fold", "accuracy", "precision", "recall", "f1", "accuracy_mean", "accuracy_2std"))


@register("cross_validate_predictions")
def _cross_validate_predictions(spark, d):
    """The out-of-fold prediction of every labelled row."""
    return MD.cross_validation(txn(spark, d), "decision_tree", 5)


def _txn_model(spark, d, model="random_forest", top_merchants=0):
    """Model of the training part of the statement, and the whole statement."""
    t = C.add_merchant(txn(spark, d))
    split = SP.stratified_split(t, "txn_id", "category")
    train = split.where(~F.col("is_test"))
    return MD.fit_transactions(train, model, top_merchants=top_merchants), t


@register("feature_importance")
def _feature_importance(spark, d):
    """The top-20 importances with feature names."""
    model, _ = _txn_model(spark, d)
    return MD.feature_importance(model, spark)


@register("score_batch")
def _score_batch(spark, d):
    """P5: every input row scored (no row dropped)."""
    model, t = _txn_model(spark, d)
    return rounded(MD.score(model, t).select("txn_id", "predicted_category", "confidence"))


@register("score_top3")
def _score_top3(spark, d):
    """Top-3 classes per row, long form (txn_id, rank, category, probability)."""
    model, t = _txn_model(spark, d)
    return rounded(MD.ranking_rows(MD.score(model, t)))


@register("reload_model")
def _reload_model(spark, d):
    """Save the fitted PipelineModel in the shared checkpoint folder,
    load it back and score: predictions must equal the in-memory model's."""
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    model, t = _txn_model(spark, d)
    root = os.path.join(ensure_checkpoint_dir(spark), "models", uuid.uuid4().hex)
    path = MD.save_model(model, root)
    again = MD.load_model(path)
    before = MD.score(model, t).select(*t.columns, F.col("predicted_category").alias("before"))
    both = MD.score(again, before)
    return both.select("txn_id", "before", F.col("predicted_category").alias("after"),
                       (F.col("before") == F.col("predicted_category")).alias("same"))


@register("pca_2d")
def _pca(spark, d):
    """Centred PCA to two components (signs are free)."""
    from pyspark.ml.feature import PCA, StandardScaler
    e = _embeddings(spark, d)
    c = StandardScaler(withMean=True, withStd=False, inputCol="features",
                       outputCol="centred").fit(e).transform(e)
    p = PCA(k=2, inputCol="centred", outputCol="pc").fit(c).transform(c)
    arr = vector_to_array(F.col("pc"))
    return rounded(p.select("vec_id", arr[0].alias("pc1"), arr[1].alias("pc2"), "category"))


@register("create_features")
def _create_features(spark, d):
    """F16: the compact feature vector of every statement row."""
    t = C.add_merchant(txn(spark, d))
    out, fitted = MD.create_features(t, "txn_id")
    arr = vector_to_array(F.col("features"))
    return out.select("txn_id", "category", F.size(arr).alias("n_features"),
                      F.size(F.filter(arr, lambda x: x != 0)).alias("nonzero"))


def _model_dir(spark, kind: str) -> str:
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


@register("training_run")
def _training_run(spark, d):
    """Split -> fit -> cross-validate -> evaluate -> save -> record; the row names the
    saved model, which is loaded again for its class count."""
    t = C.add_merchant(txn(spark, d))
    r = MD.run_training(t, "decision_tree", cv_folds=5, model_dir=_model_dir(spark, "training"))
    m, cv = r["metrics"], r["cv"]
    loaded = MD.load_model(r["model_path"])
    return rounded(spark.createDataFrame(
        [(r["model_type"], float(m["accuracy"]), float(m["precision"]), float(m["recall"]),
          float(m["f1"]), float(cv["accuracy_mean"]), float(cv["accuracy_2std"]),
          r["num_train"], r["num_test"], r["num_features"], len(MD.class_names(loaded)),
          r["model_path"])],
        "model_type string, accuracy double, precision double, recall double, f1 double, "
        "cv_accuracy_mean double, cv_accuracy_2std double, num_train long, num_test long, "
        "num_features long, num_classes int, model_path string"))


@register("latest_model", """SELECT 'naive_bayes' AS name, CAST(2 AS BIGINT) AS sequence,
  CAST(2 AS BIGINT) AS committed, (SELECT count(DISTINCT category) FROM ({t}SELECT category FROM txn))
  AS num_classes""".format(t=TXN_CTE))
def _latest_model(spark, d):
    """Of two saved models (and one whose save stops before its commit) the newest
    committed one, loaded."""
    from . import registry
    t, folder = txn(spark, d), _model_dir(spark, "models")
    for name in ("decision_tree", "naive_bayes"):
        MD.save_model(MD.fit_transactions(t, name), folder, name)
    MD.fit_transactions(t, "decision_tree").write().save(f"{folder}/stopped_half_way")
    models = MD.model_registry(spark, folder)
    newest = registry.latest(spark, folder).first()
    classes = len(MD.class_names(MD.load_model(newest["path"])))
    return spark.createDataFrame([(newest["name"], newest["sequence"], models.count(), classes)],
                                 "name string, sequence long, committed long, num_classes long")


@register("score_job", TXN_CTE + """SELECT txn_id, count(*) AS scored FROM txn GROUP BY txn_id""")
def _score_job(spark, d):
    """P5 as a job that was stopped after two units and run again: rows out per row in."""
    from . import scoring_job as SJ
    model, t = _txn_model(spark, d, "decision_tree")
    folder = _model_dir(spark, "score-job")
    t.repartition(8).write.parquet(f"{folder}/statement")
    files = SJ.list_files(spark, f"{folder}/statement")
    SJ.score_files(spark, model, files, f"{folder}/out", 2, stop_after=2)
    SJ.score_files(spark, model, files, f"{folder}/out", 2)
    return SJ.scored(spark, f"{folder}/out").where(F.col("predicted_category").isNotNull()).groupBy(
        "txn_id").agg(F.count(F.lit(1)).alias("scored"))


@register("top3_ranking", PRED_SQL + """, ranked AS (
  SELECT txn_id, unnest(list_reverse_sort([{s}])) AS r,
    unnest(range(1, {k} + 1)) AS rank FROM (SELECT pp.*, cn.txn_id FROM pp JOIN cn USING (txn_id)))
SELECT txn_id, CAST(rank AS INT) AS rank, [{c}][r.i + 1] AS category, round(r.p, 6) AS probability
FROM ranked WHERE rank <= 3""".format(
    s=", ".join(f"{{'p': p_{c}, 'i': {i}}}" for i, c in enumerate(CLASSES)), k=len(CLASSES),
    c=", ".join(S.q(c) for c in CLASSES)).replace(
    "(SELECT pp.*, cn.txn_id FROM pp JOIN cn USING (txn_id))", "pp"))
def _top3_ranking(spark, d):
    """P4 on a fixed array of class probabilities: ties to the higher class index."""
    ranked = MD.with_ranking(_rule_predictions(spark, d), F.col("probability"), CLASSES)
    return rounded(MD.ranking_rows(ranked))


def _component_scores(spark, d) -> DataFrame:
    """(class, label, score): component c of an embedding as the score of class c."""
    e = table(spark, d, "embeddings").where("label is not null")
    parts = F.slice("embedding", 1, 10)
    return e.select("label", F.posexplode(parts).alias("class", "score")).select(
        "class", (F.col("label") == F.col("class")).cast("int").alias("label"),
        F.col("score").cast("double").alias("score"))


_COMPONENTS_SQL = """WITH rows AS (
  SELECT CAST(i AS INT) AS class, CAST(label = i AS INT) AS y, CAST(embedding[i + 1] AS DOUBLE) AS score
  FROM embeddings, range(10) r(i) WHERE label IS NOT NULL),
g AS (SELECT class, score, sum(y) AS pos, sum(1 - y) AS neg FROM rows GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS p,
    sum(neg) OVER (PARTITION BY class) AS n FROM g
  WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""

register("roc_points", _COMPONENTS_SQL + """SELECT class, round(score, 6) AS threshold,
  round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c
UNION ALL SELECT DISTINCT class, CAST(1e9 AS DOUBLE), 0.0, 0.0 FROM c""")(
    lambda spark, d: rounded(M.roc_points(_component_scores(spark, d)).withColumn(
        "threshold", F.least("threshold", F.lit(1e9)))))

register("roc_auc_continuous", _COMPONENTS_SQL + """SELECT class, round(sum(neg * (tp - pos / 2.0))
  / (max(p) * max(n)), 6) AS auc, CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives
FROM c GROUP BY class""")(lambda spark, d: rounded(M.roc_auc(_component_scores(spark, d))))


@register("quarantine", TXN_CTE + """SELECT CASE
  WHEN txn_id % 50 = 0 THEN 'number of fields'
  WHEN txn_id % 41 = 0 THEN 'amount: not of type double'
  WHEN description IS NULL THEN 'description: missing' ELSE 'good' END AS reason, count(*) AS rows
FROM txn GROUP BY 1""")
def _quarantine(spark, d):
    """The statement as CSV lines, some of them malformed, scanned with a quarantine."""
    from ..sources.files import read_quarantined
    t, path = txn(spark, d), _model_dir(spark, "lines") + "/statement.csv"
    amount = F.when(F.col("txn_id") % 41 == 0, F.lit("12,5x")).otherwise(F.col("amount").cast("string"))
    more = F.when(F.col("txn_id") % 50 == 0, F.lit(",extra")).otherwise(F.lit(""))
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    lines = t.select(F.concat(F.col("txn_id").cast("string"), F.lit(","), quoted(F.col("description")),
                              F.lit(","), quoted(amount), F.lit(","), quoted(F.col("category")),
                              more).alias("value"))

    def headed(batches):
        yield pa.RecordBatch.from_pydict({"value": ["txn_id,description,amount,category"]})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    # each file of a folder has its header line; a task writes one file
    lines.mapInArrow(headed, "value string").write.text(path + "/whole.csv")
    good, bad = read_quarantined(spark, path + "/whole.csv", "txn_id long, description string, "
                                 "amount double, category string", ["description"])
    return good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason")).groupBy(
        "reason").agg(F.count(F.lit(1)).alias("rows"))


@register("model_info")
def _model_info(spark, d):
    model, _ = _txn_model(spark, d)
    return MD.model_info(spark, model)

"""Transaction tables derived from the shared parquet test tables.

None of the shared tables is a bank statement, so ``txn`` derives one from
``events`` with pure projections (no join, no shuffle): the description,
prefix and category are picked from small literal arrays by ``pmod`` of the
event / user id.  The same view is written as SQL (``TXN_CTE``) for the DuckDB
oracle, where it is a join against inline VALUES tables; both give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- FIXED VALUES
# Description templates of the test statement, indexed by event_id % 23.
TXN_DESCRIPTIONS = [
    "swiggy food order", "zomato food delivery", "restaurant dinner", "uber ride",
    "ola cab ride", "bus ticket", "train booking", "amazon purchase",
    "flipkart shopping order", "movie ticket booking", "netflix subscription",
    "prime video subscription", "spotify premium", "petrol pump fuel", "diesel refill",
    "electricity bill payment", "internet bill payment", "mobile recharge",
    "gaming purchase", "concert tickets", "grocery store purchase", "supermarket shopping",
    "pharmacy medicine purchase",
]
# Bank prefixes, indexed by user_id % 6.
TXN_PREFIXES = ["", "UPI/shop@bank/", "UPI-", "POS DEBIT ", "NEFT-0001-", "IMPS 12 "]
# Labels, indexed by user_id % 8.
TXN_CATEGORIES = ["food", "transport", "shopping", "groceries", "bills", "subscription",
                  "fuel", "other_expenses"]
# ------------------------------------------------------------ end FIXED VALUES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    """Element ``index`` (0-based) of a literal array: a projection, no join."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction statement ``(txn_id, date, description, amount, category)``."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    eid, uid = F.col("event_id"), F.col("user_id")
    description = F.when(F.pmod(eid, F.lit(97)) == 0, F.lit(None).cast("string")).otherwise(
        F.concat(_pick(TXN_PREFIXES, F.pmod(uid, F.lit(6))),
                 _pick(TXN_DESCRIPTIONS, F.pmod(eid, F.lit(23)))))
    sign = F.when(F.pmod(eid, F.lit(11)) == 0, F.lit(-1)).otherwise(F.lit(1))
    amount = (sign * F.round(F.col("value") * 10, 2)).cast("decimal(18,2)")
    return e.select(
        eid.alias("txn_id"),
        F.col("ts").cast("date").alias("date"),
        description.alias("description"),
        amount.alias("amount"),
        _pick(TXN_CATEGORIES, F.pmod(uid, F.lit(8))).alias("category"),
    )


def _sql_values(rows) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


# The same statement as SQL text (DuckDB dialect), for oracle queries.
TXN_CTE = (
    "WITH tpl(k, d) AS (VALUES " + _sql_values(enumerate(TXN_DESCRIPTIONS)) + "),\n"
    "pfx(k, p) AS (VALUES " + _sql_values(enumerate(TXN_PREFIXES)) + "),\n"
    "cat(k, c) AS (VALUES " + _sql_values(enumerate(TXN_CATEGORIES)) + "),\n"
    "txn AS (\n"
    "  SELECT e.event_id AS txn_id, CAST(e.ts AS DATE) AS date,\n"
    "    CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE concat(pfx.p, tpl.d) END AS description,\n"
    "    CAST(CASE WHEN e.event_id % 11 = 0 THEN -1 ELSE 1 END * round(e.value * 10, 2)"
    " AS DECIMAL(18,2)) AS amount,\n"
    "    cat.c AS category\n"
    "  FROM events e JOIN tpl ON e.event_id % 23 = tpl.k JOIN pfx ON e.user_id % 6 = pfx.k\n"
    "  JOIN cat ON e.user_id % 8 = cat.k)\n"
)

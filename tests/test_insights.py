"""Insight rules on small literal statements."""
from spendlens.operators import insights as I


def stmt(spark, rows):
    return spark.createDataFrame(rows, "category string, amount double, merchant string")


def test_spend_by_category_share_counts_uncategorised(spark):
    df = stmt(spark, [("food", 10.0, "a"), ("food", 30.0, "a"), (None, 60.0, "b"),
                      ("bills", -5.0, "c")])
    r = {x["category"]: x for x in I.spend_by_category(df).collect()}
    assert set(r) == {"food"}
    assert r["food"]["total_spent"] == 40.0 and abs(r["food"]["pct_of_total"] - 40.0) < 1e-9
    assert r["food"]["std_dev"] is not None


def test_single_row_std_is_null(spark):
    r = I.spend_by_category(stmt(spark, [("fuel", 5.0, "x")])).first()
    assert r["std_dev"] is None


def test_anomaly_needs_nine_rows(spark):
    eight = [("food", 1.0, "m")] * 7 + [("food", 1000.0, "m")]
    assert I.anomalies(stmt(spark, eight)).count() == 0
    nine = [("food", 1.0, "m")] * 8 + [("food", 1000.0, "m")]
    assert I.anomalies(stmt(spark, nine)).count() == 1


def test_summary_stats_ties_and_empty(spark):
    df = stmt(spark, [("b", 10.0, "m"), ("a", 10.0, "m"), ("a", -4.0, "m")])
    r = I.summary_stats(df).first()
    assert r["top_category"] == "a" and r["most_frequent_category"] == "a"
    assert r["total_income"] == 4.0 and r["net_savings"] == 4.0 - 20.0
    empty = I.summary_stats(stmt(spark, [("a", -1.0, "m")])).first()
    assert empty["top_category"] is None and empty["num_transactions"] == 0


def test_message_rounding_is_python_like(spark):
    # mean 2.5 -> Python formats "2" (half-even), not "3"
    df = stmt(spark, [("food", 2.0, "m"), ("food", 3.0, "m")] * 6)
    r = I.frequent_small(df, max_mean=100.0, min_total=0.0).first()
    assert "(avg ₹2)" in r["message"]


def test_all_insights_sorted_by_severity(spark):
    rows = [("subscription", 50.0, "netflix")] * 12 + [("food", 5.0, "swiggy")] * 3
    out = I.all_insights(stmt(spark, rows)).collect()
    sev = [r["severity"] for r in out]
    order = {"high": 0, "medium": 1, "low": 2}
    assert sev == sorted(sev, key=order.get)

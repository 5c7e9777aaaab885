"""Feature, TF-IDF, split and metric operators."""
import math

from pyspark.sql import functions as F

from spendlens.operators import features as FE
from spendlens.operators import metrics as M
from spendlens.operators import split as SP
from spendlens.operators import tfidf as TF


def test_text_features_null_reads_nan(spark):
    df = spark.createDataFrame([("bus ticket bus",), (None,), ("",)], "description string")
    r = FE.text_features(df).collect()
    assert (r[0]["word_count"], r[0]["char_count"]) == (3, 14)
    assert r[0]["transport_keyword_count"] == 3 and r[0]["has_transport_keyword"] == 1
    assert (r[1]["word_count"], r[1]["char_count"]) == (1, 3)
    assert (r[2]["word_count"], r[2]["avg_word_length"]) == (0, 0.0)


def test_amount_stats_and_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 50, 100, 499, 500, 999, 1000, 8000]],
                               "amount double")
    st = FE.AmountStats.fit(df)
    assert st.median == 499.5 and st.min == 0.0 and st.max == 8000.0
    bins = df.select(*[v.alias(k) for k, v in FE.fixed_bins(F.col("amount")).items()]).collect()
    assert [tuple(r) for r in bins][:3] == [(1, 0, 0, 0), (1, 0, 0, 0), (0, 1, 0, 0)]
    assert FE.minmax_scale(F.col("amount"), 5.0, 5.0) is not None


def test_tfidf_matches_formula(spark):
    df = spark.createDataFrame([(1, "apple banana"), (2, "apple"), (3, "")],
                               "doc_id long, text string")
    p = TF.TfidfParams(max_features=10, sublinear_tf=False)
    vocab, w = TF.tfidf_long(df, "doc_id", "text", p)
    v = {r["term"]: r for r in vocab.collect()}
    assert sorted(v) == ["apple", "apple banana", "banana"]
    assert abs(v["apple"]["idf"] - (math.log(4 / 3) + 1)) < 1e-12
    d1 = {r["term"]: r["weight"] for r in w.where("doc = 1").collect()}
    assert abs(sum(x * x for x in d1.values()) - 1.0) < 1e-12
    assert w.where("doc = 3").count() == 0


def test_stratified_split_exact_sizes(spark):
    df = spark.range(0, 1003).select("id", (F.col("id") % 3).cast("string").alias("category"))
    s = SP.stratified_split(df, "id", buckets=16)
    sizes = {r["category"]: r["n_test"] for r in SP.stratified_sizes(df).collect()}
    got = {r["category"]: r["t"] for r in s.groupBy("category").agg(
        F.count_if("is_test").alias("t")).collect()}
    assert got == sizes and sum(got.values()) == math.ceil(0.2 * 1003)
    assert s.count() == 1003


def test_folds_balanced(spark):
    df = spark.range(0, 100).select("id", F.lit("a").alias("category"))
    f = SP.with_folds(df, "id", k=5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in f) == [20] * 5


def test_metrics_weighted_and_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")],
                               "label string, prediction string")
    w = M.weighted_prf(df).first()
    assert w["accuracy"] == 0.5
    rep = {r["row"]: r for r in M.classification_report(df).collect()}
    assert rep["c"]["precision"] == 0.0 and rep["c"]["support"] == 1
    assert rep["b"]["precision"] == 1 / 3


def test_roc_auc_perfect_and_ties(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("x", 1, 0.8), ("x", 0, 0.1), ("y", 1, 0.5),
                                ("y", 0, 0.5)], "class string, label int, score double")
    r = {x["class"]: x["auc"] for x in M.roc_auc(df).collect()}
    assert r["x"] == 1.0 and r["y"] == 0.5


def test_exact_quantiles_match_percentile_with_ties(spark):
    from spendlens.operators.quantiles import exact_quantiles
    rows = [("a", float(v)) for v in [5] * 500 + list(range(1000))] + \
        [("b", 1.0), ("b", 2.0), ("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in
           exact_quantiles(df, "x", [0.25, 0.5, 0.75], ["g"], accuracy=100).collect()}
    want = {r["g"]: tuple(r["p"]) for r in df.groupBy("g").agg(
        F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p")).collect()}
    for g in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[g], want[g])), (g, got[g], want[g])
    glob = exact_quantiles(df, "x", [0.5]).first()["q0"]
    assert abs(glob - df.agg(F.percentile("x", F.lit(0.5))).first()[0]) < 1e-9

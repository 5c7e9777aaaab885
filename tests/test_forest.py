"""Deep forests whose trees stand in a table: splits, leaves, scoring, saving."""
import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from spendlens.plans import forest
from spendlens.plans import models as MD


def rows_of(spark, n=300, seed=3):
    r = np.random.default_rng(seed)
    label = r.integers(0, 3, n)
    x = r.normal(size=(n, 5)) + 1.5 * (label[:, None] == np.arange(5))
    return spark.createDataFrame(
        [(i, x[i].tolist(), float(label[i]), 1.0 + i % 2) for i in range(n)],
        "id long, x array<double>, label double, weight double").select(
        "id", array_to_vector("x").alias("features"), "label", "weight")


def test_deep_forests_are_not_sparks(spark):
    for registry, name in (("voting", "random_forest"), ("bakeoff", "random_forest")):
        est = MD.make_estimator(name, 10, registry=registry)
        assert isinstance(getattr(est, "estimator", est), forest.Forest)
    assert type(MD.make_estimator("random_forest", 10)) is RandomForestClassifier


@pytest.mark.parametrize("least,min_rows,depth", [(1, 0, 30), (3, 10, 30), (1, 0, 2)])
def test_each_split_is_the_best_one(least, min_rows, depth, monkeypatch):
    monkeypatch.setattr(forest, "CELLS", 500)
    r = np.random.default_rng(5)
    bins, label = r.integers(0, 8, (400, 4)).astype(np.uint8), r.integers(0, 3, 400)
    weight = r.uniform(0.5, 2, 400)
    feature, cut, left, shares, importance = forest.grow(
        bins, label, weight, 3, 8, [1, 2], depth, least, min_rows, 4)
    times = np.random.default_rng([1, 2]).poisson(1.0, 400)

    def gini(rows):
        t = np.bincount(label[rows], (times * weight)[rows], 3)
        return (t ** 2).sum() / t.sum() if t.sum() else 0.0

    def best(rows):
        found = 0.0
        for f in range(4):
            for c in range(8):
                a = bins[rows, f] <= c
                if min(times[rows[a]].sum(), times[rows[~a]].sum()) >= least:
                    found = max(found, gini(rows[a]) + gini(rows[~a]) - gini(rows))
        return found

    def check(node, rows, level):
        t = np.bincount(label[rows], (times * weight)[rows], 3)
        if feature[node] < 0:
            assert shares[left[node]] == pytest.approx(t / t.sum(), abs=1e-6)
            assert level == depth or times[rows].sum() < min_rows or best(rows) < 1e-6
            return 1
        a = bins[rows, feature[node]] <= cut[node]
        got = gini(rows[a]) + gini(rows[~a]) - gini(rows)
        assert times[rows].sum() >= min_rows and got == pytest.approx(best(rows))
        return 1 + check(left[node], rows[a], level + 1) + check(left[node] + 1, rows[~a], level + 1)

    assert check(0, np.flatnonzero(times), 0) == len(feature)
    assert importance.sum() == pytest.approx(1)


def test_forest_is_scored_in_chunks_however_rows_were_dealt(spark, monkeypatch, tmp_path):
    df = rows_of(spark)
    est = forest.Forest(numTrees=20, maxDepth=20, minInstancesPerNode=2, weightCol="weight", seed=4)
    whole = est.fit(df)

    def scores(model):
        return {r["id"]: (r["prediction"], list(r["p"]), list(r["raw"])) for r in model.transform(
            df).select("id", "prediction", vector_to_array("probability").alias("p"),
                       vector_to_array("rawPrediction").alias("raw")).collect()}

    want = scores(whole)
    for p, c, raw in ((c[1], c[0], c[2]) for c in want.values()):
        assert sum(p) == pytest.approx(1) and c == p.index(max(p)) and sum(raw) == pytest.approx(20)
    monkeypatch.setattr(forest, "CHUNK_BYTES", 1)
    assert len(whole._chunks()) == 20
    monkeypatch.setattr(forest, "PACKED_ROWS", 7)
    for other in (whole, est.fit(df.repartition(7))):
        got = scores(other)
        assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)
    whole.write().save(f"file://{tmp_path}/forest")
    again = forest.ForestModel.load(f"file://{tmp_path}/forest")
    got = scores(again)
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)
    importance = again.featureImportances.toArray()
    assert importance.sum() == pytest.approx(1) and set(importance.argsort()[-3:]) == {0, 1, 2}


def test_forest_predicts_like_sparks(spark):
    train, test = rows_of(spark, 600), rows_of(spark, 600, 8)
    shares = []
    for kind in (forest.Forest, RandomForestClassifier):
        out = kind(numTrees=40, maxDepth=20, seed=1).fit(train).transform(test)
        shares.append(out.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0])
    assert shares[0] == pytest.approx(shares[1], abs=0.05) and shares[0] > 0.7


def test_a_large_table_is_left_to_spark(spark, monkeypatch):
    monkeypatch.setattr(forest, "LOCAL_BYTES", 100)
    model = MD.make_estimator("random_forest", 300, registry="bakeoff", hyperparams={
        "numTrees": 3, "maxDepth": 4, "minRowsToSplit": 20}).fit(rows_of(spark))
    assert not isinstance(model, forest.ForestModel) and model.getNumTrees == 3

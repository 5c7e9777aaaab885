"""RBF machine, softmax boosting and tree pruning on data whose answer is known."""
import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from spendlens.plans import boosting as B
from spendlens.plans import kernel as KN
from spendlens.plans import models as MD
from spendlens.plans import pruning


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, f array<double>, label double").select(
        "id", array_to_vector("f").alias("features"), "label")


def ring(spark, n=400, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        r, a = rng.random() * 2, rng.random() * 2 * math.pi
        rows.append((i, [r * math.cos(a), r * math.sin(a)], float(r < 1)))
    return points(spark, rows)


def blocks(spark, n=400, seed=2):
    rng, rows = random.Random(seed), []
    for i in range(n):
        x, y = rng.random(), rng.random()
        rows.append((i, [x, y, rng.random()], float(int(x * 3) + (y > 0.5))))
    return points(spark, rows)


def share_right(rows):
    return sum(r["label"] == r["prediction"] for r in rows) / len(rows)


def probabilities(rows):
    p = np.array([r["p"] for r in rows])
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-9 and p.min() >= 0
    assert all(r["prediction"] == x.argmax() for r, x in zip(rows, p))
    return p


def test_kernel_machine_beats_the_linear_one_on_a_ring(spark, tmp_path):
    df = ring(spark)
    train, test = df.where("id % 4 != 0").cache(), df.where("id % 4 = 0")
    model = MD.make_estimator("svm", 300, hyperparams={"penalty": 1.0, "numFeatures": 128}).fit(train)
    model.write().save(f"file://{tmp_path}/svm")
    linear = MD.make_estimator("linear_svm", 300, hyperparams={"penalty": 1.0, "maxIter": 10}).fit(train)
    out = model.transform(test).withColumn("p", vector_to_array("probability"))
    rows = out.orderBy("id").collect()
    assert share_right(rows) > 0.95 > 0.7 > share_right(linear.transform(test).collect())
    p = probabilities(rows)
    # calibrated: rows given a high probability are right about as often
    sure = p.max(axis=1) > 0.9
    assert sure.sum() > 50 and share_right([r for r, s in zip(rows, sure) if s]) > 0.95
    again = PipelineModel.load(f"file://{tmp_path}/svm").transform(test).withColumn(
        "p", vector_to_array("probability")).orderBy("id").collect()
    assert [r["p"] for r in again] == [r["p"] for r in rows]
    train.unpersist()


def test_fourier_features_approach_the_kernel(spark):
    df = ring(spark, 40)
    model = KN.RandomFourierFeatures(numFeatures=4000, gamma=0.7).fit(df)
    rows = model.transform(df).collect()
    x, z = (np.stack([r[c].toArray() for r in rows]) for c in ("features", "kernel_features"))
    kernel = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(np.einsum("id,jd->ij", z, z) - kernel).max() < 0.12
    width = KN.RandomFourierFeatures(numFeatures=8).fit(df).getOrDefault("gamma")
    assert width == pytest.approx(1 / (2 * x.var()))


def test_sigmoids_fit_the_maximum_likelihood(spark):
    rng = random.Random(3)
    rows = []
    for k, (a, b) in enumerate([(2.0, -0.5), (0.3, 1.0)]):
        for _ in range(1500):
            m = rng.gauss(0, 2)
            rows.append((k, m, int(rng.random() < 1 / (1 + math.exp(-(a * m + b))))))
    slopes, intercepts = KN.fit_sigmoids(
        spark.createDataFrame(rows, "class int, margin double, y int").cache(), 3)
    assert slopes[0] == pytest.approx(2.0, rel=0.15) and slopes[1] == pytest.approx(0.3, rel=0.25)
    assert intercepts[0] == pytest.approx(-0.5, abs=0.2) and intercepts[1] == pytest.approx(1, abs=0.2)
    assert len(slopes) == 3  # a class without rows keeps a finite sigmoid
    assert all(map(math.isfinite, slopes + intercepts))


def test_rare_class_takes_part_in_every_fold(spark):
    rows = [(i, [float(i % 2), float(i % 3)], float(i % 2)) for i in range(30)] + [(99, [9.0, 9.0], 2.0)]
    model = KN.KernelSVM(numFeatures=16, maxIter=20).fit(points(spark, rows))
    assert len(model.transform(points(spark, rows)).first()["probability"]) == 3


# ---------------------------------------------------------------- boosting
def plain_round(x, y, weight, scores, edges, depth, least):
    """One round of softmax boosting, node by node: leaf and its value per row and class."""
    k = scores.shape[1]
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    out = np.zeros_like(scores)
    for c in range(k):
        r = (y == c) - p[:, c]

        def grow(rows, level):
            best = (1e-12, None)
            if level < depth:
                whole = (weight[rows] * r[rows]).sum() ** 2 / weight[rows].sum()
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        left = rows[x[rows, f] <= e]
                        right = rows[x[rows, f] > e]
                        if min(len(left), len(right)) < least:
                            continue
                        gain = sum((weight[s] * r[s]).sum() ** 2 / weight[s].sum()
                                   for s in (left, right)) - whole
                        if gain > best[0] + 1e-12:
                            best = (gain, (left, right))
            if best[1] is None:
                size = weight[rows] * np.abs(r[rows]) * (1 - np.abs(r[rows]))
                out[rows, c] = (k - 1) / k * (weight[rows] * r[rows]).sum() / max(size.sum(), 1e-150)
            else:
                grow(best[1][0], level + 1)
                grow(best[1][1], level + 1)

        grow(np.arange(len(x)), 0)
    return out


def test_boosting_equals_a_plain_version(spark):
    df = blocks(spark, 150)
    est = B.SoftmaxBoosting(maxIter=5, maxDepth=2, maxBins=8, checkpointInterval=2, stepSize=0.3,
                            minInstancesPerNode=5)
    model = est.fit(df)
    assert model.numTrees() == 5 * 4
    rows = model.transform(df).withColumn("p", vector_to_array("probability")).orderBy("id").collect()
    x, y = np.stack([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows])
    arrays = df.select(vector_to_array("features").alias("x"))
    edges = [e[np.isfinite(e)] for e in B.bin_edges(arrays, 8)]
    weight = np.ones(len(x))
    share = np.array([(y == c).sum() for c in range(4)]) / len(y)
    scores = np.tile(np.log(share), (len(x), 1))
    for _ in range(5):
        scores = scores + 0.3 * plain_round(x, y, weight, scores, edges, 2, 5)
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    assert np.abs(p / p.sum(axis=1, keepdims=True) - probabilities(rows)).max() < 1e-9


def test_boosting_is_as_good_as_one_against_the_rest(spark, tmp_path):
    df = blocks(spark)
    train, test = df.where("id % 4 != 0").cache(), df.where("id % 4 = 0")
    model = MD.make_estimator("gradient_boosting", 300, hyperparams={"maxIter": 15, "maxDepth": 3}).fit(train)
    other = MD.make_estimator("gbt_one_vs_rest", 300, hyperparams={"maxIter": 3, "maxDepth": 3}).fit(train)
    rows = model.transform(test).withColumn("p", vector_to_array("probability")).orderBy("id").collect()
    probabilities(rows)
    assert share_right(rows) >= share_right(other.transform(test).collect()) and share_right(rows) > 0.9
    model.write().overwrite().save(f"file://{tmp_path}/gbt")
    again = B.SoftmaxBoostingModel.load(f"file://{tmp_path}/gbt").transform(test).withColumn(
        "p", vector_to_array("probability")).orderBy("id").collect()
    assert [r["p"] for r in again] == [r["p"] for r in rows]
    train.unpersist()


def test_class_weights_move_the_boosted_probabilities(spark):
    df = blocks(spark, 200).withColumn("w", F.when(F.col("label") == 0, 20.0).otherwise(1.0))
    est = B.SoftmaxBoosting(maxIter=2)
    even = est.fit(df).transform(df).agg(F.avg(vector_to_array("probability")[0])).first()[0]
    heavy = est.setWeightCol("w").fit(df).transform(df).agg(
        F.avg(vector_to_array("probability")[0])).first()[0]
    assert heavy > even + 0.2


# ---------------------------------------------------------------- minimum split size
def saved_nodes(spark, model, path):
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        return data.select("treeID", "nodeData.*")
    return data.withColumn("treeID", F.lit(0))


@pytest.mark.parametrize("name,least", [("decision_tree", 10), ("random_forest", 5)])
def test_no_split_below_the_minimum(spark, tmp_path, name, least):
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    df = blocks(spark, 200).cache()
    est = (DecisionTreeClassifier(maxDepth=12, seed=1) if name == "decision_tree"
           else RandomForestClassifier(numTrees=8, maxDepth=12, seed=1))
    free = est.fit(df)
    model = pruning.with_min_split(free, least, spark)
    before = saved_nodes(spark, free, f"file://{tmp_path}/free")
    after = saved_nodes(spark, model, f"file://{tmp_path}/pruned")
    inner = F.col("leftChild") >= 0
    assert before.where(inner & (F.col("rawCount") < least)).count() > 0
    assert after.where(inner & (F.col("rawCount") < least)).count() == 0
    # what stays is what was there: same splits of the large nodes
    kept = lambda d: sorted(
        (r["treeID"], r["rawCount"], r["split"]["featureIndex"],
         tuple(r["split"]["leftCategoriesOrThreshold"]))
        for r in d.where(inner & (F.col("rawCount") >= least)).collect())
    assert kept(after) == kept(before)
    again = type(model).load(f"file://{tmp_path}/pruned")
    a, b = (m.transform(df).orderBy("id").select("probability").collect() for m in (model, again))
    assert a == b and len(a) == 200
    df.unpersist()


def test_bakeoff_trees_carry_the_bound(spark):
    est = MD.make_estimator("decision_tree", 100, "w", registry="bakeoff")
    assert isinstance(est, pruning.MinSplit) and est.min_rows == 10
    assert est.getMaxDepth() == 15 and est.getWeightCol() == "w"
    assert MD.make_estimator("random_forest", 100, registry="bakeoff").min_rows == 5

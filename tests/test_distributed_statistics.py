"""Quantile narrowing, prefix sums, correlation and sparse TF-IDF against plain versions."""
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from spendlens.operators import metrics as M
from spendlens.operators import profile as P
from spendlens.operators import quantiles as Q
from spendlens.operators import tfidf as TF
from spendlens.operators.prefix import prefix_sums


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def test_a_million_distinct_values_in_brackets_of_a_thousand(spark, monkeypatch):
    """Coarse sketch: the first brackets hold 40,000 values each, so narrowing has to work."""
    rounds, narrowed = [], Q._narrowed

    def seen(cells, key, bound, keep):
        out = narrowed(cells, key, bound, keep)
        sizes = out.groupBy(*key).count().agg(F.max("count")).first()[0]
        rounds.append((cells.groupBy(*key).count().agg(F.max("count")).first()[0], sizes))
        return out

    monkeypatch.setattr(Q, "_narrowed", seen)
    n = 1_000_003
    df = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("x"))
    got = Q.exact_quantiles(df, "x", [0.1, 0.5, 0.75], accuracy=100, bound=1000).first()
    for name, q in zip(("q0", "q1", "q2"), (0.1, 0.5, 0.75)):
        at = q * (n - 1)
        assert got[name] == pytest.approx(at, abs=1e-6)
    assert rounds[0][0] > 30_000 and rounds[0][1] <= 1000


@pytest.mark.parametrize("bound", [1, 3, 100])
def test_quantiles_of_uneven_groups(spark, bound):
    rng = random.Random(bound)
    groups = {"hot": [rng.choice([0.0, -0.0, 1.5, 7.0]) if rng.random() < 0.5 else rng.gauss(0, 1e6)
                      for _ in range(3000)],
              "one": [4.0], "two": [1.0, 2.0], "same": [3.0] * 900, "steps": list(range(1000))}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), (None, 8.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r for r in Q.exact_quantiles(
        df.where("g is not null"), "x", probs, ["g"], accuracy=50, bound=bound).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        for i, q in enumerate(probs):
            assert got[g][f"q{i}"] == pytest.approx(quantile(xs, q), abs=1e-9), (g, q)


def test_a_bracket_that_misses_its_rank_is_widened(spark, monkeypatch):
    old = Q._brackets
    monkeypatch.setattr(Q, "_brackets", lambda *a: old(*a).withColumn(
        "__b", F.transform("__b", lambda x, i: F.lit(5.0))))
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    assert Q.exact_quantiles(df, "x", [0.5]).first()["q0"] == 49.5


def test_no_rows_no_quantiles(spark):
    assert Q.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]).collect() == []


def test_prefix_sums_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 37 % 1001, 1 + i % 5) for i in range(2000)]
    rows = list({(g, o): (g, o, v) for g, o, v in rows}.values()) + [(None, 1, 4), (None, 2, 5)]
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(6)
    got = {(r["g"], r["o"]): (r["s"], r["s_all"]) for r in prefix_sums(
        df, "g", -F.col("o"), {"s": "v"}).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted(((o, v) for h, o, v in rows if h == g), reverse=True)
        sums = list(itertools.accumulate(v for _, v in mine))
        for (o, _), s in zip(mine, sums):
            assert got[g, o] == (s, sums[-1])


def test_roc_points_of_continuous_scores(spark):
    rng = random.Random(5)
    rows = [(c, int(rng.random() < 0.3), rng.random()) for c in "ab" for _ in range(500)]
    rows += [("a", 1, 0.5), ("a", 0, 0.5), ("pos", 1, 0.1), ("neg", 0, 0.1)]
    df = spark.createDataFrame(rows, "class string, label int, score double").repartition(7)
    points = {}
    for r in M.roc_points(df).collect():
        points.setdefault(r["class"], []).append((r["threshold"], r["fpr"], r["tpr"]))
    auc = {r["class"]: r for r in M.roc_auc(df).collect()}
    for c in "ab":
        mine = [(y, s) for k, y, s in rows if k == c]
        pos, neg = sum(y for y, _ in mine), sum(1 - y for y, _ in mine)
        for threshold, fpr, tpr in points[c]:
            assert tpr == pytest.approx(sum(y for y, s in mine if s >= threshold) / pos)
            assert fpr == pytest.approx(sum(1 - y for y, s in mine if s >= threshold) / neg)
        pairs = sum((s > t) + 0.5 * (s == t) for y, s in mine if y for z, t in mine if not z)
        assert auc[c]["auc"] == pytest.approx(pairs / (pos * neg))
        assert (auc[c]["positives"], auc[c]["negatives"]) == (pos, neg)
    assert auc["pos"]["auc"] is None and auc["neg"]["auc"] is None


def test_correlation_skips_nulls_by_pair(spark):
    rng = random.Random(4)
    rows = [tuple(None if rng.random() < 0.2 else 1e6 + rng.gauss(0, 1) * (j + 1) + (i % 7) * j
                  for j in range(4)) + (5.0, None) for i in range(300)]
    names = ["a", "b", "c.d", "e", "constant", "empty"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in P.correlation_matrix(df).collect()}
    assert len(got) == 36
    for i, j in itertools.product(range(4), range(4)):
        x = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        x = x - x.mean(axis=0)
        want = (x[:, 0] * x[:, 1]).sum() / math.sqrt((x[:, 0] ** 2).sum() * (x[:, 1] ** 2).sum())
        assert got[names[i], names[j]] == pytest.approx(want, abs=1e-9)
    assert got["a", "constant"] is None and got["empty", "a"] is None


def test_correlation_of_two_hundred_columns(spark):
    df = spark.range(50).select(*((F.pmod(F.col("id") * (i + 1), F.lit(13 + i % 5))).cast("double")
                                  .alias(f"c{i}") for i in range(200)))
    began = time.time()
    assert P.correlation_matrix(df).count() == 40_000
    assert time.time() - began < 30


def weights(spark, terms, vocabulary, sublinear):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "id long, t array<string>")
    idf = [1.0 + i / 10 for i in range(len(vocabulary))]
    return df.select("id", TF.sparse_weights(F.col("t"), vocabulary, idf, sublinear).alias("v"))


@pytest.mark.parametrize("sublinear", [False, True])
def test_sparse_weights(spark, sublinear):
    rows = [["a", "b", "a", "x"], [], None, ["x", "y"], ["c", "c", "c", "b"]]
    got = [r["v"] for r in weights(spark, rows, ["a", "b", "c"], sublinear).orderBy("id").collect()]
    for row, vector in zip(rows, got):
        tf = np.array([(row or []).count(t) for t in "abc"], float)
        tf = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) if sublinear else tf
        w = tf * [1.0, 1.1, 1.2]
        norm = math.sqrt((w * w).sum())
        assert vector.size == 3 and np.allclose(vector.toArray(), w / norm if norm else w)
        assert len(vector.indices) == (w > 0).sum()


def test_large_vocabulary_costs_no_more_than_a_small_one(spark):
    terms = [[f"t{(i * 31 + j * j) % 5000}" for j in range(30)] for i in range(2000)]
    took = {}
    for size in (100, 5000):
        out = weights(spark, terms, [f"t{i}" for i in range(size)], True).cache()
        for _ in range(3):
            began = time.time()
            out.select(F.sum(F.size(F.filter(vector_to_array("v"), lambda x: x > 0)))).collect() \
                if size == 100 else out.select("v").write.format("noop").mode("overwrite").save()
            took[size] = min(took.get(size, 9e9), time.time() - began)
            out.unpersist()
    assert took[5000] <= 2 * took[100] + 0.5

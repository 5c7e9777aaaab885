"""What makes a query's time, disk or memory grow faster than its input."""
import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spendlens.operators import tfidf as TF
from spendlens.operators.passes import summed, tree_groups
from spendlens.plans import catalog as cat
from spendlens.plans import models as MD
from statements import statement


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranking_in_long_form_does_not_repeat_the_scoring(spark, sf_dir):
    plan = optimized(cat.QUERIES["top3_ranking"](spark, sf_dir))
    assert "Filter (size(" not in plan and len(plan) < 100_000


def test_ranking_rows_are_the_ranked_classes(spark):
    df = spark.createDataFrame([(1, [0.2, 0.5, 0.2, 0.1]), (2, None)], "txn_id long, p array<double>")
    rows = MD.ranking_rows(MD.with_ranking(df, F.col("p"), ["a", "b", "c", "d"])).orderBy("rank")
    assert [tuple(r) for r in rows.collect()] == [
        (1, 1, "b", 0.5), (1, 2, "c", 0.2), (1, 3, "a", 0.2)]


class Probe(Estimator):
    """Stands for a classifier and notes what its fit is given."""

    def _fit(self, df):
        self.tasks, self.plan = df.rdd.getNumPartitions(), optimized(df)
        return SQLTransformer(statement="SELECT *, 0.0 AS prediction FROM __THIS__")


def test_fits_read_a_written_table_in_few_tasks(spark, monkeypatch):
    probe = Probe()
    monkeypatch.setattr(MD, "classifier_stages", lambda *a, **k: [probe])
    MD.fit_transactions(statement(spark, 3).repartition(50))
    assert probe.tasks <= 4 and "contains" not in probe.plan.lower()
    rows = spark.range(100).select("id", (F.col("id") % 2).cast("double").alias("label"),
                                   array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    MD.fit_predict(rows.repartition(50), rows, "decision_tree")
    assert probe.tasks <= 4
    assert MD.make_estimator("random_forest", 10).getCacheNodeIds()


def test_a_vocabulary_shuffles_terms_not_documents_terms(spark):
    p = TF.TfidfParams(4, 1, 1.0, True)
    df = spark.createDataFrame([(1, "aa bb aa cc"), (2, "aa"), (2, "aa bb"), (None, "cc aa"),
                                (None, "aa dd"), (3, None), (4, "")], "id long, text string")
    got = {r["term"]: (r["df"], r["total"]) for r in TF.term_stats(df, "id", "text", p).collect()}
    want = {r["term"]: (r["df"], r["total"]) for r in TF.term_counts(df, "id", "text", p).groupBy(
        "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).collect()}
    assert got == want and got["aa"] == (3, 6)
    plan = TF.fit_vocabulary(df.where("id in (1, 3, 4)"), "id", "text", p)._jdf.queryExecution(
        ).executedPlan().toString()
    assert "hashpartitioning(doc" not in plan


def test_one_array_of_a_pass_reaches_the_driver(spark, monkeypatch):
    rows = spark.range(0, 100, 1, 40)

    def count(batches):
        return np.array([float(sum(b.num_rows for b in batches))])

    got, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: got.append(collect(df)) or got[-1])
    for partitions in (40, 3, 1):
        table = rows.coalesce(partitions)
        assert summed(table, count, (1,), tree_groups(table)).tolist() == [100.0]
        assert len(got[-1]) == 1


def test_quarantined_lines_lie_in_as_many_files_as_tasks(spark, tmp_path, monkeypatch):
    n = 400
    t = spark.range(0, n, 1, 8).select(
        F.col("id").alias("txn_id"), F.when(F.col("id") % 7 != 0, F.lit("a, b")).alias("description"),
        F.lit(1.5).alias("amount"), F.lit("food").alias("category"))
    monkeypatch.setattr(cat, "txn", lambda *_: t)
    monkeypatch.setattr(cat, "_model_dir", lambda *_: f"file://{tmp_path}/lines")
    rows = {r["reason"]: r["rows"] for r in cat.QUERIES["quarantine"](spark, "").collect()}
    assert sum(rows.values()) == n and rows["number of fields"] == 8
    assert rows["description: missing"] == sum(
        i % 7 == 0 and i % 50 != 0 and i % 41 != 0 for i in range(n))
    assert len(list(tmp_path.rglob("whole.csv/part-*"))) == 8

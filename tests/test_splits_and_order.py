"""Rows without label, draws, order of duplicates, matrices, paths."""
import random

import pytest
from pyspark.sql import functions as F

from spendlens.operators import clean as C
from spendlens.operators import label as L
from spendlens.operators import metrics as M
from spendlens.operators import split as SP
from spendlens.sources import files as FS


def labelled_rows(spark):
    rows = [(i, None if i % 4 == 0 else f"c{i % 3}") for i in range(100)]
    return spark.createDataFrame(rows, "id long, category string")


def test_rows_without_label_are_left_out_alike(spark):
    df = labelled_rows(spark)
    sizes = SP.stratified_sizes(df).agg(F.sum("n"), F.sum("n_test")).first()
    split = SP.stratified_split(df, "id").collect()
    assert sizes[0] == len(split) == 75 and sizes[1] == sum(r["is_test"] for r in split) == 15
    assert SP.with_folds(df, "id").count() == SP.with_class_weights(df).count() == 75


@pytest.mark.parametrize("limit", [100, 0])
def test_split_sizes_hold_with_few_and_many_buckets(spark, monkeypatch, limit):
    monkeypatch.setattr(SP, "MAX_BROADCAST_CLASSES", limit)
    df = labelled_rows(spark)
    want = {r["category"]: r["n_test"] for r in SP.stratified_sizes(df, test_size=0.3).collect()}
    for buckets in (1, 7, 1 << 20):
        got = SP.stratified_split(df, "id", test_size=0.3, buckets=buckets)
        assert {r["category"]: r["t"] for r in got.groupBy("category").agg(
            F.count_if("is_test").alias("t")).collect()} == want
        again = SP.stratified_split(df.repartition(5), "id", test_size=0.3, buckets=buckets)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in again.collect()}


def test_drawn_splits_can_be_repeated_outside_spark(spark):
    import hashlib

    df = labelled_rows(spark)

    def order(i, seed):
        h = int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:8], 16)
        return h % 7, h, i

    classes = {}
    for r in df.where("category IS NOT NULL").collect():
        classes.setdefault(r["category"], []).append(r["id"])
    sizes = {r["category"]: r["n_test"] for r in SP.stratified_sizes(df).collect()}
    want = {i for c, ids in classes.items()
            for i in sorted(ids, key=lambda i: order(i, 42))[:sizes[c]]}
    got = SP.stratified_split(df, "id", buckets=7, draw=SP.md5_draw("id", 42))
    assert {r["id"] for r in got.where("is_test").collect()} == want
    folds = SP.with_folds(df, "id", k=3, draw=SP.md5_draw("id", 43)).collect()
    for c, ids in classes.items():
        own = sorted((r["id"] for r in folds if r["category"] == c),
                     key=lambda i: (order(i, 43)[1] % SP.HASH_BUCKETS, order(i, 43)[1], i))
        assert [r["fold"] for i in own for r in folds if r["id"] == i] == [
            k % 3 for k in range(len(ids))]


def test_partial_repair_draws_rows_apart(spark):
    df = spark.range(1000).select("id", F.lit("swiggy food order").alias("description"),
                                  F.lit("x").alias("merchant"), F.lit("bills").alias("category"))
    with pytest.raises(ValueError):
        L.repair_labels(df, fix_ratio=0.5)
    n = L.repair_labels(df, fix_ratio=0.75, key_col="id").where("corrected").count()
    assert 690 < n < 810


@pytest.mark.parametrize("parts", [1, 7])
def test_clean_keeps_the_first_row_of_the_file(spark, tmp_path, parts):
    rows = [("swiggy food order", 5.0, "2026-01-01", f"first{i}" if i < 3 else "later")
            for i in range(200)]
    df = spark.createDataFrame(rows, "description string, amount double, date string, note string")
    path = f"file://{tmp_path}/s{parts}"
    df.coalesce(1).write.option("parquet.block.size", 1024).parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m" if parts == 1 else "700")
    try:
        out, _ = C.clean(spark.read.parquet(path))
        assert [r["note"] for r in out.collect()] == ["first0"]
        assert not [c for c in out.columns if c.startswith("__")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    out, _ = C.clean(df.coalesce(1))
    assert [r["note"] for r in out.collect()] == ["first0"]


def test_confusion_matrix_has_all_cells(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "a"), ("c", "z")],
                                 "label string, prediction string")
    full = {(r[0], r[1]): r[2] for r in M.confusion_matrix(pred, zeros=True).collect()}
    assert len(full) == 9 and full["a", "a"] == 1 and full["c", "b"] == 0 and full["b", "a"] == 1
    wide = M.confusion_matrix(pred, wide=True).collect()
    assert [r["true_label"] for r in wide] == ["a", "b", "c"] and wide[2]["a"] == 0


def test_roc_points_follow_scores(spark):
    r = random.Random(1)
    rows = [("c", int(s > 0.4) if r.random() < 0.8 else 0, round(s, 2))
            for s in (r.random() for _ in range(200))]
    df = spark.createDataFrame(rows, "class string, label int, score double")
    points = sorted((-p["threshold"], p["fpr"], p["tpr"]) for p in M.roc_points(df).collect())
    assert points[0][1:] == (0, 0) and points[-1][1:] == (1, 1)
    area = sum((b[1] - a[1]) * (a[2] + b[2]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(M.roc_auc(df).first()["auc"])


def test_paths_on_any_file_system(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/folder")
    assert FS.validate_path(spark, f"file://{tmp_path}/folder") == "parquet"
    spark.range(3).write.csv(f"file://{tmp_path}/text.csv")
    assert FS.validate_path(spark, f"file://{tmp_path}/text.csv") == "csv"
    assert FS.validate_path(spark, str(tmp_path / "text.csv")) == "csv"
    with pytest.raises(FileNotFoundError):
        FS.validate_path(spark, f"file://{tmp_path}/none.csv")
    with pytest.raises(ValueError):
        FS.validate_path(spark, "book.xlsx")

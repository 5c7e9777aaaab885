"""Cross-validation, model registry, resumable scoring and CSV quarantine."""
import json
import os

import duckdb
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spendlens.plans import models as MD
from spendlens.plans import registry as R
from spendlens.plans import scoring_job as SJ
from spendlens.sources import files as FS
from statements import statement


def test_cross_validation_predicts_every_labelled_row_out_of_fold(spark, tmp_path):
    df = statement(spark, 3, 20)
    p = MD.cross_validation(df, "decision_tree", 4)
    rows = p.collect()
    assert sorted(r["txn_id"] for r in rows) == sorted(
        r["txn_id"] for r in df.where("category is not null").collect())
    assert {r["fold"] for r in rows} == set(range(4))
    assert {r["prediction"] for r in rows} <= {f"class{c}" for c in range(3)}
    p.write.parquet(f"file://{tmp_path}/p")
    folds = MD.fold_metrics(p).orderBy("fold").collect()
    sql = duckdb.connect().execute(f"""
      WITH a AS (SELECT fold, avg(CAST(label = prediction AS DOUBLE)) AS acc
        FROM read_parquet('{tmp_path}/p/*.parquet') GROUP BY fold)
      SELECT avg(acc), 2 * stddev_pop(acc), list(acc ORDER BY fold) FROM a""").fetchone()
    assert folds[0]["accuracy_mean"] == pytest.approx(sql[0])
    assert folds[0]["accuracy_2std"] == pytest.approx(sql[1])
    assert [r["accuracy"] for r in folds] == pytest.approx(sql[2])
    summary = MD.cross_validate(df, "decision_tree", 4)
    assert summary["accuracy_mean"] == pytest.approx(sql[0])
    assert len(summary["fold_accuracies"]) == 4


def test_naive_bayes_scores_rows_below_the_training_minimum(spark):
    train = statement(spark, 3, 10)
    test = train.withColumn("amount", F.col("amount") * 1000 - 1e6)
    model = MD.fit_transactions(train, "naive_bayes")
    assert all(r["predicted_category"] for r in MD.score(model, test).collect())
    vectors = lambda xs: spark.createDataFrame([([x, x + 1.0],) for x in xs], "f array<double>").select(
        array_to_vector("f").alias("features"))
    for scale in (0.001, 1.0, 1000.0):
        _, out = MD.nonnegative(vectors([0.0, scale]), vectors([-5 * scale, 9 * scale, 0.5 * scale]))
        got = [tuple(r["features"].toArray()) for r in out.collect()]
        assert got[0] == (0.0, 0.0) and got[1][0] == pytest.approx(9.0) and len(got) == 3


def test_registry_lists_only_committed_models(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/models"
    assert MD.model_registry(spark, folder).collect() == []
    assert R.latest(spark, folder).collect() == []
    model = MD.fit_transactions(statement(spark, 2), "decision_tree")
    first = MD.save_model(model, folder, "m", {"accuracy": 0.5})
    second = MD.save_model(model, folder, "m")
    # a save that dies before its commit
    monkeypatch.setattr(R, "write_once", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        MD.save_model(model, folder, "m")
    monkeypatch.undo()
    rows = MD.model_registry(spark, folder).orderBy("sequence").collect()
    assert [(r["sequence"], r["path"]) for r in rows] == [(1, first), (2, second)]
    assert json.loads(rows[0]["metadata"])["accuracy"] == 0.5
    assert R.latest(spark, folder).first()["path"] == second
    assert MD.load_model(second).stages
    # two savers that drew the same number: both entries stand, in a fixed order
    text = json.dumps({"sequence": 2, "path": "zz", "saved_at": "x", "name": "m", "metadata": "{}"})
    R.write_once(spark, f"{folder}/registry", "000000000002-other.json", text)
    assert MD.model_registry(spark, folder).count() == 3
    assert R.latest(spark, folder).first()["path"] == "zz"
    # a hidden, half-written entry is not read
    with open(tmp_path / "models" / "registry" / ".half.json", "w") as f:
        f.write('{"sequence": 9')
    assert R.latest(spark, folder).first()["path"] == "zz"


def test_stopped_scoring_goes_on_without_losing_or_repeating_rows(spark, tmp_path):
    df = statement(spark, 3, 20)
    model = MD.fit_transactions(df, "decision_tree")
    df.repartition(6).write.parquet(f"file://{tmp_path}/in")
    files = SJ.list_files(spark, f"file://{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        SJ.scored(spark, out)
    assert SJ.score_files(spark, model, files, out, 2, stop_after=1) == 1
    part = SJ.scored(spark, out).count()
    assert 0 < part < df.count()
    # a unit that was written but not committed is written over
    waiting = [n for n in SJ.units(files, 2) if not os.path.exists(f"{tmp_path}/out/commits/{n}.json")]
    df.limit(3).write.parquet(f"{out}/units/{waiting[0]}")
    assert SJ.scored(spark, out).count() == part
    assert SJ.score_files(spark, model, files, out, 2) == len(waiting)
    assert SJ.score_files(spark, model, files, out, 2) == 0
    rows = SJ.scored(spark, out)
    assert rows.count() == df.count() == rows.select("txn_id").distinct().count()
    assert rows.where("predicted_category is null or confidence is null").count() == 0


SCHEMA = "description string, amount double, category string, day date"


def test_quarantine_keeps_every_line(spark, tmp_path):
    lines = ["a,1.5,x,2024-01-01", "b,oops,x,2024-01-01", "c,2,x", "d,3,x,2024-01-01,more",
             "NA,4,x,2024-01-02", "e,NA,null,", '"f,g",5,y,2024-13-45', "NA", "h, 7 ,z,2024-02-03"]
    path = tmp_path / "s.csv"
    path.write_text("description,amount,category,day\n" + "\n".join(lines) + "\n")
    good, bad = FS.read_quarantined(spark, f"file://{path}", SCHEMA, ["description"])
    assert good.columns == ["description", "amount", "category", "day"]
    assert good.count() + bad.count() == len(lines)
    assert sorted((r["description"], r["amount"]) for r in good.collect()
                  if r["amount"] is not None) == [("a", 1.5), ("h", 7.0)]
    assert {r["record"]: r["reason"] for r in bad.collect()} == {
        '{"description":"b","amount":"oops","category":"x","day":"2024-01-01"}':
            "amount: not of type double",
        "c,2,x": "number of fields", "d,3,x,2024-01-01,more": "number of fields",
        "NA": "number of fields",
        '{"amount":"4","category":"x","day":"2024-01-02"}': "description: missing",
        '{"description":"f,g","amount":"5","category":"y","day":"2024-13-45"}':
            "day: not of type date"}
    # a projection of one column parses whole lines all the same
    assert bad.select("reason").where("reason = 'number of fields'").count() == 3
    with pytest.raises(ValueError):
        spark.range(1).write.parquet(f"file://{tmp_path}/p.parquet")
        FS.read_quarantined(spark, f"file://{tmp_path}/p.parquet", SCHEMA)

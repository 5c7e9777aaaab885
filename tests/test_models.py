"""Model invariants: one row out per row in, probabilities, reload equality."""
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from spendlens.plans import catalog as cat
from spendlens.plans import models as MD
from statements import statement


def test_score_keeps_every_row_and_top3(spark, sf_dir):
    model, t = cat._txn_model(spark, sf_dir)
    s = MD.score(model, t)
    assert s.count() == t.count()
    r = s.select("confidence", "top_3", vector_to_array("probability").alias("p")).first()
    assert abs(sum(r["p"]) - 1.0) < 1e-6
    assert len(r["top_3"]) == 3 and r["top_3"][0]["probability"] == r["confidence"]


NAMES = ["random_forest", "logistic_regression", "gradient_boosting", "naive_bayes", "svm",
         "decision_tree", "ensemble"]

@pytest.mark.parametrize("name,classes", [
    ("random_forest", 2), ("random_forest", 5), ("random_forest", 8), ("logistic_regression", 2),
    ("logistic_regression", 5), ("naive_bayes", 2), ("naive_bayes", 5), ("decision_tree", 2),
    ("decision_tree", 5), ("ensemble", 2), ("ensemble", 5), ("svm", 3), ("gradient_boosting", 2)])
def test_models_fit_save_load_and_score(spark, tmp_path, monkeypatch, name, classes):
    small = {"random_forest": {"numTrees": 5, "maxDepth": 4}, "gradient_boosting": {"maxIter": 2},
             "svm": {"maxIter": 5, "numFeatures": 32}, "logistic_regression": {"maxIter": 20}}
    monkeypatch.setattr(MD.K, "VOTING_PARAMS", {
        "logistic_regression": {"maxIter": 20}, "random_forest": {"numTrees": 5}})
    monkeypatch.setitem(MD.REGISTRIES, "voting", MD.K.VOTING_PARAMS)
    df = statement(spark, classes)
    model = MD.fit_transactions(df, name, hyperparams=small.get(name))
    assert MD.class_names(model) == [f"class{c}" for c in range(classes)]
    path = MD.save_model(model, f"file://{tmp_path}")
    assert path != MD.save_model(model, f"file://{tmp_path}")
    for m in (model, MD.load_model(path)):
        rows = MD.score(m, df.drop("category")).collect()
        assert len(rows) == 12 * classes
        for r in rows:
            assert r["predicted_category"] in MD.class_names(model)
            p = [t["probability"] for t in r["top_3"]]
            assert len(p) == min(3, classes) and p == sorted(p, reverse=True)
            assert r["confidence"] == p[0] and 0 < p[0] <= 1
    assert MD.score(model, df.drop("amount", "category")).count() == 12 * classes
    assert MD.score(model, df.drop("description")).where("predicted_category is null").count() == 0


def test_registries_are_kept_apart():
    rf = MD.make_estimator("random_forest", 100, "w", registry="bakeoff")
    assert (rf.getNumTrees(), rf.getMaxDepth(), rf.getMinInstancesPerNode(), rf.getWeightCol()) == (
        300, 20, 2, "w")
    single = MD.make_estimator("random_forest", 100)
    assert (single.getNumTrees(), single.getMaxDepth()) == (100, 10)
    lr = MD.make_estimator("logistic_regression", 200, "w", registry="bakeoff")
    assert lr.getMaxIter() == 2000 and lr.getRegParam() == pytest.approx(1 / 200)
    assert MD.make_estimator("svm", 100, registry="bakeoff").getRegParam() == \
        pytest.approx(2 / 100)
    # Given parameters replace the set's, they are not merged into it.
    assert MD.make_estimator("random_forest", 100, hyperparams={"maxDepth": 3}).getNumTrees() == 20


def test_training_run_is_saved_with_its_metrics(spark, tmp_path):
    df = statement(spark, 3, 20)
    run = MD.run_training(df, "decision_tree", cv_folds=2, model_dir=f"file://{tmp_path}")
    assert run["num_train"] + run["num_test"] == df.where("category is not null").count()
    saved = MD.model_registry(spark, f"file://{tmp_path}")
    assert M_latest(saved).first()["path"] == run["model_path"]
    meta = spark.read.json(f"file://{tmp_path}/*_metadata").first()
    assert meta["metrics"]["accuracy"] == run["metrics"]["accuracy"] and "accuracy_mean" in meta["cv"]
    top = MD.feature_importance(run["model"], spark, 5)
    assert top.count() == 5
    linear = MD.fit_transactions(df, "logistic_regression", hyperparams={"maxIter": 10})
    assert MD.feature_importance(linear, spark).first()["importance"] > 0
    out = MD.score_file(run["model"], df, f"file://{tmp_path}/scored")
    assert spark.read.parquet(out).count() == df.count()


def test_unknown_model_raises():
    with pytest.raises(ValueError):
        MD.make_estimator("nope", 10)


def test_reload_equality(spark, sf_dir):
    out = cat.QUERIES["reload_model"](spark, sf_dir)
    assert out.where(~F.col("same")).count() == 0


def test_latest_model_registry(spark):
    reg = spark.createDataFrame([("m/a", "20260101_000000"), ("m/b", "20260301_000000"),
                                 ("m/c", "20260201_000000")], "path string, saved_at string")
    r = M_latest(reg).first()
    assert r["path"] == "m/b"
    empty = M_latest(reg.where("false")).first()
    assert empty["path"] is None


def M_latest(df):
    from spendlens.operators.metrics import latest_model
    return latest_model(df)


def test_tfidf_stage_equals_the_grouped_weights(spark, tmp_path):
    from spendlens.operators import tfidf as TF
    from spendlens.plans.stages import TfidfModel, TfidfVectorizer
    rows = [(0, "food order food"), (1, "bus ticket order"), (2, None), (3, ""), (4, "rent"),
            (5, "food food food bus order order")]
    df = spark.createDataFrame(rows, "id long, description string")
    fitted = TfidfVectorizer(maxFeatures=5).fit(df)
    fitted.write().save(f"file://{tmp_path}/tfidf")
    vocab, long = TF.tfidf_long(df, "id", "description", TF.TfidfParams(5, 1, 1.0, True))
    want = {(r["doc"], r["index"]): r["weight"] for r in long.collect()}
    for model in (fitted, TfidfModel.load(f"file://{tmp_path}/tfidf")):
        assert model.vocabulary() == [r["term"] for r in vocab.orderBy("index").collect()]
        got = {(r["id"], i): x for r in model.transform(df).collect()
               for i, x in enumerate(r["tfidf"].toArray()) if x}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in got)
    text = MD.fit_transactions(statement(spark, 3), "decision_tree", text_terms=6)
    assert len([n for n in MD.feature_names(text) if n.startswith("text_tfidf:")]) == 6
    assert MD.score(text, statement(spark, 3).drop("category")).count() == 36

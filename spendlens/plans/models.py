"""Classifier registry, training runs, model comparison, persistence and scoring.

Fits are distributed ``pyspark.ml`` estimators (tree aggregates, L-BFGS);
nothing is collected to the driver except fitted model parameters.

Rows without a label take no part in any fit (they are filtered first, see
``operators.split``) and are scored like all others.  The label index is only
used while fitting: a fitted pipeline ends with the stage that names classes, so
scoring needs neither labels nor a label column.

Where Spark has no estimator, the library has its own: ``kernel`` (RBF SVM with
probabilities), ``boosting`` (multiclass, with probabilities), ``pruning`` (minimum
rows of a split).  ``linear_svm`` and ``gbt_one_vs_rest`` are Spark's, for callers that
name them with their parameters.  Departure (see README): the voting forest has no
depth limit in the original, Spark's largest is 30.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import IndexToString, MinMaxScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import metrics as M
from ..operators import split as SP
from ..scratch import Scratch, kept
from .boosting import SoftmaxBoosting
from .forest import Forest
from .kernel import KernelSVM
from .pruning import MinSplit
from .registry import load_model, model_registry, save_model  # noqa: F401
from .stages import (MeanProbability, NonNegative, TfidfModel, TfidfVectorizer,
                     TransactionFeatures)

SEED = 42
# least rows of a task of a fit (see ``fit_table``)
ROWS_PER_TASK = 10_000
# one-vs-rest fits its binary models as concurrent jobs
OVR_PARALLELISM = 8

_CLASSIFIERS = {
    "random_forest": RandomForestClassifier, "decision_tree": DecisionTreeClassifier,
    "logistic_regression": LogisticRegression, "naive_bayes": NaiveBayes,
    "gradient_boosting": SoftmaxBoosting, "svm": KernelSVM,
    "gbt_one_vs_rest": GBTClassifier, "linear_svm": LinearSVC,
}
_ONE_VS_REST = ("gbt_one_vs_rest", "linear_svm")
REGISTRIES = {"single": K.SINGLE_MODEL_PARAMS, "bakeoff": K.BAKEOFF_PARAMS,
              "voting": K.VOTING_PARAMS}
SINGLE, BAKEOFF = K.SINGLE_MODEL_PARAMS, K.BAKEOFF_PARAMS


def make_estimator(name: str, n_rows: int, weight_col: str | None = None,
                   hyperparams: dict | None = None, registry: str = "single"):
    """Estimator ``name`` with the parameters of ``registry``, or with
    ``hyperparams`` instead of them.  ``penalty`` is the inverse strength C of an
    L2 penalty on summed losses; Spark averages losses, hence 1 / (C * n)."""
    known = REGISTRIES[registry]
    if name not in known and (hyperparams is None or name not in _CLASSIFIERS):
        raise ValueError(f"no model {name!r} in the {registry} set: {sorted(known)}")
    params = dict(known[name] if hyperparams is None else hyperparams)
    if "penalty" in params:
        params["regParam"] = 1.0 / (params.pop("penalty") * max(n_rows, 1))
    if name in ("random_forest", "decision_tree", "gradient_boosting", "gbt_one_vs_rest"):
        params.setdefault("seed", SEED)
    if name in ("random_forest", "decision_tree"):
        # a level's pass looks a row's node up instead of walking all trees from the root
        params.setdefault("cacheNodeIds", True)
    min_split = params.pop("minRowsToSplit", 0)
    # the deep forests of the other sets outgrow the driver in Spark's form
    deep = name == "random_forest" and registry != "single"
    est = (Forest if deep else _CLASSIFIERS[name])(**params)
    if min_split:
        est = MinSplit(est, min_split)
    if name in _ONE_VS_REST:
        est = OneVsRest(classifier=est, parallelism=OVR_PARALLELISM)
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def _column(est, name: str):
    """Send a member's output columns of a vote to names of their own."""
    return est.setProbabilityCol(f"{name}_probability").setPredictionCol(
        f"{name}_prediction").setRawPredictionCol(f"{name}_raw")


def classifier_stages(name: str, n_rows: int, weight_col: str | None, label: str, features: str,
                      hyperparams: dict | None = None, registry: str = "single") -> list:
    """Stages that turn ``features`` into ``prediction`` (and ``probability``);
    ``ensemble`` (M9) is the mean of its members' probabilities."""
    if name != "ensemble":
        est = make_estimator(name, n_rows, weight_col, hyperparams, registry)
        return [est.setLabelCol(label).setFeaturesCol(features)]
    members = [_column(make_estimator(m, n_rows, weight_col, registry="voting"), m)
               .setLabelCol(label).setFeaturesCol(features) for m in K.VOTING_PARAMS]
    return [*members, MeanProbability(inputCols=[m.getProbabilityCol() for m in members])]


def nonnegative(train: DataFrame, *others: DataFrame, features: str = "features") -> list:
    """M6: min-max scaled features, fitted on ``train``; entries of rows that lie
    below the training minimum become 0, as naive Bayes takes no negative input."""
    scale = Pipeline(stages=[MinMaxScaler(inputCol=features, outputCol="__scaled"),
                             NonNegative(inputCol="__scaled", outputCol="__clipped")]).fit(train)
    return [scale.transform(x).drop(features, "__scaled").withColumnRenamed("__clipped", features)
            for x in (train, *others)]


def fit_table(df: DataFrame, keep) -> tuple[DataFrame, int]:
    """``df`` written once, and its rows: the passes of a fit read a narrow table in as many
    tasks as its size asks for, however the rows came to be dealt.  A table of few files
    is dealt again for the cores there are, with no more tasks than rows to fill them."""
    table = keep(df)
    n = table.count()
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, 1 + n // ROWS_PER_TASK)
    if table.rdd.getNumPartitions() < tasks:
        table = keep(table.repartition(tasks))
    return table, n


def fit_predict(train: DataFrame, test: DataFrame, name: str, label: str = "label",
                features: str = "features", weight_col: str | None = None,
                n_rows: int | None = None, registry: str = "single") -> DataFrame:
    """Fit ``name`` on the labelled rows of ``train`` and predict ``test`` (adds
    ``prediction``)."""
    columns = [label, features, *([weight_col] if weight_col else [])]
    with Scratch(train.sparkSession) as keep:
        train, n_train = fit_table(train.where(F.col(label).isNotNull()).select(*columns), keep)
        stages = classifier_stages(name, n_train if n_rows is None else n_rows, weight_col, label,
                                   features, registry=registry)
        fitted = Pipeline(stages=stages).fit(train)
    out = fitted.transform(test)
    return out.drop(*(c for c in out.columns if c.endswith(("_prediction", "_raw", "_probability"))
                      and c not in test.columns))


# ------------------------------------------------------------------ transactions
def fit_transactions(train: DataFrame, model: str = "random_forest", n_rows: int | None = None,
                     top_merchants: int = 0, hyperparams: dict | None = None,
                     weight_col: str | None = None, registry: str = "single",
                     text_terms: int = 0) -> PipelineModel:
    """F17 features (with ``text_terms`` also the tf-idf block) -> vector -> classifier -> class name, fitted on the rows of
    ``train`` that have a category.  One PipelineModel: saved and loaded as a unit
    (P1: scoring always sees the training feature layout).

    The rows and then their vectors are written once, so that no pass computes the
    features again."""
    with Scratch(train.sparkSession) as keep:
        train, n_train = fit_table(train.where(F.col("category").isNotNull()), keep)
        n = n_rows if n_rows is not None else n_train
        features, source, index = feature_stages(train, model, top_merchants, text_terms, keep)
        assembled = index.transform(train)
        for stage in features:
            assembled = stage.transform(assembled)
        assembled = keep(assembled.select("label", source, *([weight_col] if weight_col else [])))
        stages = classifier_stages(model, n, weight_col, "label", source, hyperparams, registry)
        fitted = Pipeline(stages=stages).fit(assembled)
    names = IndexToString(inputCol="prediction", outputCol="predicted_category",
                          labels=list(index.labels))
    return PipelineModel(stages=[*features, *fitted.stages, names])


def feature_stages(train: DataFrame, model: str, top_merchants: int = 0, text_terms: int = 0,
                   keep=lambda df: df):
    """(fitted stages from a statement row to the classifier's vector, the vector's
    column, the fitted label index).  ``keep`` writes the vectors that a stage is fitted on."""
    stages = [TransactionFeatures(topMerchants=top_merchants).fit(train)]
    inputs = stages[0].feature_names()
    if text_terms:
        stages.append(TfidfVectorizer(maxFeatures=text_terms, outputCol="text_tfidf").fit(train))
        inputs = [*inputs, "text_tfidf"]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw_features", handleInvalid="error"))
    index = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc",
                          handleInvalid="error").fit(train)
    if model != "naive_bayes":
        return stages, "raw_features", index
    # Naive Bayes counts: its inputs must not be negative (F10 instead of F9).
    assembled = train
    for stage in stages:
        assembled = stage.transform(assembled)
    assembled = keep(assembled.select("raw_features"))
    stages += [MinMaxScaler(inputCol="raw_features", outputCol="scaled_features").fit(assembled),
               NonNegative(inputCol="scaled_features", outputCol="features")]
    return stages, "features", index


def class_names(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the vector's entries; a tf-idf entry is named by its term."""
    vector = next(s for s in model.stages if isinstance(s, VectorAssembler))
    terms = {s.getOrDefault("outputCol"): s.vocabulary() for s in model.stages
             if isinstance(s, TfidfModel)}
    return [n for c in vector.getInputCols()
            for n in ([f"{c}:{t}" for t in terms[c]] if c in terms else [c])]


def classifier(model: PipelineModel):
    """The fitted classifier (of a vote its last stage, the mean)."""
    return model.stages[-2]


def score(model: PipelineModel, df: DataFrame, top_k: int = 3) -> DataFrame:
    """One output row per input row with ``predicted_category``,
    ``confidence`` (max probability, NULL without probabilities) and
    ``top_3`` (class, probability) by probability desc, ties: higher index."""
    out = model.transform(df)
    if "probability" not in out.columns:
        return out.withColumns({"confidence": F.lit(None).cast("double"),
                                "top_3": F.array(F.struct(
                                    F.col("predicted_category").alias("category"),
                                    F.lit(None).cast("double").alias("probability")))})
    return with_ranking(out, vector_to_array("probability"), class_names(model), top_k)


def with_ranking(df: DataFrame, probabilities: F.Column, names: list[str],
                 top_k: int = 3) -> DataFrame:
    """``confidence`` and ``top_3`` from an array of class probabilities."""
    labels = F.array(*[F.lit(c) for c in names])
    ranked = F.sort_array(F.transform(probabilities, lambda x, i: F.struct(
        x.alias("probability"), i.alias("index"))), asc=False)
    top = F.transform(F.slice(ranked, 1, min(top_k, len(names))), lambda s: F.struct(
        F.element_at(labels, s["index"] + 1).alias("category"),
        s["probability"].alias("probability")))
    return df.withColumns({"confidence": F.array_max(probabilities), "top_3": top})


def ranking_rows(df: DataFrame, id_col: str = "txn_id") -> DataFrame:
    """P4 in long form: (id, rank from 1, category, probability), a row per class of ``top_3``."""
    # posexplode_outer, not posexplode: for posexplode the optimizer infers a size > 0
    # filter and pushes it below the projections, so that the whole scoring (of a model,
    # its features too) would run again for every use inside the filter.
    long = df.select(id_col, F.posexplode_outer("top_3").alias("pos", "t"))
    return long.where(F.col("pos").isNotNull()).select(
        id_col, (F.col("pos") + 1).alias("rank"), F.col("t.category").alias("category"),
        F.col("t.probability").alias("probability"))


def score_file(model: PipelineModel, df: DataFrame, path: str, top_k: int = 3) -> str:
    """P5: score a statement and write ids, classes, confidence and ranking."""
    out = score(model, df, top_k)
    keep = [c for c in df.columns] + ["predicted_category", "confidence", "top_3"]
    out.select(*keep).write.parquet(path)
    return path


# ------------------------------------------------------------------ runs
def run_training(df: DataFrame, model: str = "random_forest", test_size: float = 0.2,
                 id_col: str = "txn_id", hyperparams: dict | None = None,
                 cv_folds: int = 0, model_dir: str | None = None) -> dict:
    """Split -> fit -> (CV) -> evaluate -> (save with metadata) -> record."""
    with Scratch(df.sparkSession) as keep:
        split = keep(SP.stratified_split(df, id_col, "category", test_size))
        train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
        n_train = train.count()
        fitted = fit_transactions(train, model, n_train, hyperparams=hyperparams)
        pred = fitted.transform(test).select(F.col("category").alias("label"),
                                             F.col("predicted_category").alias("prediction"))
        metrics = M.weighted_prf(pred).first().asDict()
        rec = {"model_type": model, "metrics": metrics, "num_train": n_train,
               "num_test": test.count(), "num_features": len(feature_names(fitted)),
               "classes": class_names(fitted)}
        if cv_folds:
            rec["cv"] = cross_validate(train.drop("is_test"), model, cv_folds, id_col, hyperparams)
    if model_dir:
        rec["model_path"] = save_model(fitted, model_dir, metadata=rec)
    return {"model": fitted, **rec}


def cross_validation(df: DataFrame, model: str, k: int = 5, id_col: str = "txn_id",
                     hyperparams: dict | None = None, registry: str = "single") -> DataFrame:
    """Out-of-fold predictions (id, fold, label, prediction) of every labelled row.

    The features of all rows are fitted and written once, as in the original, with a
    stratified fold per row; the folds' classifiers are then fitted side by side,
    each on the other folds' rows, and predict their own fold."""
    spark, rows = df.sparkSession, SP.labelled(df)
    with Scratch(spark) as keep:
        stages, source, index = feature_stages(rows, model, keep=keep)
        table = index.transform(SP.with_folds(rows, id_col, "category", k))
        for stage in stages:
            table = stage.transform(table)
        table, n = fit_table(table.select(id_col, "fold", "category", "label",
                                          F.col(source).alias("features")), keep)

        def fold(f: int) -> DataFrame:
            fitted = Pipeline(stages=classifier_stages(
                model, n * (k - 1) // k, None, "label", "features", hyperparams, registry)).fit(
                table.where(F.col("fold") != f))
            return keep(fitted.transform(table.where(F.col("fold") == f)).select(
                id_col, "fold", "category", "prediction"))

        with ThreadPool(k) as pool:
            parts = pool.map(inheritable_thread_target(spark)(fold), range(k), chunksize=1)
        long = parts[0]
        for p in parts[1:]:
            long = long.unionByName(p)
        names = F.array(*map(F.lit, index.labels))
        return kept(long.select(id_col, "fold", F.col("category").alias("label"), F.element_at(
            names, F.col("prediction").cast("int") + 1).alias("prediction")))


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """M14, M15 of each fold (one grouping by fold, label and prediction), and beside them
    the mean and twice the spread (population) of the folds' accuracies."""
    folds = M.prf_by(predictions, ("fold",))
    every = Window.partitionBy(F.lit(1))  # a row per fold
    return folds.withColumns({"accuracy_mean": F.avg("accuracy").over(every),
                              "accuracy_2std": 2 * F.stddev_pop("accuracy").over(every)})


def cross_validate(df: DataFrame, model: str, k: int = 5, id_col: str = "txn_id",
                   hyperparams: dict | None = None) -> dict:
    """Accuracy mean and 2 x std over the folds, and the folds' accuracies."""
    rows = fold_metrics(cross_validation(df, model, k, id_col, hyperparams)).orderBy("fold").collect()
    return {"accuracy_mean": rows[0]["accuracy_mean"], "accuracy_2std": rows[0]["accuracy_2std"],
            "fold_accuracies": [r["accuracy"] for r in rows]}


# ------------------------------------------------------------------ F16
def create_features(df: DataFrame, id_col: str = "txn_id", text_column: str = "description",
                    max_features: int = 100, use_amount: bool = True, top_merchants: int = 15):
    """F16: sublinear word 1-2-gram TF-IDF of the text (description, else
    merchant) || min-max amount, log amount, four fixed amount bins || top
    merchant one-hots, assembled into ``features``.  Returns (frame, fitted)
    where ``fitted`` holds the tf-idf stage and the amount / merchant fit."""
    from ..operators import features as FE
    text = text_column if text_column in df.columns else (
        "merchant" if "merchant" in df.columns else None)
    if text is None:
        raise ValueError("F16 needs a description or merchant column")
    tfidf = TfidfVectorizer(textCol=text, maxFeatures=max_features).fit(df)
    out = tfidf.transform(df)
    cols = ["tfidf"]
    fitted = {"tfidf": tfidf}
    if use_amount and "amount" in df.columns:
        filled = df.select(F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"))
        st = FE.AmountStats.fit(filled)
        out = FE.compact_amount_features(out, st)
        cols += ["amount_scaled", "log_amount", "amt_small", "amt_medium", "amt_large", "amt_xl"]
        fitted["amount"] = st
    if "merchant" in df.columns and top_merchants:
        ms = [r[0] for r in FE.top_values(df, "merchant", top_merchants).collect()]
        out = out.withColumns(FE.merchant_onehot(F.col("merchant"), ms))
        cols += [f"merchant_{m}" for m in ms]
        fitted["merchants"] = ms
    out = VectorAssembler(inputCols=cols, outputCol="features").transform(out)
    fitted["feature_names"] = cols
    return out, fitted


def feature_importance(model: PipelineModel, spark: SparkSession, top: int = 20) -> DataFrame:
    """The features of largest importance: of a tree model its importances,
    of a linear one the mean absolute coefficient over the classes."""
    clf = classifier(model)
    if hasattr(clf, "featureImportances"):
        values = clf.featureImportances.toArray()
    elif hasattr(clf, "coefficientMatrix"):
        values = abs(clf.coefficientMatrix.toArray()).mean(axis=0)
    else:
        raise ValueError(f"{type(clf).__name__} has neither importances nor coefficients")
    rows = [(n, float(x)) for n, x in zip(feature_names(model), values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(top)


def model_info(spark: SparkSession, model: PipelineModel, model_path: str | None = None) -> DataFrame:
    """One-row description of a fitted transaction pipeline."""
    names = class_names(model)
    return spark.createDataFrame(
        [(type(classifier(model)).__name__, len(names), ",".join(names),
          len(feature_names(model)), model_path)],
        "model_type string, num_classes int, class_names string, num_features int, "
        "model_path string")

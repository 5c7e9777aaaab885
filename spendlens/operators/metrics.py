"""Classification metrics over a predictions DataFrame ``(label, prediction)``.

Everything is one ``groupBy(label, prediction)`` (partial aggregation; the
output has at most K^2 rows for K classes) followed by work on that small
table, so the metric cost is one pass over the predictions however large.
Zero division counts as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import prefix_sums


def pair_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def per_class(pred: DataFrame, label: str = "label", prediction: str = "prediction",
              by: tuple[str, ...] = ()) -> DataFrame:
    """Per class of label U prediction (and group of ``by``): tp, support, predicted, precision, recall, f1.

    One linear plan: every (label, prediction, n) cell becomes a label-side row
    (support, tp) and a prediction-side row (predicted), summed by class; the
    predictions are read once (no self-join, nothing to recompute)."""
    pc = pred.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), hit.alias("tp"),
                 F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted")))
    t = (pc.select(*by, F.explode(sides).alias("s")).select(*by, "s.*").groupBy(*by, "class")
         .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    t = t.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
        .otherwise(F.lit(0.0))
    return t.withColumn("f1", f1)


def weighted_prf(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Support-weighted precision, recall, F1 (and accuracy) in one row."""
    return prf_by(pred, (), label, prediction)


def prf_by(pred: DataFrame, by: tuple[str, ...], label: str = "label",
           prediction: str = "prediction") -> DataFrame:
    """M15 for each group of ``by`` (a fold, a model), from one grouping of the rows by
    group, label and prediction."""
    t = per_class(pred, label, prediction, by)
    tot = F.sum("support")
    return t.groupBy(*by).agg(*[(F.sum(F.col(m) * F.col("support")) / tot).alias(m)
                   for m in ("precision", "recall", "f1")],
                 (F.sum("tp") / tot).alias("accuracy"))


def classification_report(pred: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per class rows plus ``accuracy``, ``macro avg``, ``weighted avg``.
    The summary figures are windows over the per-class table (K rows) and the
    first class row also emits the three summary rows: one read of the input."""
    t = per_class(pred, label, prediction)
    every = Window.partitionBy(F.lit(1))
    tot = F.sum("support").over(every)
    t = t.withColumns({
        "__tot": tot, "__acc": F.sum("tp").over(every) / tot,
        "__mp": F.avg("precision").over(every), "__mr": F.avg("recall").over(every),
        "__mf": F.avg("f1").over(every),
        "__wp": F.sum(F.col("precision") * F.col("support")).over(every) / tot,
        "__wr": F.sum(F.col("recall") * F.col("support")).over(every) / tot,
        "__wf": F.sum(F.col("f1") * F.col("support")).over(every) / tot,
        "__first": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("class")) == 1})

    def row(name, p, r, f, n):
        return F.struct(name.alias("row"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        n.cast("long").alias("support"))
    none = F.lit(None)
    own = F.array(row(F.col("class"), F.col("precision"), F.col("recall"), F.col("f1"),
                      F.col("support")))
    summary = F.array(row(F.lit("accuracy"), none, none, F.col("__acc"), F.col("__tot")),
                      row(F.lit("macro avg"), F.col("__mp"), F.col("__mr"), F.col("__mf"),
                          F.col("__tot")),
                      row(F.lit("weighted avg"), F.col("__wp"), F.col("__wr"), F.col("__wf"),
                          F.col("__tot")))
    rows = F.when(F.col("__first"), F.concat(own, summary)).otherwise(own)
    return t.select(F.explode(rows).alias("r")).select("r.*")


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     wide: bool = False, zeros: bool = False) -> DataFrame:
    """Counts of (true, predicted) over the labels seen as true (predictions
    outside that set are not counted).  Long form lists non-zero cells, with
    ``zeros`` or ``wide`` all K x K of them; ``wide`` makes a column per class (the
    class list is the distinct true labels, bounded by the number of classes)."""
    pc = pair_counts(pred, label, prediction).where(F.col("label").isNotNull())
    names = pc.select(F.col("label").alias("name")).distinct()
    cells = pc.join(names, F.col("prediction") == F.col("name"), "left_semi").select(
        F.col("label").alias("true_label"), F.col("prediction").alias("predicted_label"),
        F.col("n").alias("count"))
    if not wide and not zeros:
        return cells
    classes = sorted(r[0] for r in names.collect())
    full = names.select(F.col("name").alias("true_label"), F.explode(
        F.array(*[F.lit(c) for c in classes])).alias("predicted_label"))
    cells = full.join(cells, ["true_label", "predicted_label"], "left").fillna(0, ["count"])
    if not wide:
        return cells
    return cells.groupBy("true_label").pivot("predicted_label", classes).agg(
        F.sum("count")).orderBy("true_label")


def roc_points(scored: DataFrame, label: str = "label", score: str = "score",
               cls: str = "class") -> DataFrame:
    """Points (class, threshold, fpr, tpr) of the one-vs-rest ROC curves, a
    point per distinct score, highest first, after the origin.  The rate of a side
    without rows is NULL."""
    c = _roc_counts(scored, label, score, cls)
    at = c.select(cls, F.col(score).cast("double").alias("threshold"),
                  F.try_divide("fp", "fp_all").alias("fpr"),
                  F.try_divide("tp", "tp_all").alias("tpr"))
    origin = at.select(cls).distinct().select(
        cls, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(at)


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score",
            cls: str = "class") -> DataFrame:
    """One-vs-rest ROC AUC per class from rows ``(class, label, score)``
    where ``label`` is 1 for the positive class, by the trapezoid rule over the
    distinct scores (ties share a threshold)."""
    c = _roc_counts(scored, label, score, cls)
    # of the step to this score: the mean of the true positives before and after
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    return c.groupBy(cls).agg(
        F.try_divide(F.sum(area), F.max("tp_all") * F.max("fp_all")).alias("auc"),
        F.max("tp_all").alias("positives"), F.max("fp_all").alias("negatives"))


def _roc_counts(scored: DataFrame, label: str, score: str, cls: str) -> DataFrame:
    """Per class and distinct score: rows of either side there (pos, neg), at or above it
    (tp, fp) and in all (tp_all, fp_all).  Prefix sums over ranges of (class, score):
    no task holds a class."""
    g = scored.groupBy(cls, score).agg(F.sum(F.col(label)).cast("long").alias("pos"),
                                       F.sum(1 - F.col(label)).cast("long").alias("neg"))
    return prefix_sums(g, cls, -F.col(score), {"tp": "pos", "fp": "neg"})


def compare_models(long: DataFrame, order: list[str] | None = None, model: str = "model",
                   label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy per model from one grouped pass over the long
    ``(model, label, prediction)`` rows; best first, ties in training order."""
    acc = long.groupBy(model).agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))
    if order:
        pos = F.array_position(F.array(*[F.lit(m) for m in order]), F.col(model))
        acc = acc.withColumn("train_order", pos.cast("long"))
    else:
        acc = acc.withColumn("train_order", F.lit(0).cast("long"))
    return acc.orderBy(F.desc("accuracy"), "train_order", model)


def best_model(comparison: DataFrame) -> DataFrame:
    """The first maximum (training order on ties)."""
    return comparison.orderBy(F.desc("accuracy"), "train_order", "model").limit(1)


def latest_model(registry: DataFrame, path: str = "path", saved_at: str = "saved_at") -> DataFrame:
    """Newest entry of a model registry table (``max_by``; NULL if empty).  The
    manifest's sequence decides where the table has it, else the time of saving."""
    order = "sequence" if "sequence" in registry.columns else saved_at
    newest = F.struct(order, path)
    return registry.agg(F.max_by(path, newest).alias(path), F.max_by(saved_at, newest).alias(saved_at))

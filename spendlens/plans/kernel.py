"""M7: multiclass SVM with an RBF kernel and class probabilities.

The kernel is a fitted feature map (random Fourier features): an inner product of
two mapped rows approximates exp(-gamma |x - y|^2), so a linear solver that scales
with the rows gives the kernel machine; its error shrinks with the square root of
``numFeatures``.  Probabilities are sigmoids of the one-vs-rest margins (Platt),
fitted on out-of-fold margins: the rows are dealt into stratified folds, and each
fold's margins come from machines that did not see it.  The sigmoids of all
classes are fitted together, one small aggregate per Newton step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasInputCol, HasLabelCol, HasMaxIter,
                                     HasOutputCol, HasRegParam, HasSeed, HasWeightCol)
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import split as SP
from ..scratch import Scratch
from ..operators.passes import in_task, stacked, summed, tree_groups


def _set(stage, kwargs: dict):
    return stage._set(**{k: v for k, v in kwargs.items() if v is not None})


# ------------------------------------------------------------------ kernel map
class _FourierParams(HasInputCol, HasOutputCol, HasSeed):
    numFeatures = Param(Params._dummy(), "numFeatures", "random features",
                        TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width; 0: 1 / (entries * variance)",
                  TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel_features", numFeatures=512,
                         gamma=0.0, seed=42)


class RandomFourierFeatures(Estimator, _FourierParams, DefaultParamsReadable,
                            DefaultParamsWritable):
    """Fits the vector's size and, with ``gamma`` 0, the width from the variance of all
    entries (one aggregate)."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, numFeatures=None, gamma=None, seed=None):
        super().__init__()
        _set(self, self._input_kwargs)

    def _fit(self, df: DataFrame) -> "RandomFourierFeaturesModel":
        stats = Summarizer.metrics("count", "mean", "normL2")
        row = df.select(stats.summary(F.col(self.getInputCol())).alias("s")).select("s.*").first()
        mean, size = row["mean"].toArray(), len(row["mean"])
        entries = max(row["count"] * size, 1)
        variance = float((row["normL2"].toArray() ** 2).sum() / entries - mean.mean() ** 2)
        gamma = self.getOrDefault("gamma") or (
            1.0 / (size * variance) if variance > 0 else 1.0)
        model = self._copyValues(RandomFourierFeaturesModel())
        return model._set(gamma=float(gamma), inputSize=size)


def fourier_map(size: int, width: int, gamma: float, seed: int):
    """The map of rows (n x size) to sqrt(2 / D) cos(x W + b) (n x width)."""
    draw = np.random.default_rng(seed)
    w = draw.normal(0.0, math.sqrt(2 * gamma), (size, width))
    b = draw.uniform(0.0, 2 * math.pi, width)
    return lambda x: math.sqrt(2 / width) * np.cos(x @ w + b)


class RandomFourierFeaturesModel(Model, _FourierParams, DefaultParamsReadable,
                                 DefaultParamsWritable):
    """W and b follow from the seed, so only it is saved."""

    inputSize = Param(Params._dummy(), "inputSize", "entries of the input", TypeConverters.toInt)

    def arguments(self) -> tuple[int, int, float, int]:
        g = self.getOrDefault
        return g("inputSize"), g("numFeatures"), g("gamma"), g("seed")

    def _transform(self, df: DataFrame) -> DataFrame:
        arguments = self.arguments()

        @F.pandas_udf("array<double>")
        def mapped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            kernel = fourier_map(*arguments)
            for rows in parts:
                yield pd.Series(list(kernel(np.stack(rows.to_numpy()))) if len(rows) else [],
                                dtype=object)

        return df.withColumn(self.getOutputCol(), array_to_vector(mapped(
            vector_to_array(F.col(self.getInputCol())))))


# ------------------------------------------------------------------ sigmoids
class SigmoidProbability(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``probability`` from a vector of margins: sigmoid(slope m + intercept) of each
    class, divided by their sum; ``prediction`` is the first largest."""

    slopes = Param(Params._dummy(), "slopes", "by class", TypeConverters.toListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "by class", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol=None, slopes=None, intercepts=None):
        super().__init__()
        _set(self, self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        line = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"))
                         for a, b in zip(self.getOrDefault("slopes"),
                                         self.getOrDefault("intercepts"), strict=True)))
        raw = F.zip_with(vector_to_array(F.col(self.getInputCol())), line,
                         lambda m, p: 1.0 / (1.0 + F.exp(-(p["a"] * m + p["b"]))))
        out = df.withColumn("__p", raw).withColumn("__sum", F.aggregate(
            "__p", F.lit(0.0), lambda s, x: s + x))
        even = F.lit(1.0 / len(self.getOrDefault("slopes")))
        out = out.withColumn("__p", F.transform("__p", lambda x: F.when(
            F.col("__sum") > 0, x / F.col("__sum")).otherwise(even)))
        best = F.array_position("__p", F.array_max("__p")) - 1
        return out.withColumns({"probability": array_to_vector(F.col("__p")),
                                "prediction": best.cast("double")}).drop("__p", "__sum")


def fit_sigmoids(margins: DataFrame, classes: int, steps: int = 50) -> tuple[list, list]:
    """Slope and intercept of each class from rows (class, margin, y): maximum
    likelihood of Platt's smoothed targets, by damped Newton steps.  A step is one
    aggregate with a row per class; a class's step is halved until its loss falls."""
    count = {r["class"]: (r["pos"], r["neg"]) for r in margins.groupBy("class").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).collect()}
    pos = np.array([count.get(k, (0, 0))[0] for k in range(classes)], float)
    neg = np.array([count.get(k, (0, 0))[1] for k in range(classes)], float)
    high, low = (pos + 1) / (pos + 2), 1 / (neg + 2)
    at = np.stack((np.ones(classes), np.log((neg + 1) / (pos + 1)) * -1), 1)
    step, loss = np.zeros((classes, 2)), np.full(classes, np.inf)

    def element(values):
        return F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("class") + 1)

    for _ in range(steps):
        z = element(at[:, 0]) * F.col("margin") + element(at[:, 1])
        p = 1.0 / (1.0 + F.exp(-z))
        t = F.when(F.col("y") == 1, element(high)).otherwise(element(low))
        d, v = p - t, p * (1.0 - p)
        m = F.col("margin")
        found = {r["class"]: r for r in margins.select("class", m, z.alias("z"), t.alias("t"),
                                                       d.alias("d"), v.alias("v")).groupBy(
            "class").agg(F.sum(F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))
                               - F.col("t") * F.col("z")).alias("loss"),
                         F.sum(F.col("d") * m).alias("ga"), F.sum("d").alias("gb"),
                         F.sum(F.col("v") * m * m).alias("haa"), F.sum(F.col("v") * m).alias("hab"),
                         F.sum("v").alias("hbb")).collect()}
        moved = False
        for k, r in found.items():
            if r["loss"] > loss[k] + 1e-10 * abs(loss[k]):  # too far: half the way back
                step[k] /= 2
                at[k] -= step[k]
                moved = moved or np.abs(step[k]).max() > 1e-8
                continue
            improved, loss[k] = loss[k] - r["loss"], r["loss"]
            if improved < 1e-9 * (1 + abs(loss[k])):
                step[k] = 0
                continue
            h = np.array([[r["haa"] + 1e-9, r["hab"]], [r["hab"], r["hbb"] + 1e-9]])
            step[k] = -np.linalg.solve(h, [r["ga"], r["gb"]])
            at[k] += step[k]
            moved = True
        if not moved:
            break
    return at[:, 0].tolist(), at[:, 1].tolist()


# ------------------------------------------------------------------ the machine
class KernelMachineModel(Model, HasFeaturesCol, HasOutputCol, DefaultParamsReadable,
                         DefaultParamsWritable):
    """One margin per class: the kernel map times a weight vector per class."""

    kernel = Param(Params._dummy(), "kernel", "input size, random features, gamma, seed",
                   TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "(features + 1) x classes, row by row",
                    TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, featuresCol=None, outputCol=None, kernel=None, weights=None):
        super().__init__()
        _set(self, self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        size, width, gamma, seed = self.getOrDefault("kernel")
        shared = df.sparkSession.sparkContext.broadcast(
            np.array(self.getOrDefault("weights")).reshape(int(width) + 1, -1))

        @F.pandas_udf("array<double>")
        def margins(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            mapped, v = fourier_map(int(size), int(width), gamma, int(seed)), shared.value
            for rows in parts:
                yield pd.Series(list(mapped(np.stack(rows.to_numpy())) @ v[:-1] + v[-1])
                                if len(rows) else [], dtype=object)

        return df.withColumn(self.getOutputCol(), array_to_vector(margins(
            vector_to_array(F.col(self.getFeaturesCol())))))


def _columns(b: pa.RecordBatch):
    """(features n x d, label, weight, fold, always) of a batch; None if it is empty."""
    if not b.num_rows:
        return None
    return (stacked(b.column(0), b.num_rows), *(b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)))


class KernelSVM(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter, HasRegParam,
                HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """RBF kernel map -> one-vs-rest linear machines -> sigmoids, as one PipelineModel.

    The machines of all classes and of all folds are fitted together: each step is
    one pass over the rows, which maps them and adds up the gradients of all
    machines (the mapped rows are never stored).  The loss is the squared hinge; twice the
    mapped rows' moment matrix bounds its curvature for every machine, so steps
    preconditioned with it need no line search and few rounds (accelerated, and
    restarted where the acceleration overshoots)."""

    numFeatures = Param(Params._dummy(), "numFeatures", "random features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width; 0: from the data",
                  TypeConverters.toFloat)
    folds = Param(Params._dummy(), "folds", "folds of the out-of-fold margins",
                  TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "least relative change of the weights",
                TypeConverters.toFloat)

    @keyword_only
    def __init__(self, featuresCol=None, labelCol=None, weightCol=None, maxIter=None,
                 regParam=None, seed=None, numFeatures=None, gamma=None, folds=None, tol=None):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", maxIter=100, regParam=0.01,
                         seed=42, numFeatures=512, gamma=0.0, folds=3, tol=1e-3)
        _set(self, self._input_kwargs)

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    def setLabelCol(self, value):
        return self._set(labelCol=value)

    def setWeightCol(self, value):
        return self._set(weightCol=value)

    def _fit(self, df: DataFrame) -> PipelineModel:
        g, label = self.getOrDefault, F.col(self.getLabelCol()).cast("int")
        weight = F.col(g("weightCol")) if self.isDefined("weightCol") else F.lit(1.0)
        kernel = RandomFourierFeatures(
            inputCol=g("featuresCol"), numFeatures=g("numFeatures"), gamma=g("gamma"),
            seed=g("seed")).fit(df).arguments()
        with Scratch(df.sparkSession) as keep:
            rows = keep(df.select(
                F.monotonically_increasing_id().alias("row"), label.alias("label"),
                weight.cast("double").alias("weight"),
                vector_to_array(F.col(g("featuresCol"))).alias("x")))
            # A class with fewer rows than folds is in every fit.
            sizes = rows.groupBy("label").count()
            small = sizes.where(F.col("count") < g("folds")).select("label", F.lit(True).alias("small"))
            rows = keep(SP.with_folds(rows, "row", "label", g("folds"), g("seed")).join(
                small, "label", "left").select(
                "x", "label", "weight", "fold", F.coalesce("small", F.lit(False)).alias("always")))
            classes = sizes.agg(F.max("label")).first()[0] + 1
            weights = self._machines(rows, kernel, classes)
            margins = keep(self._held_out(rows, kernel, weights))
            slopes, intercepts = fit_sigmoids(margins, classes)
        return PipelineModel(stages=[
            KernelMachineModel(featuresCol=g("featuresCol"), outputCol="margins",
                               kernel=[float(x) for x in kernel],
                               weights=weights[:, 0].ravel().tolist()),
            SigmoidProbability(inputCol="margins", slopes=slopes, intercepts=intercepts)])

    def _machines(self, rows: DataFrame, kernel: tuple, classes: int) -> np.ndarray:
        """Weights (features + 1, 1 + folds, classes): machine 0 sees all rows, machine
        1 + f all but fold f."""
        g, sc = self.getOrDefault, rows.sparkSession.sparkContext
        size, folds, penalty = g("numFeatures") + 1, g("folds"), g("regParam")

        def ones(z):
            return np.hstack((z, np.ones((len(z), 1))))

        def moments(batches):
            mapped, total = fourier_map(*kernel), np.zeros((size, size + 1))
            for b in batches:
                if (columns := _columns(b)) is not None:
                    z = ones(mapped(columns[0]))
                    total[:, :size] += z.T @ (z * columns[2][:, None])
                    total[0, size] += len(z)
            return total

        groups = tree_groups(rows)
        total = summed(rows, moments, (size, size + 1), groups)
        n = total[0, size]
        ridge = np.full(size, penalty)
        ridge[-1] = 0.0  # the intercept bears no penalty
        curvature = 2 * total[:, :size] / n + np.diag(ridge)
        inverse = in_task(rows.sparkSession, np.linalg.inv,
                          curvature + 1e-9 * np.trace(curvature) / size * np.eye(size))

        def gradient(shared):
            def partial(batches):
                mapped, v = fourier_map(*kernel), shared.value
                out = np.zeros(v.shape)
                for b in batches:
                    if (columns := _columns(b)) is None:
                        continue
                    x, y, w, fold, always = columns
                    z = ones(mapped(x))
                    sign = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)[:, None, :]
                    seen = (fold[:, None] != np.arange(-1, folds)) | always[:, None]
                    slack = np.maximum(0, 1 - sign * np.tensordot(z, v, 1)) * seen[:, :, None]
                    out -= 2 * np.tensordot(z, w[:, None, None] * sign * slack, (0, 0))
                return out
            return partial

        v = ahead = np.zeros((size, 1 + folds, classes))
        pace = np.ones((1 + folds, classes))
        for _ in range(g("maxIter")):
            shared = sc.broadcast(ahead)
            slope = summed(rows, gradient(shared), ahead.shape, groups) / n + ridge[:, None, None] * ahead
            shared.unpersist()
            new = ahead - np.einsum("ij,jmk->imk", inverse, slope)  # not threaded, see in_task
            moved = new - v
            restart = (slope * moved).sum(axis=0) > 0
            pace = np.where(restart, 1.0, pace)
            faster = (1 + np.sqrt(1 + 4 * pace ** 2)) / 2
            ahead = new + np.where(restart, 0.0, (pace - 1) / faster) * moved
            pace, v = faster, new
            if np.abs(moved).max() <= g("tol") * max(np.abs(v).max(), 1e-12):
                break
        return v

    @staticmethod
    def _held_out(rows: DataFrame, kernel: tuple, weights: np.ndarray) -> DataFrame:
        """(class, margin, y) of every row by the machines that did not see its fold."""
        shared = rows.sparkSession.sparkContext.broadcast(weights)
        classes = weights.shape[2]

        def task(batches):
            mapped, v = fourier_map(*kernel), shared.value
            for b in batches:
                if (columns := _columns(b)) is None:
                    continue
                x, y, _, fold, _ = columns
                z = np.hstack((mapped(x), np.ones((len(x), 1))))
                margin = np.einsum("nd,dnk->nk", z, v[:, 1 + fold.astype(int)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(classes, dtype=np.int32), len(x))),
                    pa.array(margin.ravel()),
                    pa.array((y[:, None] == np.arange(classes)).astype(np.int32).ravel())],
                    ["class", "margin", "y"])

        return rows.mapInArrow(task, "class int, margin double, y int")

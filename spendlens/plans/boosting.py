"""M5: multiclass gradient boosting with softmax probabilities.

Each round grows one regression tree per class on that class's residuals (label
indicator minus probability).  The trees of all classes grow together, level by level:
one pass over the rows gives, for every class, node, feature and bin, the summed
weights, residuals and curvatures; the best cuts follow from these sums, and the
last level's sums also give the leaf values (one Newton step of the multinomial
deviance).  So a round takes ``maxDepth`` passes however many classes there are, and
the driver holds sums, never rows.

Features are cut into bins once, at approximate quantiles.  The class scores of a row are
stored with it and brought up to date every ``checkpointInterval`` rounds in a new table
in the shared folder; in between a pass adds the trees grown since.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasStepSize,
                                     HasWeightCol)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..operators.passes import stacked, summed, tree_groups

ROWS_PER_TASK = 20_000


def softmax(scores: F.Column) -> F.Column:
    """Probabilities of an array of scores."""
    raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def bin_edges(rows: DataFrame, bins: int) -> np.ndarray:
    """Upper edges (features x bins - 1) of the bins: approximate quantiles of each
    feature; repeated ones become infinite, as no value lies between them."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(
        F.percentile_approx("v", shares, 10_000).alias("e")).orderBy("f").collect()
    edges = np.full((len(found), bins - 1), np.inf)
    for i, r in enumerate(found):
        values = np.unique(np.array(r["e"], float))
        edges[i, :len(values)] = values
    return edges


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Place (rows x trees) on level ``depth``; trees are heaps of (feature, cut), a row goes
    left where its bin (or value) is at most the cut."""
    rows, trees = np.arange(len(bins))[:, None], np.arange(len(feature))
    at = np.zeros((len(bins), len(feature)), np.int64)
    for level in range(depth):
        node = (1 << level) - 1 + at
        at = 2 * at + ~(bins[rows, feature[trees, node]] <= cut[trees, node])
    return at


class _BoostParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter, HasSeed, HasStepSize):
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of each tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a leaf",
                                TypeConverters.toInt)
    checkpointInterval = Param(Params._dummy(), "checkpointInterval",
                               "rounds between written tables", TypeConverters.toInt)

    maxBins = Param(Params._dummy(), "maxBins", "bins of each feature, at most 256",
                    TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(maxBins=32, featuresCol="features", labelCol="label", maxIter=100, stepSize=0.1,
                         maxDepth=3, minInstancesPerNode=1, seed=42, checkpointInterval=10)


class SoftmaxBoosting(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, featuresCol=None, labelCol=None, weightCol=None, maxIter=None, stepSize=None,
                 maxDepth=None, minInstancesPerNode=None, seed=None, checkpointInterval=None,
                 maxBins=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    def setLabelCol(self, value):
        return self._set(labelCol=value)

    def setWeightCol(self, value):
        return self._set(weightCol=value)

    def _fit(self, df: DataFrame) -> "SoftmaxBoostingModel":
        g = self.getOrDefault
        weight = F.col(g("weightCol")) if self.isDefined("weightCol") else F.lit(1.0)
        depth, step = g("maxDepth"), g("stepSize")
        with Scratch(df.sparkSession) as keep:
            rows = keep(df.select(vector_to_array(F.col(g("featuresCol"))).alias("x"),
                                  F.col(g("labelCol")).cast("int").alias("label"),
                                  weight.cast("double").alias("weight")))
            by_class = rows.groupBy("label").agg(F.sum("weight").alias("w"),
                                                 F.count("*").alias("n")).collect()
            classes = max(r["label"] for r in by_class) + 1
            prior = np.zeros(classes)
            for r in by_class:
                prior[r["label"]] = r["w"]
            init = np.log(np.maximum(prior, 1e-12) / prior.sum())
            # Many short passes follow: no more tasks than there are rows to fill them.
            rows = rows.coalesce(1 + sum(r["n"] for r in by_class) // ROWS_PER_TASK)
            edges = bin_edges(rows, g("maxBins"))
            state, grown = keep(_binned(rows, edges, init)), _Trees(depth, classes)
            groups = tree_groups(state)
            for number in range(1, g("maxIter") + 1):
                new = self._round(state, grown, step, edges.shape, groups)
                grown.add(*new)
                if number % g("checkpointInterval") == 0 and number < g("maxIter"):
                    state = keep(_advanced(state, grown, step))
                    grown.settle()
        feature, cut, value = grown.everything()
        inner = edges[feature, np.minimum(cut, edges.shape[1] - 1)]
        threshold = np.where(cut < edges.shape[1], inner, np.inf)
        return self._copyValues(SoftmaxBoostingModel())._set(
            classes=classes, init=init.tolist(), feature=feature.ravel().tolist(),
            threshold=threshold.ravel().tolist(), value=value.ravel().tolist())

    def _round(self, state: DataFrame, grown: "_Trees", step: float, edges: tuple, groups: int):
        """(feature, cut, leaf value) of one tree per class."""
        depth, k, (d, last) = self.getOrDefault("maxDepth"), grown.classes, edges
        feature = np.zeros((k, (1 << depth) - 1), np.int64)
        cut = np.full(feature.shape, last, np.int64)  # the last bin: all rows go left
        value = np.zeros((k, 1 << depth))
        least = self.getOrDefault("minInstancesPerNode")
        for level in range(depth):
            shared = state.sparkSession.sparkContext.broadcast((grown.recent(), feature, cut))
            sums = summed(state, _histograms(shared, level, step, (k, 1 << level, d, last + 1)),
                          (k, 1 << level, d, last + 1, 4), groups)
            shared.unpersist()
            left = np.cumsum(sums, axis=3)  # over the bins up to a cut
            whole = left[:, :, :, -1:]
            right = whole - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] \
                    - whole[..., 1] ** 2 / whole[..., 0]
            fits = (left[..., 3] >= least) & (right[..., 3] >= least)
            gain = np.where(fits & (gain > 1e-12), gain, -1.0).reshape(k, 1 << level, -1)
            best = gain.argmax(axis=2)
            some = np.take_along_axis(gain, best[..., None], 2)[..., 0] > 0
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            feature[:, nodes] = np.where(some, best // (last + 1), 0)
            cut[:, nodes] = np.where(some, best % (last + 1), last)
            if level == depth - 1:
                tree, node = np.indices(best.shape)
                at = (tree, node, feature[:, nodes], cut[:, nodes])
                for side, part in ((0, left[at]), (1, right[at])):
                    value[:, side::2] = np.where(
                        part[..., 2] > 1e-150,
                        (k - 1) / k * part[..., 1] / np.maximum(part[..., 2], 1e-150), 0.0)
        return feature, cut, value


class _Trees:
    """Trees grown so far; the recent ones are not yet in the rows' scores."""

    def __init__(self, depth: int, classes: int):
        self.depth, self.classes, self.rounds, self.settled = depth, classes, [], 0

    def add(self, feature, cut, value) -> None:
        self.rounds.append((feature, cut, value))

    def settle(self) -> None:
        self.settled = len(self.rounds)

    def recent(self):
        return self.rounds[self.settled:]

    def everything(self):
        return tuple(np.concatenate(x) for x in zip(*self.rounds, strict=True))


def _binned(rows: DataFrame, edges: np.ndarray, init: np.ndarray) -> DataFrame:
    def task(batches):
        for b in batches:
            if b.num_rows:
                x = stacked(b.column(0), b.num_rows)
                bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r.tobytes() for r in bins.astype(np.uint8)], pa.binary()),
                    b.column(1), b.column(2),
                    pa.array([init.tobytes()] * b.num_rows, pa.binary())],
                    ["bins", "label", "weight", "scores"])

    return rows.mapInArrow(task, "bins binary, label int, weight double, scores binary")


def _batches(batches, recent: list, step: float):
    """(bins, label, weight, scores) of each batch, with the recent trees added."""
    for b in batches:
        if not b.num_rows:
            continue
        bins = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
        scores = np.frombuffer(b"".join(b.column(3).to_pylist())).reshape(b.num_rows, -1)
        for feature, cut, value in recent:
            at = walk(bins, feature, cut, (value.shape[1]).bit_length() - 1)
            scores = scores + step * value[np.arange(len(value)), at]
        yield bins, b.column(1).to_numpy(), b.column(2).to_numpy(), scores


def _advanced(state: DataFrame, grown: _Trees, step: float) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(grown.recent())

    def task(batches):
        for bins, label, weight, scores in _batches(batches, shared.value, step):
            yield pa.RecordBatch.from_arrays([
                pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(label, pa.int32()),
                pa.array(weight), pa.array([r.tobytes() for r in scores], pa.binary())],
                ["bins", "label", "weight", "scores"])

    return state.mapInArrow(task, state.schema)


def _histograms(shared, level: int, step: float, shape: tuple):
    """Per class, node of the level, feature and bin: sums of the weights, residuals,
    curvatures and rows."""
    def partial(batches):
        recent, feature, cut = shared.value
        k, nodes, d, bins_of = shape
        out = np.zeros((k, 4, nodes * d * bins_of))
        for bins, label, weight, scores in _batches(batches, recent, step):
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            residual = (label[:, None] == np.arange(k)) - p
            at = walk(bins, feature, cut, level)
            columns = np.arange(d) * bins_of + bins
            for c in range(k):
                cell = (at[:, c, None] * (d * bins_of) + columns).ravel()
                r = residual[:, c]
                for i, x in enumerate((weight, weight * r, weight * np.abs(r) * (1 - np.abs(r)))):
                    out[c, i] += np.bincount(cell, np.repeat(x, d), out.shape[2])
                out[c, 3] += np.bincount(cell, minlength=out.shape[2])
        return np.ascontiguousarray(np.moveaxis(out, 1, 2).reshape(*shape, 4))

    return partial


class SoftmaxBoostingModel(Model, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (sums to 1) and ``prediction`` (its first largest).  The
    trees are heaps of (feature, threshold) with a value per leaf, a tree per class and
    round."""

    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    init = Param(Params._dummy(), "init", "first scores", TypeConverters.toListFloat)
    feature = Param(Params._dummy(), "feature", "of each inner node", TypeConverters.toListInt)
    threshold = Param(Params._dummy(), "threshold", "left if at most", TypeConverters.toListFloat)
    value = Param(Params._dummy(), "value", "of each leaf", TypeConverters.toListFloat)

    def numTrees(self) -> int:
        return len(self.getOrDefault("value")) >> self.getOrDefault("maxDepth")

    def _transform(self, df: DataFrame) -> DataFrame:
        g, n = self.getOrDefault, self.numTrees()
        shared = df.sparkSession.sparkContext.broadcast((
            np.array(g("feature"), np.int64).reshape(n, -1), np.array(g("threshold")).reshape(n, -1),
            np.array(g("value")).reshape(n, -1), np.array(g("init"))))
        depth, step, classes = g("maxDepth"), g("stepSize"), g("classes")

        @F.pandas_udf("array<double>")
        def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            feature, threshold, value, init = shared.value
            for rows in parts:
                if not len(rows):
                    yield pd.Series([], dtype=object)
                    continue
                x = np.stack(rows.to_numpy())
                leaf = walk(x, feature, threshold, depth)
                total = value[np.arange(len(value)), leaf].reshape(len(x), -1, classes).sum(axis=1)
                yield pd.Series(list(init + step * total), dtype=object)

        out = df.withColumn("__scores", scores(vector_to_array(F.col(g("featuresCol")))))
        out = out.withColumn("__p", softmax(F.col("__scores")))
        best = F.array_position("__p", F.array_max("__p")) - 1
        return out.withColumns({"probability": array_to_vector(F.col("__p")),
                                "prediction": best.cast("double")}).drop("__p", "__scores")

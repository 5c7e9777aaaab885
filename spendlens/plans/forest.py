"""M3, M8, M9: deep random forests whose trees never stand in the driver.

Spark's own forest keeps every node of all trees in the driver and sends a full set of sums
for each node, however few rows it has; on a deep forest both grow with rows times trees.
Here the features are cut into bins once (approximate quantiles, as in ``boosting``), and
each tree is grown in one task from the table of bins, which every task reads whole; only
the trees are written.  A fitted forest is a table with a row per tree.  Scoring hands its
trees out in chunks, of which driver and workers hold one at a time.

The law is Spark's: Poisson bootstrap, square root of the features drawn for each node,
Gini, weights in the sums, rows counted as often as they were drawn.  The draws are this
module's, set by seed and tree, and rows are sorted first, so a forest does not depend on
how they were dealt.  A table of bins above ``LOCAL_BYTES`` is left to Spark's estimator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasPredictionCol, HasProbabilityCol,
                                     HasRawPredictionCol)
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.passes import stacked
from ..scratch import Scratch, kept
from .boosting import bin_edges

LOCAL_BYTES = 64 << 20
# cells (node, feature, bin, class) of the sums that a task holds at once
CELLS = 1 << 19
CHUNK_BYTES = 16 << 20
PACKED_ROWS = 10_000
_TREE = ("tree int, feature binary, cut binary, left binary, shares binary, importance binary")


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, n_bins: int,
         seed: list[int], depth: int, least: int, min_rows: int, subset: int) -> tuple:
    """(feature, cut, left, shares, importance) of one tree.  Nodes are numbered level by
    level; rows with a bin of at most ``cut`` go to node ``left``, others to the next one.
    A leaf has feature -1, and ``left`` is the row of ``shares`` with its classes' shares."""
    d, rng = bins.shape[1], np.random.default_rng(seed)
    times = rng.poisson(1.0, len(bins))
    rows = np.flatnonzero(times)
    at, count, made = np.zeros(len(rows), np.int64), 1, 1
    levels, leaves, importance = [], [], np.zeros(d)
    for level in range(depth + 1):
        n, w = times[rows], times[rows] * weight[rows]
        total = np.bincount(at * classes + label[rows], w, count * classes).reshape(count, classes)
        size = np.bincount(at, n, count)
        mass = total.sum(1)
        feature, cut = np.full(count, -1, np.int16), np.zeros(count, np.uint8)
        if level < depth:
            able = (total.max(1) < mass) & (size >= max(min_rows, 2 * least))
            mine = np.flatnonzero(able[at])
            mine = mine[np.argsort(at[mine], kind="stable")]
            nodes = np.flatnonzero(able)
            ends = np.searchsorted(at[mine], nodes, side="right")
            step = max(1, CELLS // (subset * n_bins * classes))
            for a in range(0, len(nodes), step):
                some = nodes[a:a + step]
                part = mine[ends[a - 1] if a else 0:ends[a + len(some) - 1]]
                f, c, gain = _best(bins, label, rows[part], np.searchsorted(some, at[part]), n[part],
                                   w[part], total[some], size[some], n_bins, least, subset, rng)
                good = gain > 1e-9 * mass[some]
                feature[some[good]], cut[some[good]] = f[good], c[good]
                importance += np.bincount(f[good], gain[good], d)
        split = feature >= 0
        left = np.zeros(count, np.int32)
        left[split] = made + 2 * np.arange(split.sum())
        left[~split] = sum(map(len, leaves)) + np.arange((~split).sum())
        leaves.append(total[~split] / np.maximum(mass[~split, None], 1e-300))
        levels.append((feature, cut, left))
        keep = split[at]
        rows, at = rows[keep], at[keep]
        at = left[at] - made + (bins[rows, feature[at]] > cut[at])
        count = 2 * int(split.sum())
        made += count
        if not count:
            break
    feature, cut, left = (np.concatenate(x) for x in zip(*levels, strict=True))
    shares, number = np.unique(np.concatenate(leaves).astype(np.float32), axis=0, return_inverse=True)
    leaf = feature < 0
    left[leaf] = number.ravel()[left[leaf]]
    return feature, cut, left, shares, importance / max(importance.sum(), 1e-300)


def _best(bins, label, rows, node, n, w, total, size, n_bins, least, subset, rng) -> tuple:
    """Feature, cut and gain (times the node's weight) of the best split of each node among
    features drawn for it."""
    nodes, classes = total.shape
    drawn = np.argsort(rng.random((nodes, bins.shape[1])), axis=1)[:, :subset]
    cell = (node[:, None] * subset + np.arange(subset)) * n_bins + bins[rows[:, None], drawn[node]]
    sums = np.bincount((cell * classes + label[rows, None]).ravel(), np.repeat(w, subset),
                       nodes * subset * n_bins * classes)
    left = sums.reshape(nodes, subset, n_bins, classes).cumsum(2)
    right = total[:, None, None] - left
    few = np.bincount(cell.ravel(), np.repeat(n, subset), nodes * subset * n_bins).reshape(
        nodes, subset, n_bins).cumsum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(np.einsum("...k,...k->...", x, x) / x.sum(-1) for x in (left, right))
        gain -= ((total ** 2).sum(1) / total.sum(1))[:, None, None]
    fits = (few >= least) & (size[:, None, None] - few >= least)
    gain = np.where(fits & np.isfinite(gain), gain, -1.0).reshape(nodes, -1)
    best = gain.argmax(1)
    at = np.arange(nodes)
    return drawn[at, best // n_bins], best % n_bins, gain[at, best]


class Forest(RandomForestClassifier):
    """Spark's parameters; the fit is this module's for forests with Spark's standard choices."""

    def _fit(self, df: DataFrame):
        return self.fit_bounded(df, 0)

    def fit_bounded(self, df: DataFrame, min_rows: int):
        """The forest without splits of nodes of fewer than ``min_rows`` rows (0: no bound)."""
        g, spark = self.getOrDefault, df.sparkSession
        weight = F.col(g("weightCol")) if self.isDefined("weightCol") else F.lit(1.0)
        d, n = None, 0
        with Scratch(spark) as keep:
            rows = keep(df.select(vector_to_array(F.col(g("featuresCol"))).alias("x"),
                                  F.col(g("labelCol")).cast("int").alias("label"),
                                  weight.cast("double").alias("weight")))
            n, d, top, least, lightest = rows.agg(
                F.count("*"), F.max(F.size("x")), F.max("label"), F.min("label"),
                F.min("weight")).first()
            fits = (n and n * (d + 12) <= LOCAL_BYTES and least >= 0 and lightest >= 0
                    and g("numTrees") > 1 and g("maxBins") <= 256 and g("bootstrap")
                    and g("impurity") == "gini" and g("featureSubsetStrategy") in ("auto", "sqrt")
                    and g("subsamplingRate") == 1.0 and g("minInfoGain") == 0.0
                    and g("minWeightFractionPerNode") == 0.0)
            if fits:
                named = df.schema[g("labelCol")].metadata.get("ml_attr", {}).get("vals", ())
                classes = max(top + 1, len(named), 2)
                edges = bin_edges(rows, g("maxBins"))
                trees = kept(self._trees(keep(_packed(rows, edges)), classes, edges.shape, min_rows))
        if not fits:
            model = super()._fit(df)
            if not min_rows:
                return model
            from .pruning import with_min_split
            return with_min_split(self._copyValues(model), min_rows, spark)
        model = ForestModel()._set(classes=classes, edges=edges.ravel().tolist(), numFeatures=d)
        for name in ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
            model._set(**{name: g(name)})
        model.trees = trees
        return model

    def _trees(self, packed: DataFrame, classes: int, shape: tuple, min_rows: int) -> DataFrame:
        """A row per tree, grown in tasks that each read all ``packed`` rows."""
        g, spark = self.getOrDefault, packed.sparkSession
        d, n_bins = shape[0], shape[1] + 1
        number, seed = g("numTrees"), g("seed") & (1 << 63) - 1
        tasks = min(number, 2 * spark.sparkContext.defaultParallelism)
        depth, least = g("maxDepth"), g("minInstancesPerNode")
        subset = int(np.ceil(np.sqrt(d)))
        kind = np.dtype([("bins", np.uint8, (d,)), ("label", np.int32), ("weight", np.float64)])

        def task(batches):
            parts, first = [], None
            for b in batches:
                for i, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    first = i
                    parts.append(rows)
            if first is None:
                return
            raw = np.frombuffer(b"".join(parts), f"V{kind.itemsize}")
            rows = _sorted(raw, kind)
            del parts
            for tree in range(first, number, tasks):
                found = grow(np.ascontiguousarray(rows["bins"]), rows["label"].astype(np.int64),
                             rows["weight"].copy(), classes, n_bins, [seed, tree], depth, least,
                             min_rows, subset)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree], pa.int32()), *(pa.array([x.tobytes()], pa.binary())
                                                     for x in found)],
                    ["tree", "feature", "cut", "left", "shares", "importance"])

        return spark.range(0, tasks, 1, tasks).crossJoin(F.broadcast(packed)).mapInArrow(task, _TREE)


def _sorted(raw: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Packed rows in an order of their own."""
    table = raw.view(np.uint8).reshape(len(raw), -1)
    return raw[np.lexsort(table.T[::-1])].view(kind)


def _packed(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """Bins, label and weight of up to ``PACKED_ROWS`` rows in one binary value."""
    def task(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = stacked(b.column(0), b.num_rows)
            out = np.zeros(b.num_rows, [("bins", np.uint8, (len(edges),)), ("label", np.int32),
                                        ("weight", np.float64)])
            out["bins"] = _binned(x, edges)
            out["label"], out["weight"] = b.column(1).to_numpy(), b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([out[i:i + PACKED_ROWS].tobytes() for i in range(0, len(out), PACKED_ROWS)],
                          pa.binary())], ["rows"])

    return rows.mapInArrow(task, "rows binary")


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1).astype(np.uint8)


def _arrays(r, classes: int) -> tuple:
    """(feature, cut, left, shares) of a saved tree."""
    return (np.frombuffer(r["feature"], np.int16), np.frombuffer(r["cut"], np.uint8),
            np.frombuffer(r["left"], np.int32),
            np.frombuffer(r["shares"], np.float32).reshape(-1, classes))


def leaf_shares(bins: np.ndarray, tree: tuple) -> np.ndarray:
    """The classes' shares in each row's leaf."""
    feature, cut, left, shares = tree
    at, live = np.zeros(len(bins), np.int32), np.arange(len(bins))
    while True:
        live = live[feature[at[live]] >= 0]
        if not len(live):
            return shares[left[at]]
        node = at[live]
        at[live] = left[node] + (bins[live, feature[node]] > cut[node])


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.trees.write.parquet(f"{path}/trees")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str) -> "ForestModel":
        model = super().load(path)
        model.trees = SparkSession.active().read.schema(_TREE).parquet(f"{path}/trees")
        return model


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol,
                  MLWritable, MLReadable):
    """Adds the sums over the trees of the classes' shares in a row's leaf, their shares in
    these sums and the first largest class."""

    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    edges = Param(Params._dummy(), "edges", "upper edges of the bins", TypeConverters.toListFloat)
    numFeatures = Param(Params._dummy(), "numFeatures", "features", TypeConverters.toInt)

    trees: DataFrame

    def write(self) -> _ForestWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> _ForestReader:
        return _ForestReader(cls)

    @property
    def featureImportances(self):
        """Mean over the trees of each feature's share of the gains, as shares of their sum."""
        total = sum((np.frombuffer(r["importance"]) for r in self.trees.select(
            "importance").toLocalIterator()), np.zeros(self.getOrDefault("numFeatures")))
        return Vectors.dense(total / max(total.sum(), 1e-300))

    def _chunks(self) -> list:
        """Broadcasts of the trees in order, each of about ``CHUNK_BYTES``."""
        out, some, size, classes = [], [], 0, self.getOrDefault("classes")
        share = self.trees.sparkSession.sparkContext.broadcast
        for r in self.trees.drop("importance").orderBy("tree").toLocalIterator():
            some.append(_arrays(r, classes))
            size += sum(x.nbytes for x in some[-1])
            if size > CHUNK_BYTES:
                out.append(share(some))
                some, size = [], 0
        return [*out, share(some)] if some else out

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        classes, edges = g("classes"), np.array(g("edges")).reshape(g("numFeatures"), -1)
        chunks = self._chunks()

        @F.pandas_udf("array<double>")
        def votes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in parts:
                total = np.zeros((len(rows), classes))
                bins = _binned(np.stack(rows.to_numpy()), edges) if len(rows) else None
                for chunk in chunks if len(rows) else ():
                    for tree in chunk.value:
                        total += leaf_shares(bins, tree)
                    if len(chunks) > 1:
                        del chunk._value  # read again for the next rows: one chunk at a time
                yield pd.Series(list(total), dtype=object)

        out = df.withColumn("__votes", votes(vector_to_array(F.col(g("featuresCol")))))
        total = F.aggregate("__votes", F.lit(0.0), lambda s, x: s + x)
        out = out.withColumn("__total", total)
        best = F.array_position("__votes", F.array_max("__votes")) - 1
        return out.withColumns({
            g("rawPredictionCol"): array_to_vector(F.col("__votes")),
            g("probabilityCol"): array_to_vector(F.transform(
                F.col("__votes"), lambda x: x / F.col("__total"))),
            g("predictionCol"): best.cast("double")}).drop("__votes", "__total")

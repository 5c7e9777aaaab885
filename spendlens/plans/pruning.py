"""M3, M8: minimum rows of a node to be split, by rewriting the fitted trees.

Spark grows trees without such a bound.  A greedy tree splits each node on its own
rows only, so cutting every subtree below a node with too few rows gives the tree that
would have been grown under the bound (of a forest: with the same draws).  Spark's
saved form is a table with one row per node; the rewrite is one group per tree on it,
and the result is loaded as the same class of model.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, file_system
from .forest import Forest

_NODE = ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild",
         "rightChild", "split")
_LEAF_SPLIT = ("named_struct('featureIndex', -1, 'leftCategoriesOrThreshold', "
               "cast(array() as array<double>), 'numCategories', -1)")


def _renumbered(min_rows: int):
    """Old and new numbers of a tree's nodes that stay, in Spark's (pre-)order."""
    def rewrite(tree: pd.DataFrame) -> pd.DataFrame:
        nodes = {r.id: r for r in tree.itertuples(index=False)}
        rows, pending = [], [(0, None, None)]  # node, row of its parent, side
        while pending:
            old, parent, side = pending.pop()
            node, new = nodes[old], len(rows)
            if parent is not None:
                parent[side] = new
            inner = node.leftChild >= 0 and node.rawCount >= min_rows
            rows.append([node.treeID, old, new, -1, -1])
            if inner:
                pending += [(node.rightChild, rows[-1], 4), (node.leftChild, rows[-1], 3)]
        return pd.DataFrame(rows, columns=["treeID", "id", "new_id", "new_left", "new_right"])
    return rewrite


def rewritten_nodes(nodes: DataFrame, min_rows: int) -> DataFrame:
    """Rows (treeID and the columns of a saved node) with small inner nodes as leaves."""
    plan = nodes.select("treeID", "id", "rawCount", "leftChild", "rightChild").groupBy(
        "treeID").applyInPandas(_renumbered(min_rows), "treeID int, id int, new_id int, "
                                                       "new_left int, new_right int")
    leaf = F.col("new_left") < 0
    return nodes.join(plan, ["treeID", "id"]).withColumns({
        "id": F.col("new_id"), "leftChild": F.col("new_left"), "rightChild": F.col("new_right"),
        "gain": F.when(leaf, F.lit(-1.0)).otherwise(F.col("gain")),
        "split": F.when(leaf, F.expr(_LEAF_SPLIT)).otherwise(F.col("split"))}).select("treeID", *_NODE)


def with_min_split(model, min_rows: int, spark):
    """The fitted tree or forest without splits of nodes of fewer than ``min_rows`` rows."""
    with Scratch(spark) as keep:
        old, new = f"{keep.root}/fitted", f"{keep.root}/rewritten"
        model.write().save(old)
        data = spark.read.parquet(f"{old}/data")
        forest = "nodeData" in data.columns
        nodes = data.select("treeID", "nodeData.*") if forest else data.withColumn(
            "treeID", F.lit(0))
        out = rewritten_nodes(nodes, min_rows)
        out = out.select("treeID", F.struct(*_NODE).alias("nodeData")) if forest else out.select(*_NODE)
        out.write.parquet(f"{new}/data")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for part in ("metadata", *(["treesMetadata"] if forest else [])):
            files, place = file_system(spark, f"{old}/{part}")
            target, copy = file_system(spark, f"{new}/{part}")
            jvm.org.apache.hadoop.fs.FileUtil.copy(files, place, target, copy, False, conf)
        return type(model).load(new)


class MinSplit(Estimator):
    """A tree estimator whose fitted model has no split of fewer than ``min_rows`` rows."""

    def __init__(self, estimator, min_rows: int):
        super().__init__()
        self.estimator, self.min_rows = estimator, min_rows

    def __getattr__(self, name: str):
        """Setters and getters of the inner estimator."""
        if name.startswith("set"):
            def call(value):
                getattr(self.estimator, name)(value)
                return self
            return call
        if name.startswith("get"):
            return getattr(self.estimator, name)
        raise AttributeError(name)

    def _fit(self, df: DataFrame):
        if isinstance(self.estimator, Forest):
            return self.estimator.fit_bounded(df, self.min_rows)
        return with_min_split(self.estimator.fit(df), self.min_rows, df.sparkSession)

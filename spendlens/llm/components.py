"""Connected components of a link table, by alternating large and small stars.

Each round replaces a node's links by links to the smallest node it knows: one
shuffle for each of the two stars and one to drop repeated links.  The link
table is written to the shared folder after each round, so lineage stays short
and a lost executor repeats one round at most.  No link, label or component
ever reaches the driver; it only compares one row of counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spendlens.llm.common import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One shuffle by node: each link of it becomes one to its smallest node.
    The window's rows of a node spill; no array of them is built."""
    if large:
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = sides.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # The node's own link to the smallest comes from the row that holds it.
        out = met.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
                         .alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v"))


def components(links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v); the component is its
    smallest node.  ``max_rounds`` stops early with finer classes, each of them
    connected; NULL ends and self links are ignored."""
    table = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
        (F.col("u") != F.col("v")) & F.col("u").isNotNull() & F.col("v").isNotNull()).distinct()
    state, rounds = None, 0
    while max_rounds is None or rounds < max_rounds:
        table = written(_stars(_stars(table, True), False).distinct(), "components")
        seen = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        rounds += 1
        if seen == state:
            break
        state = seen
    # Short of convergence a node may still have two links: take the smaller.
    labels = table.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = table.select(F.col("v").alias("node")).distinct().join(
        labels.select("node"), "node", "left_anti")
    return labels.unionByName(roots.select("node", F.col("node").alias("component")))

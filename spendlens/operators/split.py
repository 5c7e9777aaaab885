"""Label encoding, stratified train/test split, class weights, CV folds.

Rows without a label belong to no class: sizes, split, weights and folds all
leave them out (they can still be scored).

The split is exact and scale-safe: each row gets a seeded hash ``h``; per class
the ``n_test`` rows with the smallest ``h`` go to test.  Rows are counted per
(class, hash bucket); cumulative counts give one boundary bucket per class.
These K rows meet the data (by broadcast up to ``MAX_BROADCAST_CLASSES``), every
row's bucket tells its side, and only rows of a boundary bucket, about
class_size / buckets of them, are shuffled and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKETS = 1 << 20   # rows per (class, bucket) stay small even for a hot class
MAX_BROADCAST_CLASSES = 100_000


def labelled(df: DataFrame, label: str = "category") -> DataFrame:
    return df.where(F.col(label).isNotNull())


def with_class_table(df: DataFrame, table: DataFrame, label: str) -> DataFrame:
    """``df`` with a table of one row per class: no shuffle of the rows while the
    table's counted size allows a broadcast."""
    small = table.count() <= MAX_BROADCAST_CLASSES
    return df.join(F.broadcast(table) if small else table, label)


def label_index(df: DataFrame, label: str = "category") -> DataFrame:
    """M1: classes in alphabetical order -> 0-based index (StringIndexer
    ``alphabetAsc``); the fitted label list is bounded by the class count."""
    from pyspark.ml.feature import StringIndexer
    model = StringIndexer(inputCol=label, outputCol="label_index",
                          stringOrderType="alphabetAsc", handleInvalid="skip").fit(df)
    return df.sparkSession.createDataFrame(
        [(c, i) for i, c in enumerate(model.labels)], f"{label} string, label_index long")


def class_counts(df: DataFrame, label: str = "category") -> DataFrame:
    return labelled(df, label).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def stratified_sizes(df: DataFrame, label: str = "category", test_size: float = 0.2) -> DataFrame:
    """M2 sizes: n_test = ceil(test_size * N) spread over classes by floor of the
    proportional share, the remainder going to the largest fractional parts
    (ties: class name).  Works on the per-class table (K rows)."""
    c = class_counts(df, label)
    all_ = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(all_)
    c = c.withColumn("__total", total).withColumn(
        "__test", F.ceil(F.lit(test_size) * F.col("__total")).cast("long"))
    c = c.withColumn("exact", F.col("n").cast("double") * F.col("__test") / F.col("__total"))
    c = c.withColumn("base", F.floor("exact").cast("long"))
    c = c.withColumn("left", F.col("__test") - F.sum("base").over(all_))
    rk = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(
        F.desc(F.col("exact") - F.col("base")), F.asc(label)))
    c = c.withColumn("rk", rk)
    n_test = F.col("base") + F.when(F.col("rk") <= F.col("left"), 1).otherwise(0)
    return c.select(label, "n", n_test.cast("long").alias("n_test"),
                    (F.col("n") - n_test).cast("long").alias("n_train"))


def md5_draw(id_col: str, seed: int) -> Column:
    """32 bits of the MD5 of ``id:seed``: an order that other engines can draw too,
    for splits that have to be repeated outside Spark."""
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def stratified_split(df: DataFrame, id_col: str, label: str = "category",
                     test_size: float = 0.2, seed: int = 42,
                     buckets: int = HASH_BUCKETS, draw: Column | None = None) -> DataFrame:
    """M2: adds boolean ``is_test``; exact per-class sizes of ``stratified_sizes``.
    Rows of a class go to test in the order (``draw`` modulo ``buckets``, ``draw``,
    id); the default draw is a seeded hash of the id."""
    h = F.xxhash64(F.col(id_col), F.lit(seed)) if draw is None else draw
    d = labelled(df, label).withColumns({"__h": h, "__b": F.pmod(h, F.lit(buckets))})
    # order inside a class: (bucket, hash, id) -- bucket-major so that bucket
    # counts give every row's rank offset
    bc = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    sizes = stratified_sizes(df, label, test_size).select(label, "n_test")
    wc = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bc = bc.withColumn("__before", F.coalesce(F.sum("__bn").over(wc), F.lit(0))) \
        .join(sizes, label)
    # first bucket of each class that is not wholly test rows
    out = F.col("__before") + F.col("__bn") > F.col("n_test")
    cut = bc.groupBy(label).agg(F.min(F.when(out, F.struct("__b", "__before"))).alias("__cut"),
                                F.first("n_test").alias("__n_test"))
    d = with_class_table(d, cut, label)
    at = F.col("__cut.__b")
    boundary = d.where(F.col("__b") == at)
    rank = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", id_col))
    boundary = boundary.withColumn("is_test", F.col("__cut.__before") + rank <= F.col("__n_test"))
    settled = d.where(at.isNull() | (F.col("__b") != at)).withColumn(
        "is_test", at.isNull() | (F.col("__b") < at))
    cols = df.columns + ["is_test"]
    return settled.select(*cols).unionByName(boundary.select(*cols))


def class_weights(df: DataFrame, label: str = "category") -> DataFrame:
    """Balanced weight N / (K * n_class) per class (K-row table)."""
    c = class_counts(df, label)
    all_ = Window.partitionBy(F.lit(1))
    return c.select(label, "n", (F.sum("n").over(all_) / (F.count(F.lit(1)).over(all_)
                                                          * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "category", out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return with_class_table(labelled(df, label), w, label)


def with_folds(df: DataFrame, id_col: str, label: str = "category", k: int = 5,
               seed: int = 42, draw: Column | None = None) -> DataFrame:
    """Stratified fold id in [0, k): per class, rows ordered by a seeded
    hash (or by ``draw``) are dealt round-robin.  The round-robin position is the
    rank, computed with the same bucketed scheme as the split (no whole-class sort)."""
    h = F.xxhash64(F.col(id_col), F.lit(seed + 1)) if draw is None else draw
    d = labelled(df, label).withColumns({"__h": h, "__b": F.pmod(h, F.lit(HASH_BUCKETS))})
    bc = d.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    wc = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bc = bc.withColumn("__before", F.coalesce(F.sum("__bn").over(wc), F.lit(0)))
    d = d.join(bc.select(label, "__b", "__before"), [label, "__b"])
    rank = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", id_col))
    return d.withColumn("fold", F.pmod(F.col("__before") + rank - 1, F.lit(k)).cast("int")) \
        .drop("__h", "__b", "__before")

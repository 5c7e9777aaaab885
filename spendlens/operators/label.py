"""Rule-based label repair: description keywords + merchant lookup.

The merchant table is a fixed 40-row literal, so its join is a broadcast
hash join with a proven size bound; the keyword match is a projection.  The
partial repair draws a per-row uniform from a hash of a stable key and the
seed, so the chosen rows do not depend on partitioning or task retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.keywords import with_best_category
from ..functions.text import as_python_text


def merchant_map_df(spark: SparkSession, mapping: dict = K.MERCHANT_CATEGORY) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "merchant string, merchant_category string")


def desc_category_score(df: DataFrame, description_col: str = "description",
                        keywords: dict = K.CLEANER_KEYWORDS) -> DataFrame:
    """L1: ``desc_category`` / ``desc_score`` (NULL / 0 without a keyword hit)."""
    low = F.lower(as_python_text(F.col(description_col)))
    return with_best_category(df, low, keywords, "desc_category", "desc_score")


def merchant_lookup(df: DataFrame, merchant_col: str = "merchant",
                    mapping: dict = K.MERCHANT_CATEGORY) -> DataFrame:
    """L2: exact, case-sensitive merchant -> category (left broadcast join)."""
    m = merchant_map_df(df.sparkSession, mapping).withColumnRenamed("merchant", "__m")
    return (df.join(F.broadcast(m), F.col(merchant_col) == F.col("__m"), "left").drop("__m"))


def reconcile(merchant_cat: F.Column, desc_cat: F.Column, desc_score: F.Column) -> F.Column:
    """L3: agree -> it; disagree -> merchant when the description signal is weak
    (score <= 1) else description; one side only -> that side; else NULL."""
    return (F.when(merchant_cat.isNotNull() & desc_cat.isNotNull(),
                   F.when(merchant_cat == desc_cat, merchant_cat)
                   .when(desc_score <= 1, merchant_cat).otherwise(desc_cat))
            .when(merchant_cat.isNotNull(), merchant_cat)
            .when(desc_cat.isNotNull() & (desc_score >= 1), desc_cat))


def proposed_labels(df: DataFrame, description_col: str = "description",
                    merchant_col: str = "merchant") -> DataFrame:
    """L1 + L2 + L3: adds desc_category, desc_score, merchant_category, new_label."""
    d = merchant_lookup(desc_category_score(df, description_col), merchant_col)
    return d.withColumn("new_label", reconcile(F.col("merchant_category"),
                                               F.col("desc_category"), F.col("desc_score")))


def uniform_draw(key: F.Column, seed: int) -> F.Column:
    """Deterministic U[0,1) per row from the MD5 of a stable key and the seed, in
    steps of 16^-6 (other engines can draw the same)."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("double") / float(16 ** 6)


def repair_labels(df: DataFrame, category_col: str = "category",
                  description_col: str = "description", merchant_col: str = "merchant",
                  fix_ratio: float = 1.0, seed: int = 42, key_col: str | None = None) -> DataFrame:
    """L4 (``fix_ratio=1``) and L5: replace the label by the proposed one where
    they differ (case-sensitive; a NULL label differs), for all rows or for a
    seeded ``fix_ratio`` share of them, drawn by ``key_col`` (equal rows are drawn
    apart).  Adds boolean ``corrected``."""
    d = proposed_labels(df, description_col, merchant_col)
    differs = F.col("new_label").isNotNull() & ~F.col("new_label").eqNullSafe(F.col(category_col))
    if fix_ratio >= 1.0:
        pick = F.lit(True)
    elif fix_ratio <= 0.0:
        pick = F.lit(False)
    elif key_col is None:
        raise ValueError("a share of the rows is drawn by a row key: name it in key_col")
    else:
        pick = uniform_draw(F.col(key_col), seed) < fix_ratio
    d = d.withColumn("corrected", differs & pick)
    return (d.withColumn(category_col, F.when(F.col("corrected"), F.col("new_label"))
                         .otherwise(F.col(category_col)))
            .drop("desc_category", "desc_score", "merchant_category", "new_label"))


def repair_summary(repaired: DataFrame) -> DataFrame:
    """Rows and corrected rows in one aggregate."""
    return repaired.agg(F.count(F.lit(1)).alias("rows"),
                        F.count_if(F.col("corrected")).alias("corrected"))


def label_distribution(before: DataFrame, after: DataFrame,
                       category_col: str = "category") -> DataFrame:
    """Counts per label before and after, most frequent first (one union)."""
    b = before.select(F.lit("before").alias("stage"), F.col(category_col).alias("category"))
    a = after.select(F.lit("after").alias("stage"), F.col(category_col).alias("category"))
    return (b.unionByName(a).groupBy("stage", "category").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("stage", F.desc("count"), "category"))

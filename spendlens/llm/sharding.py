"""Sharding by proportional stratified interleaving.

Every shard gets the corpus's mixture of sources, in a shuffled order, and as many
rows as any other (at most one apart):

1. Each document draws a key from the seed, its id and its text's checksum.  Its
   rank in its source is its place among the source's keys.  Rows are dealt by
   ranges of (source, key), so a source that holds a third of all rows spreads
   over a third of the ranges; a rank is the place in the range plus what the
   source has in the ranges before.
2. A row's fractional rank is (rank - 1/2) / rows of its source: a source of n rows
   puts its rows at n even steps over the interval 0 to 1.
3. Rows are dealt by ranges of the fractional rank (ties by key), which gives each
   its place in the whole order; ``shards`` equal cuts are the shards, and the place
   in the cut is the slot.  So shard by shard each source has its share, with
   less than two rows of difference.

Only slim rows (id, size, checksum, key, source) are shuffled, never texts.
Groups of equal texts are spread like all rows: equal counts and a group of a third
of all rows exclude one another.

Edge cases: NULL text has size 1 and the checksum of no bytes; a NULL source is a
source of its own (and apart from the empty name); rows that repeat an id and a text
are interchangeable; NULL ids take part; other columns are ignored, whatever
their names; an empty table gives no rows, fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spendlens.llm.common import written
from spendlens.llm.ranges import numbered


def keyed(docs: DataFrame, source: str, seed: int) -> DataFrame:
    """Slim rows, written: row, doc_id, size, text_crc32, stratum, key."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    crc = F.crc32(text)
    key = F.md5(F.encode(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
        crc.cast("string")), "UTF-8"))
    stratum = F.concat(F.lit("="), F.col(f"`{source}`").cast("string"))  # NULL sorts before all
    return written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"),
        F.coalesce(stratum, F.lit("")).alias("stratum"), key.alias("key")), "shard-keys")


def interleaved(docs: DataFrame, source: str = "source", seed: int = 2024) -> DataFrame:
    """The slim rows with ``place`` in the interleaved order of all rows."""
    placed = numbered(keyed(docs, source, seed), F.col("stratum"), F.col("key"), F.col("row"))
    # A stratum's rows stand together in the order of (stratum, key).
    strata = placed.groupBy("stratum").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    ranked = placed.join(strata, "stratum").withColumn("fraction", (
        2 * (F.col("place") - F.col("first")) + 1) / (2 * F.col("n"))).drop("place", "first", "n")
    return numbered(ranked, F.col("fraction"), F.col("key"), F.col("stratum"), F.col("row"))


def shard(docs: DataFrame, shards: int = 8, source: str = "source", seed: int = 2024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document;
    the law is ``rows``, so ``grown_shard`` is NULL."""
    order = interleaved(docs, source, seed)
    n = order.count()
    cut = F.expr(f"place * {shards} div {max(n, 1)}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")  # first place of the shard
    return order.withColumn("shard", cut).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), (F.col("place") - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))

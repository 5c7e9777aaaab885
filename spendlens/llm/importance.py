"""Target-distribution importance resampling.

Draws the documents whose hashed words look most like a target corpus, with
Gumbel noise on the log weights (so the draw is a sample without replacement).

1. *Array-scored weights.*  Words (runs of a-z, 0-9 and non-ASCII bytes, A-Z
   lower-cased) and longer runs of words are hashed into buckets; one pass over
   each corpus counts its buckets (partial arrays per task, one row per bucket on
   the driver).  The log ratio of the smoothed bucket shares is an array of
   integer gains; a second pass sums a document's gains from that array, adds
   the noise drawn from the seed and the id, and persists one slim row per
   document.
2. *Threshold bisection.*  The cutoff is the score at which exactly the wanted
   number of rows stands at or above: repeated count jobs over the persisted
   scores, each counting several thresholds, halve the bracket many times over;
   then the same on the ids of the rows tied at the cutoff.  All counts are exact
   and partially aggregated, however many rows share one score or id.
3. *Ranks.*  Only selected rows are range-partitioned by (score, id) and sorted;
   a row's rank is its place in its range plus the sizes of the ranges before.

Edge cases: NULL and empty texts have no feature and weight 0; ties go to the
smaller id, then to fewer features, and rows alike in all of these are
interchangeable; a NULL id hashes as the empty text and sorts behind all ids;
rows that repeat an id are scored each on its own; extra columns are ignored,
whatever their names; empty documents or an empty target give no rows, or gains
against an empty target.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from spendlens.llm.common import bound_batches, raw_texts, written
from spendlens.llm.decontaminate import words
from spendlens.llm.ranges import numbered

#: Thresholds that one count job tests.
CUTS = 15
LAST_ID = (1 << 63) - 1


class _Buckets(dict):
    """Bucket of each feature seen, emptied when many are kept."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.buckets
        return value

    def of(self, found: list[bytes], longest: int) -> np.ndarray:
        """Buckets of all runs of 1 to ``longest`` words."""
        features = list(found)
        for n in range(2, longest + 1):
            features += [b" ".join(found[i:i + n]) for i in range(len(found) - n + 1)]
        return np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts (the one column of ``texts``) by bucket."""
    schema = _parse_datatype_string("bucket int, n long")
    arrow = to_arrow_schema(schema)

    def task(batches):
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in raw_texts(b.column(0)):
                total += np.bincount(known.of(words(text), longest), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])],
                                         schema=arrow)

    found = texts.mapInArrow(task, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000 ln of each bucket's smoothed share in the target over its share in
    the source, in doubles."""
    s_all, t_all, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(
        ((t + 1.0) * (s_all + buckets)) / ((s + 1.0) * (t_all + buckets))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Floored 1000 x Gumbel noise from the seed and the id."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, seed: int = 2024, buckets: int = 10_000,
           longest: int = 1) -> DataFrame:
    """Persisted rows (row, doc_id, n_words, n_features, weight, score); ``docs`` has
    doc_id and text, ``target`` text."""
    spark = docs.sparkSession
    bound_batches(spark)
    array = spark.sparkContext.broadcast(gains(
        bucket_counts(docs.select("text"), buckets, longest),
        bucket_counts(target.select("text"), buckets, longest)))
    schema = _parse_datatype_string(
        "doc_id long, n_words long, n_features long, weight long, score long")
    arrow = to_arrow_schema(schema)

    def task(batches):
        known, gain = _Buckets(buckets), array.value
        for b in batches:
            ids, sizes, many, weights, scores = b.column(0).to_pylist(), [], [], [], []
            for doc_id, text in zip(ids, raw_texts(b.column(1)), strict=True):
                found = words(text)
                at = known.of(found, longest)
                weight = int(gain[at].sum()) // len(at) if len(at) else 0
                sizes.append(len(found))
                many.append(len(at))
                weights.append(weight)
                scores.append(weight + noise(doc_id, seed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, sizes, many, weights, scores)], schema=arrow)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .mapInArrow(task, schema).select(
        F.monotonically_increasing_id().alias("row"), "*"), "resample-scores")


def smallest(rows: DataFrame, key: Column, low: int, high: int, wanted: int) -> tuple[int, int]:
    """(x, rows with key < x) for the smallest x of [low, high] with at least
    ``wanted`` rows whose key is at most x; ``high`` must do."""
    below = 0
    while low < high:
        step = -(-(high - low) // (CUTS + 1))
        cuts = list(range(low + step - 1, high, step))
        counts = rows.agg(*(F.count_if(key <= c).alias(f"n{i}")
                            for i, c in enumerate(cuts))).first()
        for cut, n in zip(cuts, counts, strict=True):
            if n >= wanted:
                high = cut
                break
            low, below = cut + 1, n
    return low, below


def chosen(rows: DataFrame, wanted: int) -> DataFrame:
    """The rows (score, doc_id) that hold the ``wanted`` highest scores; ties to
    smaller ids.  Rows alike in both are all returned."""
    key, doc = -F.col("score"), F.coalesce("doc_id", F.lit(LAST_ID))
    low, high = rows.agg(F.min(key), F.max(key)).first()
    cut, above = smallest(rows, key, low, high, wanted)
    tied = rows.where(key == cut)
    first, last = tied.agg(F.min(doc), F.max(doc)).first()
    last, _ = smallest(tied, doc, first, last, wanted - above)
    return rows.where((key < cut) | ((key == cut) & (doc <= last)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20,
             seed: int = 2024, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: 1, 2, ... among the
    floor(percent N / 100) drawn of the N documents with ``min_words`` words or
    more, NULL for the others."""
    rows = scored(docs, target, seed, buckets, longest)
    out = rows.select("row", "doc_id", "n_features", "weight", "score")
    fit = rows.where(F.col("n_words") >= min_words)
    wanted = percent * fit.count() // 100
    if not wanted:
        return out.drop("row").withColumn("rank", F.lit(None).cast("long"))
    ranks = numbered(chosen(fit, wanted).select("row", "doc_id", "n_features", "score"),
                     -F.col("score"), F.coalesce("doc_id", F.lit(LAST_ID)), F.col("n_features"),
                     F.col("row")).select("row", (F.col("place") + 1).alias("rank"))
    return out.join(ranks.where(F.col("rank") <= wanted), "row", "left").drop("row")

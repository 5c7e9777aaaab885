"""Word 1-2-gram TF-IDF as DataFrame jobs.

fit:       a row's terms are sorted and the first of each is marked -> per term
           (df, total count) -> df filters -> top ``max_features`` by total count
           -> idf.  Only per-term sums are shuffled, added up in the task first; rows
           whose id occurs again are one document, their (doc, term) counts come
           first.  The vocabulary is a top-k, so it has a proven size bound and is
           broadcast to the transform.
transform: terms of the vocabulary alone -> (doc, term) counts -> tf * idf -> L2 norm
           per document (a document has at most ``max_features`` terms left, so
           the per-document group is bounded).

Formula (smooth idf): idf = ln((1 + N) / (1 + df)) + 1, tf = count or
1 + ln(count), rows L2-normalised.  Ties in the vocabulary cut go to the
smaller term.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

# ids that occur again are broadcast up to this counted number
MAX_BROADCAST_IDS = 100_000


@dataclass
class TfidfParams:
    max_features: int | None = 100
    min_df: float = 1          # int-like: document count; float < 1: share of documents
    max_df: float = 1.0        # float <= 1: share of documents; int-like > 1: count
    sublinear_tf: bool = False
    ngram_max: int = 2
    stop_words: tuple[str, ...] = ()


def with_terms(df: DataFrame, text_col: str, p: TfidfParams, out: str = "__terms") -> DataFrame:
    """Array column of a row's terms: lower-cased word tokens (stop words removed)
    and the bigrams of consecutive remaining tokens joined by a space."""
    t = tokens(F.col(text_col))
    if p.stop_words:
        t = F.filter(t, lambda w: ~w.isin(*p.stop_words))
    d = df.withColumn("__t", t)
    terms = F.col("__t")
    if p.ngram_max >= 2:
        bigrams = F.transform(F.slice("__t", 2, F.greatest(F.size("__t") - 1, F.lit(0))),
                              lambda x, i: F.concat(F.col("__t")[i], F.lit(" "), x))
        terms = F.concat(F.col("__t"), bigrams)
    return d.withColumn(out, terms).drop("__t")


def doc_terms(df: DataFrame, id_col: str, text_col: str, p: TfidfParams) -> DataFrame:
    """(id, term) rows of the documents' terms."""
    d = with_terms(df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("__text")),
                   "__text", p)
    # explode_outer, not explode: for explode the optimizer infers a size > 0
    # filter and pushes it below the projections, inlining the tokenizer into
    # the bigram lambda (the regex would rerun per element).  The explicit NULL
    # filter drops the row of an empty array, and keeps both count subtrees
    # identical (the join would infer it on one side only), so the exchange is
    # reused.
    return d.select("doc", F.explode_outer("__terms").alias("term")).where(
        F.col("term").isNotNull())


def sparse_weights(terms: F.Column, vocabulary: list[str], idf: list[float],
                   sublinear_tf: bool) -> F.Column:
    """L2-normalised tf-idf of one row over a fitted vocabulary, as a sparse vector.
    One pass over the row's terms with a hash lookup each (Arrow batches), whatever the
    size of the vocabulary; nothing is shuffled."""
    place, size = {t: i for i, t in enumerate(vocabulary)}, len(vocabulary)
    scale = np.array(idf, float)

    @F.pandas_udf(VectorUDT())
    def weigh(rows: pd.Series) -> pd.DataFrame:
        indices, values = [], []
        for row in rows:
            found = Counter(map(place.get, row if row is not None else ()))
            found.pop(None, None)
            at = np.array(sorted(found), np.int32)
            tf = np.array([found[i] for i in at], float)
            w = (1.0 + np.log(tf) if sublinear_tf else tf) * scale[at]
            indices.append(at)
            values.append(w / np.sqrt((w * w).sum()) if len(w) else w)
        n = len(indices)
        return pd.DataFrame({"type": np.zeros(n, np.int8), "size": np.full(n, size, np.int32),
                             "indices": pd.Series(indices, dtype=object),
                             "values": pd.Series(values, dtype=object)})

    return weigh(terms)


def term_counts(df: DataFrame, id_col: str, text_col: str, p: TfidfParams) -> DataFrame:
    return doc_terms(df, id_col, text_col, p).groupBy("doc", "term").agg(
        F.count(F.lit(1)).alias("tf"))


def term_stats(df: DataFrame, id_col: str, text_col: str, p: TfidfParams,
               unique_ids: bool = False) -> DataFrame:
    """(term, df, total): documents with the term and its occurrences.  Documents of one
    row are counted inside the row; rows that share an id (NULL is one id) are one
    document and counted by (doc, term).  ``unique_ids`` says that there are none."""
    d = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("__text"))
    shared = None
    if not unique_ids:
        ids = d.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            F.col("doc").alias("again"))
        n = ids.count()
        if n:
            ids = F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids
            same = F.col("doc").eqNullSafe(F.col("again"))
            shared, d = d.join(ids, same, "left_semi"), d.join(ids, same, "left_anti")
    rows = with_terms(d, "__text", p).withColumn("__sorted", F.array_sort("__terms"))
    at = F.col("__sorted")
    marked = F.transform(at, lambda x, i: F.struct(x.alias("term"), F.when(
        (i > 0) & (F.get(at, i - 1) == x), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("docs")))
    # see ``doc_terms`` for the outer explode
    terms = rows.select(F.explode_outer(marked).alias("m")).where(F.col("m").isNotNull()).select(
        "m.term", "m.docs", F.lit(1).cast("long").alias("tf"))
    if shared is not None:
        terms = terms.unionByName(term_counts(shared, "doc", "__text", p).select(
            "term", F.lit(1).cast("long").alias("docs"), "tf"))
    return terms.groupBy("term").agg(F.sum("docs").alias("df"), F.sum("tf").alias("total"))


def fit_vocabulary(df: DataFrame, id_col: str, text_col: str, p: TfidfParams,
                   unique_ids: bool = False) -> DataFrame:
    """Vocabulary ``(term, index, df, idf)``; index = alphabetical position.
    ``max_features`` must be set: it is the size bound that lets the
    vocabulary be indexed in one window and broadcast to the transform."""
    if not p.max_features:
        raise ValueError("max_features must be set (it bounds the vocabulary)")
    n_docs = df.select(id_col).count()
    stats = term_stats(df, id_col, text_col, p, unique_ids)
    lo = p.min_df if p.min_df >= 1 and float(p.min_df).is_integer() else p.min_df * n_docs
    hi = p.max_df * n_docs if p.max_df <= 1.0 else p.max_df
    kept = stats.where((F.col("df") >= F.lit(lo)) & (F.col("df") <= F.lit(hi)))
    if p.max_features:
        kept = kept.orderBy(F.desc("total"), F.asc("term")).limit(p.max_features)
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    vocab = kept.select("term", "df", idf.alias("idf"))
    # index over <= max_features rows: a window on the (bounded) vocabulary
    return vocab.withColumn("index", (F.row_number().over(Window.orderBy("term")) - 1)
                            .cast("long")) \
        .select("term", "index", "df", "idf")


def weights(df: DataFrame, id_col: str, text_col: str, vocab: DataFrame, p: TfidfParams) -> DataFrame:
    """Long form ``(doc, term, index, weight)`` of L2-normalised tf-idf."""
    j = doc_terms(df, id_col, text_col, p).join(
        F.broadcast(vocab.select("term", "index", "idf")), "term").groupBy(
        "doc", "term", "index", "idf").agg(F.count(F.lit(1)).alias("tf"))
    tf = (1.0 + F.log(F.col("tf"))) if p.sublinear_tf else F.col("tf").cast("double")
    w = j.withColumn("w", tf * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return w.select("doc", "term", "index", (F.col("w") / norm).alias("weight"))


def tfidf_long(df: DataFrame, id_col: str, text_col: str, p: TfidfParams) -> tuple[DataFrame,
                                                                                     DataFrame]:
    vocab = fit_vocabulary(df, id_col, text_col, p)
    return vocab, weights(df, id_col, text_col, vocab, p)

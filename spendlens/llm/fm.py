"""Factorisation machine for yes/no labels of documents.

    margin(x) = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairwise interactions cost one pass over a document's entries.  Inputs
are hashed words (presence; CRC-32 modulo ``slots``) and dense statistics.

Fitting, all in Spark: a bounded sample of the labelled rows (``sample_rows``
expected, chosen by a hash of the id) becomes a table of features; a slot's
association with the label is counted over that table, and the ``max_words``
slots of largest |z| of at least ``min_z`` are kept.  A slot whose effect shows
only beside another one has no z of its own, so the ``pair_words`` slots that vary most and
the ``pair_strong`` strongest ones are tested in pairs, and both members of a pair of |z| of at
least ``min_pair_z`` are kept as well.  Then ``rounds`` of local
Adagrad run on ``shards`` of the table in parallel, and the driver averages the
shards' weights (some thousand numbers each).  Scoring is a row-local
projection with the weights by broadcast: no shuffle of documents.

Nothing but the sample's size is bounded: every document is scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens.llm.common import bound_batches, list_slices, texts, written

#: A featuriser maps (text, metadata number or None) to (set of words, statistics).
Featuriser = Callable[[str, int | None], tuple[set[bytes], list[float]]]
#: An expander maps a word to the terms that are hashed for it.
Expander = Callable[[bytes], tuple[bytes, ...]]


def word_itself(word: bytes) -> tuple[bytes, ...]:
    return (word,)


@dataclass(frozen=True)
class FitParams:
    sample_rows: int = 20_000
    slots: int = 1 << 24
    max_words: int = 4096
    min_z: float = 4.0
    min_rows: int = 3
    pair_words: int = 384
    pair_strong: int = 128
    min_pair_z: float = 6.0
    rank: int = 4
    shards: int = 8
    rounds: int = 5
    epochs: int = 10
    step: float = 0.2
    l2: float = 1e-4
    seed: int = 7


@dataclass
class Model:
    """Weights: the first ``len(slot_at)`` inputs are words, the others statistics."""

    slots: int
    slot_at: dict[int, int]
    mean: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    expand: Expander = word_itself
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def _inputs(self, word: bytes) -> tuple[int, ...]:
        at = (self.slot_at.get(slot(t, self.slots)) for t in self.expand(word))
        return tuple(i for i in at if i is not None)

    def word_index(self, words: set[bytes]) -> list[int]:
        """Input numbers of the words' terms that have one."""
        known = self.known
        if len(known) > 300_000:
            known.clear()
        new = words.difference(known)
        known.update(zip(new, map(self._inputs, new), strict=True))
        return sorted({*chain.from_iterable(map(known.__getitem__, words))})

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)


def slot(word: bytes, slots: int) -> int:
    return zlib.crc32(word) % slots


def margins(rows: np.ndarray, index: np.ndarray, dense: np.ndarray, w0: float, w: np.ndarray,
            v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins and factor sums of a batch: ``index[j]`` is an input of row
    ``rows[j]`` with value 1, ``dense`` holds the statistics."""
    n, words = len(dense), len(w) - dense.shape[1]
    dw, dv = w[words:], v[words:]
    linear = w0 + dense @ dw + np.bincount(rows, w[index], n)
    total = dense @ dv
    squares = (dense ** 2) @ (dv ** 2).sum(1) + np.bincount(rows, (v[index] ** 2).sum(1), n)
    for f in range(v.shape[1]):
        total[:, f] += np.bincount(rows, v[index, f], n)
    return linear + 0.5 * ((total ** 2).sum(1) - squares), total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ragged(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a list of lists."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes.sum() else (
        np.zeros(0, np.int64))
    return np.repeat(np.arange(len(lists)), sizes), flat


def train_shard(index: list[np.ndarray], dense: np.ndarray, y: np.ndarray, state: np.ndarray,
                rank: int, p: FitParams, round_no: int) -> np.ndarray:
    """``p.epochs`` of minibatch Adagrad on one shard.  ``state`` stacks weights
    [w0, w, v] and their accumulated squared gradients."""
    d = (state.shape[1] - 1) // (1 + rank)
    theta, acc = state[0].copy(), state[1].copy()
    rng = np.random.default_rng(p.seed + round_no)
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            pick = order[at:at + 64]
            rows, flat = ragged([index[i] for i in pick])
            z = dense[pick]
            w, v = theta[1:1 + d], theta[1 + d:].reshape(d, rank)
            margin, total = margins(rows, flat, z, theta[0], w, v)
            g = (sigmoid(margin) - y[pick]) / len(pick)
            words = d - z.shape[1]
            grad_w = np.concatenate((np.bincount(flat, g[rows], words)[:words], z.T @ g))
            grad_v = np.empty((d, rank))
            own = np.bincount(flat, g[rows], words)[:words]
            own_z = (z ** 2).T @ g
            for f in range(rank):
                grad_v[:words, f] = np.bincount(flat, (g[:, None] * total)[rows, f], words)[:words]
                grad_v[words:, f] = z.T @ (g * total[:, f])
            grad_v -= np.concatenate((own, own_z))[:, None] * v
            grad = np.concatenate(([g.sum()], grad_w, grad_v.ravel())) + p.l2 * theta
            acc += grad ** 2
            theta -= p.step * grad / np.sqrt(acc + 1e-8)
    return np.stack((theta, acc))


def _sample(labels: DataFrame, label: str, held_out, p: FitParams) -> DataFrame:
    """At most about ``p.sample_rows`` labelled rows outside the held-out part."""
    usable = labels.where(~held_out & F.col(label).isNotNull() & F.col("doc_id").isNotNull()
                          ).select("doc_id", F.col(label).cast("double").alias("label"))
    n = usable.count()
    share = min(1.0, p.sample_rows / max(n, 1))
    grid = 1 << 20
    return usable.where(F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(grid))
                        < int(share * grid))


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out, featurise: Featuriser,
        n_stats: int, p: FitParams = FitParams(), expand: Expander = word_itself) -> Model:
    """Fit on documents (doc_id, text, meta) and labels (doc_id, ``label``)."""
    spark = docs.sparkSession
    bound_batches(spark)
    # The sample's size is a parameter, so its ids are a bounded broadcast.
    chosen = docs.join(F.broadcast(_sample(labels, label, held_out, p)), "doc_id").select(
        "doc_id", "text", "meta", "label")
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("key", T.LongType()),
        T.StructField("label", T.DoubleType()),
        T.StructField("words", T.ArrayType(T.IntegerType())),
        T.StructField("stats", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)
    slots, shards = p.slots, p.shards

    def describe(batches):
        for b in batches:
            done = [featurise(t, m) for t, m in zip(texts(b.column(1)), b.column(2).to_pylist(),
                                                   strict=True)]
            keys = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((
                [zlib.crc32(b"%d" % k) % shards for k in keys], keys, b.column(3).to_pylist(),
                [sorted({slot(t, slots) for w in ws for t in expand(w)}) for ws, _ in done],
                [s for _, s in done]), arrow, strict=True)], schema=arrow)

    table = written(chosen.mapInArrow(describe, schema), "fm")
    n, positive = table.agg(F.count("*"), F.sum("label")).first()
    if not n:
        return Model(slots, {}, np.zeros(n_stats), np.ones(n_stats), 0.0, np.zeros(n_stats),
                     np.zeros((n_stats, p.rank)), expand)
    share = positive / n
    spread = max(share * (1 - share), 1e-9)
    z = (F.col("pos") - F.col("n") * share) / F.sqrt(F.col("n") * spread)
    terms = written(table.select(F.explode("words").alias("slot"), "label").groupBy("slot").agg(
        F.count("*").alias("n"), F.sum("label").alias("pos")).where(F.col("n") >= p.min_rows)
        .withColumn("z", F.abs(z)), "fm")
    strong = [r["slot"] for r in terms.where(F.col("z") >= p.min_z).orderBy(
        F.desc("z"), "slot").limit(p.max_words).collect()]
    varied = [r["slot"] for r in terms.where(F.col("n") < n).orderBy(
        F.desc(F.col("n") * (n - F.col("n"))), "slot").limit(p.pair_words).collect()]
    tested = sorted({*varied, *strong[:p.pair_strong]})
    kept = {*strong, *_in_strong_pairs(table, tested, share, p)}
    slot_at = {s: i for i, s in enumerate(sorted(kept))}
    moments = table.select(F.posexplode("stats").alias("k", "x")).groupBy("k").agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    mean, scale = np.zeros(n_stats), np.ones(n_stats)
    for r in moments:
        mean[r["k"]], scale[r["k"]] = r["m"], max(r["s"], 1e-6)
    d = len(slot_at) + n_stats
    rng = np.random.default_rng(p.seed)
    start = np.zeros(1 + d * (1 + p.rank))
    start[1 + d:] = rng.normal(0, 0.02, d * p.rank)
    state = np.stack((start, np.full(start.shape, 1e-2)))
    out = T.StructType([T.StructField("state", T.BinaryType()), T.StructField("n", T.LongType())])
    out_arrow = to_arrow_schema(out)
    compact = _compact(table, slot_at)
    for round_no in range(p.rounds):
        shared = spark.sparkContext.broadcast((state, mean, scale))

        rows = compact.groupBy("shard").applyInArrow(
            _local_training(shared, p, round_no, out_arrow), out).collect()
        size = sum(r["n"] for r in rows)
        # Sum in a fixed order: the shards may come in any.
        state = sum(np.frombuffer(r["state"]).reshape(state.shape) * (r["n"] / size)
                    for r in sorted(rows, key=lambda r: r["state"]))
        shared.unpersist()
    theta = state[0]
    return Model(slots, slot_at, mean, scale, float(theta[0]), theta[1:1 + d],
                 theta[1 + d:].reshape(d, p.rank), expand)


def _in_strong_pairs(table: DataFrame, tested: list[int], share: float,
                     p: FitParams) -> list[int]:
    """Slots of a pair whose product of centred inputs goes with the label.  A
    shard returns two matrices over the tested slots (``pair_words`` +
    ``pair_strong`` rows at most)."""
    if len(tested) < 2:
        return []
    size = len(tested)
    rows = _compact(table, {s: i for i, s in enumerate(tested)})
    present = np.zeros(size)
    for r in rows.select(F.explode("words").alias("i")).groupBy("i").count().collect():
        present[r["i"]] = r["count"]
    mean = present / max(rows.count(), 1)
    out = T.StructType([T.StructField("shard", T.IntegerType()),
                        T.StructField("sums", T.BinaryType()),
                        T.StructField("squares", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def add(group):
        group = group.combine_chunks()
        sums, squares = np.zeros((size, size)), np.zeros((size, size))
        y = group.column("label").to_numpy() - share
        lists = group.column("words").to_pylist()
        for at in range(0, len(lists), 4096):
            x = np.zeros((len(lists[at:at + 4096]), size))
            where = ragged(lists[at:at + 4096])
            x[where] = 1
            x -= mean
            marked = x * y[at:at + 4096, None]
            sums += x.T @ marked
            squares += (x ** 2).T @ marked ** 2
        return pa.table({"shard": group.column("shard")[:1],
                         "sums": [sums.astype(np.float32).tobytes()],
                         "squares": [squares.astype(np.float32).tobytes()]}, schema=arrow)

    parts = sorted(rows.groupBy("shard").applyInArrow(add, out).collect(),
                   key=lambda r: r["shard"])

    def total(name):
        return sum(np.frombuffer(r[name], np.float32).astype(float) for r in parts).reshape(
            size, size)

    z = np.abs(total("sums")) / np.sqrt(np.maximum(total("squares"), 1.0))
    np.fill_diagonal(z, 0)
    return [tested[i] for i in np.flatnonzero((z >= p.min_pair_z).any(1))]


def _local_training(shared, p: FitParams, round_no: int, schema: pa.Schema):
    def step(group):
        state, mean, scale = shared.value
        group = group.combine_chunks().sort_by("key")
        index = [np.asarray(x, np.int64) for x in group.column("words").to_pylist()]
        dense = np.clip((np.array(group.column("stats").to_pylist()) - mean) / scale, -4, 4)
        y = group.column("label").to_numpy()
        new = train_shard(index, dense, y, state, p.rank, p, round_no)
        return pa.table({"state": [new.tobytes()], "n": [len(y)]}, schema=schema)

    return step


def _compact(table: DataFrame, slot_at: dict[int, int]) -> DataFrame:
    """The feature table with kept slots only, as input numbers."""
    schema = table.schema
    arrow = to_arrow_schema(schema)
    shared = table.sparkSession.sparkContext.broadcast(slot_at)

    def keep(batches):
        for b in batches:
            get = shared.value.get
            words = [[i for i in map(get, x.tolist()) if i is not None]
                     for x in list_slices(b.column(3))]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(3)), pa.array(words, arrow.field(3).type),
                 b.column(4).cast(arrow.field(4).type)], schema=arrow)

    return written(table.mapInArrow(keep, schema), "fm")


def score(docs: DataFrame, model: Model, featurise: Featuriser, score_col: str = "score",
          text_col: str = "text", meta_col: str | None = None) -> DataFrame:
    """``docs`` with the model's probability in ``score_col``."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]
                          + [T.StructField(score_col, T.DoubleType())])
    arrow = to_arrow_schema(schema)
    n, at = len(docs.columns), docs.columns.index(text_col)
    meta_at = docs.columns.index(meta_col) if meta_col else None

    def rate(batches):
        m = shared.value
        for b in batches:
            meta = b.column(meta_at).to_pylist() if meta_at is not None else [None] * len(b)
            done = [featurise(t, x) for t, x in zip(texts(b.column(at)), meta, strict=True)]
            rows, flat = ragged([m.word_index(ws) for ws, _ in done])
            dense = m.standard(np.array([s for _, s in done]).reshape(len(done), len(m.mean)))
            margin, _ = margins(rows, flat, dense, m.w0, m.w, m.v)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).cast(arrow.field(i).type) for i in range(n)),
                 pa.array(sigmoid(margin))], schema=arrow)

    return docs.mapInArrow(rate, schema)

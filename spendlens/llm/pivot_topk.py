"""Exact top-k search with a pivot-distance index.

Components become integers floor(scale * x); a score is an inner product.  With
R the largest norm, x' = (x, sqrt(R^2 - |x|^2)) and q' = (q, 0) the order by
score is the order by Euclidean distance, |q' - x'|^2 = |q|^2 + R^2 - 2 q.x, so
the triangle inequality holds.

Index: every vector belongs to its nearest pivot and, by its distance to it, to
an annulus; annuli are cut into blocks of about ``BLOCK_ROWS`` by a hash of the
id (a vector with a third of all rows fills many blocks), a row of the index
table each.  Pivots are centres fitted on a bounded sample of ``SAMPLE_ROWS``
rows; they only steer the pruning, the result is exact for any pivots.

Search: queries are a table too, grouped by their nearest annuli.  First each query
scans a block of its nearest annulus, which gives a first bound on its k-th
score.  Then groups meet ranges of blocks by a join on the annuli that the bounds
leave open; a task has one group and one range, expands its annuli from the nearest
outwards and stops for a query where |d(q', p) - d(x', p)| proves that nothing in
the annulus reaches the bound.  It returns at most k rows per query, merged by a
window over k rows per task.  Plan and jobs are the same for any number of queries.

Edge cases: vectors that are NULL, hold NULL or non-finite components, or have
no id take no part; shorter vectors count as padded with zeros; ties go to the
smaller id; rows with the query's own id are not candidates; of rows of one id the
least vector asks, all are candidates; a query without candidates gives no rows; extra columns are ignored.  Scores are exact while
products of integer components sum to less than 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens.llm.common import bound_batches, list_slices, written

K = 20
SCALE = 64
EVERY = 20
PIVOTS = 32
SAMPLE_ROWS = 2048
RINGS = 16  # of a pivot at most, and one for each RING_ROWS of its rows at most
RING_ROWS = 64
BLOCK_ROWS = 1024
#: Queries are cut into ``GROUPS`` groups, vectors into ``CELLS`` ranges of blocks, of
#: (least, most) so many rows; a task holds one group and one range.
GROUPS, GROUP_ROWS = 4, (1024, 65536)
CELLS, CELL_ROWS = 64, (1024, 65536)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


INTS = _schema(("vec_id", T.LongType()), ("v", T.ArrayType(T.DoubleType())))
PLACED = _schema(("pivot", T.IntegerType()), ("d", T.DoubleType()), ("vec_id", T.LongType()),
                 ("v", T.ArrayType(T.DoubleType())))
BLOCKS = _schema(("pivot", T.IntegerType()), ("ring", T.IntegerType()), ("sub", T.IntegerType()),
                 ("low", T.DoubleType()), ("high", T.DoubleType()),
                 ("ids", T.ArrayType(T.LongType())), ("vectors", T.BinaryType()))
HOMES = _schema(("pivot", T.IntegerType()), ("ring", T.IntegerType()), ("vec_id", T.LongType()),
                ("v", T.ArrayType(T.DoubleType())))
QUERIES = _schema(("g", T.LongType()), ("vec_id", T.LongType()),
                  ("v", T.ArrayType(T.DoubleType())), ("bound", T.DoubleType()))
OPEN = _schema(("g", T.LongType()), ("pivot", T.IntegerType()), ("ring", T.IntegerType()))
HITS = _schema(("query_id", T.LongType()), ("vec_id", T.LongType()), ("score", T.LongType()))


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    x = F.transform("embedding", lambda c: F.floor(scale * c.cast("double")).cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c)
                    & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``width``."""
    out = np.zeros((len(column), width))
    for i, row in enumerate(list_slices(column)):
        out[i, :len(row)] = row
    return out


def lifted(x: np.ndarray, radius2: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(radius2 - (x ** 2).sum(1), 0))
    return np.concatenate((x, rest[:, None]), 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0))


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 4) -> np.ndarray:
    """Centres of the sample: a few rounds of k-means."""
    centres = sample[:pivots].copy()
    for _ in range(rounds):
        near = distances(sample, centres).argmin(1)
        for p in range(len(centres)):
            own = sample[near == p]
            if len(own):
                centres[p] = own.mean(0)
    return centres


class Top:
    """The k best (score, id) of each query so far."""

    def __init__(self, bound: np.ndarray, k: int):
        self.k, self.bound = k, bound.copy()  # scores below it cannot be among the k best
        self.query = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query = np.concatenate((self.query, query))
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        full = np.flatnonzero(rank == self.k - 1)
        self.bound[query[full]] = np.maximum(self.bound[query[full]], scores[full])
        keep = rank < self.k
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]


def scan_block(top: Top, queries: np.ndarray, query_ids: np.ndarray, active: np.ndarray,
               ids: np.ndarray, vectors: np.ndarray) -> None:
    """Score a block for the active queries (row numbers), a slice at a time."""
    for at in range(0, len(active), 512):
        own = active[at:at + 512]
        scores = queries[own] @ vectors.T
        scores[query_ids[own][:, None] == ids[None]] = -np.inf
        least = top.bound[own]
        if len(ids) > top.k:
            kth = np.partition(scores, len(ids) - top.k, axis=1)[:, len(ids) - top.k]
            least = np.maximum(least, kth)
        row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        if len(row):
            top.add(own[row], ids[col], scores[row, col])


class Index:
    """Blocks of all vectors, with what a search must know of pivots and rings."""

    def __init__(self, vectors: DataFrame):
        self.spark = spark = vectors.sparkSession
        self.vectors = vectors = written(vectors, "pivot-vectors")
        norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        self.width, radius2, self.rows = vectors.agg(
            F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm2), F.lit(0.0)),
            F.count("*")).first()
        self.radius2 = radius2
        sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(
            SAMPLE_ROWS).toArrow()
        lift = lifted(matrix(sample.column("v").combine_chunks(), self.width), radius2)
        self.pivots = pivots = fit_pivots(lift, PIVOTS)
        width = self.width
        self.shared = shared = spark.sparkContext.broadcast(pivots)
        placed_arrow = to_arrow_schema(PLACED)

        def place(batches):
            for b in batches:
                if not len(b):
                    continue
                x = matrix(b.column(1), width)
                d = distances(lifted(x, radius2), shared.value)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near]),
                     b.column(0), b.column(1).cast(placed_arrow.field(3).type)],
                    schema=placed_arrow)

        placed = written(vectors.mapInArrow(place, PLACED), "pivot-placed")
        # Annuli of equal width between a pivot's nearest and farthest vector;
        # pivots times annuli rows at most come to the driver.
        span = placed.groupBy("pivot").agg(
            F.min("d").alias("lo"), F.max("d").alias("hi"),
            F.least(F.ceil(F.count("*") / F.lit(RING_ROWS)), F.lit(RINGS)).alias("many"))
        at = F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("many"))
        ringed = placed.join(F.broadcast(span), "pivot").withColumn("ring", F.when(
            F.col("hi") > F.col("lo"), F.least(at, F.col("many") - 1)).otherwise(0).cast("int"))
        rings = ringed.groupBy("pivot", "ring").agg(
            F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
        self.ring_sizes = rings = written(rings, "pivot-rings")
        self.rings = rings.collect()
        cuts = F.ceil(F.col("n") / F.lit(BLOCK_ROWS))
        sizes = F.broadcast(rings.select("pivot", "ring", cuts.alias("cuts")))
        blocks = ringed.join(sizes, ["pivot", "ring"]).withColumn(
            "sub", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int"))
        blocks_arrow = to_arrow_schema(BLOCKS)

        def pack(group):
            group = group.combine_chunks().sort_by("vec_id")
            x = matrix(group.column("v").combine_chunks(), width)
            d = group.column("d").to_numpy()
            return pa.table({
                "pivot": group.column("pivot")[:1], "ring": group.column("ring")[:1],
                "sub": group.column("sub")[:1], "low": [d.min()], "high": [d.max()],
                "ids": [group.column("vec_id").to_numpy()], "vectors": [x.tobytes()]},
                schema=blocks_arrow)

        self.blocks = written(blocks.select("pivot", "ring", "sub", "d", "vec_id", "v").groupBy(
            "pivot", "ring", "sub").applyInArrow(pack, BLOCKS), "pivot-blocks")

    def homes(self, queries: DataFrame, k: int) -> DataFrame:
        """(g, pivot, ring, vec_id, v): each query's nearest annulus of more than 2 k rows
        and its group, groups being ranges of annuli, so that their queries lie together."""
        big = [r for r in self.rings if r["n"] > 2 * k] or self.rings
        at = np.array([r["pivot"] for r in big]), np.array([r["ring"] for r in big])
        low, high = (np.array([r[c] for r in big]) for c in ("low", "high"))
        width, shared = self.width, self.shared
        arrow = to_arrow_schema(HOMES)

        def home(batches):
            for b in batches:
                if not len(b):
                    continue
                far = distances(_flat(matrix(b.column(1), width)), shared.value)
                best = _gap(far[:, at[0]], low, high).argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[0][best], pa.int32()), pa.array(at[1][best], pa.int32()),
                     b.column(0), b.column(1).cast(arrow.field(3).type)], schema=arrow)

        placed = written(queries.mapInArrow(home, HOMES), "pivot-homes")
        # A row per annulus at most, whatever the number of queries.
        sizes = placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"))
        before = Window.orderBy("pivot", "ring").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        rows = _cut(placed.count(), GROUPS, *GROUP_ROWS)
        place = F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("n"))
        return placed.join(F.broadcast(sizes), ["pivot", "ring"]).select(
            F.floor(place / F.lit(rows)).alias("g"), "pivot", "ring", "vec_id", "v")

    def bounded(self, queries: DataFrame, k: int) -> DataFrame:
        """(g, vec_id, v, bound): the k-th best score in the first block of each query's
        home, below which nothing is among its k best (minus infinity: fewer than k)."""
        at = ["g", "pivot", "ring"]
        homes = self.homes(queries, k)
        first = homes.select(*at).distinct().join(self.blocks.where("sub = 0"), ["pivot", "ring"])
        arrow, width = to_arrow_schema(QUERIES), self.width

        def seek(own, blocks):
            ids, x = _rows(own, width)
            top = Top(np.full(len(ids), -np.inf), k)
            for block_ids, y in _blocks(blocks, width):
                scan_block(top, x, ids, np.arange(len(ids)), block_ids, y)
            return pa.Table.from_arrays(
                [own.column("g"), own.column("vec_id"),
                 own.column("v").cast(arrow.field(2).type), pa.array(top.bound)], schema=arrow)

        first = first.toDF(*first.columns)  # columns of their own beside those of homes
        return written(homes.groupBy(*at).cogroup(first.groupBy(*at)).applyInArrow(
            seek, QUERIES), "pivot-queries")

    def open_rings(self, queries: DataFrame) -> DataFrame:
        """(g, pivot, ring): the annuli that a query of the group cannot rule out."""
        arrow, width, radius2, shared = to_arrow_schema(OPEN), self.width, self.radius2, self.shared
        at = np.array([[r["pivot"], r["ring"]] for r in self.rings], np.int32)
        low, high = (np.array([r[c] for r in self.rings]) for c in ("low", "high"))

        def test(batches):
            for b in batches:
                x, g = matrix(b.column(2), width), b.column(0).to_numpy()
                far = distances(_flat(x), shared.value)
                norm2 = (x ** 2).sum(1) + radius2
                reach = _reach(far[:, at[:, 0]], low, high, norm2[:, None])
                row, ring = np.nonzero(reach >= b.column(3).to_numpy()[:, None])
                met = np.unique(np.stack((g[row], ring)), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met[0]), pa.array(at[met[1], 0]), pa.array(at[met[1], 1])],
                    schema=arrow)

        return written(queries.mapInArrow(test, OPEN).distinct(), "pivot-open")

    def cells(self) -> DataFrame:
        """The blocks with their range ``h``: neighbouring annuli, equally many rows."""
        rows = _cut(self.rows, CELLS, *CELL_ROWS)
        before = Window.orderBy("pivot", "ring").rowsBetween(Window.unboundedPreceding, -1)
        base = self.ring_sizes.select("pivot", "ring", F.coalesce(
            F.sum("n").over(before), F.lit(0)).alias("base"))
        place = F.col("base") + F.col("sub") * F.lit(BLOCK_ROWS)
        return self.blocks.join(F.broadcast(base), ["pivot", "ring"]).withColumn(
            "h", F.floor(place / F.lit(rows))).drop("base")

    def top_k(self, queries: DataFrame, k: int = K) -> DataFrame:
        """(query_id, rank, vec_id, score) of queries (vec_id, v)."""
        queries = self.bounded(queries, k)
        blocks = self.cells().join(self.open_rings(queries), ["pivot", "ring"])
        asked = queries.join(blocks.select("g", "h").distinct(), "g")
        arrow, width, radius2, shared = to_arrow_schema(HITS), self.width, self.radius2, self.shared

        def seek(own, blocks):
            ids, x = _rows(own, width)
            far, norm2 = distances(_flat(x), shared.value), (x ** 2).sum(1) + radius2
            top = Top(own.column("bound").to_numpy(), k)
            # Best possible score of each query in each block.
            reach = np.array([_reach(far[:, p], low, high, norm2) for p, low, high in zip(
                *(blocks.column(c).to_pylist() for c in ("pivot", "low", "high")), strict=True)])
            packed = list(_blocks(blocks, width))
            for i in np.argsort(-reach.mean(1)):
                active = np.flatnonzero(reach[i] >= top.bound)
                if len(active):
                    scan_block(top, x, ids, active, *packed[i])
            return pa.Table.from_arrays(
                [pa.array(ids[top.query]), pa.array(top.ids),
                 pa.array(top.scores.astype(np.int64))], schema=arrow)

        blocks = blocks.toDF(*blocks.columns)  # columns of their own beside those of asked
        hits = asked.groupBy("g", "h").cogroup(blocks.groupBy("g", "h")).applyInArrow(seek, HITS)
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(ranked)).where(
            F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cut(rows: int, parts: int, least: int, most: int) -> int:
    """Rows of each of ``parts`` equal parts, within the bounds."""
    return min(max(-(-rows // parts), least), most)


def _flat(queries: np.ndarray) -> np.ndarray:
    return np.concatenate((queries, np.zeros((len(queries), 1))), 1)


def _rows(own: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    return own.column("vec_id").to_numpy(), matrix(own.column("v").combine_chunks(), width)


def _blocks(blocks: pa.Table, width: int):
    """Ids and vectors of each block."""
    for ids, vectors in zip(list_slices(blocks.column("ids").combine_chunks()),
                            blocks.column("vectors").to_pylist(), strict=True):
        yield ids, np.frombuffer(vectors).reshape(len(ids), width)


def _gap(far: np.ndarray, low: float, high: float) -> np.ndarray:
    """Least distance that the triangle inequality leaves to an annulus (less a
    little for rounding)."""
    return np.maximum(np.maximum(far - high, low - far) * (1 - 1e-9) - 1e-6, 0)


def _reach(far: np.ndarray, low: float, high: float, norm2: np.ndarray) -> np.ndarray:
    return (norm2 - _gap(far, low, high) ** 2) / 2 + 0.5


def search(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k best of all other rows for every row whose vec_id ``every`` divides."""
    spark = rows.sparkSession
    bound_batches(spark, 2000)
    vectors = integer_vectors(rows)
    result = _schema(("query_id", T.LongType()), ("rank", T.IntegerType()),
                     ("vec_id", T.LongType()), ("score", T.LongType()))
    if vectors.isEmpty():
        return spark.createDataFrame([], result)
    index = Index(vectors)
    wanted = index.vectors.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(
        F.min("v").alias("v"))
    if wanted.isEmpty():
        return spark.createDataFrame([], result)
    return index.top_k(wanted, k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

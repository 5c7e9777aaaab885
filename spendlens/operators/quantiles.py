"""Exact quantiles (linear interpolation) by repeated narrowing.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer and merges it in one task: unbounded for a hot group.  Here:

1. one aggregate per group: ``n`` and ``percentile_approx`` at q +- 2/accuracy,
   which brackets the order statistics needed for q (the sketch's rank error is
   at most n / accuracy; groups whose counts contradict that are bracketed by
   all their values);
2. one grouping of the rows by bracket and value: the values of a bracket collapse to
   one row each with their number, all values below it to one row;
3. while some bracket still holds more than ``bound`` distinct values: cut each
   bracket at about ``GRID`` even steps of its distinct values, add up the rows of
   each cell, and keep the cell that holds the wanted rank.  Only the rows of step 2,
   about 4 / accuracy of the values, are read again;
4. a running count over at most ``bound`` values gives the values at ranks
   floor(q(n-1)) and ceil(q(n-1)); result = lo + (hi - lo) * frac.

The table itself is read twice, and no task holds more than ``bound`` values of a
bracket, however large the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch, kept

BOUND = 10_000
GRID = 64


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                    accuracy: int = 100_000, bound: int = BOUND) -> DataFrame:
    """Rows ``(*by, q0, q1, ...)``: exact linear-interpolated quantiles of
    ``value`` (NULLs ignored), columns named ``q0..q{m-1}`` in ``probs`` order."""
    by = list(by or [])
    key = by or ["__all"]
    base = df.select(*by, F.col(value).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    if not by:
        base = base.withColumn("__all", F.lit(1))
    with Scratch(df.sparkSession) as keep:
        brackets = keep(_brackets(base, key, probs, accuracy))
        values = keep(_bracketed(base, brackets, key, len(probs)))
        targets = keep(_targets(values, brackets, key, probs))
        if not targets.where(~F.col("__holds")).isEmpty():  # the sketch erred: take all values
            wide = F.transform("__b", lambda x, i: F.when(i % 2 == 0, F.lit(float("-inf")))
                               .otherwise(F.lit(float("inf"))))
            values = keep(_bracketed(base, brackets.withColumn("__b", wide), key, len(probs)))
            targets = keep(_targets(values, brackets, key, probs))
        cells = values.where(F.col("__v").isNotNull()).join(
            targets.select(*key, "__i", "__t", "__rank", "__below"), [*key, "__i"])
        cells = _narrowed(cells, [*key, "__t"], bound, keep)
        result = kept(_interpolated(cells, targets, key, len(probs)))
    return result.drop("__all") if not by else result


def _brackets(base: DataFrame, key: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """(key, __n, __b): for each q the lower and upper end of its bracket."""
    # percentile_approx takes constant percentages, so two brackets per q are
    # sketched (tight: +-2/accuracy, wide: +-1%) and each group picks the
    # tightest that spans at least 8 ranks; groups under 800 rows use all rows.
    eps, wide = 2.0 / accuracy, 0.01
    edges = []
    for q in probs:
        edges += [max(0.0, q - eps), min(1.0, q + eps), max(0.0, q - wide), min(1.0, q + wide)]
    sketch = base.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"),
                                    F.percentile_approx("__x", edges, accuracy).alias("__e"))
    n, e, inf = F.col("__n"), F.col("__e"), float("inf")
    tight, loose = n * eps >= 8, n * wide >= 8
    ends = []
    for i in range(len(probs)):
        for side, end in ((0, -inf), (1, inf)):
            ends.append(F.when(tight, e[4 * i + side]).when(loose, e[4 * i + 2 + side])
                        .otherwise(F.lit(end)))
    return sketch.select(*key, "__n", F.array(*ends).alias("__b"))


def _bracketed(base: DataFrame, brackets: DataFrame, key: list[str], m: int) -> DataFrame:
    """(key, __i, __v, __c): the distinct values of each bracket with their numbers, and
    as value NULL the number of values below it."""
    b = F.col("__b")
    at = [F.when(F.col("__x") <= b[2 * i + 1], F.struct(F.lit(i).alias("__i"), F.when(
        F.col("__x") >= b[2 * i], F.col("__x")).alias("__v"))) for i in range(m)]
    # K group rows: AQE broadcasts them after measuring
    return base.join(brackets.select(*key, "__b"), key).select(
        *key, F.explode(F.array_compact(F.array(*at))).alias("__s")).select(*key, "__s.*").groupBy(
        *key, "__i", "__v").agg(F.count(F.lit(1)).alias("__c"))


def _targets(values: DataFrame, brackets: DataFrame, key: list[str], probs: list[float]) -> DataFrame:
    """(key, __i, __t, __rank, __below, __frac, __holds): target 2 i is the rank below
    quantile i, 2 i + 1 the rank above."""
    v = F.col("__v")
    counts = values.groupBy(*key, "__i").agg(
        F.coalesce(F.sum(F.when(v.isNull(), F.col("__c"))), F.lit(0)).alias("__below"),
        F.coalesce(F.sum(F.when(v.isNotNull(), F.col("__c"))), F.lit(0)).alias("__inside"))
    q = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i") + 1)
    rows = brackets.select(*key, "__n", F.explode(F.array(*map(F.lit, range(len(probs))))).alias(
        "__i")).withColumn("__pos", q * (F.col("__n") - 1)).join(counts, [*key, "__i"], "left")
    sides = F.array(F.floor("__pos").cast("long"), F.ceil("__pos").cast("long"))
    rows = rows.select(*key, "__i", "__below", "__inside", "__pos",
                       F.posexplode(sides).alias("__side", "__rank"))
    below = F.coalesce("__below", F.lit(0))
    holds = (below <= F.col("__rank")) & (F.col("__rank") < below + F.coalesce("__inside", F.lit(0)))
    return rows.select(*key, "__i", (2 * F.col("__i") + F.col("__side")).alias("__t"), "__rank",
                       below.alias("__below"), (F.col("__pos") - F.floor("__pos")).alias("__frac"),
                       holds.alias("__holds"))


def _narrowed(cells: DataFrame, key: list[str], bound: int, keep) -> DataFrame:
    """Shrinks every target's values (key, __v, __c, __rank, __below) until none has more
    than ``bound``; the wanted rank stays among them."""
    grid = [i / GRID for i in range(1, GRID)]
    while True:
        cells = keep(cells)
        sizes = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("__d"))
        if not sizes.where(F.col("__d") > bound).count():
            return cells
        cuts = keep(cells.groupBy(*key).agg(F.count(F.lit(1)).alias("__d"),
                                            F.percentile_approx("__v", grid, 1000).alias("__cuts")))
        # the cell of a value: how many cuts lie below it
        cell = F.when(F.col("__d") > bound, F.size(F.filter(
            "__cuts", lambda c: c < F.col("__v")))).otherwise(F.lit(0))
        placed = cells.join(cuts, key).withColumn("__cell", cell).drop("__cuts", "__d")
        order = Window.partitionBy(*key).orderBy("__cell")
        sums = placed.groupBy(*key, "__cell").agg(
            F.sum("__c").alias("__in"), F.first("__rank").alias("__r"),
            F.first("__below").alias("__b")).withColumn(
            "__upto", F.col("__b") + F.sum("__in").over(order))  # at most GRID rows
        chosen = sums.where((F.col("__upto") > F.col("__r"))
                            & (F.col("__upto") - F.col("__in") <= F.col("__r"))).select(
            *key, "__cell", (F.col("__upto") - F.col("__in")).alias("__new"))
        cells = placed.join(chosen, [*key, "__cell"]).withColumn("__below", F.col("__new")).drop(
            "__cell", "__new")


def _interpolated(cells: DataFrame, targets: DataFrame, key: list[str], m: int) -> DataFrame:
    upto = F.col("__below") + F.sum("__c").over(Window.partitionBy(*key, "__t").orderBy("__v"))
    found = cells.withColumn("__upto", upto).where(F.col("__upto") > F.col("__rank")).groupBy(
        *key, "__t").agg(F.min("__v").alias("__v"))
    rows = targets.join(found, [*key, "__t"])
    low, high = (F.max(F.when(F.col("__t") % 2 == s, F.col("__v"))) for s in (0, 1))
    per_q = rows.groupBy(*key, "__i").agg(low.alias("__lo"), high.alias("__hi"),
                                          F.first("__frac").alias("__frac"))
    per_q = per_q.withColumn("__q", F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__frac"))
    return per_q.groupBy(*key).agg(*[F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(f"q{i}")
                                     for i in range(m)])

"""Periodic runs of words, by scale-tiled distribution.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``max(min_length, 2 q)`` words long, that no
neighbouring word extends.  Words are runs of characters other than ASCII white
space, numbered from 0.

1. *Tiles.*  The periods are cut into octaves [P, 2P).  A document is exploded
   into overlapping tiles per octave: small octaves share tiles of ``TILE`` words,
   octave P beyond them has tiles of 8 P words, each with 2 P words before and
   4 P words behind.  Short documents share a tile; their words get names of their
   own, so nothing matches across documents.
2. *Boundary Z-functions.*  A tile has a boundary every P / 2 words.  For boundary
   c and period q the Z-function (how far c and c + q agree) forwards and its mirror
   backwards bound the stretch of period q around c.  Every run of the octave
   covers a boundary at which c and c + q start with the same short gram, so
   only these offsets are evaluated, all boundaries of a tile at once, on exact
   ranks of the grams of 1, 2, 4, ... words (no fingerprints of grams).  A tile
   is solved without looking at any other.
3. *Stitching.*  The fragments (document row, period, interval) are shuffled by
   document and period, and intervals that touch are joined: fragments of one run
   overlap in neighbouring tiles, different runs of one period never touch.
   Of the periods of one interval the smallest is the run's.

Texts do not travel with the fragments; only texts with a fragment are written
once more and meet their document's runs to be collapsed.  A word is dropped if a
run holds it after that run's first q words.

Edge cases: NULL, empty and white-space texts have no words, no run, and the
digests of the empty text; rows that repeat an id or a text are judged each on
its own; a NULL id counts as the empty text where ``echo`` hashes ids; very
long texts cost about 100 bytes of memory a word of their largest tile; extra
columns are ignored, whatever their names; an empty table gives no rows.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from spendlens.llm.common import bound_batches, raw_texts, written

TILE = 1 << 16
MIN_LENGTH = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


# ---------------------------------------------------------------- one tile
def _named(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the keys at positions ``at``; -1 where no other position has the key."""
    out = np.full(n, -1, np.int64)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], np.diff(keys[order]) != 0))
        group = np.cumsum(new) - 1
        often = np.bincount(group)[group] > 1
        out[at[order[often]]] = group[often]
    return out


class Ranks:
    """For each k the ranks of all grams of 2^k words that occur twice or more."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        self.levels = [_named(words, np.arange(n), n)]
        while True:
            last, width = self.levels[-1], 1 << (len(self.levels) - 1)
            at = np.flatnonzero(last[:max(n - width, 0)] >= 0)
            at = at[last[at + width] >= 0]
            level = _named(last[at] * (n + 1) + last[at + width], at, n)
            if not (level >= 0).any():
                break
            self.levels.append(level)

    def extensions(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Z-values: how many words agree from i and j on, or before them (i < j)."""
        z = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[k], 1 << k
            a, b = (i + z, j + z) if forward else (i - z - width, j - z - width)
            inside = (b + width <= self.n) if forward else (a >= 0)
            x = level[np.where(inside, a, 0)]
            z += width * (inside & (x >= 0) & (x == level[np.where(inside, b, 0)]))
        return z

    def at_distance(self, k: int, c: np.ndarray, low: int, high: int):
        """All (c, position) with equal grams of 2^k words, low <= distance < high."""
        level = self.levels[k]
        c = c[level[c] >= 0]
        at = np.flatnonzero(level >= 0)
        at = at[np.argsort(level[at], kind="stable")]
        keys = level[at] * (self.n + 1) + at
        base = level[c] * (self.n + 1)
        lo = np.searchsorted(keys, base + np.minimum(c + low, self.n))
        many = np.searchsorted(keys, base + np.minimum(c + high, self.n)) - lo
        first = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many)
        return np.repeat(c, many), at[first + np.arange(len(first))]


def _spacing(period: int) -> int:
    """Words between boundaries: fewer than a run of the octave has positions at
    which the gram of ``_gram_level`` recurs one period later."""
    return {1: 4, 2: 4, 4: 3, 8: 4}.get(period, period // 2)


def _gram_level(period: int) -> int:
    return max(2, period.bit_length() - 3)


def solve(words: np.ndarray, octaves: range, core: range, min_length: int = MIN_LENGTH):
    """Fragments (period, start, stop) of a tile, for boundaries in ``core``; octave
    o has the periods 2^o to 2^(o+1) - 1."""
    if len(words) < min_length:
        return np.empty((0, 3), np.int64)
    ranks, found = Ranks(words), []
    for o in octaves:
        low, level = 1 << o, _gram_level(1 << o)
        if level >= len(ranks.levels):
            break
        c, j = ranks.at_distance(level, np.arange(core.start, core.stop, _spacing(low)), low, 2 * low)
        if not len(c):
            continue
        q = j - c
        ahead, behind = ranks.extensions(c, j, True), ranks.extensions(c, j, False)
        keep = ahead + behind >= np.maximum(q, min_length - q)
        found.append(np.unique(np.stack((q, c - behind, j + ahead), 1)[keep], axis=0))
    if not sum(map(len, found)):
        return np.empty((0, 3), np.int64)
    # Of one interval's periods the smallest: a stretch of twice the period has a
    # smaller one only if the whole run has.
    all_found = np.concatenate(found)
    order = np.lexsort((all_found[:, 0], all_found[:, 2], all_found[:, 1]))
    rows = all_found[order]
    return rows[np.concatenate(([True], (np.diff(rows[:, 1:], axis=0) != 0).any(axis=1)))]


def tiles(n: int, tile: int = TILE) -> Iterator[tuple[range, range, range]]:
    """(octaves, slice, core inside the slice) of a document of n words."""
    top = max((n // 2).bit_length(), 1)
    if n <= tile:
        yield range(top), range(n), range(n)
        return
    shared = min(max((tile // 16).bit_length(), 1), top)
    steps = [(range(shared), tile, 1 << (shared - 1))]
    steps += [(range(o, o + 1), 8 << o, 1 << o) for o in range(shared, top)]
    for octaves, size, low in steps:
        for start in range(0, n, size):
            a, b = max(start - 2 * low, 0), min(start + size + 4 * low, n)
            yield octaves, range(a, b), range(start - a, min(start + size, n) - a)


# ---------------------------------------------------------------- one task
class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def group_fragments(hashes: list[np.ndarray], tile: int = TILE, min_length: int = MIN_LENGTH):
    """Fragments of each of the documents (arrays of word hashes)."""
    out: list[np.ndarray | None] = [None] * len(hashes)

    def shared(group: list[int]) -> None:
        starts = np.cumsum([0, *(len(hashes[i]) for i in group)])
        with np.errstate(over="ignore"):
            words = np.concatenate([hashes[i] + np.uint64(k) * _ODD for k, i in enumerate(group)])
        longest = max(len(hashes[i]) for i in group)
        found = solve(words.view(np.int64), range(max((longest // 2).bit_length(), 1)),
                      range(len(words)), min_length)
        owner = np.searchsorted(starts, found[:, 1], side="right") - 1
        for k, i in enumerate(group):
            mine = found[owner == k]
            mine[:, 1:] -= starts[k]
            out[i] = mine

    group, size = [], 0
    for i, words in enumerate(hashes):
        if len(words) > tile:
            parts = []
            for octaves, part, core in tiles(len(words), tile):
                one = solve(words[part.start:part.stop].view(np.int64), octaves, core, min_length)
                one[:, 1:] += part.start
                parts.append(one)
            out[i] = np.unique(np.concatenate(parts), axis=0)
        elif len(words) < min_length:
            out[i] = np.empty((0, 3), np.int64)
        else:
            if size + len(words) > tile:
                shared(group)
                group, size = [], 0
            group.append(i)
            size += len(words)
    if group:
        shared(group)
    return out


def echo(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Rewrites a tenth of the documents, by a hash of the id: from a position on they
    repeat a stretch of their own words."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + period]
    return words[:a] + (unit * ((n - a) // period + 1))[:n - a]


_SCANNED = ("row long, doc_id long, text binary, digest string, "
            "fragments array<struct<period:long,start:long,stop:long>>")


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def scan(docs: DataFrame, rewrite: Rewrite | None = None, tile: int = TILE,
         min_length: int = MIN_LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per document, written: a row number of its own, the fragments of all
    its tiles, and its text if it has any (or ``keep_text``), else the digest of its
    words."""
    schema = _parse_datatype_string(_SCANNED)
    arrow = to_arrow_schema(schema)

    def task(batches):
        known, row = _Hashes(), TaskContext.get().partitionId() << 40
        for b in batches:
            ids, texts = b.column(0).to_pylist(), raw_texts(b.column(1))
            words = [t.split() for t in texts]
            if rewrite is not None:
                words = [rewrite(i, w) for i, w in zip(ids, words, strict=True)]
            hashes = [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in words]
            found = group_fragments(hashes, tile, min_length)
            some = [keep_text or len(x) > 0 for x in found]
            offsets = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            cells = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)],
                                               fields=list(arrow.field(4).type.value_type))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(ids)), pa.int64()),
                b.column(0).cast(pa.int64()),
                pa.array([t if s else None for t, s in zip(texts, some, strict=True)], pa.binary()),
                pa.array([None if s else _digest(w) for w, s in zip(words, some, strict=True)]),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells).cast(
                    arrow.field(4).type)], schema=arrow)
            row += len(ids)

    bound_batches(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                   .mapInArrow(task, schema), "runs-scanned")


# ---------------------------------------------------------------- stitching
def stitch(fragments: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Runs (row, start, length, period) from fragments (row, period, start, stop).

    In terms of the positions whose word recurs one period later, a fragment is
    [start, stop - period); these intervals touch within a run and never
    between runs."""
    own = Window.partitionBy("row", "period").orderBy("start", "stop")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col("start") > reach - F.col("period"))
    numbered = fragments.withColumn("opens", opens.cast("int")).withColumn(
        "run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("row", "period", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"))
    return whole.where(F.col("stop") - F.col("start") >= F.greatest(
        F.lit(min_length), 2 * F.col("period"))).groupBy("row", "start", "stop").agg(
        F.min("period").alias("period")).select(
        "row", "start", (F.col("stop") - F.col("start")).alias("length"), "period")


def _runs(scanned: DataFrame, min_length: int) -> DataFrame:
    return stitch(scanned.where(F.size("fragments") > 0).select(
        "row", F.explode("fragments").alias("f")).select("row", "f.*"), min_length)


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None, tile: int = TILE,
              min_length: int = MIN_LENGTH) -> DataFrame:
    """Every run of every document: row, doc_id, start, length, period."""
    scanned = scan(docs, rewrite, tile, min_length)
    return _runs(scanned, min_length).join(scanned.select("row", "doc_id"), "row")


_REPORT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string, collapsed string")


def _collapsed(rewrite: Rewrite | None, keep_text: bool):
    schema = _parse_datatype_string(_REPORT)
    arrow = to_arrow_schema(schema)

    def task(batches):
        for b in batches:
            rows = []
            for doc_id, text, runs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = (text or b"").split()
                words = rewrite(doc_id, words) if rewrite is not None else words
                runs = sorted(((r["start"], r["length"], r["period"]) for r in runs or ()),
                              key=lambda r: (r[0], r[2]))
                keep = np.ones(len(words), bool)
                for start, length, period in runs:
                    keep[start + period:start + length] = False
                kept = [words[i] for i in np.flatnonzero(keep)]
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                said = "".join("%d,%d,%d\n" % r for r in runs)
                rows.append((doc_id, len(runs), *(best or (None,) * 3),
                             best and 1000 * best[1] // best[2],
                             hashlib.sha256(said.encode()).hexdigest(), _digest(kept),
                             b" ".join(kept).decode("utf-8", "replace") if keep_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return task, schema


def report(docs: DataFrame, rewrite: Rewrite | None = None, tile: int = TILE,
           min_length: int = MIN_LENGTH, keep_text: bool = False) -> DataFrame:
    """Per document its number of runs, the longest one (ties: smallest start, then
    period), digests of all runs and of the collapsed text, and with ``keep_text``
    the collapsed text itself as ``collapsed``."""
    scanned = scan(docs, rewrite, tile, min_length, keep_text)
    runs = _runs(scanned, min_length).groupBy("row").agg(
        F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    task, schema = _collapsed(rewrite, keep_text)
    some = F.col("text").isNotNull()
    repeated = scanned.where(some).select("row", "doc_id", "text").join(runs, "row", "left").select(
        "doc_id", "text", "runs").mapInArrow(task, schema)
    if keep_text:
        return repeated
    none, empty = F.lit(None).cast("long"), hashlib.sha256(b"").hexdigest()
    plain = scanned.where(~some).select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"),
        none.alias("period"), none.alias("exponent_milli"), F.lit(empty).alias("runs_sha256"),
        F.col("digest").alias("collapsed_sha256"))
    return plain.unionByName(repeated.drop("collapsed"))

"""LM scoring: prediction by partial matching over a byte-context trie.

A text is its words (ASCII lower-cased runs without white space), each closed by
a blank, and one end.  Its bytes are coded one after the other in the contexts of up to
``ORDER`` preceding bytes, which run on over blanks into the words before; ahead of
a text stand ``ORDER`` blanks, which no other place has.  A context seen in
training codes a byte it knows by its share of the counts, and escapes for
others to the next shorter context, in which the symbols of the longer one are
excluded; below the empty context the symbols never seen share the rest evenly.
The escape probability is estimated by leaving each training symbol out in turn,
pooled over contexts of one order, size and number of symbols.  Training
documents are dealt to one trie per class (language), and a text's probability
is the mixture over the tries by the classes' shares; its own class is not used.
The end is coded in the contexts of no and one byte only (a blank stands before it),
so it costs every text the same.

In Spark: one pass counts the keys (longest context and symbol) of all documents,
combined in the task before the shuffle.  Counts of shorter contexts are sums of these,
so the table holds each key once a class and grows with the input.  It is dealt to
tasks by the last two bytes of the context, so a context of two bytes or more
meets all shorter ones down to two in its task; those of no or one byte (fewer
than 2^17 keys a class, whatever the input) are a broadcast, the root.  One pass
sums up the escape estimates, a second one codes every key once for each class.  A
document's sums use broadcasts of the most frequent keys and words (at most
``HEAD_KEYS`` and ``HEAD_WORDS``); its others are joined to the tables.  What is
too rare for a broadcast has few rows by definition, so no join key is hot.

Edge cases: NULL and empty texts are one end; repeated documents are scored
each; without training rows every base probability is 1 and the trie is empty;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens.llm.common import bound_batches, held_out, raw_texts, written

ORDER = 5
END = 256
SYMBOLS = 257
HEAD_WORDS = 1 << 18
HEAD_KEYS = 1 << 20
#: Contexts shorter than this go with every part of the trie.
ROOT_ORDER = 2
#: Tries for the most frequent classes of training documents, and one for others.
MAX_CLASSES = 6
#: A task hands on its counts when it holds this many words, or keys.
TASK_WORDS = 300_000
TASK_KEYS = 2_000_000
#: Bytes whose contexts are worked out together when counted, and when scored.
RUN_BYTES = 1 << 20
SCORED_BYTES = 1 << 18
FOLDS, HELD_OUT = 10, 0
SMOOTHING = 0.1

# A context is (bytes << 3 | length); a key is (context << 9 | symbol).
_LEN, _SYM = 3, 9
_KEY = 8 * ORDER + _LEN + _SYM


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_BEGIN = b" " * ORDER


def words(text: bytes) -> list[bytes]:
    """What of a text is coded: one run of all its words behind the mark of its beginning
    (none without words)."""
    return _run(text.lower().split())


def _run(found: list[bytes]) -> list[bytes]:
    return [_BEGIN + b" ".join(found)] if found else []


# ---- contexts of a batch of runs, as arrays ---------------------------------

def positions(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, run number, place and preceding bytes (packed, the last byte lowest) of each
    coded position; a run ends with a blank.  The mark of a beginning is no position but the
    context of the next ones, so all of them have places of at least ``ORDER`` - 1; a run
    without it is one word behind a blank, with places from 0."""
    sizes = np.fromiter(map(len, batch), np.int64, len(batch)) + 1
    skip = np.fromiter((ORDER if r.startswith(_BEGIN) else 0 for r in batch), np.int64, len(batch))
    flat = np.frombuffer(b" ".join(batch) + b" ", np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(batch)), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    within = np.arange(len(flat)) - starts[owner]
    history = np.zeros(len(flat), np.int64)
    padded = np.concatenate((np.full(ORDER, 0x20), flat))
    for back in range(ORDER, 0, -1):
        history = history << 8 | padded[ORDER - back:len(flat) + ORDER - back]
    marked = skip[owner]
    place = within - (marked > 0)
    coded = within >= marked
    return flat[coded], owner[coded], place[coded], history[coded]


def _pieces(run: bytes, most: int):
    """A long run cut at blanks; each piece begins with the ``ORDER`` bytes before it."""
    at = ORDER
    while len(run) - at > most:
        blank = run.rfind(b" ", at, at + most)
        if blank < 0:
            blank = run.find(b" ", at)
        if blank < 0:
            break
        yield run[at - ORDER:blank]
        at = blank + 1
    yield run[at - ORDER:]


def _parts(runs: list[list[bytes]], most: int):
    """(numbers of the texts, pieces of their runs) in parts of about ``most`` bytes."""
    numbers, pieces, size = [], [], 0
    for i, run in ((i, run) for i, of_text in enumerate(runs) for run in of_text):
        for piece in _pieces(run, most):
            numbers.append(i)
            pieces.append(piece)
            size += len(piece)
            if size >= most:
                yield np.array(numbers), pieces
                numbers, pieces, size = [], [], 0
    if pieces:
        yield np.array(numbers), pieces


def text_keys(runs: list[list[bytes]], most: int):
    """(text number, key) of all coded positions, in parts and in the texts' order, from the
    ``words`` of each text; a key is the longest context and the symbol."""
    for numbers, pieces in _parts(runs, most):
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        flat = b" " * 7 + b" ".join(pieces) + b" "
        # eight bytes up to each position as one number
        last = np.ndarray((len(flat) - 7,), ">u8", flat, strides=(1,)).astype(np.uint64)
        key = (last >> 8 & ((1 << 8 * ORDER) - 1)) << (_LEN + _SYM) | ORDER << _SYM | last & 255
        coded = np.ones(len(key), bool)
        coded[((np.cumsum(sizes) - sizes)[:, None] + np.arange(ORDER)).ravel()] = False
        yield np.repeat(numbers, sizes - ORDER), key[coded].view(np.int64)


def contexts(history: np.ndarray, order: int) -> np.ndarray:
    return (history & ((1 << 8 * order) - 1)) << _LEN | order


# ---- the trie ------------------------------------------------------------------

#: Escape probabilities are kept by order, size and number of symbols of a context.
_SIZES, _KINDS = 40, 48


def _bucket(order: np.ndarray, total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    size = np.minimum(2 * np.log2(np.maximum(total, 0) + 1), _SIZES - 1).astype(np.int64)
    return (order * _SIZES + size) * _KINDS + np.minimum(distinct, _KINDS - 1)


_BUCKETS = (ORDER + 1) * _SIZES * _KINDS


def _missed(order, total, distinct, unseen, events) -> np.ndarray:
    """Sums of ``unseen`` symbols and of all ``events`` by kind of context."""
    at = _bucket(order, total, distinct)
    return np.stack((np.bincount(at, events * unseen, _BUCKETS),
                     np.bincount(at, events, _BUCKETS))).astype(float)


def _escapes(sums: np.ndarray) -> np.ndarray:
    """Share of unseen symbols among the events for each kind of context."""
    missed, all_ = sums
    n = np.arange(_BUCKETS)
    size, kinds = (n // _KINDS) % _SIZES, n % _KINDS
    # A context like no other in training escapes by method C.
    by_c = (kinds + 0.5) / (2.0 ** (size / 2) + kinds)
    return (missed + by_c) / (all_ + 1)


@dataclass
class Trie:
    keys: np.ndarray       # sorted
    counts: np.ndarray
    nodes: np.ndarray      # sorted contexts
    total: np.ndarray
    distinct: np.ndarray
    rest_total: np.ndarray     # of the next shorter context, without this one's symbols
    rest_distinct: np.ndarray
    sums: np.ndarray           # ``_missed`` of the contexts and of the rests
    escape: np.ndarray         # by kind of context, no symbol excluded
    rest_escape: np.ndarray    # the same with symbols of the longer context excluded

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, least: int = 0,
           sums: np.ndarray | None = None) -> Trie:
        """A trie, or the part of one that holds with each context all shorter
        ones.  Escapes are estimated from ``sums`` of the whole trie, or from the
        contexts of ``least`` bytes and more that are given."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        nodes, first, distinct = np.unique(keys >> _SYM, return_index=True, return_counts=True)
        total = np.add.reduceat(counts, first) if len(keys) else counts
        length = nodes & ((1 << _LEN) - 1)
        # The next shorter context drops the oldest (highest) byte.
        shorter = ((nodes >> _LEN) & ((1 << 8 * np.maximum(length - 1, 0)) - 1)) << _LEN \
            | np.maximum(length - 1, 0)
        parent = np.searchsorted(nodes, shorter)
        node = np.repeat(np.arange(len(nodes)), distinct)
        same = np.searchsorted(keys, shorter[node] << _SYM | keys & ((1 << _SYM) - 1))
        shared = np.add.reduceat(counts[same], first) if len(keys) else counts
        rest_total, rest_distinct = total[parent] - shared, distinct[parent] - distinct
        if sums is None:
            # Escape estimation: leave each training symbol out in turn and see
            # whether its context still knows it.
            lone, own = counts == 1, length[node] >= least
            at = node[own]
            own_sums = _missed(length[at], total[at] - 1, distinct[at] - lone[own], lone[own],
                               counts[own])
            # A symbol left out of a context that saw it once is looked for in the
            # next shorter one, among the symbols the longer one does not know.
            left = lone & own & (length[node] > 0)
            wider, at = counts[same][left], node[left]
            rest_sums = _missed(length[at] - 1, rest_total[at] + wider - 1,
                                rest_distinct[at] + (wider > 1), wider == 1,
                                np.ones(len(at), np.int64))
            sums = np.stack((own_sums, rest_sums))
        return cls(keys, counts, nodes, total, distinct, rest_total, rest_distinct, sums,
                   _escapes(sums[0]), _escapes(sums[1]))

    def log10(self, symbol: np.ndarray, history: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log probability of each symbol in its contexts."""
        out = np.zeros(len(symbol))
        open_at = np.arange(len(symbol))
        longer = np.full(len(symbol), -1)
        for order in range(ORDER, -1, -1):
            if not len(self.nodes) or not len(open_at):
                break
            at = open_at[place[open_at] + 1 >= order]
            context = contexts(history[at], order)
            node = np.minimum(np.searchsorted(self.nodes, context), len(self.nodes) - 1)
            there = self.nodes[node] == context
            at, node = at[there], node[there]
            key = context[there] << _SYM | symbol[at]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            child = longer[at]
            free = child < 0
            total = np.where(free, self.total[node], self.rest_total[child])
            distinct = np.where(free, self.distinct[node], self.rest_distinct[child])
            kind = _bucket(np.full(len(at), order), total, distinct)
            escape = np.where(free, self.escape[kind], self.rest_escape[kind])
            # Without new symbols a context is passed free of cost.
            part = np.where(hit, (1 - escape) * self.counts[found] / np.maximum(total, 1), escape)
            out[at] += np.where(total > 0, np.log10(part), 0)
            longer[at] = node
            gone = np.zeros(len(symbol), bool)
            gone[at[hit]] = True
            open_at = open_at[~gone[open_at]]
        seen = self.distinct[0] if len(self.nodes) and self.nodes[0] == 0 else 0
        out[open_at] -= np.log10(max(SYMBOLS - seen, 1))
        return out

    def words_log10(self, batch: list[bytes]) -> np.ndarray:
        """Log probability of each word with its closing blank."""
        if not batch:
            return np.zeros(0)
        symbol, owner, place, history = positions(batch)
        return np.bincount(owner, self.log10(symbol, history, place), len(batch))

    def end_log10(self) -> float:
        return float(self.log10(np.array([END]), np.array([0x20]), np.array([0]))[0])


# ---- Spark jobs ------------------------------------------------------------------

def _classes(docs: DataFrame) -> list[tuple[str | None, int]]:
    """The most frequent classes of training documents with their numbers of
    documents; the last entry (None) stands for all others."""
    sizes = docs.where("train").groupBy("kind").count()
    top = sizes.where(F.col("kind").isNotNull()).orderBy(F.desc("count"), "kind").limit(
        MAX_CLASSES).collect()
    total = sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    found = [(r["kind"], r["count"]) for r in top]
    rest = total - sum(n for _, n in found)
    return [*found, (None, rest)] if rest or not found else found


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): the words of the training rows of ``docs`` (text, train) with their counts."""
    schema = _schema(("word", T.BinaryType()), ("c", T.LongType()))
    arrow = to_arrow_schema(schema)

    def count(batches):
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), arrow.field(0).type),
                                               pa.array(list(seen.values()), pa.int64())],
                                              schema=arrow)

        for b in batches:
            for text in raw_texts(b.column(0)):
                seen.update(text.lower().split())
                if len(seen) > TASK_WORDS:
                    yield rows()
                    seen.clear()
        yield rows()

    return docs.where("train").select("text").mapInArrow(count, schema).groupBy("word").agg(
        F.sum("c").alias("c"))


def key_counts(docs: DataFrame, n_classes: int) -> DataFrame:
    """(class, key, n) of all positions of ``docs`` (text, train, class); those of other than
    training rows have the class ``n_classes``."""
    schema = _schema(("class", T.IntegerType()), ("key", T.LongType()), ("n", T.LongType()))
    arrow = to_arrow_schema(schema)

    def count(batches):
        keys = sums = np.zeros(0, np.int64)

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array((keys >> _KEY).astype(np.int32)), pa.array(keys & ((1 << _KEY) - 1)),
                 pa.array(sums)], schema=arrow)

        for b in batches:
            kind = np.where(b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(),
                            n_classes).astype(np.int64)
            for owner, key in text_keys(list(map(words, raw_texts(b.column(0)))), RUN_BYTES):
                # the class stands above the bits of a key
                new, n = np.unique(kind[owner] << _KEY | key, return_counts=True)
                at = np.searchsorted(keys, new)
                old = np.append(keys, -1)[at] == new
                sums[at[old]] += n[old]
                keys, sums = (np.insert(x, at[~old], y[~old]) for x, y in ((keys, new), (sums, n)))
                if len(keys) > TASK_KEYS:
                    yield rows()
                    keys = sums = keys[:0]
        yield rows()

    return docs.select("text", "train", "class").mapInArrow(count, schema).groupBy(
        "class", "key").agg(F.sum("n").alias("n"))


def _at_most(table: DataFrame, column: str, limit: int) -> int:
    """Smallest count of at most ten significant bits such that at most ``limit`` rows have
    it or more.  Rounding leaves a few thousand different counts whatever the input, and
    a row below has at most 1 / ``limit`` of the sum of all counts (and 0.2 % more)."""
    c = F.col(column)
    unit = F.expr(f"shiftleft(1L, greatest(length(bin({column})) - 10, 0))")
    sizes = table.select((c - c % unit).alias("c")).groupBy("c").count()
    left, least = limit, 1 << 62
    for r in sorted(sizes.collect(), key=lambda r: -r["c"]):
        if r["count"] > left:
            return least
        left, least = left - r["count"], r["c"]
    return 1


def _branch(key: str) -> Column:
    """Last two bytes of a key's context, by which the trie is dealt to tasks."""
    return F.shiftright(key, _SYM + _LEN).bitwiseAND(F.lit(0xFFFF))


def shorter(keys: np.ndarray, counts: np.ndarray, orders) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ``orders`` of contexts and their counts, from the keys of longest contexts."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for order in orders:
        some = contexts(keys >> (_SYM + _LEN), order) << _SYM | keys & ((1 << _SYM) - 1)
        one, inverse = np.unique(some, return_inverse=True)
        found.append((one, np.bincount(inverse, counts, len(one)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _whole(batches, width: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """A task's part (class, key, n): keys and counts of each class with contexts of
    ``ROOT_ORDER`` bytes and more, and all rows' keys and counts."""
    found = [tuple(b.column(i).to_numpy() for i in range(3)) for b in batches]
    kind, key, n = (np.concatenate([np.zeros(0, np.int64), *x])
                    for x in (zip(*found, strict=True) if found else ((), (), ())))
    parts = [shorter(key[kind == k], n[kind == k], range(ROOT_ORDER, ORDER + 1))
             for k in range(width)]
    return parts, key, n


@dataclass
class Root:
    """What is known of all tries in every task: their keys and counts of
    contexts below ``ROOT_ORDER`` and the sums for the escapes, by class."""

    keys: list[np.ndarray]
    counts: list[np.ndarray]
    sums: list[np.ndarray]

    def trie(self, k: int, keys=(), counts=(), own: bool = False) -> Trie:
        """Class ``k``'s trie of the root and ``keys``; ``own``: with the sums of
        the keys themselves."""
        return Trie.of(np.concatenate((self.keys[k], np.asarray(keys, np.int64))),
                       np.concatenate((self.counts[k], np.asarray(counts, np.int64))),
                       ROOT_ORDER, None if own else self.sums[k])


def trie_root(pairs: DataFrame, sizes: list[int]) -> Root:
    """The root of the tries of ``pairs`` (class, key, n); ``sizes`` are the
    classes' training documents."""
    spark, width = pairs.sparkSession, len(sizes)
    last = F.shiftright("key", _SYM + _LEN).bitwiseAND(F.lit(0xFF))
    few = pairs.where(F.col("class") < width).groupBy(
        "class", (F.shiftleft(last, _SYM + _LEN) + F.col("key").bitwiseAND(
            F.lit((1 << _SYM) - 1))).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    kind, key, n = (few.column(c).to_numpy() for c in ("class", "key", "n"))
    root, blank = Root([], [], []), np.array([0x20])
    for k, ends in enumerate(sizes):
        keys, counts = shorter(key[kind == k], n[kind == k], range(ROOT_ORDER))
        if ends:  # the end stands where a word could begin
            ends_at = [int(contexts(blank, order)[0]) << _SYM | END for order in (0, 1)]
            keys = np.concatenate((keys, ends_at))
            counts = np.concatenate((counts, [ends, ends]))
        root.keys.append(keys)
        root.counts.append(counts)
        root.sums.append(Trie.of(keys, counts).sums)
    shared = spark.sparkContext.broadcast(root)
    schema = _schema(("class", T.IntegerType()), ("what", T.IntegerType()),
                     ("at", T.IntegerType()), ("n", T.DoubleType()))
    arrow = to_arrow_schema(schema)

    def add_up(batches):
        parts, _, _ = _whole(batches, width)
        for k, (keys, counts) in enumerate(parts):
            if len(keys):
                sums = shared.value.trie(k, keys, counts, own=True).sums.reshape(4, -1)
                what, at = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k, np.int32)), pa.array(what, pa.int32()),
                     pa.array(at, pa.int32()), pa.array(sums[what, at])], schema=arrow)

    # Whole numbers, so the order of the additions does not matter.
    found = pairs.where(F.col("class") < width).select("class", "key", "n").repartition(
        _branch("key")).mapInArrow(add_up, schema).groupBy("class", "what", "at").agg(
        F.sum("n").alias("n")).toArrow()
    kind, what, at, n = (found.column(i).to_numpy() for i in range(4))
    for k in range(width):
        mine = kind == k
        root.sums[k].reshape(4, -1)[what[mine], at[mine]] += n[mine]
    return root


def key_codes(pairs: DataFrame, shared, width: int) -> DataFrame:
    """(key, c, codes): occurrences of each key of ``pairs`` in all documents and its log
    probabilities in the tries, whose ``Root`` is the broadcast ``shared``."""
    schema = _schema(("key", T.LongType()), ("c", T.LongType()),
                     ("codes", T.ArrayType(T.FloatType())))
    arrow = to_arrow_schema(schema)

    def answer(batches):
        parts, every, n = _whole(batches, width)
        keys, number = np.unique(every, return_inverse=True)
        c = np.bincount(number, n, len(keys)).astype(np.int64)
        symbol, history = keys & ((1 << _SYM) - 1), keys >> (_SYM + _LEN)
        codes = np.zeros((len(keys), width), np.float32)
        for k in range(width):
            trie, parts[k] = shared.value.trie(k, *parts[k]), None
            for i in range(0, len(keys), 200_000):
                some = slice(i, i + 200_000)
                codes[some, k] = trie.log10(symbol[some], history[some],
                                            np.full(len(symbol[some]), ORDER - 1))
        for i in range(0, len(keys), 100_000):
            some = slice(i, i + 100_000)
            at = pa.array(np.arange(len(keys[some]) + 1) * width, pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(codes[some].ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[some]), pa.array(c[some]), lists.cast(arrow.field(2).type)],
                schema=arrow)

    return pairs.select("class", "key", "n").repartition(_branch("key")).mapInArrow(answer, schema)


_BUILT: dict = {}


def built(name: str, make):
    """What a worker makes from a broadcast, kept from task to task."""
    if name not in _BUILT:
        while len(_BUILT) > 1:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[name] = make()
    return _BUILT[name]


class Head:
    """Places of keys in a sorted table: a hashed slot of each key, in which the more frequent
    key stands, and a search for those that do not stand in theirs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.bits = np.append(keys, -1), len(keys).bit_length() + 2
        self.slots = np.full(1 << self.bits, len(keys), np.int32)
        order = np.argsort(counts, kind="stable")
        self.slots[self._slot(keys[order])] = order

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, the number of keys in the table for those it does not hold."""
        at = self.slots[self._slot(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        some = keys[missed]
        place = np.searchsorted(self.keys[:-1], some)
        at[missed] = np.where(self.keys[place] == some, place, len(self.keys) - 1)
        return at


def _times(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, in order, and how often each occurs."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.flatnonzero(np.concatenate(([True] * bool(len(key)), (owner[1:] != owner[:-1])
                                         | (key[1:] != key[:-1]))))
    return owner[new], key[new], np.diff(np.append(new, len(key)))


def base_log10(c, n: int, v: int):
    return np.log10((c + SMOOTHING) / (n + SMOOTHING * (v + 1)))


def score(docs: DataFrame, class_col: str | None = None, folds: int = FOLDS,
          remainder: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    ``docs`` (doc_id, text); training excludes the held-out fold.  ``class_col``
    deals the training documents to tries; a score never looks at it."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")
    docs = docs.select("doc_id", "text", (~held_out("doc_id", folds, remainder)).alias("train"),
                       kind.alias("kind"))
    classes = _classes(docs)
    number_of = F.lit(len(classes) - 1)
    for k, (name, _) in enumerate(classes):
        if name is not None:
            number_of = F.when(F.col("kind") == name, k).otherwise(number_of)
    docs = docs.withColumn("class", number_of.cast("int"))
    sizes, width = [n for _, n in classes], len(classes)
    counted = written(word_counts(docs), "ppm-words")
    ends = sum(sizes)
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + bool(ends)
    pairs = written(key_counts(docs, width), "ppm-trie")
    root = trie_root(pairs, sizes)
    run = uuid.uuid4().hex
    coded = written(key_codes(pairs, spark.sparkContext.broadcast(root), width), "ppm-coded")
    least_word, least_key = (_at_most(t, "c", m) for t, m in (
        (counted, HEAD_WORDS), (coded, HEAD_KEYS)))
    head = counted.where(F.col("c") >= least_word).toArrow()
    head_keys = coded.where(F.col("c") >= least_key).toArrow().sort_by("key")
    ends_coded = [root.trie(k).end_log10() for k in range(width)]
    # Words hold no blanks, so one string carries them all.
    shared = spark.sparkContext.broadcast((
        b" ".join(head.column("word").to_pylist()), base_log10(head.column("c").to_numpy(), n, v),
        Head(head_keys.column("key").to_numpy(), head_keys.column("c").to_numpy()),
        # the last row is for keys that are not in the head
        np.concatenate((head_keys.column("codes").combine_chunks().flatten().to_numpy().reshape(
            -1, width), np.zeros((1, width), np.float32))),
        float(base_log10(ends, n, v)), np.array(ends_coded), int(ends > 0)))
    del head, head_keys
    schema = _schema(("row", T.LongType()), ("doc_id", T.LongType()), ("word", T.BinaryType()),
                     ("key", T.LongType()), ("tokens", T.LongType()), ("known", T.LongType()),
                     ("base", T.DoubleType()), ("codes", T.ArrayType(T.DoubleType())))
    arrow = to_arrow_schema(schema)

    def sums(batches):
        listed, bases, head, codes, end_base, end_codes, end_known = shared.value
        number = built(f"head {run}", lambda: dict(zip(listed.split(b" "), range(len(bases)))))

        def table(size, **columns):
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type)
                 for f in arrow], schema=arrow)

        for b in batches:
            rows, texts = b.column(0).to_numpy(), raw_texts(b.column(2))
            runs, tokens, known, base, rare = [], [], [], [], []
            for row, text in zip(rows.tolist(), texts, strict=True):
                ws = text.lower().split()
                at = np.fromiter(map(number.get, ws, repeat(-1)), np.int32, len(ws))
                here = at[at >= 0]
                runs.append(_run(ws))
                tokens.append(len(ws) + 1)
                known.append(len(here) + end_known)
                base.append(bases[here].sum() + end_base)
                if len(here) < len(ws):
                    left = Counter([ws[i] for i in np.flatnonzero(at < 0)])
                    rare += [(row, w, k) for w, k in left.items()]
            total = np.zeros((len(rows), width)) + end_codes
            for owner, key in text_keys(runs, SCORED_BYTES):
                at = head.find(key)
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                found = codes.take(at, axis=0)
                total[owner[first]] += [np.einsum("ij->j", found[i:j], dtype=np.float64) for i, j
                                        in pairwise([*first.tolist(), len(at)])]
                left = np.flatnonzero(at == len(codes) - 1)
                text, key, times = _times(owner[left], key[left])
                yield table(len(times), row=rows[text], key=key, tokens=times)
            yield table(len(rows), row=rows, doc_id=b.column(1), tokens=tokens, known=known,
                        base=base, codes=list(total))
            if rare:
                row, word, k = zip(*rare, strict=True)
                yield table(len(rare), row=row, word=word, tokens=k)

    parts = written(docs.select(F.monotonically_increasing_id().alias("row"),
                                F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sums, schema), "ppm-sums")
    found = F.coalesce("c", F.lit(0))
    base = F.log10((found + F.lit(SMOOTHING)) / F.lit(n + SMOOTHING * (v + 1)))
    rare = parts.where(F.col("word").isNotNull()).select("row", "word", F.col("tokens").alias("k"))
    rare = rare.join(counted.where(F.col("c") < least_word), "word", "left").groupBy("row").agg(
        F.sum(F.when(found > 0, F.col("k")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("k") * base).alias("rare_base"))
    rare_keys = parts.where(F.col("key").isNotNull()).select("row", "key", F.col("tokens").alias("k"))
    rare_keys = rare_keys.join(coded.where(F.col("c") < least_key).select("key", "codes"), "key").groupBy(
        "row").agg(*[F.sum(F.col("k") * F.col("codes")[k]).alias(f"rare_code{k}") for k in range(width)])
    whole = parts.where(F.col("tokens").isNotNull() & F.col("known").isNotNull()).join(
        rare, "row", "left").join(rare_keys, "row", "left")
    # Each class's probability of the whole text, mixed by the classes' shares.
    logs = [F.col("codes")[k] + F.coalesce(f"rare_code{k}", F.lit(0.0))
            + F.lit(float(np.log10(m / ends))) for k, m in enumerate(sizes) if m] or [
        F.col("codes")[0] + F.coalesce("rare_code0", F.lit(0.0))]
    best = F.greatest(*logs) if len(logs) > 1 else logs[0]
    mixed = best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in logs), F.lit(0.0)))
    return whole.select(
        "doc_id", held_out("doc_id", folds, remainder).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        mixed.alias("score"))

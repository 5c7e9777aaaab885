"""N-gram Jaccard join: rare-first prefix filtering.

Two documents link when their sets of 5-word shingles have a Jaccard similarity
of at least 0.75.  The join works on distinct sets (copies share one):

1. A count sketch of all shingles of the corpus orders them rare-first: a shingle
   ranks by the count of its slot, then by its number.  A slot holds the same share of
   one-time shingles as any other, up to the square root of that share, so a shingle
   that more documents share stands behind them however large the corpus is.  The
   order is the same for all documents.
2. Each set emits its first n - ceil(0.75 n) + 1 shingles; a pair that links
   shares one of them.  A task emits a set it has seen before only once.
3. Sets that share a prefix shingle meet in its list.  Candidates must pass the
   length filter (4 min >= 3 max), the positional filter (what is left of both
   after the shared shingle must reach the needed overlap) and the suffix
   filter: the universe of shingles is cut into ranges by the low bits of their
   numbers, and each range whose counts differ in parity holds a shingle that
   only one of the two sets has, which bounds the overlap from above.  A list
   tests 256 ranges, a pair four ranges and more per shingle.  Survivors are
   verified once on the whole sets.

Lists of thousands of near copies are not expanded into all pairs: links are
first sought between neighbours of a list (all lists run by size and set, so a group
of near copies has the same neighbours in each of its lists), then between each set and one
member of the list's main class; what these links connect is one class, and only
pairs of different classes remain.  All of those are then tested, so classes
are exact.  ``links(verifier, all_links=True)`` skips the shortcut and returns every
link between different sets.

Edge cases: NULL and empty texts have no set and no link; rows with equal ids
get the class of their own text; a NULL id links nothing and is reported without
component; extra columns are ignored; an empty table gives no rows.  Numbers of shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens.llm.common import bound_batches, raw_texts, written
from spendlens.llm.components import components
from spendlens.llm.shingles import WIDTH, WordHashes, shingles

#: Slots of the shingle sketch (4 MB as a broadcast), and slices it travels in.
SLOT_BITS = 20
SLICES = 16
#: Parities of so many ranges, in words of 64, go with each list entry.
WORDS = 4
#: Ids of candidate documents are broadcast up to this number; beyond, the join
#: that fetches their texts shuffles.
MAX_BROADCAST_IDS = 2_000_000

_SLOT_SHIFT = np.uint64(64 - SLOT_BITS)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def slots(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> _SLOT_SHIFT).astype(np.int64)


def batch_shingles(words: list[np.ndarray]) -> np.ndarray:
    """Numbers of all shingles of a batch's documents, computed on all words at once."""
    short = [shingles(w) for w in words if 0 < len(w) < WIDTH]
    long = [w for w in words if len(w) >= WIDTH]
    if long:
        ends = np.cumsum([len(w) for w in long])
        inside = np.ones(ends[-1], bool)  # windows that start in a document's last words cross its end
        inside[(ends[:, None] - np.arange(1, WIDTH)).ravel()] = False
        short.append(shingles(np.concatenate(long))[inside[:ends[-1] - WIDTH + 1]])
    return np.concatenate(short) if short else np.empty(0, np.uint64)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Number of shingles in each slot, over all documents.  Each task counts into an
    array, which travels in compressed slices; a slice is added up in one place."""
    width = (1 << SLOT_BITS) // SLICES

    def count(batches):
        hashes, total = WordHashes(), np.zeros(1 << SLOT_BITS, np.uint32)
        for b in batches:
            found = batch_shingles([hashes.of(t) for t in raw_texts(b.column(0))])
            total += np.bincount(slots(found), minlength=len(total)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()),
             pa.array([zlib.compress(x.tobytes(), 1) for x in total.reshape(SLICES, width)])],
            ["slice", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(x), np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()],
                                                         pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    out = np.zeros((SLICES, width), np.uint32)
    for r in docs.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(
            add, schema).collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def set_id(numbers: np.ndarray) -> int:
    digest = hashlib.blake2b(numbers.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


SETS = _schema(("doc_id", T.LongType()), ("n", T.IntegerType()), ("set_id", T.LongType()),
               ("prefix", T.ArrayType(T.LongType())), ("parity", T.BinaryType()))


def parities(numbers: np.ndarray) -> np.ndarray:
    """Parity of each range's count, as bits: range r holds the numbers that end
    in r; four ranges and more per shingle."""
    size = max(64 * WORDS, 1 << (4 * len(numbers) - 1).bit_length())
    odd = np.bincount((numbers & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The parities of fewer, wider ranges."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def document_sets(docs: DataFrame) -> DataFrame:
    """Per document: size and id of its set; prefix and range counts with the
    first document of each set that a task sees.  Rows without id carry none, as
    they do not join."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs))
    arrow = to_arrow_schema(SETS)

    def describe(batches):
        hashes, seen, often = WordHashes(), set(), counts.value
        for b in batches:
            sizes, ids, prefixes, parity = [], [], [], []
            for named, text in zip(b.column(0).is_valid().to_pylist(), raw_texts(b.column(1)),
                                   strict=True):
                numbers = np.unique(shingles(hashes.of(text)))
                n = len(numbers)
                key = set_id(numbers) if n else None
                sizes.append(n)
                ids.append(key)
                if not n or not named or key in seen:
                    prefixes.append(None)
                    parity.append(None)
                    continue
                seen.add(key)
                keep = n - (3 * n + 3) // 4 + 1
                order = np.argsort(often[slots(numbers)], kind="stable")[:keep]  # ties by number
                prefixes.append(numbers[order].view(np.int64))
                parity.append(parities(numbers).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(sizes, pa.int32()), pa.array(ids, pa.int64()),
                 pa.array(prefixes, arrow.field(3).type), pa.array(parity, arrow.field(4).type)],
                schema=arrow)

    return docs.mapInArrow(describe, SETS)


def _sizes_fit(a: Column, b: Column) -> Column:
    """Length and positional filter of two list entries (size << 32 | position)."""
    na, nb = F.shiftright(a, 32), F.shiftright(b, 32)
    left = F.least(na - a.bitwiseAND(F.lit(0xFFFFFFFF)), nb - b.bitwiseAND(F.lit(0xFFFFFFFF)))
    return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & (7 * left >= 3 * (na + nb))


def _parities_fit(a: str, b: str) -> Column:
    """Suffix filter of two entries with parities: the overlap must reach 3/7 of
    both sizes, so at most 1/7 may differ."""
    differ = sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}")))
                  for i in range(WORDS)), F.lit(0))
    return 7 * differ <= F.shiftright(F.col(f"{a}.at"), 32) + F.shiftright(F.col(f"{b}.at"), 32)


def prefix_lists(sets: DataFrame) -> DataFrame:
    """Entries (h, set_id, at, other, other_at) of all prefix shingles that two
    sets share: at is size << 32 | position, other the entry before in the list."""
    entries = sets.where(F.col("prefix").isNotNull()).select(
        "set_id", "n", F.posexplode("prefix").alias("pos", "h")).select(
        "h", "set_id", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("at"))
    ordered = Window.partitionBy("h").orderBy(F.shiftright("at", 32), "set_id")
    once = entries.withColumn("before", F.lag("set_id").over(ordered)).where(
        F.col("before").isNull() | (F.col("before") != F.col("set_id"))).drop("before")
    # The sorted neighbours tell whether a list has two entries.
    return once.withColumns({
        "other": F.lag("set_id").over(ordered), "other_at": F.lag("at").over(ordered),
        "after": F.lead("h").over(ordered)}).where(
        F.col("other").isNotNull() | F.col("after").isNotNull()).drop("after")


LINK = _schema(*((c, T.LongType()) for c in ("a", "b", "doc_a", "doc_b")))


def _pairs(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of the ids ``set_id`` and ``other``."""
    return entries.select(F.least("set_id", "other").alias("a"),
                          F.greatest("set_id", "other").alias("b"))


class Verifier:
    """Tests candidate pairs of sets on the whole sets."""

    def __init__(self, docs: DataFrame, sets: DataFrame):
        """``docs`` (doc_id, text) and their ``document_sets``, written."""
        self.docs, self.sets = docs, sets
        schema = _schema(("set_id", T.LongType()), ("doc", T.LongType()), ("n", T.IntegerType()),
                         ("parity", T.BinaryType()),
                         *((f"p{i}", T.LongType()) for i in range(WORDS)))
        arrow = to_arrow_schema(schema)

        def fold(batches):
            for b in batches:
                few = np.array([folded(np.frombuffer(x, np.uint64), WORDS)
                                for x in b.column(3).to_pylist()], np.uint64).reshape(-1, WORDS)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).cast(arrow.field(i).type) for i in range(4)),
                     *(pa.array(few[:, i].view(np.int64)) for i in range(WORDS))], schema=arrow)

        self.meta = written(sets.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(
            F.min("doc_id").alias("doc"), F.first("n").alias("n"),
            F.first("parity", ignorenulls=True).alias("parity")).mapInArrow(fold, schema),
            "join-sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b, doc_a, doc_b) among ``pairs`` (a, b) of set ids."""
        known = pairs.distinct()
        for s in "ab":
            known = known.join(self.meta.select(
                F.col("set_id").alias(s), *(F.col(c).alias(f"{c}_{s}")
                                            for c in ("doc", "n", "parity"))), s)
        left = written(self._plausible(known.select(*LINK.names, "n_a", "n_b", "parity_a",
                                                    "parity_b")), "join-pairs")
        wanted = left.select(F.col("doc_a").alias("doc_id")).union(left.select("doc_b")).distinct()
        if wanted.count() <= MAX_BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        numbers = self._numbers(self.docs.join(wanted, "doc_id", "left_semi"))
        sides = left
        for s in "ab":
            sides = sides.join(numbers.select(F.col("set_id").alias(s),
                                              F.col("numbers").alias(f"numbers_{s}")), s)
        # Rows that repeat an id and a text repeat their pairs.
        return written(self._verified(sides.select(*LINK.names, "numbers_a", "numbers_b"))
                       .distinct(), "join-links")

    @staticmethod
    def _plausible(pairs: DataFrame) -> DataFrame:
        """Pairs that pass the suffix filter on all their ranges."""
        def test(batches):
            for b in batches:
                keep = []
                for na, nb, x, y in zip(*(b.column(i).to_pylist() for i in range(4, 8)),
                                        strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    words = min(len(x), len(y))
                    differ = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()
                    keep.append(7 * int(differ) <= na + nb)
                yield b.select(LINK.names).filter(pa.array(keep, pa.bool_()))

        return pairs.mapInArrow(test, LINK)

    @staticmethod
    def _numbers(docs: DataFrame) -> DataFrame:
        schema = _schema(("set_id", T.LongType()), ("numbers", T.BinaryType()))
        arrow = to_arrow_schema(schema)

        def collect(batches):
            hashes = WordHashes()
            for b in batches:
                found = [np.unique(shingles(hashes.of(t))) for t in raw_texts(b.column(0))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(x) for x in found], pa.int64()),
                     pa.array([x.tobytes() for x in found], arrow.field(1).type)], schema=arrow)

        return docs.select("text").mapInArrow(collect, schema)

    @staticmethod
    def _verified(sides: DataFrame) -> DataFrame:
        def verify(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.concatenate((x, y))
                    both.sort()
                    overlap = int((both[1:] == both[:-1]).sum())
                    keep.append(7 * overlap >= 3 * len(both))
                yield b.select(LINK.names).filter(pa.array(keep, pa.bool_()))

        return sides.mapInArrow(verify, LINK)


def _classes(lists: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """Entries (h, set_id, at, class, main) of lists that hold two classes or more;
    main is the class of most entries.  One shuffle of the entries by list."""
    known = _few(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), rounds))
    tagged = lists.join(known, F.col("set_id") == F.col("node"), "left").select(
        "h", "set_id", "at", F.coalesce("component", "set_id").alias("class")).repartition("h")
    main = tagged.groupBy("h", "class").agg(F.count("*").alias("n")).groupBy("h").agg(
        F.max_by("class", F.struct("n", "class")).alias("main"), F.count("*").alias("classes"))
    return tagged.join(main.where(F.col("classes") > 1).select("h", "main"), "h")


def _with_parities(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """The entries' ids, sizes and parities as a struct ``me``."""
    words = [f"p{i}" for i in range(WORDS)]
    return entries.join(meta.select("set_id", *words), "set_id").withColumn(
        "me", F.struct("set_id", "at", *words)).drop("at", *words)


def links(verifier: Verifier, all_links: bool = False) -> DataFrame:
    """Links (a, b, doc_a, doc_b) between distinct sets; all of them, or enough
    for exact classes."""
    lists = written(prefix_lists(verifier.sets), "join-lists")
    neighbours = lists.where(F.col("other").isNotNull()
                             & _sizes_fit(F.col("at"), F.col("other_at")))
    lists = lists.drop("other", "other_at")
    if all_links:
        mine = _with_parities(lists, verifier.meta)
        met = mine.join(mine.select("h", F.col("set_id").alias("other"),
                                    F.col("me").alias("you")), "h").where(
            (F.col("set_id") < F.col("other")) & _sizes_fit(F.col("me.at"), F.col("you.at"))
            & _parities_fit("me", "you"))
        return verifier.links(_pairs(met))
    found = verifier.links(_pairs(neighbours))
    # One member of the main class, another one for each list.
    open_lists = written(_classes(lists, found, 2), "join-open")
    in_main = F.col("class") == F.col("main")
    heads = open_lists.where(in_main).groupBy("h").agg(F.min_by(
        F.struct("set_id", "at"), F.xxhash64("h", "set_id")).alias("head"))
    to_head = open_lists.where(~in_main).select("h", "set_id", "at").join(heads, "h").where(
        _sizes_fit(F.col("at"), F.col("head.at")))
    found = found.unionByName(verifier.links(_pairs(
        to_head.select("set_id", F.col("head.set_id").alias("other")))))
    # All pairs of different classes; one side is never of the main class.
    open_lists = written(_with_parities(_classes(lists, found, 2), verifier.meta), "join-open")
    left = open_lists.where(F.col("class") != F.col("main"))
    right = open_lists.select("h", F.col("set_id").alias("other"), F.col("me").alias("you"),
                              F.col("class").alias("other_class"))
    rest = left.join(right, "h").where(
        (F.col("class") != F.col("other_class"))
        & ((F.col("other_class") == F.col("main")) | (F.col("set_id") < F.col("other")))
        & _sizes_fit(F.col("me.at"), F.col("you.at")) & _parities_fit("me", "you"))
    return found.unionByName(verifier.links(_pairs(rest)))


def _few(ids: DataFrame) -> DataFrame:
    """A table of ids as a broadcast if their number allows."""
    ids = written(ids, "join-ids")
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), set_id and
    class (a set of it) of every document."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(document_sets(docs), "join-documents")
    verifier = Verifier(docs.where(F.col("doc_id").isNotNull()),
                        sets.where(F.col("doc_id").isNotNull()))
    found = links(verifier)
    # Classes are built on sets: rows that share an id but not a text stay apart.
    linked = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    classes = verifier.meta.join(linked, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "doc", F.coalesce("component", "set_id").alias("class"))
    first = classes.groupBy("class").agg(F.min("doc").alias("component"))
    by_set = written(classes.join(first, "class").select("set_id", "component", "class"),
                     "join-classes")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set_id").join(
        by_set, "set_id", "left").select("doc_id", "n_shingles", own.alias("component_id"), "set_id", "class")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    return classified(docs).drop("set_id", "class")


def keep_first(docs: DataFrame) -> DataFrame:
    """The document of smallest id of each class, columns as they came (whatever their
    names).  Rows that share an id are judged each by its own text, and of a class's rows
    with that id one stays; documents without words or id all stay."""
    classes = written(classified(docs), "join-result")
    known = classes.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    gone = known.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    if repeated.isEmpty():
        return _matching(docs, _few(gone), "left_anti")
    repeated = _few(repeated)
    single = _matching(_matching(docs, repeated, "left_anti"),
                       _few(gone.join(repeated, "doc_id", "left_anti")), "left_anti")
    # Of the rows with a class's smallest id those of one set stay.
    stay = known.where(F.col("doc_id") == F.col("component_id")).join(
        repeated, "doc_id", "left_semi").groupBy("doc_id", "class").agg(
        F.min("set_id").alias("set_id"))
    return single.unionByName(_one_of_each(_matching(docs, repeated, "left_semi"), stay))


def quoted(df: DataFrame) -> list:
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]


def _matching(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by id; ``docs`` may have columns of any name."""
    return docs.join(ids, docs["doc_id"].cast("long") == ids["doc_id"], how).select(*quoted(docs))


def _one_of_each(rows: DataFrame, stay: DataFrame) -> DataFrame:
    """Of ``rows``, whose ids repeat, the first of each (doc_id, set_id) of ``stay``, and all
    rows without words.  Rows are grouped by id, text and set only, so the other
    columns may have any name."""
    packed = rows.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t"),
                         F.struct(*quoted(rows)).alias("row"))
    schema = T.StructType([*packed.schema.fields, T.StructField("s", T.LongType())])

    def name(batches):
        hashes = WordHashes()
        for b in batches:
            found = [np.unique(shingles(hashes.of(t))) for t in raw_texts(b.column(1))]
            ids = pa.array([set_id(x) if len(x) else None for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=["id", "t", "row", "s"])

    named = packed.mapInArrow(name, schema)
    at = named.withColumn("place", F.row_number().over(
        Window.partitionBy("id", "s").orderBy("t", F.xxhash64("row"))))
    own = stay.select(F.col("doc_id").alias("id"), F.col("set_id").alias("s"))
    first = at.where(F.col("place") == 1).join(own, ["id", "s"], "left_semi").select("row.*")
    return at.where(F.col("s").isNull()).select("row.*").unionByName(first)

"""Benchmark decontamination: broadcast set of normalised test n-grams.

The windows of the benchmark (10 consecutive words; a shorter item is one
window) form a dictionary that every task gets by broadcast.  A document is
scanned once: its words are mapped to the benchmark's word numbers (0: not in
the benchmark), only runs of known words as long as a window are looked at,
and each window of such a run is looked up by its exact word numbers, so a hit
needs no further proof.  Word normalisation: A-Z lower-cased, words are runs of
ASCII letters, digits and non-ASCII characters.

Size: the bound is on the index in memory, ``max_index_bytes``, which
``WORD_BYTES`` a word and the text itself never exceed (a test measures it).  A
larger benchmark is dealt by a hash into fine buckets, buckets are packed into blocks
within the bound (an item larger than it is a block of its own), and the
documents pass the blocks one after another; hits add up, so the result does
not depend on the number of blocks.  There is no shuffle of documents.

Edge cases: NULL or empty texts have no words and no hits; a NULL or empty
item has no window; an item without id hits words but is not listed; repeated
documents are reported each; an empty benchmark hits nothing; other columns of
the documents pass through, the state columns have reserved ``_dc_`` names.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens.llm.common import bound_batches, raw_texts, under_plain_names, written

WINDOW = 10
MAX_INDEX_BYTES = 256 << 20
#: Memory of a word with its window: number, window key, dictionary places and, for
#: a window of several items, its set.
WORD_BYTES = 400
FINE_BUCKETS = 1024

#: Bytes that belong to words keep their (lower) value, all others become blanks.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20 for b in range(256))
_WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class WindowIndex:
    """Exact windows of benchmark items, by length."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        #: Items of a window: a tuple that an item's windows share, or a set.
        self.by_length: dict[int, dict[bytes, tuple | set]] = {}
        for item_id, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)],
                           np.int32)
            size = min(window, len(ids))
            own = (item_id,)
            if size:
                found = self.by_length.setdefault(size, {})
                for i in range(len(ids) - size + 1):
                    key = ids[i:i + size].tobytes()
                    had = found.setdefault(key, own)
                    if item_id not in had:
                        if isinstance(had, tuple):
                            had = found[key] = set(had)
                        had.add(item_id)

    def hits(self, doc_words: list[bytes]) -> tuple[np.ndarray, set]:
        """Mask of hit words and the ids of items with an occurring window."""
        mask = np.zeros(len(doc_words), bool)
        items: set = set()
        if not doc_words or not self.number:
            return mask, items
        ids = np.fromiter(map(self.number.get, doc_words, repeat(0)), np.int32, len(doc_words))
        unknown = np.flatnonzero(ids == 0)
        starts = np.concatenate(([0], unknown + 1))
        ends = np.concatenate((unknown, [len(ids)]))
        runs = ends - starts
        for size, windows in self.by_length.items():
            for k in np.flatnonzero(runs >= size):
                for i in range(starts[k], ends[k] - size + 1):
                    got = windows.get(ids[i:i + size].tobytes())
                    if got:
                        mask[i:i + size] = True
                        items.update(got)
        return mask, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[DataFrame]:
    items = benchmark.select(F.col(id_col).cast("long").alias("item"),
                             F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    memory = F.octet_length("text") + WORD_BYTES * F.regexp_count("text", F.lit(_WORD_PATTERN))
    total = items.agg(F.sum(memory)).first()[0] or 0
    if total <= limit:
        return [items]
    n = FINE_BUCKETS * -(-total // (limit * FINE_BUCKETS // 8))
    placed = items.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    # Ranges of buckets within the bound: at most n sums reach the driver.
    cuts, size = [0], 0
    for r in placed.groupBy("bucket").agg(F.sum(memory).alias("size")).orderBy("bucket").collect():
        if size and size + r["size"] > limit:
            cuts.append(r["bucket"])
            size = 0
        size += r["size"]
    return [placed.where((F.col("bucket") >= low) & (F.col("bucket") < high)).drop("bucket")
            for low, high in zip(cuts, [*cuts[1:], n], strict=True)]


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
         max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``docs`` with ``_dc_words`` (count), ``_dc_hits`` (a byte per word, 1 if
    hit) and ``_dc_items`` (ids of items with occurring windows)."""
    spark = docs.sparkSession
    bound_batches(spark)
    state = docs.withColumns({
        "_dc_words": F.lit(0).cast("long"), "_dc_hits": F.lit(None).cast("binary"),
        "_dc_items": F.array().cast("array<long>")})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in state.schema.fields])
    arrow = to_arrow_schema(schema)
    at = arrow.get_field_index(text_col)
    n_state = len(schema.fields) - 3
    blocks = _blocks(benchmark, item_id_col, item_text_col, max_index_bytes)
    for k, block in enumerate(blocks):
        rows = [(r["item"], r["text"].encode()) for r in block.toLocalIterator()]
        shared = spark.sparkContext.broadcast(WindowIndex(rows, window))

        def mark(batches, shared=shared):
            index = shared.value
            for b in batches:
                counts, masks, found = [], [], []
                before_hits = b.column(n_state + 1).to_pylist()
                before_items = b.column(n_state + 2).to_pylist()
                for text, old, had in zip(raw_texts(b.column(at)), before_hits, before_items,
                                          strict=True):
                    ws = words(text)
                    mask, items = index.hits(ws)
                    if old is not None:
                        mask |= np.frombuffer(old, np.uint8).astype(bool)
                    counts.append(len(ws))
                    masks.append(mask.astype(np.uint8).tobytes() if mask.any() else None)
                    found.append(sorted({*had, *(i for i in items if i is not None)}))
                columns = [b.column(i).cast(arrow.field(i).type) for i in range(n_state)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(counts, arrow.field(n_state).type),
                     pa.array(masks, arrow.field(n_state + 1).type),
                     pa.array(found, arrow.field(n_state + 2).type)], schema=arrow)

        state = state.mapInArrow(mark, schema)
        if k + 1 < len(blocks):
            state = written(state, "decontaminate")
    return state


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per document: words, hit words, items and their digest."""
    text_col = kw.get("text_col", "text")
    marked = scan(docs.select(id_col, text_col), benchmark, **kw)
    names = F.array_sort(F.col("_dc_items").cast("array<string>"))
    n_hit = F.coalesce(F.length(F.translate(F.hex("_dc_hits"), "0", "")), F.lit(0)).cast("long")
    return marked.select(
        F.col(id_col).alias("doc_id"), F.col("_dc_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("_dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Documents without a hit word, columns as they came."""
    return under_plain_names(docs, (kw.get("text_col", "text"),), lambda rows: scan(
        rows, benchmark, **kw).where(F.col("_dc_hits").isNull()))


def cut_spans(text: str | None, hits: bytes | None) -> str | None:
    """``text`` without its hit words (and what stands between two hit words)."""
    if text is None or not hits:
        return text
    raw, out, keep = text.encode(), [], 0
    spans = [m.span() for m in _WORD.finditer(raw)]
    i = 0
    while i < len(spans):
        if hits[i]:
            j = i
            while j + 1 < len(spans) and hits[j + 1]:
                j += 1
            out.append(raw[keep:spans[i][0]])
            keep = spans[j][1]
            i = j
        i += 1
    return (b"".join(out) + raw[keep:]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """All documents, hit spans cut out of their texts."""
    @F.pandas_udf("string")
    def cut(text: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t, h) for t, h in zip(text, hits, strict=True)], dtype=object)

    return under_plain_names(docs, (text_col,), lambda rows: scan(
        rows, benchmark, text_col=text_col, **kw).withColumn(text_col, F.when(
            F.col("_dc_hits").isNull(), F.col(text_col)).otherwise(cut(text_col, "_dc_hits"))))

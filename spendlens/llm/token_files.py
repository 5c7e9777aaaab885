"""Token-id output: Parquet list columns with dictionary or delta encoding.

Documents are dealt by ranges of the id (one shuffle of the texts, spilling
sort inside each range), encoded with the ``tokenizers`` library, closed with
the end id and written, one row per document in ascending id order:

    doc_id, part (number of the file's range), pos (row in the range),
    n_tokens, token_ids array<int>

``encoding="dictionary"`` keeps a dictionary page per column chunk (a
vocabulary of 50,000 ids packs to 16 bits an id), ``"delta"`` uses the format's
version 2 delta encoding.  Row groups and pages have set sizes, the writer adds
the page index (column and offset index), so a read of some ids or ranges of
``doc_id`` skips pages, and a read of the metadata columns never touches the
token column.

``read_back`` recomputes count and checksum from the ids in the files and adds
each document's start: a running sum inside the range plus the sum of the
ranges before it, so no task sees more than one range.

Edge cases: NULL and empty texts hold only the end id; documents with equal ids
stand in order of their texts; a NULL id sorts first; extra columns are
ignored; an empty table writes an empty file set.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens.llm.common import bound_batches, list_slices

MAX_TOKENIZER_BYTES = 64 << 20
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Chunks that a worker keeps from one run of texts to the next; longer chunks are not kept.
CACHE_ENTRIES = 400_000
KEPT_BYTES = 100
#: Chunks that go to the library as one text.
JOINED_CHUNKS = 100
#: Bytes of texts whose chunks are told apart at once.
RUN_BYTES = 8 << 20
FILE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
    T.StructField("pos", T.LongType()), T.StructField("n_tokens", T.IntegerType()),
    T.StructField("token_ids", T.ArrayType(T.IntegerType()))])


#: Bytes by what they say of their character: ASCII that is no white space; first
#: bytes of characters that are no white space; ASCII letters; other ASCII that ends
#: a run of letters.  White space beyond ASCII begins with C2, E1, E2 or E3.
_SOLID, _STARTS, _LETTER = (np.zeros(256, bool) for _ in range(3))
_SOLID[0x21:0x7F] = True
_STARTS[0x21:0x7F] = _STARTS[0xC3:0xE1] = _STARTS[0xE4:0xF5] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SIGN = _SOLID & ~_LETTER
_SIGN[0x0A] = True
_BLANK, _LINE_END = 0x20, 0x0A


def _solid_before(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before byte ``at`` is surely no white space
    (``padded`` has three more bytes in front)."""
    last = padded[at + 2]
    three = padded[at]
    return _SOLID[last] | ((last >= 0x80) & (padded[at + 1] != 0xC2)
                           & ((three < 0xE1) | (three > 0xE3)))


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Marks of bytes at which a byte-level tokenizer's pattern surely begins a piece, so
    that what stands before and after can be encoded apart: a single blank between
    characters that are no white space; what follows a single line end between such
    characters; an ASCII sign, digit or line end after a letter (A-Z, a-z, or U+00C0 to
    U+00FF without the signs in it).  Places it is not sure of stay unmarked."""
    padded = np.concatenate((np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)))
    marks = np.zeros(len(data), bool)
    at = np.flatnonzero(data == _BLANK)
    marks[at[_solid_before(padded, at) & _STARTS[padded[at + 4]]]] = True
    at = np.flatnonzero(_SIGN[data])
    last = padded[at + 2]
    latin = (padded[at + 1] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    marks[at[_LETTER[last] | latin]] = True
    at = at[data[at] == _LINE_END]
    marks[at[_solid_before(padded, at) & _STARTS[padded[at + 4]]] + 1] = True
    return marks


def _bytes_of(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without NULLs, and where each row begins (and the last ends)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _lists_at(pool: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists number ``at``, one after the other, of those that lie in ``pool`` one after
    the other and have sizes ``size``."""
    size_at = size[at]
    shift = (np.cumsum(size) - size)[at] - (np.cumsum(size_at) - size_at)
    where = np.repeat(shift.astype(np.int32), size_at)
    where += np.arange(len(where), dtype=np.int32)
    return pool[where]


class ChunkEncoder:
    """The library's encoder with a bounded memory of chunks.

    Texts are cut where the tokenizer's pattern cuts in any case (``chunk_starts``) and
    the chunks of many texts are told apart at once; only chunks not in memory go to
    the library, many joined into one text, whose ids are dealt to the chunks by the bytes
    each id stands for.  Texts that hold the string of an added token go to the library
    whole, as do all texts if the tokenizer is no plain byte-level one.  A full memory
    keeps the half that was met in the most runs of texts."""

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        #: Strings that the library takes out of a text before it splits the rest.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Bytes of each id: a byte-level vocabulary has one character a byte.
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.cuts = self._is_plain(json.loads(tokenizer_json), vocab)
        #: Chunks in memory, the sizes of their lists of ids, these lists one after the
        #: other, and the number of runs of texts each chunk was met in.
        self.chunks = pa.array([], pa.large_binary())
        self.size, self.met = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")

    def _is_plain(self, spec: dict, vocab: dict) -> bool:
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        return (split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True)
                and split.get("use_regex", True) and model.get("type") == "BPE"
                and not any(map(spec.get, ("normalizer", "truncation", "padding")))
                and not any(map(model.get, ("dropout", "continuing_subword_prefix",
                                            "end_of_word_suffix")))
                and sum(len(token) == 1 for token in vocab) == 256
                and not any(c.isspace() for token in self.added for c in token))

    def _library(self, parts: list[bytes]) -> list[np.ndarray]:
        encode = self.tokenizer.encode_batch_fast
        return [np.array(encode([p.decode()], add_special_tokens=False)[0].ids, "<u4")
                for p in parts]

    def _alone(self, chunks: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        found = self._library(chunks.to_pylist())
        return np.concatenate(found), np.fromiter(map(len, found), np.int32, len(found))

    def _joined(self, chunks: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their numbers, of chunks of which each begins and ends with a piece when
        they stand one after the other."""
        data, bounds = _bytes_of(chunks)
        stops = [*bounds[:-1:JOINED_CHUNKS].tolist(), len(data)]
        ids = np.concatenate(self._library([data[a:b].tobytes() for a, b in pairwise(stops)]))
        last = np.searchsorted(np.cumsum(self.width[ids]), bounds[1:])
        return ids, np.diff(last, prepend=-1).astype(np.int32)

    def _joined_by_lines(self, chunks: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The same with a line end after each, whose one id is taken out again."""
        line_end = pa.scalar(b"\n", pa.large_binary())
        ids, size = self._joined(
            pc.binary_join_element_wise(chunks, line_end, pa.scalar(b"", pa.large_binary())))
        return np.delete(ids, np.cumsum(size) - 1), size - 1

    def _encoded(self, chunks: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct chunks' order of encoding, their ids and numbers of ids in that order."""
        data, bounds = _bytes_of(chunks)
        padded = np.concatenate((np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)))
        start, stop = bounds[:-1], bounds[1:]
        blank = padded[start + 3] == _BLANK
        # No white space at the ends, but for one blank in front.
        fit = _STARTS[padded[start + 3 + blank]] & (stop - start > blank) & _solid_before(padded, stop)
        fit &= self.cuts
        for token in self.added:
            fit &= ~np.asarray(pc.match_substring(chunks, token))
        order, done = [], []
        for which, encode in ((fit & blank, self._joined), (fit & ~blank, self._joined_by_lines),
                              (~fit, self._alone)):
            if which.any():
                order.append(np.flatnonzero(which))
                done.append(encode(chunks.take(pa.array(order[-1]))))
        ids, size = zip(*done, strict=True)
        return np.concatenate(order), np.concatenate(ids), np.concatenate(size)

    def _remember(self, chunks: pa.LargeBinaryArray) -> np.ndarray:
        """Places in memory of distinct chunks, of which the new ones are encoded."""
        found = pc.index_in(chunks, value_set=self.chunks)
        places = found.fill_null(-1).to_numpy().copy()
        lack = np.flatnonzero(places < 0)
        if len(lack):
            new = chunks.take(pa.array(lack))
            order, ids, size = self._encoded(new)
            places[lack[order]] = np.arange(len(self.chunks), len(self.chunks) + len(lack))
            self.chunks = pa.concat_arrays([self.chunks, new.take(pa.array(order))])
            self.ids = np.concatenate((self.ids, ids))
            self.size = np.concatenate((self.size, size))
            self.met = np.concatenate((self.met, np.zeros(len(lack), np.int32)))
        self.met[places] += 1
        return places

    def _forget(self) -> None:
        """Drop long chunks, and half of the rest if there are too many."""
        keep = np.flatnonzero(np.asarray(pc.binary_length(self.chunks)) <= KEPT_BYTES)
        if len(keep) > CACHE_ENTRIES:
            most = np.argsort(-self.met[keep], kind="stable")[:CACHE_ENTRIES // 2]
            keep = keep[np.sort(most)]
            self.met //= 2
        if len(keep) < len(self.chunks):
            self.chunks = self.chunks.take(pa.array(keep))
            self.ids = _lists_at(self.ids, self.size, keep)
            self.size, self.met = self.size[keep], self.met[keep]

    def _encode(self, column: pa.LargeBinaryArray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = _bytes_of(column)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(column), np.int32)
        marks = chunk_starts(data) if self.cuts else np.zeros(len(data), bool)
        for i in np.flatnonzero(special):
            marks[bounds[i]:bounds[i + 1]] = False
        marks[bounds[bounds < len(data)]] = True
        cuts = np.append(np.flatnonzero(marks), len(data))
        found = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts) - 1,
            [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        at = self._remember(found.dictionary)[found.indices.to_numpy()]
        ids = _lists_at(self.ids, self.size, at)
        ends = np.concatenate(([0], np.cumsum(self.size[at])))
        self._forget()
        return ids, np.diff(ends[np.searchsorted(cuts, bounds)]).astype(np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, one after the other, and their number in
        each text; NULL counts as the empty text."""
        column = column.cast(pa.large_string()).fill_null("")
        special = np.zeros(len(column), bool)
        for token in self.added:
            special |= np.asarray(pc.match_substring(column, token))
        column = column.cast(pa.large_binary())
        # Long batches are encoded in runs of texts, as a chunk takes more memory than its text.
        size = np.asarray(pc.binary_length(column))
        run = np.cumsum(size) // RUN_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(run)) + 1), len(column)]
        done = [self._encode(column[a:b], special[a:b]) for a, b in pairwise(bounds)]
        return tuple(map(np.concatenate, zip(*done, strict=True)))

    def encode_all(self, batch: list[str]) -> list[bytes]:
        ids, size = self.encode(pa.array(batch, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(size)[:-1])] if batch else []


_ENCODERS: dict = {}


def _encoder(shared, digest: str) -> ChunkEncoder:
    """The worker's encoder; a reused worker keeps it from task to task."""
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest] = ChunkEncoder(shared.value)
    return _ENCODERS[digest]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0,
                      encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES,
                      page_bytes: int = PAGE_BYTES) -> None:
    """Encode ``docs`` (doc_id, text) and write the token files below ``path``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    if len(content) > MAX_TOKENIZER_BYTES:
        raise ValueError("the tokenizer file is larger than the broadcast bound")
    shared = spark.sparkContext.broadcast(content)
    digest = hashlib.sha256(content.encode()).hexdigest()
    arrow = to_arrow_schema(FILE_SCHEMA)

    def encode(batches):
        part, pos = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, sizes = _encoder(shared, digest).encode(b.column(1))
            flat = np.insert(ids, np.cumsum(sizes), end_id).view("<i4")
            offsets = np.concatenate(([0], np.cumsum(sizes + 1))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(np.full(len(sizes), part, np.int32)),
                 pa.array(np.arange(pos, pos + len(sizes))), pa.array(sizes + 1, pa.int32()),
                 lists.cast(arrow.field(4).type)], schema=arrow)
            pos += len(sizes)

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        "doc_id").sortWithinPartitions("doc_id", "text")
    (ranged.mapInArrow(encode, FILE_SCHEMA).write
     .option("compression", "snappy")
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
     .option("parquet.dictionary.page.size", str(1 << 20))
     .option("parquet.block.size", str(row_group_bytes))
     .option("parquet.page.size", str(page_bytes))
     .option("parquet.page.row.count.limit", "1000")
     .parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    bound_batches(spark)
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
                        T.StructField("pos", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids_crc32", T.LongType())])
    arrow = to_arrow_schema(out)

    def measure(batches):
        for b in batches:
            ids = list(list_slices(b.column(3)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2),
                 pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                schema=arrow)

    files = read_token_files(spark, path)
    rows = files.select("doc_id", "part", "pos", "token_ids").mapInArrow(measure, out)
    # The ranges' totals come from the metadata column alone: a row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(parts, "part").select(
        "doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"),
        "n_tokens", "ids_crc32")

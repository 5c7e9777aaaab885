"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece the table holds the one token that its valid
encoding ends with.  A token is the last one of a prefix if it is a suffix of
it and, with the last token of what stands before, a valid pair; two tokens are
a valid pair if no merge by rank of their joint bytes crosses the border.  An
encoding is the rank merge's own exactly if all its neighbours are valid pairs,
so each prefix has one last token and the table is exact.  Appending bytes only
adds entries (``PrefixTable.append``); an edit of a text re-encodes the pieces
around it (``BytePairCodec.replace``).

Texts are cut into pieces by the tokenizer's pattern and each piece is encoded
by itself; a piece that is a whole token is that token.  Pieces and
blank-separated chunks repeat, so a worker keeps their ids in a dictionary of
bounded size.  Encoding is a row-local projection: no shuffle, the rank table
(a file of under 1 MB, checked) goes to the workers by broadcast.

Edge cases: NULL and empty texts have no ids (and decode to no bytes); repeated
documents are encoded each; extra columns pass through ``encode_documents``.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens.llm.common import blank_separated, bound_batches, texts

MAX_RANK_BYTES = 64 << 20
#: Entries of a worker's dictionary of chunks; of new ones, and as many old ones.
CACHE_ENTRIES = 150_000
#: Longer pieces get a table of their own instead of shared, recursive entries.
SHARED_PREFIX = 100


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Bounded(dict):
    """Dictionary of a function's results with at most ``limit`` new and as many
    old entries; entries not asked for while the new ones fill are dropped."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PrefixTable:
    """Last valid token of every byte prefix of a growing byte string."""

    def __init__(self, codec: BytePairCodec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the string; entries of earlier prefixes stay as they are."""
        get, follows, last = self.codec.ranks.get, self.codec.follows, self.last
        longest = self.codec.longest
        data = self.data = self.data + more
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = get(data[start:end])
                if token is not None and follows[last[start - 1] if start else None, token]:
                    last.append(token)
                    break
            else:
                raise ValueError("the rank table lacks a single byte")

    def ids(self, end: int | None = None) -> list[int]:
        """Encoding of the first ``end`` bytes, read back from the table."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.codec.tokens[out[-1]])
        return out[::-1]


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.packed = {v: v.to_bytes(4, "little") for v in self.tokens}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self.halves = Bounded(self._halves, len(ranks) + 1)
        self.left_spine = Bounded(lambda t: self._spine(t, 0), len(ranks) + 1)
        self.right_spine = Bounded(lambda t: self._spine(t, 1), len(ranks) + 1)
        self.follows = Bounded(self._follows, 4 * CACHE_ENTRIES)
        self.last = Bounded(self._last, CACHE_ENTRIES)
        self.piece_ids = Bounded(self._piece_ids, CACHE_ENTRIES)
        self.chunk_ids = Bounded(self._chunk_ids, CACHE_ENTRIES)

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the last merge joins into ``token``; none for a
        single byte or a token that no merges lead to."""
        parts = [token[i:i + 1] for i in range(len(token))]
        get, never = self.ranks.get, len(self.ranks)
        while len(parts) > 2:
            pairs = [get(a + b, never) for a, b in zip(parts, parts[1:])]
            best = min(pairs)
            if best == never:
                return None
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Parts of ``token`` that touch its left (0) or right (1) end at some
        time of its merges, each with the rank of the merge that absorbs it."""
        out, absorbed = [(token, len(self.ranks))], self.ranks[token]
        while (halves := self.halves[token]) is not None:
            token = halves[side]
            out.append((token, absorbed))
            absorbed = self.ranks[token]
        return out

    def _follows(self, pair: tuple[int | None, int]) -> bool:
        """Whether no merge crosses the border of the two tokens: a part at the
        border's left and one at its right would merge only while both exist
        (of equal merges the leftmost comes first)."""
        left, right = pair
        token = self.tokens[right]
        if len(token) > 1 and self.halves[token] is None:
            return False
        if left is None:
            return True
        get = self.ranks.get
        for a, a_ends in self.right_spine[self.tokens[left]]:
            for b, b_ends in self.left_spine[token]:
                joint = get(a + b)
                if joint is not None and joint < a_ends and joint <= b_ends:
                    return False
        return True

    def _last(self, prefix: bytes) -> int:
        """The table's entry for one prefix, from those of shorter ones; pieces
        that begin alike share them, and only entries that are asked for are made."""
        get, follows, last = self.ranks.get, self.follows, self.last
        for start in range(max(0, len(prefix) - self.longest), len(prefix)):
            token = get(prefix[start:])
            if token is not None and follows[last[prefix[:start]] if start else None, token]:
                return token
        raise ValueError("the rank table lacks a single byte")

    def _piece_ids(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return self.packed[whole]
        if len(data) > SHARED_PREFIX:
            return b"".join(map(self.packed.__getitem__, PrefixTable(self, data).ids()))
        out = []
        while data:
            token = self.last[data]
            out.append(self.packed[token])
            data = data[:-len(self.tokens[token])]
        return b"".join(out[::-1])

    def _pieces_of(self, text: str) -> bytes:
        return b"".join(map(self.piece_ids.__getitem__, self.pattern.findall(text)))

    def _chunk_ids(self, chunk: str) -> bytes:
        if chunk.isalpha():  # a blank and letters: one piece
            return self._piece_ids(" " + chunk)
        return self._pieces_of(" " + chunk)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not blank_separated(text):
            return self._pieces_of(text)
        first, *rest = text.split(" ")
        return self._pieces_of(first) + b"".join(map(self.chunk_ids.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def replace(self, text: str, ids: bytes, start: int, end: int, new: str) -> tuple[str, bytes]:
        """Text and ids after ``text[start:end]`` became ``new``.  Pieces well
        before and after the edit keep their ids: the text is cut anew only
        from the last blank-or-letter boundary before the edit to the first
        boundary after it where old and new pieces meet again."""
        changed = text[:start] + new + text[end:]
        old_at = [m.start() for m in self.pattern.finditer(text)] + [len(text)]
        sizes = [len(self.piece_ids[text[a:b]]) for a, b in zip(old_at, old_at[1:])]
        offset = np.concatenate(([0], np.cumsum(sizes, dtype=int)))
        # A piece can depend on one piece of white space or letters before it.
        keep = max(0, next((i for i, a in enumerate(old_at) if a >= start), len(sizes)) - 2)
        shift = len(changed) - len(text)
        meet = {a + shift: i for i, a in enumerate(old_at) if a >= end}
        out, at = [ids[:offset[keep]]], old_at[keep]
        stop = start + len(new)
        while at < len(changed):
            if at > stop and at in meet:
                return changed, b"".join(out) + ids[offset[meet[at]]:]
            piece = self.pattern.match(changed, at).group()
            out.append(self.piece_ids[piece])
            at += len(piece)
        return changed, b"".join(out)


_CODECS: dict = {}


def _codec(shared, key: tuple[str, str]) -> BytePairCodec:
    """The worker's codec; a reused worker keeps it from task to task."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = BytePairCodec(shared.value, key[1])
    return _CODECS[key]


def share_ranks(spark, path: str, pattern: str):
    """Broadcast of the rank table, and the key by which workers keep its codec."""
    ranks = read_ranks(path)
    size = sum(map(len, ranks))
    if size > MAX_RANK_BYTES:
        raise ValueError(f"rank file of {size} bytes; the broadcast bound is {MAX_RANK_BYTES}")
    digest = hashlib.sha256(b"".join(b"%d %s\n" % (v, k) for k, v in ranks.items())).hexdigest()
    return spark.sparkContext.broadcast(ranks), (digest, pattern)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text",
                     ids_col: str = "token_ids", decoded_sha_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col`` binary (little-endian unsigned 32-bit ids) and,
    if named, the digest of the bytes the ids decode to; columns of these names are
    replaced."""
    spark = docs.sparkSession
    docs = docs.select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns
                         if c not in (ids_col, decoded_sha_col)))
    bound_batches(spark)
    shared, key = share_ranks(spark, rank_path, pattern)
    names, n, at = docs.columns, len(docs.columns), docs.columns.index(text_col)
    extra = [T.StructField("ids", T.BinaryType())]
    if decoded_sha_col:
        extra.append(T.StructField("sha", T.StringType()))
    docs = docs.toDF(*(f"x{i}" for i in range(n)))  # the task finds columns by place
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields] + extra)
    arrow = to_arrow_schema(schema)

    def encode(batches):
        codec = _codec(shared, key)
        for b in batches:
            ids = [codec.encode(t) for t in texts(b.column(at))]
            columns = [b.column(i).cast(arrow.field(i).type) for i in range(n)]
            columns.append(pa.array(ids, arrow.field(n).type))
            if decoded_sha_col:
                columns.append(pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids],
                                        arrow.field(n + 1).type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(encode, schema).toDF(
        *names, ids_col, *([decoded_sha_col] if decoded_sha_col else []))


def decode_documents(encoded: DataFrame, rank_path: str, pattern: str,
                     ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with column ``decoded`` (binary) from its ids."""
    bound_batches(encoded.sparkSession)
    shared, key = share_ranks(encoded.sparkSession, rank_path, pattern)

    @F.pandas_udf("binary")
    def decode(ids):
        codec = _codec(shared, key)
        return ids.map(lambda x: codec.decode(x or b""))

    return encoded.withColumn("decoded", decode(ids_col))


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, number of ids, digests of the ids and of the decoded bytes."""
    done = encode_documents(docs.select("doc_id", "text"), rank_path, pattern,
                            decoded_sha_col="decoded_sha256")
    return done.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("token_ids", 256).alias("ids_sha256"), "decoded_sha256")

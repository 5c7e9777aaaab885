"""Codecs, token files and their queries against the reference libraries."""

import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.dataset as ds
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendlens.llm import prefix_bpe, queries, token_files
from spendlens.llm.prefix_bpe import BytePairCodec, PrefixTable, read_ranks

PARTS = ["ab", " ", "  ", "\n", "\t", "é", "thing", "'s", "12", "!!", " ", "日本", "<|endoftext|>",
         "𝄞", "x y", " ", "Über", "don't"]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(queries.MULTI_RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def made_up(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_ranks_are_read_as_stated(ranks):
    with open(queries.MULTI_RANKS, "rb") as f:
        token, rank = f.readline().split()
    assert ranks[base64.b64decode(token)] == int(rank)


def test_codec_equals_library(ranks, library):
    codec = BytePairCodec(ranks, P.PATTERN)
    for text in [*made_up(1), "", " ", "a" * 3000, "ab" * 400 + " " * 50 + "\n" * 9]:
        ids = codec.encode(text)
        assert ids == np.array(library.encode_ordinary(text), "<u4").tobytes(), text
        assert codec.decode(ids) == text.encode()


def test_small_memory_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "CACHE_ENTRIES", 3)
    codec = BytePairCodec(ranks, P.PATTERN)
    for text in made_up(2, 60):
        assert codec.encode(text) == np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_prefix_table_appends_exactly(ranks, library):
    codec = BytePairCodec(ranks, P.PATTERN)
    word = b" unbelievablethingsaround"
    table = PrefixTable(codec)
    for i in range(len(word)):
        before = list(table.last)
        table.append(word[i:i + 1])
        assert table.last[:i] == before
        assert table.ids() == library._encode_single_piece(word[:i + 1])


def test_edits_reencode_exactly(ranks, library):
    codec = BytePairCodec(ranks, P.PATTERN)
    r = random.Random(5)
    for text in made_up(3, 300):
        a = r.randint(0, len(text))
        b = r.randint(a, len(text))
        new = r.choice(["", " ", "zz\n", "  q", "th"])
        got, ids = codec.replace(text, codec.encode(text), a, b, new)
        assert got == text[:a] + new + text[b:]
        assert ids == np.array(library.encode_ordinary(got), "<u4").tobytes()


def documents(sf_dir):
    t = ds.dataset(f"{sf_dir}/documents.parquet").to_table(columns=["doc_id", "text"])
    return sorted(zip(t.column(0).to_pylist(), t.column(1).to_pylist()))


def test_op3_equals_library(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in queries.op3_prefix_bpe(spark, sf_dir).collect()}
    for doc_id, text in documents(sf_dir):
        ids = library.encode_ordinary(text or "")
        r = got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_and_decode_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 40_000), (3, "x" * 40_000), (None, " a  b\n")]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, ids string")
    done = prefix_bpe.encode_documents(docs, queries.MULTI_RANKS, P.PATTERN)
    back = prefix_bpe.decode_documents(done, queries.MULTI_RANKS, P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in back) == sorted(t or "" for _, t in rows)
    assert {r["ids"] for r in back} == {"kept"}
    twice = prefix_bpe.encode_documents(done.withColumn("a.b", F.lit(1)), queries.MULTI_RANKS, P.PATTERN,
                                        decoded_sha_col="ids")  # both names are taken
    assert sorted(twice.columns) == sorted(["doc_id", "text", "a.b", "token_ids", "ids"])
    assert {bytes(r["token_ids"]) for r in twice.collect()} == {
        bytes(r["token_ids"]) for r in done.collect()}
    assert prefix_bpe.digests(docs.limit(0), queries.MULTI_RANKS, P.PATTERN).count() == 0


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(queries.BYTE_BPE_JSON)


def test_chunk_encoder_equals_library(byte_bpe):
    with open(queries.BYTE_BPE_JSON, encoding="utf-8") as f:
        own = token_files.ChunkEncoder(f.read())
    for seed in (1, 2):
        batch = made_up(seed) + ["", " ", "a b c", "a b c", "<|endoftext|>", "a <|endoftext|> b",
                                 "a b<|endoftext|>c d", "<|endoftext", "x <| endoftext |> y"]
        expected = [np.array(e.ids, "<u4").tobytes()
                    for e in byte_bpe.encode_batch(batch, add_special_tokens=False)]
        assert own.encode_all(batch) == expected


def test_op4_equals_library(spark, sf_dir, byte_bpe):
    got = {r["doc_id"]: r for r in queries.op4_token_files(spark, sf_dir).collect()}
    start = 0
    for doc_id, text in documents(sf_dir):
        ids = np.array([*byte_bpe.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (
            start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_hold_edge_rows(spark, tmp_path, byte_bpe, encoding):
    rows = [(5, "b c"), (5, "a"), (None, "n"), (1, None), (9, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    path = f"file://{tmp_path}/{encoding}"
    token_files.write_token_files(docs, path, queries.BYTE_BPE_JSON, encoding=encoding)
    files = token_files.read_token_files(spark, path)
    ids = {r["doc_id"]: r["token_ids"] for r in files.where("doc_id in (1, 9)").collect()}
    assert ids == {1: [0], 9: [0]}
    back = sorted(token_files.read_back(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in back] == [None, 1, 5, 5, 9]
    assert [r["start"] for r in back] == [0, 2, 3, 5, 8]
    meta = spark.read.parquet(path).agg(F.sum("n_tokens")).first()[0]
    assert meta == 9


def test_no_documents_give_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = f"file://{tmp_path}/none"
    token_files.write_token_files(docs, path, queries.BYTE_BPE_JSON)
    assert token_files.read_back(spark, path).count() == 0


#: Characters around which the pattern's cuts differ: white space of all kinds, letters,
#: marks, digits and signs of one to four bytes, contractions, added tokens.
ODD = ["a", "The", "é", "ÿ", "×", "÷", "Ж", "ǅ", "º", "日本", "。", "ー", "\u093f", "क", "\U0001d11e", "\u0301", "'s", "'", "'re",
       "l", "1", "²", "٣", ".", "...", "!", "“", "»", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c",
       "\x00", "\x7f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u202f", "\u205f",
       "\u3000", "\ufeff", "<|endoftext|>", "<|endof", "text|>"]


def test_chunks_are_cut_where_the_library_cuts(byte_bpe, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(token_files, "KEPT_BYTES", 9)
    with open(queries.BYTE_BPE_JSON, encoding="utf-8") as f:
        own = token_files.ChunkEncoder(f.read())
    r = random.Random(11)
    for k in range(120):
        monkeypatch.setattr(token_files, "JOINED_CHUNKS", r.choice([1, 2, 100]))
        monkeypatch.setattr(token_files, "RUN_BYTES", r.choice([1, 40, 8 << 20]))
        some = r.sample(ODD, r.randint(2, len(ODD)))
        batch = ["".join(r.choice(some) for _ in range(r.randint(0, 25))) for _ in range(k)]
        expected = [np.array(e.ids, "<u4").tobytes()
                    for e in byte_bpe.encode_batch(batch, add_special_tokens=False)]
        assert own.encode_all(batch) == expected


def test_library_sees_each_word_once_and_many_in_one_text():
    with open(queries.BYTE_BPE_JSON, encoding="utf-8") as f:
        own = token_files.ChunkEncoder(f.read())
    library, seen = own.tokenizer, []

    class Counted:
        def encode_batch_fast(self, parts, **options):
            seen.extend(parts)
            return library.encode_batch_fast(parts, **options)

    own.tokenizer = Counted()
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijkléü") for _ in range(9)) for _ in range(2000)]
    batch = [f"Of {w}. In {w}, as {w}\nto {w}" for w in words]
    found = own.encode_all(batch)
    # Words that differ in what follows them are one chunk, and chunks share a text.
    assert sum(map(len, seen)) < 2 * sum(len(w) + 1 for w in words)
    assert len(seen) < len(words) // 10
    seen.clear()
    assert own.encode_all(batch) == found and not seen


def test_tokenizers_of_another_kind_take_whole_texts(byte_bpe):
    spec = json.loads(byte_bpe.to_str())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = Tokenizer.from_str(json.dumps(spec))
    own = token_files.ChunkEncoder(json.dumps(spec))
    batch = ["a b. c", "x\ny z", "", " q"]
    assert own.encode_all(batch) == [
        np.array(e.ids, "<u4").tobytes() for e in other.encode_batch(batch, add_special_tokens=False)]

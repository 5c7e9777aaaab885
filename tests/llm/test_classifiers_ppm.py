"""Classifiers by held-out accuracy, PPM against plain sums and a plain trie."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from spendlens.llm import fm, ppm, quality_fm, queries, toxicity_fm

SF = "/root/testdata/sf0.1"


def column(sf, name, *cols):
    t = ds.dataset(f"{sf}/{name}.parquet").to_table(columns=list(cols))
    return list(zip(*(c.to_pylist() for c in t.columns)))


@pytest.mark.parametrize("query,label,folds,rest,limit,accuracy,recall", [
    (queries.op2_quality_fm, 1, 5, 0, 0.3, 0.98, 0.98),
    (queries.op6_toxicity_fm, 2, 3, 1, 0.7, 0.96, 0.75)])
def test_held_out_accuracy(spark, query, label, folds, rest, limit, accuracy, recall):
    labels = {r[0]: r[label] for r in column(SF, "labels", "doc_id", "quality", "toxic")}
    rows = query(spark, SF).collect()
    assert len(rows) == len(column(SF, "documents", "doc_id"))
    right = n = hit = positive = 0
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == rest)
        if r["held_out"] and labels.get(r["doc_id"]) is not None:
            y = labels[r["doc_id"]]
            n, right = n + 1, right + (y == r["predicted"])
            positive, hit = positive + y, hit + (y and r["predicted"])
    assert right / n >= accuracy and hit / positive >= recall


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    d, words = 9, 6
    w, v = rng.normal(size=d), rng.normal(size=(d, 3))
    dense = rng.normal(size=(4, d - words))
    lists = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    rows, flat = fm.ragged(lists)
    got, _ = fm.margins(rows, flat, dense, 0.5, w, v)
    for i, own in enumerate(lists):
        x = np.zeros(d)
        x[own] = 1
        x[words:] = dense[i]
        pairs = sum(v[a] @ v[b] * x[a] * x[b] for a in range(d) for b in range(a))
        assert got[i] == pytest.approx(0.5 + w @ x + pairs)


def test_pairs_are_learned():
    """A label that holds only for two words together needs the interaction."""
    rng = np.random.default_rng(3)
    x = rng.random((600, 4)) < 0.5
    y = (x[:, 0] == x[:, 1]).astype(float)
    index = [np.flatnonzero(r) for r in x]
    p = fm.FitParams(rank=4, epochs=60)
    theta = np.concatenate((np.zeros(5), rng.normal(0, 0.1, 16)))
    state = fm.train_shard(index, np.zeros((600, 0)), y, np.stack((theta, np.full(21, 1e-2))), 4, p, 0)
    rows, flat = fm.ragged(index)
    margin, _ = fm.margins(rows, flat, np.zeros((600, 0)), state[0, 0], state[0, 1:5],
                           state[0, 5:].reshape(4, 4))
    assert ((margin > 0) == (y > 0)).mean() > 0.95


def test_fit_learns_words_that_tell_nothing_alone(spark):
    """Equal halves for each word alone and no statistics: only the pair tells."""
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        noise = " ".join(rng.choices([f"w{k}" for k in range(60)], k=12))
        rows.append((i, f"{'alpha' if a else 'one'} {'bravo' if b else 'two'} {noise}", int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").withColumn(
        "meta", F.lit(None).cast("long"))
    test = F.pmod("doc_id", F.lit(4)) == 0

    def describe(text, _meta=None):
        return set(text.encode().split()), [0.0]

    model = fm.fit(docs, docs.select("doc_id", "y"), "y", test, describe, 1)
    got = fm.score(docs.where(test), model, describe).select("y", "score").collect()
    assert sum((r["score"] > 0.5) == r["y"] for r in got) / len(got) > 0.95


@pytest.mark.parametrize("module,columns", [(quality_fm, "quality"), (toxicity_fm, "toxic")])
def test_classifier_edge_rows(spark, module, columns):
    docs = spark.createDataFrame(
        [(1, None, None, 1.0), (2, "", 0, 1.0), (None, "x", 1, 1.0), (3, "word " * 50_000, 5, 1.0),
         (3, "word " * 50_000, 5, 1.0)], "doc_id long, text string, n_chars long, score double")
    none = spark.createDataFrame([], f"doc_id long, {columns} int")
    rows = module.predictions(docs, none).collect()
    assert [r["score"] for r in rows] == [0.5] * 5
    one = spark.createDataFrame([(2, 1), (3, 0), (1, None)], f"doc_id long, {columns} int")
    assert all(0 <= r["score"] <= 1 for r in module.predictions(docs, one).collect())
    assert module.predictions(docs.limit(0), one).count() == 0


# ---- PPM -------------------------------------------------------------------------

def plain_base(docs):
    counts = Counter()
    for d, text in docs:
        if zlib.crc32(str("" if d is None else d).encode()) % 10:
            counts.update((text or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, text in docs:
        ws = [*(text or "").encode().lower().split(), None]
        out.append((d, len(ws), sum(counts[w] > 0 for w in ws), n, sum(
            math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return sorted(out, key=str)


def check_base(rows, docs):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])
                  for r in rows), key=str)
    for a, b in zip(got, plain_base(docs), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9)


def test_op9_sums_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_ppm(spark, sf).collect()
    check_base(rows, column(sf, "documents", "doc_id", "text"))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_ppm_edge_rows_and_rare_words(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HEAD_WORDS", 4)  # most words take the join
    docs = [(i, " ".join(random.Random(i).choices(["The", "cat", "sat", "ÉTÉ", f"rare{i}"], k=8)))
            for i in range(40)] + [(50, None), (51, ""), (None, "no id"), (7, "again"), (7, "again"),
                                   (60, "x" * 30_000), (20, "zq \x00 \x7f")]
    df = spark.createDataFrame([(*d, "a") for d in docs], "doc_id long, text string, score string")
    rows = ppm.score(df).collect()
    check_base(rows, docs)
    assert all(r["score"] < 0 for r in rows)
    assert ppm.score(df.limit(0)).count() == 0
    alone = ppm.score(df.where("doc_id = 51")).collect()
    assert len(alone) == 1 and alone[0]["n_tokens"] == 1


def test_trie_probabilities_sum_to_one():
    r = random.Random(1)
    batch = [bytes(r.choices(b"abcde", k=r.randint(1, 7))) for _ in range(300)]
    symbol, _, place, history = ppm.positions(batch)
    counts = Counter()
    for order in range(ppm.ORDER + 1):
        at = np.flatnonzero(place + 1 >= order)
        counts.update((ppm.contexts(history[at], order) << 9 | symbol[at]).tolist())
    trie = ppm.Trie.of(np.array(list(counts)), np.array(list(counts.values())))
    for text in (b"", b"a", b"abc", b"abcdeabcd", b"zz"):
        context = (b" " * 5 + text)[-5:]
        h = np.full(257, int.from_bytes(context, "big"))
        total = (10 ** trie.log10(np.arange(257), h, np.full(257, len(text)))).sum()
        assert total == pytest.approx(1)
    one = trie.words_log10([b"abc"])[0]
    parts = [trie.log10(np.array([s]), np.array([int.from_bytes((b"     " + b"abc"[:i])[-5:], "big")]),
                        np.array([i]))[0] for i, s in enumerate(b"abc ")]
    assert one == pytest.approx(sum(parts))


def whole_tries(docs, classes):
    """Tries of all words of the training documents, nothing left out."""
    out = []
    for kind in classes:
        train = [t for d, t, k in docs if k == kind and zlib.crc32(str(d).encode()) % 10]
        batch = [w for t in train for w in ppm.words(t.encode())]
        symbol, _, place, history = ppm.positions(batch)
        counts = Counter()
        for order in range(ppm.ORDER + 1):
            at = np.flatnonzero(place + 1 >= order)
            counts.update((ppm.contexts(history[at], order) << 9 | symbol[at]).tolist())
        for order in (0, 1):
            counts[int(ppm.contexts(np.array([0x20]), order)[0]) << 9 | ppm.END] += len(train)
        out.append((ppm.Trie.of(np.array(list(counts)), np.array(list(counts.values()))), len(train)))
    return out


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_scores_use_every_key_of_the_trie(spark, monkeypatch, chunk):
    monkeypatch.setattr(ppm, "MAX_KEYS", 50, raising=False)  # a limit of earlier versions
    monkeypatch.setattr(ppm, "CHUNK_WORDS", chunk, raising=False)
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdeé", k=r.randint(1, 9))) for _ in range(150)]
    docs = [(i, " ".join(r.choices(vocab, k=20)) + f" odd{i}", "xy"[i % 3 == 0]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    tries = whole_tries(docs, "xy")
    ends = sum(n for _, n in tries)
    got = {row["doc_id"]: row["score"] for row in ppm.score(df, "lang").collect()}
    for d, text, _ in docs:
        logs = [trie.words_log10(ppm.words(text.encode())).sum() + trie.end_log10()
                + math.log10(n / ends) for trie, n in tries]
        best = max(logs)
        assert got[d] == pytest.approx(best + math.log10(sum(10 ** (x - best) for x in logs)),
                                       rel=1e-5)


def test_head_of_very_frequent_words(spark):
    """Counts are told apart at every height, so the most frequent words are the head."""
    counts = [7 << 21] * 5 + [3 << 20] * 10 + [(1 << 53) - 1, 1 << 53, 5, 5, 1]
    table = spark.createDataFrame([(c,) for c in counts], "c long")
    for limit in range(len(counts) + 3):
        least = ppm._at_most(table, "c", limit)
        head = sum(c >= least for c in counts)
        assert head <= limit or limit == 0 and least > max(counts)
        left = [c for c in counts if c < least]
        assert all(c * max(limit, 1) <= 1.002 * sum(counts) for c in left) or not left
    assert ppm._at_most(table, "c", 8) == 7 << 21
    assert ppm._at_most(table, "c", 100) == 1


def plain_keys(text):
    """Each coded byte of a text behind the five before it."""
    line = b"     " + b" ".join(text.lower().split()) + b" " if text.split() else b""
    return [(line[i - 5:i], line[i]) for i in range(5, len(line))]


@pytest.mark.parametrize("size", [8, 1 << 20])
def test_contexts_run_on_over_blanks(size):
    texts = [b"The cat  sat\ton a mat", b"", b" a ", "\u00c9t\u00e9 b".encode(), b"x" * 40 + b" y zz"]
    got = [(int(o), (int(k) >> 12).to_bytes(5, "big"), int(k) & 511)
           for owner, keys in ppm.text_keys(list(map(ppm.words, texts)), size) for o, k in zip(owner, keys, strict=True)]
    assert got == [(i, c, s) for i, t in enumerate(texts) for c, s in plain_keys(t)]


@pytest.mark.parametrize("head", [3, 1 << 20])
def test_a_score_depends_on_the_order_of_words(spark, monkeypatch, head):
    monkeypatch.setattr(ppm, "HEAD_KEYS", head, raising=False)
    docs = [(i, "red apple green pear") for i in range(40)] + [(100, "red pear green apple")]
    rows = ppm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["base_score"] == pytest.approx(by_id[100]["base_score"])
    assert by_id[0]["score"] > by_id[100]["score"] + 0.5
    train = [t.encode() for d, t in docs if zlib.crc32(str(d).encode()) % 10]
    counts = Counter()
    for t in train:
        for c, s in plain_keys(t):
            for order in range(ppm.ORDER + 1):
                tail = int.from_bytes(c[5 - order:], "big")
                counts[(tail << 3 | order) << 9 | s] += 1
    for order in (0, 1):
        counts[((0x20 if order else 0) << 3 | order) << 9 | ppm.END] += len(train)
    trie = ppm.Trie.of(np.array(list(counts)), np.array(list(counts.values())))
    for d, t in docs:
        keys = plain_keys(t.encode())
        want = trie.log10(np.array([s for _, s in keys]),
                          np.array([int.from_bytes(c, "big") for c, _ in keys]),
                          np.full(len(keys), 5)).sum() + trie.end_log10()
        assert by_id[d]["score"] == pytest.approx(want, rel=1e-5)


def test_places_of_keys_in_the_head():
    r = np.random.default_rng(2)
    some = np.unique(r.integers(0, 1 << 52, 2000))
    for keys in (some[::2], some[:0]):
        head = ppm.Head(keys, r.integers(1, 9, len(keys)))
        known = {k: i for i, k in enumerate(keys.tolist())}
        assert head.find(some).tolist() == [known.get(k, len(keys)) for k in some.tolist()]

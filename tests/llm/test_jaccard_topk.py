"""Near-duplicate classes and top-k search against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from spendlens.llm import jaccard_join, pivot_topk, queries
from spendlens.llm.components import components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_links(sets):
    """Pairs of positions whose sets link."""
    lists, out = defaultdict(list), set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in lists[x]}:
            inter = len(s & sets[j])
            if 100 * inter >= 75 * (len(s) + len(sets[j]) - inter):
                out.add((j, i))
        for x in s:
            lists[x].append(i)
    return out


def plain_classes(docs):
    rows = sorted((d, t) for d, t in docs if d is not None)
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in plain_links(sets):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((d, len(s), rows[find(i)][0]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def as_classes(df):
    return sorted(tuple(r) for r in df.collect() if r["doc_id"] is not None)


def near_copies(seed, groups=6, copies=14, length=60):
    """Groups of texts that differ from a base by a few words, with chains in
    which ends are only linked through others, among shared and odd texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(length + r.randint(0, 20))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(text))
                if r.random() < 0.5:
                    text[at] = r.choice(vocab)
                else:
                    del text[at]
            if r.random() < 0.3:
                base = text
            out.append(" ".join(text))
    out += ["common line that many short texts share here " + r.choice(vocab) for _ in range(25)]
    out += [" ".join(r.choice(vocab) for _ in range(r.randint(1, 9))) for _ in range(20)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_of_near_copies(spark, seed):
    texts = near_copies(seed)
    texts += texts[:7] + [None, "", " \t\n", "One", "one", "ONE two", "a b c d", "A b\nc\td"]
    docs = [(i + 3, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, "repeated id")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, a int")
    got = jaccard_join.near_duplicates(df)
    assert as_classes(got) == plain_classes(docs)
    assert [r["component_id"] for r in got.where("doc_id is null").collect()] == [None]


def test_null_id_before_its_copy(spark):
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join([*base, "more"])]
    docs = [(None, texts[0]), (4, texts[0]), (9, texts[1]), (None, texts[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = jaccard_join.near_duplicates(df)
    assert as_classes(got) == plain_classes(docs) == [(4, 36, 4), (9, 37, 4)]
    assert [r["component_id"] for r in got.where("doc_id is null").collect()] == [None, None]
    assert [r["doc_id"] for r in jaccard_join.keep_first(df).orderBy("doc_id").collect()] == [
        None, None, 4]


def test_all_links_are_found(spark):
    texts = near_copies(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = jaccard_join.written(jaccard_join.document_sets(docs), "test")
    found = jaccard_join.links(jaccard_join.Verifier(docs, sets), all_links=True).collect()
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(shingle_set(t), i)
    distinct = sorted(first.values())
    expected = {(distinct[a], distinct[b])
                for a, b in plain_links([shingle_set(texts[i]) for i in distinct])}
    assert {tuple(sorted((r["doc_a"], r["doc_b"]))) for r in found} == expected
    assert len(found) == len(expected)


def test_op5_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    t = ds.dataset(f"{sf}/documents.parquet").to_table(columns=["doc_id", "text"])
    docs = list(zip(*(c.to_pylist() for c in t.columns)))
    assert as_classes(queries.op5_jaccard_join(spark, sf)) == plain_classes(docs)


def test_one_document_of_each_class_stays(spark):
    texts = near_copies(6, groups=3) + [None, ""]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = jaccard_join.keep_first(df)
    assert kept.columns == df.columns
    expected = [d for d, n, c in plain_classes(docs) if d == c]
    expected.remove(0)  # the repeated row
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == expected


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(docs).count() == 0
    assert jaccard_join.keep_first(docs).count() == 0


def test_components_of_paths_and_stars(spark):
    r = random.Random(0)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    links = path + star + [(7, 7), (200, 201), (None, 3)]
    r.shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    expected = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert got == expected


# ---- top-k -----------------------------------------------------------------------

def plain_top(rows, k=20, every=20):
    fine = [(i, np.floor(64 * np.array(v, float))) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, np.pad(v, (0, width - len(v)))) for i, v in fine]
    out = []
    for q, v in fine:
        if q % every == 0:
            best = sorted((-int(v @ x), i) for i, x in fine if i != q)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


def as_rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_op7_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    t = ds.dataset(f"{sf}/embeddings.parquet").to_table(columns=["vec_id", "embedding"])
    rows = list(zip(*(c.to_pylist() for c in t.columns)))
    assert as_rows(queries.op7_pivot_topk(spark, sf)) == plain_top(rows)


def test_ties_hot_vectors_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "BLOCK_ROWS", 32)
    monkeypatch.setattr(pivot_topk, "GROUP_ROWS", (1, 10))
    monkeypatch.setattr(pivot_topk, "CELL_ROWS", (1, 48))
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)]  # one vector in a third of the rows
    rows += [(2000, None), (2020, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6),
             (2060, [float("inf")] * 6), (None, [1.0] * 6), (2080, [0.25, 0.5]), (-20, [0.0] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows],
                               "vec_id long, embedding array<float>, score string")
    assert as_rows(pivot_topk.search(df)) == plain_top(rows)


def test_small_and_empty_tables(spark):
    few = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert as_rows(pivot_topk.search(df)) == plain_top(few)
    assert pivot_topk.search(df.limit(0)).count() == 0
    assert pivot_topk.search(df.where("vec_id = 0")).count() == 0


def test_closed_annuli_are_not_sent(spark, monkeypatch):
    """Clusters on a sphere: the bounds close annuli of other clusters for a group of
    queries; of rows of one id the least vector asks."""
    monkeypatch.setattr(pivot_topk, "GROUP_ROWS", (1, 12))
    rng = np.random.default_rng(5)
    centres = 8 * np.concatenate((np.eye(3), -np.eye(3)))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.05, 3)).tolist()) for i in range(3000)]
    rows += [(0, [9.0, 9.0, 9.0]), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = pivot_topk.Index(pivot_topk.integer_vectors(df))
    wanted = index.vectors.where("vec_id % 20 = 0").groupBy("vec_id").agg(F.min("v").alias("v"))
    bounded = index.bounded(wanted, 20).toArrow()
    assert len(bounded) == 150 and np.isfinite(bounded.column("bound").to_numpy()).all()
    groups = len(set(bounded.column("g").to_pylist()))
    opened = index.open_rings(index.bounded(wanted, 20)).count()
    assert groups > 4 and opened < 0.7 * groups * len(index.rings)
    fine = [(i, np.floor(64 * np.array(v))) for i, v in rows]
    asks = {}
    for i, v in fine:
        if i % 20 == 0:
            asks[i] = min(asks.get(i, v.tolist()), v.tolist())
    want = [(q, rank + 1, i, -s) for q, v in asks.items() for rank, (s, i) in enumerate(
        sorted((-int(np.array(v) @ x), i) for i, x in fine if i != q)[:20])]
    assert as_rows(pivot_topk.search(df)) == sorted(want)


def test_keep_first_judges_rows_of_one_id_by_their_texts(spark):
    a, x = "alpha beta gamma delta epsilon zeta eta theta iota", "one two three four five six seven"
    rows = [(1, a), (5, a), (5, x), (5, x), (7, a + " kappa"), (7, x + " eight nine ten"), (9, None),
            (9, ""), (None, a), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "q", "s") for r in rows],
                                 "doc_id long, text string, _copy int, `a.b` string, set_id string")
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (5, x), (7, x + " eight nine ten"), (9, None), (9, ""),
                          (None, a), (None, None)], key=str)


def test_one_id_with_several_texts_of_a_class_keeps_one_row(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(1, a), (1, a + " more"), (2, a), (1, "quite another text with words of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.keep_first(docs).collect()]
    assert len(got) == 2 and all(r[0] == 1 for r in got) and rows[3] in got


def test_shared_passages_stand_behind_one_time_shingles(spark):
    """The order is by shingles: a passage of common words that many documents share
    does not enter prefixes that hold one-time shingles of the same words."""
    r = random.Random(8)
    vocab = [f"c{i}" for i in range(30)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = [(i, " ".join([r.choice(vocab) for _ in range(150)] + passage)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = jaccard_join.document_sets(docs).where("prefix is not null").cache()
    lists = jaccard_join.prefix_lists(sets)
    assert lists.count() < 300  # a word order gave each passage shingle a list of 300
    got = jaccard_join.near_duplicates(docs).collect()
    assert all(x["component_id"] == x["doc_id"] for x in got)
    sets.unpersist()


def test_batch_shingles_equal_single_ones():
    from spendlens.llm.shingles import WordHashes, shingles
    h = WordHashes()
    words = [h.of(t.encode()) for t in ("", "a", "a b c d", "a b c d e", "x " * 30, "p q r s t u v")]
    want = np.sort(np.concatenate([shingles(w) for w in words]))
    assert (np.sort(jaccard_join.batch_shingles(words)) == want).all()
    assert not len(jaccard_join.batch_shingles([])) and len(jaccard_join.batch_shingles(words[1:2])) == 1

"""Importance resampling and interleaved sharding against plain versions."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spendlens.llm import importance as I, ranges, sharding as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=1):
    found = WORD.findall((text or "").translate(LOWER))
    return found, [" ".join(found[i:i + n]) for n in range(1, longest + 1)
                   for i in range(len(found) - n + 1)]


def plain(rows, target, percent=10, min_words=20, seed=2024, buckets=10_000, longest=1):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            counts.update(map(bucket, features(text, longest)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(
        (t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for doc_id, text in rows:
        found, grams = features(text, longest)
        weight = sum(gain(bucket(f)) for f in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(grams), weight, score, None, len(found)])
    fit = sorted((r for r in out if r[5] >= min_words),
                 key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for rank, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


LONG = "the quick brown fox jumps over the lazy dog again and again until night falls on the old town wall"


def rows_with_edges():
    rows = [(i, f"{LONG} {i} {'maths proof' if i % 7 == 0 else 'Weather'} " + "x" * (i % 5))
            for i in range(60)]
    rows += [(3, None), (None, LONG + " theorem"), (None, ""), (61, " ,;\x7f "), (62, "É Ünï straße " * 9)]
    return rows + [(7, LONG + " proof proof")] * 25  # repeated rows, tied in all


@pytest.mark.parametrize("percent,longest", [(10, 1), (37, 1), (100, 1), (50, 3), (0, 1)])
def test_resampling_equals_plain_version(spark, percent, longest):
    rows, target = rows_with_edges(), ["A maths proof of a theorem.", None, "", "proof"]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows],
                                 "doc_id long, text string, `a.b` string, score int").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = I.resample(docs, t, percent=percent, longest=longest)
    assert shown(got) == plain(rows, target, percent, longest=longest)


def test_resampling_without_target_or_documents(spark):
    rows = [(i, f"{LONG} {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = docs.where("false")
    assert shown(I.resample(docs, none)) == plain(rows, [])
    assert I.resample(none, docs).collect() == []


def test_bisection_finds_exact_cutoffs(spark):
    values = [5, 5, 5, -3, 9, 9, 2 ** 62, -(2 ** 62), 0, 5]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for wanted in range(1, len(values) + 1):
        x, below = I.smallest(rows, F.col("v"), min(values), max(values), wanted)
        assert x == sorted(values)[wanted - 1]
        assert below == sum(v < x for v in values)


def test_all_scores_and_ids_equal(spark):
    rows = [(4, LONG + " twin")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = I.resample(docs, docs, percent=25)
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 11))


def test_places_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), "id")
    for parts in (1, 13):
        placed = ranges.numbered(rows.repartition(parts), F.col("a"), -F.col("id")).collect()
        want = sorted((r["a"], -r["id"]) for r in placed)
        assert all((r["a"], -r["id"]) == want[r["place"]] for r in placed)
        assert len({r["place"] for r in placed}) == 1000


# ---------------------------------------------------------------- sharding
def plain_shards(rows, shards=8, seed=2024):
    """rows (doc_id, text, source) -> sorted (doc_id, size, crc, shard, slot)."""
    slim = []
    for doc_id, text, source in rows:
        raw = (text or "").encode()
        crc = zlib.crc32(raw)
        key = hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}:{crc}".encode()).hexdigest()
        slim.append((doc_id, len(raw) + 1, crc, key, "" if source is None else "=" + source))
    order = []
    for stratum in {r[4] for r in slim}:
        mine = sorted((r for r in slim if r[4] == stratum), key=lambda r: r[3])
        order += [((2 * i + 1) / (2 * len(mine)), r[3], stratum, r) for i, r in enumerate(mine)]
    order.sort(key=lambda x: x[:3])
    n, out, used = len(order), [], Counter()
    for place, (*_, r) in enumerate(order):
        s = place * shards // n
        out.append((*r[:3], s, used[s]))
        used[s] += 1
    return sorted(out, key=str)


def shard_rows():
    rows = [(i, f"text {i % 9}", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(200)]
    return rows + [(7, "é", None), (7, "é", None), (None, None, ""), (8, "", None), (9, None, "x.y")]


def test_shards_equal_plain_version(spark):
    rows = shard_rows()
    docs = spark.createDataFrame([(*r, "q") for r in rows],
                                 "doc_id long, text string, source string, `a.b` string")
    docs = docs.withColumn("shard", F.lit("clash")).withColumn("place", F.lit(1)).repartition(4)
    got = S.shard(docs)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = sorted((tuple(r) for r in got.select(
        "doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str)
    assert found == plain_shards(rows)


@pytest.mark.parametrize("shards", [1, 3, 8, 500])
def test_every_shard_matches_the_mixture(spark, shards):
    rows = shard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = S.shard(docs, shards).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(x) for x in slots.values()] + [0] * (shards - len(slots))
    assert len(rows) == sum(sizes) and max(sizes) - min(sizes) <= 1
    placed = S.interleaved(docs).collect()
    share = Counter((r["place"] * shards // len(rows), r["stratum"]) for r in placed)
    for stratum, n in Counter(r["stratum"] for r in placed).items():
        assert all(abs(share[s, stratum] - n / shards) < 2 for s in range(shards))


def test_no_rows_no_shards(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert S.shard(docs).collect() == []

"""Periodic runs against a brute force over all periods."""
import hashlib
import random

import numpy as np
import pytest

from spendlens.llm import periodic_runs as R


def brute(words, min_length=R.MIN_LENGTH):
    """All runs (start, length, period): for each period the stretches of equal words."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(min_length, 2 * q):
                best.setdefault((start, i + q - start), q)  # periods ascend
    return sorted((s, length, q) for (s, length), q in best.items())


def plain(doc_id, text, rewrite=None):
    words = (text or "").encode().split()
    words = rewrite(doc_id, words) if rewrite else words
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    keep = set(range(len(words)))
    for s, length, q in runs:
        keep -= set(range(s + q, s + length))
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *top, top[0] is not None and 1000 * top[1] // top[2] or None,
            hashlib.sha256(said.encode()).hexdigest(),
            hashlib.sha256(b" ".join(words[i] for i in sorted(keep))).hexdigest())


def odd_texts(seed, count, longest):
    """Random words with runs of many periods, nested, adjoining and cut off."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        words, n = [], rng.randint(0, longest)
        while len(words) < n:
            unit = [rng.choice("abcdefgh") for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 13, 30, 70)))]
            if rng.random() < 0.3:
                unit = unit * 2 + [rng.choice("ab")]
            words += unit * rng.randint(1, 6) + unit[:rng.randint(0, len(unit))]
        out.append(" ".join(words[:n]))
    return out


def hashes(text):
    return np.array([hash(w) & (2 ** 64 - 1) for w in text.split()], np.uint64)


@pytest.mark.parametrize("tile", [64, 256, R.TILE])
def test_stitched_tiles_equal_brute_force(spark, tile):
    texts = odd_texts(tile, 60, 700) + ["a " * 500, "a b " * 300, "", "x", " ".join("ab" * 6)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {i: [] for i, _ in rows}
    for r in R.find_runs(docs, tile=tile).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["period"]))
    for i, t in rows:
        assert sorted(got[i]) == brute(t.split()), (i, t)


def test_tiles_cover_every_position_once():
    for n in (1, 63, 64, 65, 1000, 5001):
        seen = {}
        for octaves, part, core in R.tiles(n, 64):
            assert 0 <= part.start <= part.start + core.start and part.stop <= n
            for o in octaves:
                seen.setdefault(o, []).append((part.start + core.start, part.start + core.stop))
        assert sorted(seen) == list(range(max((n // 2).bit_length(), 1)))
        for spans in seen.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == n
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
           "collapsed_sha256"]


def test_edge_rows_clashing_columns_and_repeats(spark):
    hot = "one two three " * 40
    rows = [(1, hot, "r"), (1, hot, "r"), (1, "other words here", "r"), (None, hot, "r"),
            (2, None, "r"), (3, "", None), (4, " \t\n ", "r"), (5, "A a " * 9, "r"),
            (6, "é " * 11, "r"), (7, "é " * 12, "r"), (8, "x\x00y z " * 30, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumnsRenamed(
        {}).selectExpr("row", "text", "doc_id", "row as `a.b`", "row as fragments", "row as period")
    got = R.report(docs)
    assert got.columns == COLUMNS
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(
        (plain(i, t) for i, t, _ in rows), key=key)
    whole = {tuple(r)[:8]: r["collapsed"] for r in R.report(docs, keep_text=True).collect()}
    assert set(whole) == {plain(i, t) for i, t, _ in rows}
    assert whole[plain(1, hot)] == "one two three" and whole[plain(2, None)] == ""
    assert R.report(docs.where("false")).collect() == []


def test_echo_repeats_the_given_stretch():
    words = [str(i).encode() for i in range(100)]
    changed = 0
    for doc_id in range(300):
        got = R.echo(doc_id, list(words))
        h = __import__("zlib").crc32(str(doc_id).encode())
        if h % 10:
            assert got == words
            continue
        changed += 1
        a = h // 10 % 100
        p = 1 + (100 - a) // (3 + h // 10 % 8)
        assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(100)]
    assert 10 < changed < 60


def test_a_tile_of_one_word_is_not_quadratic():
    """All periods of an octave hold at every boundary; one fragment remains."""
    found = R.solve(np.zeros(1 << 15, np.int64), range(14), range(1 << 15))
    assert found.tolist() == [[1, 0, 1 << 15]]


def test_query_equals_brute_force_on_the_whole_table(spark, sf_dir):
    from spendlens.llm import queries
    from spendlens.llm.common import table
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_periodic_runs"](spark, sf_dir)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(plain(*r, R.echo) for r in rows)

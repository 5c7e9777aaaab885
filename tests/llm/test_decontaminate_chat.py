"""Decontamination and chat formatting against plain versions."""

import hashlib
import random
import re
import sys

import pyarrow.dataset as ds
import pytest

from spendlens.llm import chat_events, decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_report(docs, items):
    windows = {}
    for item_id, text in items:
        w = WORD.findall(lower(text))
        size = min(10, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[i:i + size]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, found = [False] * len(w), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                got = windows.get(tuple(w[i:i + size]))
                if got:
                    hit[i:i + size] = [True] * size
                    found |= got
        found -= {None}
        out.append((doc_id, len(w), sum(hit), len(found),
                    hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(),
                    any(hit)))
    return sorted(out, key=str)


def as_tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_op10_equals_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    docs = ds.dataset(f"{sf}/documents.parquet").to_table(columns=["doc_id", "text"])
    items = ds.dataset(f"{sf}/benchmark.parquet").to_table(columns=["item_id", "text"])
    expected = plain_report(zip(*(c.to_pylist() for c in docs.columns)),
                            list(zip(*(c.to_pylist() for c in items.columns))))
    assert as_tuples(queries.op10_decontaminate(spark, sf)) == expected
    assert any(r[5] for r in expected)


@pytest.fixture
def tricky():
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten + " eleven"), (2, "Short-Item"), (3, None), (4, "..."), (None, "lost id"),
             (1, ten + " eleven"), (10, "ÄÖ ü")]
    docs = [(1, f"x {ten.upper()}, y"), (2, "a short item b"), (3, None), (4, ""), (5, "äö ü ÄÖ ü"),
            (6, "lost id"), (6, "lost id"), (None, ten), (7, ten.replace(" ", " ")),
            (8, f"{ten} eleven {ten}")]
    return docs, items


def memory(index):
    """Bytes of everything an index holds."""
    parts = [index.number, *index.number.keys(), *index.number.values()]
    for windows in index.by_length.values():
        parts += [windows, *windows.keys(), *windows.values()]
    return sum(sys.getsizeof(x) for x in {id(x): x for x in parts}.values())


@pytest.mark.parametrize("copies", [1, 2, 7])
def test_index_stays_within_its_bound(copies):
    rng = random.Random(4)
    items = []
    for i in range(3000):
        text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randint(1, 40)))
        items += [(i * copies + k, text.encode()) for k in range(copies)]
    index = decontaminate.WindowIndex(items, 10)
    bound = sum(len(t) + decontaminate.WORD_BYTES * len(decontaminate.words(t)) for _, t in items)
    assert memory(index) <= bound


def test_blocks_stay_within_the_bound(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 30))))
            for i in range(300)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    limit = 60_000
    blocks = [b.collect() for b in decontaminate._blocks(items, "item_id", "text", limit)]
    assert sorted((r["item"], r["text"]) for b in blocks for r in b) == rows
    sizes = [sum(len(r["text"]) + decontaminate.WORD_BYTES * len(r["text"].split()) for r in b)
             for b in blocks]
    assert max(sizes) <= limit and len(blocks) <= 1.5 * sum(sizes) / limit + 1


@pytest.mark.parametrize("limit", [1 << 28, 15_000, 30])
def test_edge_rows_and_blocks(spark, tricky, limit):
    docs, items = tricky
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(left, right, max_index_bytes=limit)
    assert as_tuples(got) == plain_report(docs, items)


def test_clean_documents_stay_and_spans_go(spark, tricky):
    docs, items = tricky
    left = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, _x string")
    right = spark.createDataFrame(items, "item_id long, text string")
    hit = {str(r[0]) for r in plain_report(docs, items) if r[5]}
    kept = decontaminate.drop_contaminated(left, right)
    assert kept.columns == left.columns
    assert {str(r["doc_id"]) for r in kept.collect()} == {str(d) for d, _ in docs} - hit
    cut = {str(r["doc_id"]): r["text"] for r in decontaminate.remove_spans(left, right).collect()}
    assert cut["1"] == "x , y" and cut["2"] == "a  b" and cut["3"] is None
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(left, none).count() == len(docs)
    assert decontaminate.report(left.limit(0), right).count() == 0


# ---- chat ------------------------------------------------------------------------

def plain_digests(turns):
    out = {}
    for conv, _, role, text in sorted(turns, key=lambda t: (t[0], t[1], t[2] or "", t[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(),
                sum(len(x) for r, x in t if r == "assistant"),
                hashlib.sha256("".join(x for r, x in t if r == "assistant").encode()).hexdigest())
            for c, t in out.items()}


def as_digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
            for r in df.collect()}


def test_op8_equals_plain_version(spark, sf_dir):
    t = ds.dataset(f"{sf_dir}/conversations.parquet").to_table(
        columns=["conv_id", "turn", "role", "text"])
    s = "</s>[INST] ok [/INST]"
    turns = list(zip(*(c.to_pylist() for c in t.columns))) + [
        (-1, 0, "user", s), (-1, 1, "assistant", s)]
    assert as_digests(queries.op8_chat_events(spark, sf_dir)) == plain_digests(turns)


def test_any_text_survives_the_template(spark):
    r = random.Random(3)
    parts = ["<", "|", "\\", "s>", "/s>", "[", "INST]", "/INST]", "\n", "x", "<|im_end|>\n",
             "<|im_start|>assistant\n", "é", "𝄞"]
    turns = [(c, k, r.choice(["user", "assistant", "sys\nt\\n", None]),
              "".join(r.choice(parts) for _ in range(r.randint(0, 12))) or None)
             for c in range(60) for k in range(4)]
    turns += turns[:5] + [(7, None, "user", "no turn")]
    df = spark.createDataFrame([(*t, 0) for t in turns],
                               "conv_id long, turn long, role string, text string, msg int")
    rendered = chat_events.render(chat_events.fold(chat_events.turn_events(df)))
    plain = [(c, -1 if k is None else k, a, b) for c, k, a, b in turns]
    assert as_digests(chat_events.conversation_digests(rendered)) == plain_digests(plain)
    for row in rendered.collect():
        assert chat_events.parse_turn(row["formatted"]) == (row["role"], row["text"])
        if row["loss_start"] is not None:
            inside = row["formatted"][row["loss_start"]:row["loss_end"]]
            assert chat_events.unescape(inside) == row["text"]
            assert "<|" not in inside and "[INST]" not in inside


def test_fold_applies_deltas_edits_and_regenerations(spark):
    log = spark.createDataFrame([
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""),
        (1, 1, 3, "delta", None, "b"), (1, 1, 2, "delta", None, "a"),
        (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "new"),
        (1, 1, 6, "delta", None, None), (1, 0, 7, "edit", None, "hello"),
        (2, 0, 1, "delta", "user", "only")],
        "conv_id long, msg long, seq long, kind string, role string, text string")
    got = {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in chat_events.fold(log).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "new"), (2, 0): ("user", "only")}
    assert chat_events.fold(log.limit(0)).count() == 0

"""Each pipeline stage against a plain version of its decision, on its own input."""

import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from spendlens.llm import quality_fm, queries, toxicity_fm
from spendlens.llm.common import table, written
from spendlens.llm.prefix_bpe import read_ranks
from test_decontaminate_chat import plain_report
from test_jaccard_topk import plain_classes


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near duplicates", "decontamination", "byte-level BPE"]
    labels = table(spark, sf_dir, "labels")
    before = table(spark, sf_dir, "documents")
    schema = before.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, sf_dir), "test-stage")
        assert after.schema == schema
        old, new = rows_of(before), rows_of(after)
        assert all(old[k] == new[k] for k in new)
        if name in ("toxicity", "quality"):
            model = toxicity_fm if name == "toxicity" else quality_fm
            called = {r["doc_id"]: r["predicted"] for r in model.predictions(before, labels).collect()}
            expected = {d for d, y in called.items() if y == (name == "quality")}
        elif name == "near duplicates":
            docs = [(d, r["text"]) for d, r in old.items()]
            expected = {d for d, _, c in plain_classes(docs) if d == c}
        else:
            items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
            report = plain_report([(d, r["text"]) for d, r in old.items()], items)
            expected = {r[0] for r in report if not r[5]}
        assert set(new) == expected, name
        before = after
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                                mergeable_ranks=read_ranks(queries.MULTI_RANKS))
    last = rows_of(corpus_pipeline.STAGES[-1][1](spark, before, sf_dir))
    for d, r in rows_of(before).items():
        ids = np.array(library.encode_ordinary(r["text"] or ""), "<u4").tobytes()
        assert bytes(last[d]["token_ids"]) == ids
        assert last[d]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert set(last) == set(new)


def test_run_is_the_stages_in_order(spark, tmp_path):
    """On an own folder with NULLs, empty texts and an extra column."""
    text = "some plain words that make a short document of no harm at all here"
    docs = [(1, text, "en", "s", 10, 0), (2, text, "en", "s", None, 0), (3, None, None, None, None, 0),
            (4, "", "en", "s", 0, 0), (5, "window of the benchmark item", "en", "s", 3, 0)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, token int"
    spark.createDataFrame(docs, columns).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, "the benchmark item")], "item_id long, text string").write.parquet(
        f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"file://{tmp_path}/labels.parquet")
    got = rows_of(corpus_pipeline.run(spark, f"file://{tmp_path}"))
    assert set(got) == {1, 3, 4}
    assert got[3]["token_ids"] == b"" and got[1]["token"] == 0


def test_stages_take_columns_of_any_name(spark, sf_dir):
    """Dots, and the names that the stages use themselves."""
    odd = ["a.b", "_fm_toxic", "_fm_quality", "_copy", "set_id", "component_id", "class", "_dc_hits",
           "_dc_words", "x0", "token_ids", "score"]
    docs = table(spark, sf_dir, "documents").limit(60)
    for name in odd:
        docs = docs.withColumn(name, F.lit("kept"))
    docs = written(docs.unionByName(docs.limit(3)), "test-odd")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), "test-odd")
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        assert after.where(" or ".join(f"`{n}` <> 'kept'" for n in odd)).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and last.columns.count("token_ids") == 1

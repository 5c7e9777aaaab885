"""Every registered query with an oracle equals DuckDB on the same tables (sf0.001)."""
import pytest

import __spark_entry__ as entry
from spendlens.plans import catalog
from spendlens.plans.oracle_check import compare, duck

SKIP_SLOW = {"fit_predict_gbt", "fit_predict_svm", "train_all"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["category", "total_spent", "avg_transaction", "num_transactions",
                          "std_dev", "pct_of_total"]


def test_oracle_parity(spark, sf_dir):
    names = [n for n in catalog.ORACLE if n in catalog.QUERIES]
    res = compare(spark, sf_dir, names, con=duck(sf_dir), verbose=False)
    bad = {k: v for k, v in res.items() if not v.get("match")}
    assert not bad, bad


def test_every_query_runs(spark, sf_dir):
    missing = set(entry.oracle_sql()) - set(entry.queries())
    assert not missing
    for name, q in catalog.QUERIES.items():
        if name in catalog.ORACLE or name in SKIP_SLOW:
            continue
        assert q(spark, sf_dir).count() >= 0, name

"""The library's queries stand without the training-data package."""
import sys

import __spark_entry__ as entry
from spendlens.plans import catalog


def test_entry_without_training_data_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) == set(catalog.ORACLE)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""The driver's entry points, with and without the data-preparation package."""

import importlib
import sys

from homescore.plans.oracle import ORACLE
from homescore.plans.queries import QUERIES


def load():
    sys.modules.pop("__spark_entry__", None)
    return importlib.import_module("__spark_entry__")


def test_every_query_is_registered():
    entry = load()
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = load()
    assert entry.queries().keys() == QUERIES.keys() and entry.oracle_sql().keys() == ORACLE.keys()
    sys.modules.pop("__spark_entry__", None)

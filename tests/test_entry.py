"""The driver entry, with and without the subpackage of training-data operators."""

import importlib
import sys

import __spark_entry__
from threadloom.plans import queries as plans


def test_entry_without_llm(monkeypatch):
    with monkeypatch.context() as m:
        m.setitem(sys.modules, "threadloom.llm", None)
        m.setitem(sys.modules, "threadloom.llm.queries", None)
        m.delitem(sys.modules, "__spark_entry__")
        alone = importlib.import_module("__spark_entry__")
        assert set(alone.queries()) == set(plans.queries()) and set(alone.oracle_sql()) == set(plans.oracle_sql())


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""The driver's contract, with and without the training-data subpackage."""

import importlib
import sys

import __spark_entry__ as entry_module


def test_names():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_entry(spark):
    found = entry_module.entry(spark)
    assert found.count() > 0 and "composite" in found.columns


def test_without_the_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("quillspan.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry_module)
    names = set(alone.queries())
    assert "merged_rank" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    monkeypatch.undo()
    importlib.reload(entry_module)

import importlib

import __spark_entry__ as entry


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setitem(__import__("sys").modules, "fusemill.llm", None)
    alone = importlib.reload(entry)
    assert "p3_found" in alone.queries() and "bm25_topk_lucene" in alone.queries()
    monkeypatch.undo()
    importlib.reload(entry)

import builtins
import importlib
import sys

import pytest

import __spark_entry__


def test_keys():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60
    assert {"translate_text", "best_translation", "import_pipeline"} <= set(queries)


@pytest.mark.parametrize("hidden", [("glosswork.llm", "corpus_pipeline"), ("corpus_pipeline",)])
def test_entry_without_the_corpus_operators(monkeypatch, hidden):
    real = builtins.__import__

    def fake(name, globals=None, locals=None, fromlist=(), level=0):
        if name in hidden or name == "glosswork.llm" and "glosswork.llm" in hidden:
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    before = {k: v for k, v in sys.modules.items() if k.startswith("glosswork.llm") or k == "corpus_pipeline"}
    for k in before:
        sys.modules.pop(k)
    monkeypatch.setattr(builtins, "__import__", fake)
    try:
        again = importlib.reload(__spark_entry__)
        assert "translate_text" in again.queries() and "pipeline" not in again.queries()
        assert any(k.startswith("op") for k in again.queries()) == (len(hidden) == 1 and again.llm is not None)
    finally:
        monkeypatch.undo()
        sys.modules.update(before)
        importlib.reload(__spark_entry__)

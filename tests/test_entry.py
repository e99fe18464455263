import importlib
import sys

import __spark_entry__


def test_entry_and_queries(spark):
    assert __spark_entry__.entry(spark).count() == 20
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_without_the_training_data_subpackage(monkeypatch):
    """The rest imports and offers its queries when that subpackage is gone."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("tidemill.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(name, name=name)
            return None

    for name in [n for n in sys.modules if n.startswith("tidemill.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert "pipeline" not in entry.queries() and not any(n.startswith("op1_") for n in entry.queries())
    assert "search_time_score_page" in entry.oracle_sql()

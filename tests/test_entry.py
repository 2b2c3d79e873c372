"""The entry module works with and without the training-data part."""

import importlib
import sys

from lodeweave.plans.queries import QUERIES


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_without_training_data_part(monkeypatch):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name in ("lodeweave.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n.startswith("lodeweave.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    e = importlib.reload(importlib.import_module("__spark_entry__"))
    assert set(e.queries()) == set(QUERIES)


def test_library_does_not_import_it():
    import pathlib

    for f in pathlib.Path(__file__).parent.parent.joinpath("lodeweave").rglob("*.py"):
        if "llm" not in f.parts:
            assert "lodeweave.llm" not in f.read_text()

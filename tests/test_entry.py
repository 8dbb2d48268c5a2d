"""The entry point must stand without the corpus subpackage, and nothing else may import it."""

import ast
import importlib
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
NAME = "ll" + "m"


def test_entry_without_the_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(f"clearfield.{NAME}")] + ["corpus_pipeline", "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, f"clearfield.{NAME}", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    assert set(entry.oracle_sql()) <= set(names)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.skipif(not (ROOT / "clearfield" / NAME).is_dir(), reason="the subpackage is taken out")
def test_failures_inside_the_subpackage_surface(monkeypatch):
    """Only the subpackage's own absence is looked over, not that of something it needs."""
    for name in [n for n in sys.modules if n.startswith(f"clearfield.{NAME}")] + ["corpus_pipeline", "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "regex", None)
    with pytest.raises(ImportError):
        importlib.import_module("__spark_entry__")
    for name in [n for n in sys.modules if n.startswith(f"clearfield.{NAME}")] + ["__spark_entry__"]:
        sys.modules.pop(name, None)


def test_nothing_else_imports_it():
    for path in (ROOT / "clearfield").rglob("*.py"):
        if NAME in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] + [a.name for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any(NAME in n.split(".") for n in names), path

from __future__ import annotations

import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lexquarry.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
MAY_BE_EMPTY = {"graph_amendments", "graph_references", "hop_graph", "broken_parents", "duplicate_keys", "repeated_keys", "running_footers", "dangling_edges", "p3_found", "order_chunks", "statute_sections", "amended_sections", "exact_lookup", "filtered_topk"}


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and catalog.FLAGSHIP in entry.queries()


def test_the_core_does_not_import_the_subpackage():
    for path in (ROOT / "lexquarry").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("lexquarry.llm") for n in names), path


def test_the_entry_survives_without_what_the_subpackage_needs(monkeypatch):
    import builtins

    real = builtins.__import__

    def without(name, *args, **more):
        if name.startswith("lexquarry.llm"):
            raise ImportError("no module named tokenizer", name="tokenizer")
        return real(name, *args, **more)

    monkeypatch.setattr(builtins, "__import__", without)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.SQL)


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_entry(spark):
    assert entry.entry(spark).columns == ["tab", "field", "row_key"]


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_have_rows(spark, name):
    """Every query runs on the smallest tables, and all but a few have rows there."""
    df = catalog.QUERIES[name](spark, str(DATA))
    n = df.count()
    assert df.columns and (n > 0 or name in MAY_BE_EMPTY)

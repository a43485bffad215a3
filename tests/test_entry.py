"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import importlib
import os
import sys

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(__spark_entry__.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert normal(tuple(r) for r in got.select(*columns).collect()) == normal(rows)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["sid", "nation"]


def test_core_stands_without_the_corpus_package(monkeypatch):
    hidden = [m for m in sys.modules if m.startswith("quarry.llm") or m in ("corpus_pipeline", "__spark_entry__")]
    for m in hidden:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.raises(ImportError):
        import corpus_pipeline  # noqa: F401
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(entry.QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")

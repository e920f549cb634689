"""Every registered query against its SQL on the smallest scale."""

import glob
import importlib
import os

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
CORE, CORE_SQL = entry.QUERIES, entry.ORACLE
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(CORE) == set(CORE_SQL)
    assert set(CORE) <= set(QUERIES) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got, columns = [tuple(r) for r in df.collect()], df.columns
    want = duck.execute(ORACLE[name])
    want_columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(want_columns)
    assert normal(got, columns) == normal(want.fetchall(), want_columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_added_operators(monkeypatch):
    """A subpackage that is there and cannot be imported leaves the other queries."""
    import_module = importlib.import_module

    def broken(name, *args):
        if name.startswith("spendloom.llm"):
            raise ModuleNotFoundError(name)
        return import_module(name, *args)

    monkeypatch.setattr(importlib, "import_module", broken)
    assert set(entry.queries()) == set(CORE) == set(entry.oracle_sql())

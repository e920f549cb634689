"""Queries that SQL can express, against it."""

import pytest

from spendloom.llm.queries import ORACLE, QUERIES


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str(tuple(r[i] for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

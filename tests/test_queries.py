"""Each query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and n[:2] != "op"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, found):
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return names, sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = duck.execute(entry.oracle_sql()[name])
    names, want = rows([d[0] for d in sql.description], sql.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(got[0]) == sorted(names)
    assert got[1] == want


def test_entry(spark):
    assert entry.entry(spark).count() == 25

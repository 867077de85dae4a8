"""Every registered query against its SQL in DuckDB, or its row count where there is none."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 4) if isinstance(v, float) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: (repr([x for x in r if not isinstance(x, float)]), [x for x in r if isinstance(x, float)]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    assert got or name in ("join_traits_nway",)
    if name in ORACLES:
        r = con.execute(ORACLES[name])
        columns, rows = [d[0] for d in r.description], r.fetchall()
        assert sorted(columns) == sorted(df.columns)
        want = table(columns, rows)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == (pytest.approx(y, abs=2e-4, rel=1e-5) if isinstance(y, float) else y)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())

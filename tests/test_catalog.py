"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")

from clonelens.plans import catalog  # noqa: E402


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_duckdb(spark, name):
    for t in os.listdir(SF):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    df = catalog.queries()[name](spark, SF)
    found = duckdb.sql(catalog.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert mine == theirs


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

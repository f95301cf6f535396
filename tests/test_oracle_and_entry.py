"""Every registered query against its DuckDB oracle on the smallest data set,
plus the driver's entry-point smoke check."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from clientlens.sources.testdata import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 9)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "label" in df.columns


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    got = sorted([tuple(_norm(x) for x in r) for r in df.collect()], key=_key)
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    want = sorted([tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()], key=_key)
    assert got == want


def test_every_query_has_survey_ids():
    from clientlens.plans.registry import REGISTRY
    E.queries()
    assert all(e.ids for e in REGISTRY.values())

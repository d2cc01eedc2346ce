"""Every registered domain query against its SQL twin, over whole tables of the smallest size."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from hiregrid.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat()
    return round(float(v), 6) if hasattr(v, "quantize") else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    if name not in registry.oracle_sql():
        assert got
        return
    found = duck.execute(registry.oracle_sql()[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    assert got == ordered([tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()])


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()

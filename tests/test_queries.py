"""Every query runs on the smallest tables and, where it has SQL, gives DuckDB's rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lotwise.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("lineitem", "orders", "events"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = df.collect()
    if name not in ORACLES:
        return
    r = duck.execute(ORACLES[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    ours = sorted((tuple(plain(x[c]) for c in columns) for x in found), key=str)
    assert ours == sorted((tuple(map(plain, x)) for x in r.fetchall()), key=str)


def test_entry_point_without_optional_parts():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

"""Every catalogue key against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""

import hashlib
import math

import duckdb
import pytest

from tests.conftest import SF_SMALL
from verdict.plans.registry import all_queries
from verdict.session import TABLES

QUERIES = all_queries()
SLOW = {"ensemble_grid"}


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha1("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_key_matches_oracle(spark, con, name):
    q = QUERIES[name]
    df = q.build(spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if q.sql is None:
        assert df.columns
        return
    rel = con.execute(q.sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert _digest(rows, df.columns) == _digest(drows, dcols)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and df.columns
    assert set(e.oracle_sql()) <= set(e.queries())

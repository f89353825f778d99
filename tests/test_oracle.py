"""Every registered query with an oracle equals its DuckDB SQL (at sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as se
from conftest import SF_SMALL

TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SQL = se.oracle_sql()
SLOW = {"stream_assign"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(se.queries())


@pytest.mark.parametrize("name", sorted(k for k in SQL if k not in SLOW))
def test_matches_duckdb(spark, duck, name):
    df = se.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect())
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    assert cols == [dcols[i] for i in order]
    want = sorted(tuple(_norm(r[i]) for i in order) for r in cur.fetchall())
    assert got == want


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["rank", "paper_id", "score", "distance"]
    assert df.count() >= 0

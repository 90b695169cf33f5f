"""Driver contract: entry smoke check and every query against its oracle."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, _type_ok, canon


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:4] == ["o_orderstatus", "o_orderpriority", "total_sites", "ok_sites"]


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sdf.columns
    srows = sorted(tuple(canon(v) for v in r) for r in sdf.collect())
    con.execute(f"CREATE OR REPLACE VIEW oracle_view AS {E.oracle_sql()[name]}")  # the way the driver keeps it
    res = con.execute("SELECT * FROM oracle_view")
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    orows = sorted(tuple(canon(r[i]) for i in idx) for r in res.fetchall())
    assert srows == orows
    otypes = [str(d[1]) for d in res.description]
    for c, f in zip(cols, sdf.schema.fields):
        assert _type_ok(f.dataType.simpleString(), otypes[ocols.index(c)]), (c, f.dataType, otypes[ocols.index(c)])

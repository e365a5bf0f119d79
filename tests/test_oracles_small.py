"""Every query of the reference's operators equals its DuckDB SQL on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tables import SF_SMALL
from tools.check_oracles import TABLES, canon
from wirefold.plans.registry import load_all

NAMES = sorted(load_all()[1])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in res.description],
                                                                       res.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and {"application", "n_packets"} <= set(df.columns)


def test_every_query_registered_has_docstring():
    qs, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(qs) and len(qs) >= 63
    assert all(fn.__doc__ for fn in qs.values())

"""Queries of the training-data operators equal their DuckDB SQL on sf0.001; the others return a row per input row."""

import duckdb
import pytest

from tools.check_oracles import TABLES, canon
from wirefold.llm.registry import load_all

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SMALL)
    res = con.execute(ORACLES[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in res.description], res.fetchall())


@pytest.mark.parametrize("name, table", [("op1_repair_tokens", "documents"), ("op3_secret_scan", "documents"), ("op4_html_main_text", "pages"),
                                         ("op9_pairwise_quality", "documents"), ("op10_itq_near_duplicates", "embeddings")])
def test_one_row_per_input_row(spark, name, table):
    assert QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()

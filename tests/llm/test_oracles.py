"""Queries that SQL can express, against DuckDB on the generated tables."""

import math

import duckdb
import pytest

from evidentia.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert sorted(tuple(cell(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in result.fetchall())

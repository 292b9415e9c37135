"""Every query of the catalogue against its DuckDB equivalent, as the driver does."""

import datetime
import math

import pytest

from evidentia.plans import catalogue

from .conftest import SF

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
#: Queries that may return nothing at the tests' scale.
MAY_BE_EMPTY: set[str] = set()


def cell(v):
    if isinstance(v, float):
        return f"{v:.6g}" if math.isfinite(v) else str(v)
    return str(v)[:19] if isinstance(v, datetime.date) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    result = duck.execute(catalogue.ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(cell(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert got == want
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    assert got or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.ORACLES) <= set(entry.oracle_sql())

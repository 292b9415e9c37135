"""The register of queries. Modules of this package add to it when imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with DuckDB SQL for the same rows if there is any."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known(schema: str, *rows: tuple) -> str:
    """DuckDB SQL for rows that were worked out by hand; ``schema`` has name and type of each column."""
    columns = [c.split() for c in schema.split(",")]

    def cell(x: object) -> str:
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    names = ", ".join(f"c{k}" for k in range(len(columns)))
    picked = ", ".join(f"c{k}::{kind} as {name}" for k, (name, kind) in enumerate(columns))
    return f"select {picked} from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"

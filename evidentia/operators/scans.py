"""Scans, predicates and mutations over tables of items."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows whose unique key equals a value; the predicate reaches the Parquet scan."""
    return df.filter(F.col(key) == F.lit(value))


def scan_where(df: DataFrame, equal: Mapping[str, object | None] = {}, among: Mapping[str, Iterable[object] | None] = {}, least: Mapping[str, object | None] = {}) -> DataFrame:  # noqa: B006
    """Rows that meet all given predicates; a predicate of ``None`` is not given."""
    tests = [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    tests += [F.col(c).isin(list(vs)) for c, vs in among.items() if vs is not None]
    tests += [F.col(c) >= F.lit(v) for c, v in least.items() if v is not None]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def first_filled(*cols: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in cols))


def tag_by_keywords(text: Column, tags: Mapping[str, Iterable[str]], fallback: str = "unclassified") -> Column:
    """Sorted tags of which any keyword occurs in the text, else the fallback alone."""
    low = F.coalesce(F.lower(text), F.lit(""))
    hits = F.array(*(F.when(reduce(Column.__or__, (low.contains(k.lower()) for k in words)), F.lit(tag)) for tag, words in sorted(tags.items())))
    found = F.array_compact(hits)
    return F.when(F.size(found) == 0, F.array(F.lit(fallback))).otherwise(found)


def vetoed(text: Column, flags: Iterable[Iterable[str]]) -> Column:
    """Whether all keywords of any flag occur in the text."""
    low = F.coalesce(F.lower(text), F.lit(""))
    return reduce(Column.__or__, (reduce(Column.__and__, (low.contains(k.lower()) for k in words)) for words in flags))


def middle_truncated(text: Column, most: int, marker: str = "\n[...]\n") -> Column:
    """Texts longer than ``most`` keep their first and last third around a marker."""
    third = most // 3
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, third), F.lit(marker), F.right(text, F.lit(third)))).otherwise(text)


def base_id(identifier: Column) -> Column:
    """An identifier without its version suffix."""
    return F.regexp_replace(identifier, r"v[0-9]+$", "")


def finite(value: Column) -> Column:
    """A number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def placed(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` in order, with ``place`` from 1.

    The rows are numbered in two steps, by range and then within it, so that no task holds them all.
    The sorted rows are written, as another sort could cut the ranges elsewhere.
    """
    from evidentia.operators.graphs import cut_lineage

    sorted_ = cut_lineage(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id()))
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    # One row for each part of the sorted table.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sorted_.join(F.broadcast(sizes.withColumn("_before", before)), "_part").withColumn("place", (F.col("_before") + F.col("_in") - F.col("_first") + 1).cast("int")).select(*df.columns, "place")


def content_hash(*cols: Column) -> Column:
    """First 16 hexadecimal digits of the sha256 of colon-joined columns, nulls as empty."""
    return F.substring(F.sha2(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256), 1, 16)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; the top-1 is taken before the shuffle where Spark can."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def upsert_keep_first(existing: DataFrame, batch: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Rows of ``batch`` to append: first of each key, keys not in ``existing``."""
    return keep_first(batch, [key], order).join(existing.select(key), key, "left_anti")


def sparse_update(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``df`` with the non-null cells of ``updates`` (one row a key) in place of its own."""
    own = [c for c in updates.columns if c != key]
    new = updates.select(key, *(F.col(c).alias(f"_new_{c}") for c in own))
    joined = df.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in own else F.col(c) for c in df.columns))


def latest_status(log: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Each key's status in its last row by ``order``."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


def next_pending(latest: DataFrame, phases: list[str], key: str = "phase", status: str = "status") -> DataFrame:
    """The first phase of a fixed order that is not completed; no row if all are."""
    order = latest.sparkSession.createDataFrame(list(enumerate(phases)), f"_at int, {key} string")
    return order.join(latest, key, "left").filter(F.coalesce(F.col(status) != "completed", F.lit(True))).orderBy("_at").limit(1).select(key)


def counts(**tables: DataFrame) -> DataFrame:
    """(table, n) for each table."""
    return reduce(DataFrame.unionAll, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()))

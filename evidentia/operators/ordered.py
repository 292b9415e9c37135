"""Running aggregates over tables in order, whose groups may be of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.graphs import cut_lineage

#: Rows that one window may hold.
FEW = 200_000


def running(df: DataFrame, made: dict[str, tuple[str, Column | str]], order: Sequence[str], by: Sequence[str] = (), before: bool = False) -> DataFrame:
    """``df``, a written table, with running aggregates over the rows up to each one in ``order``, or only before it, within groups of the columns ``by``, which hold no nulls.

    ``made`` gives each new column a function (sum, max or min) and what it takes. A table of FEW
    rows or fewer is one window's. Else rows are dealt by ranges and written; a range combines its
    own aggregates with what the ranges before it give, so a group of any size is many tasks'
    work. ``order`` should leave no ties.
    """
    of = {"sum": F.sum, "max": F.max, "min": F.min}
    span = (Window.unboundedPreceding, -1 if before else Window.currentRow)
    if df.count() <= FEW:
        within = Window.partitionBy(*by).orderBy(*order).rowsBetween(*span)
        return df.select("*", *(of[f](c).over(within).alias(name) for name, (f, c) in made.items()))
    dealt = cut_lineage(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    whole = dealt.groupBy("_part", *by).agg(*(of[f](c).alias(f"_{name}") for name, (f, c) in made.items()))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and group
    offsets = whole.select("_part", *by, *(of[f](f"_{name}").over(ahead).alias(f"_{name}") for name, (f, _) in made.items()))
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(*span)
    summed = dealt.select("*", *(of[f](c).over(within).alias(name) for name, (f, c) in made.items())).join(offsets, ["_part", *by])

    def both(name: str, f: str) -> Column:
        a, b = F.col(name), F.col(f"_{name}")
        joined = a + b if f == "sum" else F.greatest(a, b) if f == "max" else F.least(a, b)
        return F.coalesce(joined, a, b).cast(summed.schema[name].dataType).alias(name)

    return summed.select(*df.columns, *(both(name, f) for name, (f, _) in made.items()))

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage, join_counted


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); the component is its smallest node.

    Each round hangs the larger neighbours of a node, then the smaller ones, on the smallest
    neighbour, until every node that is not the smallest around has one neighbour: a number of
    rounds logarithmic in the longest path. Minima and joins only, in which a node of very many
    edges is not one task's; no round emits more than two rows an edge. Rows with a null end and
    loops are ignored. Each round's tables replace the last one's.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    last = least = large = None
    while True:
        now = last = cut_lineage(now, last)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), least)
        if least.filter("m < u and n > 1").isEmpty():
            break
        large = cut_lineage(join_counted(both, least, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), large)
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), least)
        hung = join_counted(large, least, "u", "n").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = hung.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
    return least.select(F.col("u").alias("node"), F.col("m").alias("component"))

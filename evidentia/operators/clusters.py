"""Clustering: sequential leaders, density by mutual reachability, tiers of duplicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from evidentia.functions import expressions as E
from evidentia.operators.graphs import components, cut_lineage
from evidentia.operators.hierarchy import stable_clusters as stable_clusters


def leader_clusters(df: DataFrame, block: str, item: str, text: str, alike: Callable[[str, str], bool]) -> DataFrame:
    """(item, leader): in order of item, an unassigned item leads and takes later unassigned ones alike to it.

    The order decides, so a block is worked by one task; blocks are meant to be small, as
    structural duplicates within a topic are.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(item)[[item, text]].itertuples(index=False)
        leaders: list[tuple[int, str]] = []
        out = []
        for i, t in rows:
            to = next((j for j, u in leaders if alike(u, t)), None)
            if to is None:
                leaders.append((i, t))
                to = i
            out.append((i, to))
        return pd.DataFrame(out, columns=[item, "leader"])

    kind = df.schema[item].dataType.simpleString()
    return df.select(block, item, text).groupBy(block).applyInPandas(run, f"{item} {kind}, leader {kind}")


class Tiles:
    """A block of vectors cut into tiles of about ``tile`` items; every two tiles of a block meet in one task."""

    def __init__(self, df: DataFrame, block: str, item: str, vector: str, tile: int) -> None:
        self.rows = cut_lineage(df.select(F.col(block).alias("_b"), item, F.col(vector).alias("_v")).withColumn("_id", F.monotonically_increasing_id()))
        many = self.rows.groupBy(F.col("_b").alias("_same")).agg(F.ceil(F.count("*") / tile).alias("_k"))
        self.placed = self.rows.join(many, F.col("_b").eqNullSafe(F.col("_same"))).select("_b", "_id", "_v", "_k", F.pmod(F.xxhash64("_id"), F.col("_k")).alias("_t"))

    @staticmethod
    def met(side: DataFrame) -> GroupedData:
        other = side.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
        return other.withColumn("_i", F.least("_t", "_o")).withColumn("_j", F.greatest("_t", "_o")).drop("_k", "_o").groupBy("_b", "_i", "_j")

    def cores(self, min_samples: int) -> DataFrame:
        """(_id, _core): the distance to the ``min_samples``-th neighbour; the item itself is the first of its neighbours, and with too few of them the last one counts."""

        def nearest(frame: pd.DataFrame) -> pd.DataFrame:
            left, right, far, one = sides(frame)
            out: list[tuple[int, list[float]]] = []
            for ids, d in ((left, far),) if one else ((left, far), (right, far.T)):
                if d.size:
                    few = min(min_samples + 1, d.shape[1])
                    out += zip(ids.tolist(), np.partition(d, few - 1, 1)[:, :few].tolist(), strict=True)
            return pd.DataFrame(out, columns=["_id", "_near"])

        near = self.met(self.placed).applyInPandas(nearest, "_id long, _near array<double>").groupBy("_id").agg(F.array_sort(F.flatten(F.collect_list("_near"))).alias("_near"))
        return near.select("_id", F.get("_near", F.least(F.lit(min_samples), F.size("_near") - 1)).alias("_core"))


def sides(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Ids of two tiles, the distances between them, and whether they are one."""
    i, j = frame["_i"].iloc[0], frame["_j"].iloc[0]
    a, b = frame[frame["_t"] == i], frame[frame["_t"] == j]
    if a.empty or b.empty:
        return a["_id"].to_numpy(), b["_id"].to_numpy(), np.zeros((len(a), len(b))), i == j
    x, y = (np.stack(t["_v"].to_numpy()).astype(float) for t in (a, b))
    return a["_id"].to_numpy(), b["_id"].to_numpy(), np.stack([np.sqrt(((y - r) ** 2).sum(1)) for r in x]), i == j


def density_clusters(df: DataFrame, block: str, item: str, vector: str, min_size: int = 3, min_samples: int = 2, cut: float = 1.0, tile: int = 2048) -> DataFrame:
    """(item, cluster): single linkage on mutual reachability distances up to ``cut``; clusters below ``min_size`` are -1, others their smallest item.

    The distance of two items is at least each one's distance to its ``min_samples``-th
    neighbour. Exact. A block is cut into tiles of about ``tile`` items, and a task compares two
    tiles: first for the nearest distances of each item, then for links, of which it keeps a
    spanning forest. All pairs of a block are looked at, as the definition asks.
    """
    t = Tiles(df, block, item, vector, tile)

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        left, right, far, _ = sides(frame)
        found = [(left[r], right[c]) for r, c in forest(far <= cut) if left[r] != right[c]]
        return pd.DataFrame(found, columns=["src", "dst"])

    dense = t.cores(min_samples).filter(F.col("_core") <= cut).select("_id")
    joined = components(t.met(t.placed.join(dense, "_id")).applyInPandas(links, "src long, dst long"))
    member = t.rows.select("_id", item).join(joined, F.col("_id") == F.col("node"), "left").select(item, F.coalesce("component", "_id").alias("_c"))
    whole = member.groupBy("_c").agg(F.count("*").alias("_n"), F.min(item).cast("long").alias("_first")).filter(F.col("_n") >= min_size)
    return member.join(whole, "_c", "left").select(item, F.coalesce("_first", F.lit(-1).cast("long")).alias("cluster"))


def forest(close: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) of links that connect what all links of the matrix ``close`` connect, at most one for each row and column."""
    across = np.ascontiguousarray(close.T)
    rows, columns = np.ones(len(close), bool), np.ones(len(across), bool)
    out = []
    for start in range(len(close)):
        todo = [start] if rows[start] else []
        rows[start] = False
        while todo:
            r = todo.pop()
            for c in np.flatnonzero(close[r] & columns).tolist():
                columns[c] = False
                out.append((r, c))
                more = np.flatnonzero(across[c] & rows).tolist()
                rows[more] = False
                out += [(q, c) for q in more]
                todo += more
    return out


def unexpected_agreement(members: DataFrame, cluster: str, group: str, distant: Sequence[tuple[str, str]]) -> DataFrame:
    """(cluster, group_a, group_b, significance): clusters that hold both groups of a pair named as distant. Cluster -1 and null are no clusters."""
    held = members.filter(F.col(cluster) != -1).select(cluster, group).distinct()
    pairs = F.broadcast(members.sparkSession.createDataFrame(list(distant), "group_a string, group_b string"))
    first = held.join(pairs, F.col(group) == F.col("group_a")).select(cluster, "group_a", "group_b")
    return first.join(held.select(cluster, F.col(group).alias("group_b")), [cluster, "group_b"]).select(cluster, "group_a", "group_b", F.lit(0.8).alias("significance"))


def outliers(items: DataFrame, members: DataFrame, item: str, cluster: str, topic: str, ignore: str = "other") -> DataFrame:
    """``items`` that are in no cluster, with their significance; those of the topic ``ignore`` are left out. Cluster -1 and null are no clusters."""
    found = items.join(members.filter(F.col(cluster) != -1).select(item), item, "left_anti")
    return found.filter(~F.col(topic).eqNullSafe(F.lit(ignore))).withColumn("significance", F.lit(0.5))


def duplicate_tiers(df: DataFrame, topic: str, item: str, expression: str, structural: float = 0.95, numerical: float = 0.99) -> DataFrame:
    """(item, leader, tier) of items in clusters of two or more: exact text first, then structure, then values, each on what the tiers before left."""
    exact = df.join(df.groupBy(topic, expression).agg(F.min(item).alias("leader"), F.count("*").alias("_n")).filter("_n > 1"), [topic, expression]).select(item, "leader", F.lit("exact").alias("tier"))
    left = df.join(exact, item, "left_anti")

    def tier(rows: DataFrame, name: str, alike: Callable[[str, str], bool]) -> DataFrame:
        found = leader_clusters(rows, topic, item, expression, alike)
        many = found.groupBy("leader").count().filter("count > 1").select("leader")
        return found.join(many, "leader").select(item, "leader", F.lit(name).alias("tier"))

    second = tier(left, "structural", lambda a, b: E.structural_score(a, b) >= structural)
    rest = left.join(second, item, "left_anti")
    third = tier(rest, "numerical", lambda a, b: (E.agreement(a, b) or 0.0) >= numerical)
    return exact.unionByName(second).unionByName(third)

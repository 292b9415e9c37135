"""Vectors: similarity joins, centroids, scaling, projections, nearest profiles and classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from evidentia.operators.tiles import UnitTiles


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Vectors of a block; a task compares two blocks.
BLOCK = 2048
#: Pairs that leave a task together, about.
ROWS = 65_536


def tiles(left: DataFrame, right: DataFrame | None, key: str, vector: str, block: int = BLOCK) -> GroupedData:
    """Blocks of vectors that meet, as groups (_i, _j) of rows (_side, _key, _v and further columns).

    Every row of ``left`` meets every row of ``right``, or without it every row of ``left`` once.
    Blocks are cut by hash, as many as the number of rows asks for. Vectors travel packed as
    doubles; null, zero and non-finite ones stay out.
    """

    def packed(df: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // block))
        rows = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumnsRenamed({key: "_key", vector: "_v"})
        return rows, n

    a, m = packed(left)
    if right is None:
        other = F.sequence(F.lit(0), F.lit(m - 1))
        met = a.withColumn("_o", F.explode(other)).withColumn("_i", F.least("_block", "_o")).withColumn("_j", F.greatest("_block", "_o")).withColumn("_side", (F.col("_block") == F.col("_j")).cast("int"))
        n = m
    else:
        b, n = packed(right)
        a = a.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_i", F.col("_block")).withColumn("_side", F.lit(0))
        b = b.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("_j", F.col("_block")).withColumn("_side", F.lit(1))
        met = a.unionByName(b, allowMissingColumns=True)
    # The work is no matter of bytes, so the number of tasks is given.
    return met.drop("_block", "_o").repartition(min(20_000, max(m * n, 8)), "_i", "_j").groupBy("_i", "_j")


def unit_rows(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, in double precision, and which rows have one."""
    fine = np.array([v is not None and len(v) > 0 and all(x is not None for x in v) for v in vectors], bool)
    if not fine.any():
        return np.zeros((0, 0)), fine
    rows = np.stack([np.asarray(v, float) for v in vectors[fine]])
    size = np.sqrt((rows * rows).sum(1))
    good = np.isfinite(size) & (size > 0)
    fine[np.flatnonzero(fine)[~good]] = False
    return rows[good] / size[good, None], fine


def farthest(low: float) -> float | None:
    """The distance of vectors of length one that follows from their cosine, with room for rounding; None where all are within it."""
    return (2 - 2 * low) ** 0.5 + 1e-9 if low > -1 else None


def near_tiles(df: DataFrame, item: str, vector: str, low: float, group: str | None = None, block: int = BLOCK) -> tuple[UnitTiles, DataFrame]:
    """Vectors of length one in packed tiles of neighbours, and the pairs of tiles that may hold a cosine of ``low`` or more.

    Of vectors of length one the distance follows from the cosine, so the pivots' triangle bound keeps tiles apart.
    """
    tiles, most = UnitTiles(df, item, vector, block, group), farthest(low)
    return tiles, tiles.pairs if most is None else tiles.pairs.filter(F.col("least") <= most)


def in_band(x: np.ndarray, y: np.ndarray, low: float, high: float, most: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of rows of length one from ``low`` up to below ``high``: a product in single precision, with room for its rounding, leaves those that are worked out in double precision, ``most`` at a time."""
    room = (x.shape[1] + 8) * 2.0**-23
    c = (x.astype(np.float32) @ y.astype(np.float32).T).ravel()
    near = np.flatnonzero(c >= low - room)
    i, j = np.divmod(near[c[near] < high + room], len(y))
    each = [np.einsum("ij,ij->i", x[i[at : at + most]], y[j[at : at + most]]) for at in range(0, len(i), most)]
    exact = np.concatenate([np.zeros(0), *each])
    keep = (exact >= low) & (exact < high)
    return i[keep], j[keep], exact[keep]


def similar_pairs(df: DataFrame, item: str, vector: str, low: float, high: float = 2.0, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs (item_a, item_b, cosine) of cosine from ``low`` up to below ``high``, smaller id first, of different groups if one is named.

    Tiles of neighbouring vectors meet as matrix products unless the bound of their distances keeps
    them apart; only pairs in the band leave a task, and tiles are not shuffled to meet. ``item`` is a whole number. Rows whose vector is null, zero or not finite
    take no part; a null group is a group.
    """
    tiles = UnitTiles(df, item, vector, block, group)
    # Where all are alike, all pairs of a step's rows are found.
    units, step = tiles.units, max(1, 4 * ROWS // block)

    def compare(a: dict, b: dict, one: bool) -> Iterator[pd.DataFrame]:
        left, right, x, y = np.asarray(a["ids"]), np.asarray(b["ids"]), units(a), units(b)
        tags = pd.factorize(np.concatenate([a["tags"], b["tags"]]))[0] if group else None
        found, rows = [], 0
        for at in range(0, len(left), step):
            i, j, c = in_band(x[at : at + step], y, low, high)
            i += at
            keep = left[i] < right[j] if one else left[i] != right[j]
            if group:
                keep &= tags[i] != tags[len(left) + j]
            i, j = left[i[keep]], right[j[keep]]
            found.append((np.minimum(i, j), np.maximum(i, j), c[keep]))
            rows += len(i)
            if rows >= ROWS or at + step >= len(left):
                yield pd.DataFrame(dict(zip(("a", "b", "cosine"), map(np.concatenate, zip(*found, strict=True)), strict=True)))
                found, rows = [], 0

    kind = df.schema[item].dataType.simpleString()
    found = tiles.met_near(farthest(low), compare, "a long, b long, cosine double")
    return found.select(F.col("a").cast(kind).alias(f"{item}_a"), F.col("b").cast(kind).alias(f"{item}_b"), "cosine")


def top_similar(df: DataFrame, query: Sequence[float] | DataFrame, item: str, vector: str, k: int) -> DataFrame:
    """The ``k`` items most like one query vector, with their rank; a top-k, not a sort. A DataFrame has the query as its one row ``query``."""
    rows = df.select(item, F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    if isinstance(query, DataFrame):
        rows = rows.join(F.broadcast(query.limit(1).select(F.transform("query", lambda x: x.cast("double")).alias("_q"))))
    else:
        rows = rows.withColumn("_q", F.array(*(F.lit(float(x)) for x in query)))
    return rows.select(item, cosine(F.col("_v"), F.col("_q")).alias("cosine")).filter("cosine is not null").orderBy(F.desc("cosine"), item).limit(k)


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, pos, mean): component-wise means, partial sums before the shuffle."""
    return df.select(cluster, F.posexplode(vector).alias("pos", "x")).groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def standardised(df: DataFrame, item: str, vector: str) -> DataFrame:
    """(item, scaled): components less their mean, over their population deviation; constant components only lose their mean."""
    each = df.select(item, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    stats = each.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    lists = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))), lambda r: F.struct(r["m"].alias("m"), F.when(r["s"] > 0, r["s"]).otherwise(1.0).alias("s"))).alias("_stats"))  # one row, as long as a vector
    return df.join(F.broadcast(lists)).select(item, F.zip_with(vector, "_stats", lambda x, t: (x.cast("double") - t["m"]) / t["s"]).alias("scaled"))


def cluster_summary(df: DataFrame, cluster: str, group: str, topic: str) -> DataFrame:
    """Size, distinct groups and topics of clusters; whether they cross groups and topics, or are near universal."""
    out = df.groupBy(cluster).agg(F.count("*").alias("size"), F.countDistinct(group).alias("n_groups"), F.countDistinct(topic).alias("n_topics"))
    return out.withColumn("cross", F.col("n_groups") >= 2).withColumn("universal", F.col("n_groups") >= F.greatest(F.lit(3.0), F.col("size") / 2))


def nearest_profiles(now: DataFrame, history: DataFrame, key: str, other: str, features: str, k: int, not_itself: bool = False, digits: int = 9, block: int = BLOCK) -> DataFrame:
    """For each current profile the ``k`` historical ones of largest cosine (null-free, rounded to ``digits``), ties to the smaller one; ``not_itself`` leaves out the one of its own id.

    Blocks meet as matrix products; a task keeps the ``k`` best of each profile, and those of all tasks are ranked.
    """
    a = now.select(key, F.transform(features, lambda x: x.cast("double")).alias("_v"))
    b = history.select(F.col(other).alias(key), F.transform(features, lambda x: x.cast("double")).alias("_v"))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame["_side"] == 0], frame[frame["_side"] == 1]
        (x, ok_x), (y, ok_y) = unit_rows(a["_v"]), unit_rows(b["_v"])
        left, right = a["_key"].to_numpy()[ok_x], b["_key"].to_numpy()[ok_y]
        order = np.argsort(right, kind="stable")
        right = right[order]
        out = []
        for at in range(0, len(left) if len(right) else 0, 256):
            c = np.round(x[at : at + 256] @ y[order].T, digits)
            if not_itself:
                c[left[at : at + 256, None] == right[None, :]] = -np.inf
            top = np.argsort(-c, axis=1, kind="stable")[:, :k]
            scores = np.take_along_axis(c, top, 1)
            row, place = np.nonzero(scores > -np.inf)
            out.append(pd.DataFrame({"k": left[at + row], "o": right[top[row, place]], "cosine": scores[row, place]}))
        return pd.concat(out) if out else pd.DataFrame({"k": [], "o": [], "cosine": []})

    kinds = now.schema[key].dataType.simpleString(), history.schema[other].dataType.simpleString()
    found = tiles(a, b, key, "_v", block).applyInPandas(best, f"k {kinds[0]}, o {kinds[1]}, cosine double")
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("cosine"), "o"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("k").alias(key), F.col("o").alias(other), "cosine", "rank")


def profile_difference(now: DataFrame, then: DataFrame, kind: str) -> DataFrame:
    """(kind, side): matching, only_now or only_then."""
    a, b = now.select(kind).distinct().withColumn("_a", F.lit(1)), then.select(kind).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "only_then").when(F.col("_b").isNull(), "only_now").otherwise("matching")
    return a.join(b, kind, "full").select(kind, side.alias("side"))


def principal_axes(df: DataFrame, item: str, vector: str, k: int = 2) -> DataFrame:
    """(item, axes): projection on the ``k`` first principal components."""
    rows = df.select(item, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    fitted = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows)
    # An axis has two directions; its loadings' sum is made positive.
    signs = F.array(*(F.lit(-1.0 if x < 0 else 1.0) for x in fitted.pc.toArray().sum(0)))
    return fitted.transform(rows).select(item, F.zip_with(vector_to_array("_p"), signs, lambda x, s: x * s).alias("axes"))


def forest_probabilities(train: DataFrame, test: DataFrame, key: str, features: str, label: str, trees: int = 200, seed: int = 42) -> DataFrame:
    """(key, probabilities): class probabilities by a balanced random forest; ``label`` numbers classes from 0."""
    counts = train.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    weight = counts.join(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("_w"))
    rows = train.join(weight, label).select(F.col(label).cast("double").alias("label"), "_w", array_to_vector(features).alias("features"))
    model = RandomForestClassifier(numTrees=trees, seed=seed, weightCol="_w").fit(rows)
    out = model.transform(test.select(key, array_to_vector(features).alias("features")))
    return out.select(key, vector_to_array("probability").alias("probabilities"))


def leave_one_out(df: DataFrame, key: str, features: str, label: str) -> DataFrame:
    """(n, n_right): how often the most similar other record has the record's class. Looks at all pairs, by blocks."""
    other = df.select(F.col(key).alias("_k"), features, F.col(label).alias("_l"))
    best = nearest_profiles(df, other, key, "_k", features, 1, not_itself=True)
    told = best.join(other.select("_k", "_l"), "_k").join(df.select(key, label), key)
    return told.agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col("_l")).alias("n_right"))


def leave_one_out_forest(df: DataFrame, key: str, features: str, label: str, trees: int = 200, seed: int = 42) -> DataFrame:
    """(key, label, predicted): each record's class by a forest fitted on all others.

    A forest is fitted for each record, so the table is meant to be a short one of history; its
    keys are listed in the driver. Ties go to the smaller class.
    """
    rows = df.select(key, features, F.col(label).cast("int").alias(label))
    out = None
    for (one,) in rows.select(key).orderBy(key).collect():
        test = rows.filter(F.col(key) == F.lit(one))
        told = forest_probabilities(rows.filter(F.col(key) != F.lit(one)), test, key, features, label, trees, seed)
        most = F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1
        part = told.select(key, most.alias("predicted"))
        out = part if out is None else out.unionAll(part)
    return rows.select(key, label).join(out, key) if out is not None else rows.select(key, label, F.lit(0).alias("predicted"))

"""Vectors in packed tiles, of which only those meet that the triangle bound cannot keep apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.graphs import cut_lineage, join_counted

#: Vectors whose distances bound those of tiles; a sample of this size.
PIVOTS = 16
#: Tiles of a file, about, and files at most.
TILES, FILES = 4, 1000


def unpack(row: pd.Series | dict, n: int) -> np.ndarray:
    return np.frombuffer(row["data"]).reshape(n, -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each coordinate difference squared and summed, so that equal vectors are 0 apart and either order gives the same number."""
    return np.sqrt(np.stack([((y - r) ** 2).sum(1) for r in x])) if len(x) else np.zeros((0, len(y)))


def least_distance(i: str, j: str) -> Column:
    """A lower bound of the distances between two tiles' vectors, from their distances to the pivots (low_i, high_i, low_j, high_j)."""
    gap = F.zip_with(F.zip_with(f"low_{i}", f"high_{j}", lambda x, y: x - y), F.zip_with(f"low_{j}", f"high_{i}", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    # What rounding may take from a bound.
    return F.greatest(F.array_max(gap) - 1e-9 * F.greatest(F.lit(1.0), F.array_max(f"high_{i}"), F.array_max(f"high_{j}")), F.lit(0.0))


class Tiles:
    """Vectors of blocks in tiles of about ``tile``: ``packed`` has (tile, block, ids, data) and ``pairs`` (i, j, least), tiles of a block with a lower bound of their distances."""

    def __init__(self, df: DataFrame, block: str | None, item: str, vector: str, tile: int, tag: str | None = None) -> None:
        """``tag`` names a column that is packed beside the ids, as text; without ``block`` all rows are one."""
        real = F.transform(vector, lambda x: x.cast("double"))
        fine = F.col(item).isNotNull() & (F.size(vector) > 0) & F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        key = F.coalesce(F.concat(F.lit("="), F.col(block).cast("string")), F.lit("")) if block else F.lit("")
        rows = cut_lineage(df.filter(F.coalesce(fine, F.lit(False))).select(F.col(item).cast("long").alias("id"), key.alias("block"), real.alias("v"), (F.col(tag).cast("string") if tag else F.lit("")).alias("tag")))
        pivots = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()]
        away = F.array(*(F.sqrt(F.aggregate(F.zip_with("v", F.lit(p), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)) for p in pivots)) if pivots else F.array(F.lit(0.0))
        counted = cut_lineage(rows.groupBy("block").agg(F.count("*").alias("n")).withColumn("cells", F.least(F.ceil(F.col("n") / tile), F.lit(max(1, len(pivots)))).cast("int")))
        near = F.slice("away", F.lit(1), F.col("cells"))
        celled = cut_lineage(join_counted(rows.withColumn("away", away), counted, "block", "n").withColumn("cell", F.struct("block", F.array_position(near, F.array_min(near)).alias("of"))).drop("cells"))
        sizes = cut_lineage(celled.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / tile)))
        placed = join_counted(celled, sizes, "cell", "n").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("id")
            far = np.stack(frame["away"].to_numpy())
            return pd.DataFrame({"block": frame["block"].iloc[:1], "ids": [frame["id"].to_numpy()], "tags": [frame["tag"].to_numpy() if tag else None], "data": [np.stack(frame["v"].to_numpy()).tobytes()], "low": [far.min(0)], "high": [far.max(0)]})

        kinds = "block string, ids array<long>, tags array<string>, data binary, low array<double>, high array<double>"
        self.packed = cut_lineage(placed.select("cell", "part", "block", "id", "v", "tag", "away").groupBy("cell", "part").applyInPandas(pack, kinds).withColumn("tile", F.monotonically_increasing_id()))

    @cached_property
    def pairs(self) -> DataFrame:
        side = lambda name: self.packed.select("block", F.col("tile").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("low", "high")))
        return cut_lineage(side("i").join(side("j"), "block").filter("i <= j").select("block", "i", "j", least_distance("i", "j").alias("least")))

    def share(self, pairs: DataFrame) -> tuple[int, int]:
        """How many pairs of items the tiles of ``pairs`` make, and all that there are."""
        side = lambda name: self.packed.select(F.col("tile").alias(name), F.size("ids").cast("long").alias(f"n_{name}"))
        made = F.when(F.col("i") == F.col("j"), F.expr("n_i * (n_i - 1) div 2")).otherwise(F.col("n_i") * F.col("n_j"))
        sized = lambda rows: rows.join(side("i"), "i").join(side("j"), "j").agg(F.coalesce(F.sum(made), F.lit(0))).first()[0]
        return sized(pairs), sized(self.pairs)

    def met(self, pairs: DataFrame, work: Callable[[pd.Series, pd.Series, bool], pd.DataFrame], schema: str) -> DataFrame:
        """Rows that ``work`` makes of the two tiles of each pair, given as rows, and of whether they are one."""
        kept = self.packed.drop("block", "low", "high")
        both = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile")).join(kept, "tile")

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("tile")
            return work(frame.iloc[0], frame.iloc[-1], len(frame) == 1)

        tasks = max(8, min(20_000, pairs.count()))  # the work is no matter of bytes
        return both.repartition(tasks, "i", "j").groupBy("i", "j").applyInPandas(run, schema)

    def met_near(self, most: float | None, work: Callable[[dict, dict, bool], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """The same, in frames, for all pairs of tiles of a block whose bound is ``most`` or less, all of them without it.

        Tasks read the tiles of two partitions from the written table, so that no tile is shuffled, however many others it meets.
        """
        names = ("ids", "tags", "data")
        side = lambda s: self.packed.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "tile", "low", "high", *names)))
        i, j = F.col("tile_i"), F.col("tile_j")
        # Each pair once, in either order, so that all tasks have about as many.
        once = (i == j) | ((i < j) == (F.xxhash64(F.least(i, j), F.greatest(i, j)) % 2 == 0)) & (i != j)
        near = F.lit(True) if most is None else least_distance("i", "j") <= most
        both = side("i").join(side("j").hint("shuffle_replicate_nl"), (F.col("block_i") == F.col("block_j")) & once & near)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.to_dict("records"):
                    a, b = ({c: row[f"{c}_{s}"] for c in names} for s in "ij")
                    yield from work(a, b, row["tile_i"] == row["tile_j"])

        return both.select("tile_i", "tile_j", *(f"{c}_{s}" for c in names for s in "ij")).mapInPandas(run, schema)

    def cores(self, min_samples: int) -> DataFrame:
        """(id, core): the distance to the ``min_samples``-th neighbour, the item itself being the first; with too few the last one counts.

        A tile looks at itself first; after that only at tiles that may hold nearer ones.
        """

        def nearest(a: pd.Series, b: pd.Series, one: bool) -> pd.DataFrame:
            far = distances(unpack(a, len(a["ids"])), unpack(b, len(b["ids"])))
            out = []
            for ids, d, tile in ((a["ids"], far, a["tile"]),) if one else ((a["ids"], far, a["tile"]), (b["ids"], far.T, b["tile"])):
                few = min(min_samples + 1, d.shape[1])
                near = np.sort(np.partition(d, few - 1, 1)[:, :few], 1)
                out.append(pd.DataFrame({"id": ids, "tile": tile, "near": list(near)}))
            return pd.concat(out)

        schema = "id long, tile long, near array<double>"
        own = cut_lineage(self.met(self.pairs.filter("i = j"), nearest, schema))
        most = own.groupBy("tile").agg(F.max(F.when(F.size("near") > min_samples, F.get("near", F.lit(min_samples))).otherwise(float("inf"))).alias("most"))
        side = lambda name: most.select(F.col("tile").alias(name), F.col("most").alias(f"most_{name}"))
        left = cut_lineage(self.pairs.filter("i < j").join(side("i"), "i").join(side("j"), "j").filter("least <= greatest(most_i, most_j)").select("i", "j"))
        near = own.unionByName(self.met(left, nearest, schema)).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
        return near.select("id", F.get("near", F.least(F.lit(min_samples), F.size("near") - 1)).alias("core"))

    def give_cores(self, cores: DataFrame) -> None:
        """Packs ``core`` beside the ids, and raises the pairs' bounds to the smallest core distance of either tile."""
        each = self.packed.select("tile", F.posexplode("ids").alias("at", "id")).join(cores, "id").groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("at", "core"))).alias("all"))
        self.packed = cut_lineage(self.packed.join(each, "tile").withColumn("core", F.transform("all", lambda x: x["core"])).drop("all"))
        side = lambda name: self.packed.select(F.col("tile").alias(name), F.array_min("core").alias(f"core_{name}"))
        self.pairs = cut_lineage(self.pairs.join(side("i"), "i").join(side("j"), "j").withColumn("least", F.greatest("least", "core_i", "core_j")).drop("core_i", "core_j"))


def to_unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows brought to length one, in double precision, and which rows have one, zero and infinite ones being left out."""
    x = x.astype(float)
    with np.errstate(over="ignore"):
        size = np.sqrt((x * x).sum(1))
    fine = (size > 0) & (size < np.inf)
    return x[fine] / size[fine, None], fine


class UnitTiles(Tiles):
    """Vectors brought to length one, in tiles of one block. ``packed`` is all that is written; it has them as they come, in single precision if they have it.

    The rows of ``df`` are read once for the pivots, twice to count and once to be packed.
    """

    def __init__(self, df: DataFrame, item: str, vector: str, tile: int, tag: str | None = None) -> None:
        kind = np.dtype("f4" if df.schema[vector].dataType.elementType.typeName() == "float" else "f8")
        given = F.col(vector).cast(f"array<{'float' if kind.itemsize == 4 else 'double'}>")
        fine = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = df.select(F.col(item).cast("long").alias("id"), (F.col(tag).cast("string") if tag else F.lit("")).alias("tag"), given.alias("v")).filter(F.coalesce(fine, F.lit(False)))

        def placed(pivots: np.ndarray, parts: list[int]) -> DataFrame:
            """(place, id, tag, data): rows by the nearest pivot, of each of which ``parts`` places are made."""
            first = np.cumsum([0, *parts])[:-1].astype(np.uint64)

            def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in filter(len, batches):
                    if len(batch["v"].value_lengths().unique()) > 1:
                        raise ValueError("vectors of different lengths")
                    x = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                    unit, good = to_unit(x)
                    ids, at = batch["id"].to_numpy()[good], np.zeros(len(unit), np.uint64)
                    if len(pivots):
                        cell = distances(pivots, unit).argmin(0)
                        at = first[cell] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.array(parts, np.uint64)[cell]
                    data = pa.array([v.tobytes() for v in x[good]], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(ids), batch["tag"].filter(pa.array(good)), data], ["place", "id", "tag", "data"])

            return rows.mapInArrow(place, "place long, id long, tag string, data binary")

        every = placed(np.zeros((0, 0)), [])
        taken = every.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("data").collect()
        pivots = to_unit(np.stack([np.frombuffer(r.data, kind) for r in taken]))[0] if taken else np.zeros((0, 0))
        # No more cells than tiles; rows of each are counted to cut it evenly.
        pivots = pivots[: -(-every.count() // tile)]
        sizes = {r.place: r["count"] for r in placed(pivots, [1] * len(pivots)).groupBy("place").count().collect()} if len(pivots) > 1 else {}
        parts = [max(1, -(-sizes.get(i, 0) // tile)) for i in range(len(pivots))]

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("id")
            far = distances(pivots, to_unit(np.stack([np.frombuffer(v, kind) for v in frame["data"]]))[0])
            return pd.DataFrame({"tile": frame["place"].iloc[:1], "block": "", "ids": [frame["id"].to_numpy()], "tags": [frame["tag"].to_numpy() if tag else None], "data": [b"".join(frame["data"])], "low": [far.min(1)], "high": [far.max(1)]})

        kinds = "tile long, block string, ids array<long>, tags array<string>, data binary, low array<double>, high array<double>"
        spread = placed(pivots, parts).repartition(min(FILES, max(1, -(-sum(parts) // TILES))), "place")
        self.packed = cut_lineage(spread.groupBy("place").applyInPandas(pack, kinds))
        #: The vectors of a row of ``packed``.
        self.units = lambda row: to_unit(np.frombuffer(row["data"], kind).reshape(len(row["ids"]), -1))[0]

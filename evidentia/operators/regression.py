"""Symbolic regression over few points: expressions grow round by round, the best of each round go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNARY: dict[str, Callable[[np.ndarray], np.ndarray]] = {"abs({})": np.abs, "({})**2": np.square}
BINARY: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"({} + {})": np.add, "({} - {})": np.subtract, "({})*({})": np.multiply}
POOL = "expr string, vals array<double>, size int, loss double, slope double, offset double"


def fitted(values: np.ndarray, target: np.ndarray) -> tuple[float, float, float]:
    """Mean squared error of the best line through (values, target), its slope and offset."""
    if not np.isfinite(values).all():
        return float("inf"), 0.0, 0.0
    spread = values - values.mean()
    size = float(spread @ spread)
    slope = float(spread @ (target - target.mean()) / size) if size > 1e-12 else 0.0
    offset = float(target.mean() - slope * values.mean())
    return float(((slope * values + offset - target) ** 2).mean()), slope, offset


def symbolic_fit(points: DataFrame, target: str, features: Sequence[str], constants: Sequence[float] = (), rounds: int = 3, keep: int = 150) -> DataFrame:
    """(expr, size, loss, slope, offset) of the ``keep`` best expressions over the features, the best and then the shortest first.

    ``points`` is a table of few measured points and is held by every task, as is the bounded
    pool of ``keep`` expressions; what a round makes of them is spread over the tasks. An
    expression stands for the best line through it: slope * expr + offset.
    """
    spark = points.sparkSession
    rows = points.select(target, *features).dropna().collect()  # a measured table of a few points
    y = np.array([r[target] for r in rows], float)
    own = [(f, [float(r[f]) for r in rows], 1) for f in features]
    start = [(e, v, n, *fitted(np.array(v), y)) for e, v, n in own] + [(repr(c), [c] * len(rows), 1, *fitted(np.full(len(rows), c), y)) for c in constants]
    pool = [tuple(x) for x in start]

    def grown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[tuple, tuple] = {}
            for expr, values, size in zip(frame["expr"], frame["vals"], frame["size"], strict=True):
                a = np.asarray(values, float)
                made = [(said.format(expr), fn(a), size + 1) for said, fn in UNARY.items()]
                made += [(said.format(expr, other), fn(a, np.asarray(b, float)), size + n + 1) for other, b, n, *_ in pool for said, fn in BINARY.items()]
                for said, v, n in made:
                    key = tuple(np.round(v, 9).tolist())
                    if key not in out or n < out[key][2]:
                        out[key] = (said, v.tolist(), n, *fitted(v, y))
            yield pd.DataFrame(list(out.values()), columns=["expr", "vals", "size", "loss", "slope", "offset"])

    for _ in range(rounds):
        now = spark.createDataFrame(pool, POOL)
        new = now.select("expr", "vals", "size").repartition(max(2, spark.sparkContext.defaultParallelism)).mapInPandas(grown, POOL).filter(F.col("loss") < float("inf"))
        once = now.unionAll(new).groupBy(F.transform("vals", lambda x: F.round(x, 9)).alias("key")).agg(F.min(F.struct("size", "expr", "vals", "loss", "slope", "offset")).alias("x")).select("x.*")
        best = once.orderBy(F.round("loss", 12), "size", "expr").limit(keep).collect()
        # The start stays, so that every feature can join later.
        pool = list({x[0]: x for x in [*((r.expr, list(r.vals), r.size, r.loss, r.slope, r.offset) for r in best), *start]}.values())
    return spark.createDataFrame(pool, POOL).drop("vals").orderBy(F.round("loss", 12), "size", "expr").limit(keep)

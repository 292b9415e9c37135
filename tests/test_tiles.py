"""Similarity joins that skip tiles, against all pairs."""

from pathlib import Path

import numpy as np
import pytest

from evidentia.operators import vectors


def table(spark, x, groups=None):
    rows = [(2 * i + 1, v.tolist(), None if groups is None else groups[i], "clash") for i, v in enumerate(x)]
    more = [(5001, None, "a", ""), (5002, [0.0] * x.shape[1], "a", ""), (5003, [float("nan")] * x.shape[1], "a", ""), (5004, [None] * x.shape[1], "b", ""), (5005, [], "b", "")]
    return spark.createDataFrame([*rows, *more], "id int, v array<float>, g string, tile string").repartition(5)


def brute(x, low, high=2.0, groups=None):
    u = x.astype(np.float32).astype(float)
    u /= np.sqrt((u * u).sum(1))[:, None]
    c = u @ u.T
    return {(2 * i + 1, 2 * j + 1): c[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if low <= c[i, j] < high and (groups is None or groups[i] != groups[j])}


@pytest.mark.parametrize(("low", "high", "block"), [(0.98, 2.0, 20), (0.3, 0.5, 50), (-2.0, 0.0, 4000)])
def test_similar_pairs(spark, low, high, block):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 6) + rng.normal(0, 0.05, (25, 6)) for _ in range(8)])
    groups = [None if i % 7 == 0 else "ab"[i % 2] for i in range(len(x))]
    for g in (None, "g"):
        want = brute(x, low, high, groups if g else None)
        got = vectors.similar_pairs(table(spark, x, groups), "id", "v", low, high, g, block)
        assert got.dtypes == [("id_a", "int"), ("id_b", "int"), ("cosine", "double")]
        rows = {(r.id_a, r.id_b): r.cosine for r in got.collect()}
        assert rows.keys() == want.keys() and want and all(abs(rows[k] - want[k]) < 1e-9 for k in rows)


def test_high_thresholds_compare_few(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 16) + rng.normal(0, 0.02, (40, 16)) for _ in range(16)])
    share = lambda low: (lambda t, p: t.share(p))(*vectors.near_tiles(table(spark, x), "id", "v", low, block=40))
    few, every = share(0.99)
    assert every == 640 * 639 // 2 and few < every / 4
    assert share(-1.0) == (every, every)


def test_tiles_are_not_shuffled_to_meet(spark):
    """What is shuffled would grow with the square of the tiles."""
    x = np.random.default_rng(5).normal(0, 1, (300, 6))
    got = vectors.similar_pairs(table(spark, x), "id", "v", 0.5, block=20)
    assert got.count() == len(brute(x, 0.5))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_written_once(spark):
    """Disk holds them in tiles, as precisely as they come, and no other table of them."""
    x = np.random.default_rng(6).normal(0, 1, (2400, 64))
    size = lambda: sum(p.stat().st_size for p in top.rglob("*.parquet"))
    top = Path(vectors.near_tiles(table(spark, x), "id", "v", 0.35)[0].packed._written.removeprefix("file:")).parent
    before = size()
    got = vectors.similar_pairs(table(spark, x), "id", "v", 0.35)
    assert got.count() == len(brute(x, 0.35))
    assert size() - before < 1.2 * x.size * 4


def test_precision_is_kept(spark):
    """Vectors of doubles are not cut to single precision."""
    x = np.stack([np.cos(a := np.arange(40) * 1e-9 + 1), np.sin(a)], 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = vectors.similar_pairs(df.filter("id > 0").unionByName(spark.createDataFrame([(0, [1.0, 0.0])], df.schema)), "id", "v", x[20, 0], x[10, 0]).collect()
    assert {r.id_b for r in got if r.id_a == 0} == set(range(11, 21))


@pytest.mark.parametrize("most", [7, 65_536])
def test_bounds_in_double_precision(most):
    """Cosines next to a bound are told apart where single precision can't."""
    angles = np.arange(2000) * 1e-9 + 1
    x, y = np.array([[1.0, 0.0]]), np.stack([np.cos(angles), np.sin(angles)], 1)
    low, high = y[1500, 0], y[200, 0]
    i, j, c = vectors.in_band(x, y, low, high, most)
    assert not i.any() and j.tolist() == list(range(201, 1501)) and (c == y[201:1501, 0]).all()


@pytest.mark.parametrize("group", [None, "g"])
def test_copies_leave_by_and_by(spark, monkeypatch, group):
    """Pairs of many copies leave a task a few rows at a time, and none is lost."""
    x = np.concatenate([np.ones((30, 3)), np.random.default_rng(7).normal(0, 1, (30, 3))])
    groups = ["ab"[i % 2] for i in range(len(x))]
    want, sizes, met_near = brute(x, 0.9, groups=groups if group else None), [], vectors.UnitTiles.met_near

    def met(self, most, work, schema):
        tiles = self.packed.toPandas().to_dict("records")
        sizes.extend(len(f) for i, a in enumerate(tiles) for b in tiles[i:] for f in work(a, b, a is b))
        return met_near(self, most, work, schema)

    monkeypatch.setattr(vectors, "ROWS", 10)
    monkeypatch.setattr(vectors.UnitTiles, "met_near", met)
    got = vectors.similar_pairs(table(spark, x, groups), "id", "v", 0.9, group=group, block=40)
    assert sum(sizes) == len(want) and max(sizes) < 10 + 40
    assert {(r.id_a, r.id_b) for r in got.collect()} == want.keys()


def test_no_vectors(spark):
    assert vectors.similar_pairs(table(spark, np.zeros((0, 3))), "id", "v", 0.5).count() == 0

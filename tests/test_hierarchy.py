"""The hierarchy of density clusters against one that one task works out."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import graphs, hierarchy, ordered


def inverse(far):
    return int(Decimal(1e9 / max(far, 1e-12)).quantize(Decimal(1), ROUND_HALF_UP))


def tree_of(ids, points, min_samples):
    """Links (far, a, b) of the shortest spanning tree of mutual reachability, in order."""
    far = np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in points])
    core = np.sort(far, 1)[:, min(min_samples, len(ids) - 1)]
    far = np.maximum(np.maximum(far, core[:, None]), core[None, :])
    links = sorted((far[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in range(i))
    root = {i: i for i in ids}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for far, a, b in links:
        if up(a) != up(b):
            root[up(a)] = up(b)
            out.append((float(far), a, b))
    return out


def brute(ids, tree, min_size):
    """The lasting cluster of each item, by the tree of merges from the top down."""
    own = {i: [i] for i in ids}
    made = []  # far, left, right
    for far, a, b in tree:
        left, right = own[a], own[b]
        made.append((far, left, right))
        for i in left + right:
            own[i] = left + right
    split = {tuple(sorted(x + y)): (far, x, y) for far, x, y in made}
    out = {}

    def follow(items, birth):
        """How long a cluster born at ``birth`` lasts with the kept ones within, and those."""
        lasts = 0
        while True:
            far, x, y = split[tuple(sorted(items))]
            now = inverse(far)
            big = [z for z in (x, y) if len(z) >= min_size]
            if len(big) == 1:
                lasts += (len(items) - len(big[0])) * (now - birth)
                items = big[0]
                continue
            lasts += len(items) * (now - birth)
            if not big:
                return lasts, None
            inner = [settle(z, now) for z in big]
            return lasts, (sum(v for v, _ in inner), [k for _, ks in inner for k in ks])

    def settle(items, birth):
        lasts, inner = follow(items, birth)
        return (lasts, [items]) if inner is None or lasts >= inner[0] else inner

    if len(ids) >= min_size and tree:
        _, inner = follow(list(ids), 0)
        for items in inner[1] if inner else ():
            out |= dict.fromkeys(items, min(items))
    return out


def points(seed, n, dim=2):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-4, 4, (6, dim))
    x = np.concatenate([centres[rng.integers(0, 6, n // 2)] + rng.normal(0, 0.3, (n // 2, dim)), rng.uniform(-6, 6, (n - n // 2, dim))])
    return np.round(x, 1 if seed % 2 else 6)  # rounded ones have ties and copies


@pytest.mark.parametrize(("seed", "n", "min_size", "min_samples", "tile"), [(1, 70, 3, 2, 20), (2, 150, 5, 1, 40), (3, 200, 2, 3, 1000), (4, 120, 8, 2, 200)])
def test_equals_one_task(spark, monkeypatch, seed, n, min_size, min_samples, tile):
    if seed == 1:  # nothing is finished by one task
        monkeypatch.setattr(hierarchy, "FINISH", 0)
    x = points(seed, n)
    blocks = ["a" if i % 3 else "b" for i in range(n)]
    rows = [(1000 - 3 * i, x[i].tolist(), blocks[i]) for i in range(n)]
    more = [(2001, [0.0, 0.0], None), (2002, [0.1, 0.0], None), (3000, None, "a"), (3001, [None, 1.0], "a"), (3002, [float("nan"), 0.0], "b"), (3003, [], "a")]
    df = spark.createDataFrame([*rows, *more], "id long, v array<double>, b string").repartition(5)
    tiles = hierarchy.Tiles(df, "b", "id", "v", tile)
    tiles.give_cores(tiles.cores(min_samples))
    tree = sorted(map(tuple, hierarchy.spanning_tree(tiles).collect()))
    want, links = {}, []
    for b in ("a", "b"):
        ids = [r[0] for r in rows if r[2] == b]
        own = tree_of(ids, np.array([r[1] for r in rows if r[2] == b]), min_samples)
        links += own
        want |= brute(ids, own, min_size)
    assert [t[1:] for t in tree if t[1] < 2000] == [t[1:] for t in sorted(links)]
    got = {r.id: r.cluster for r in hierarchy.stable_clusters(df, "b", "id", "v", min_size, min_samples, tile).collect()}
    assert len(got) == n + len(more)
    if min_size > 2:
        assert all(got[i] == -1 for i in (2001, 2002))
    assert {i: c for i, c in got.items() if c != -1 and i < 2000} == want
    assert len(set(want.values())) > 2


def merges(spark, rows):
    return graphs.cut_lineage(spark.createDataFrame(rows, "far double, a long, b long"))


def test_hierarchy_by_levels(spark, monkeypatch):
    """All that is in order dealt by ranges, every frequent key broadcast alone, several trees at once."""
    monkeypatch.setattr(hierarchy, "FINISH", 0)
    monkeypatch.setattr(ordered, "FEW", 20)
    monkeypatch.setattr(graphs, "FEW", 2)
    monkeypatch.setattr(graphs, "FREQUENT", 8)
    chain = [(3 * k + j, k * (k + 1) / 20 + j * 0.001) for k in range(12) for j in range(3)]
    nested = [(1000 + i, sum(((i >> k) & 1) * 3.0**k for k in range(5)) + 1e-3 * i * i) for i in range(32)]
    links, want = [], {}
    for rows in (chain, nested):
        ids = [i for i, _ in rows]
        own = tree_of(ids, np.array([[x] for _, x in rows]), 1)
        links += own
        want |= brute(ids, own, 2)
    found = hierarchy.lasting(merges(spark, links), 2).collect()
    first = {}
    for r in found:
        first[r.node] = min(first.get(r.node, r.id), r.id)
    assert {r.id: first[r.node] for r in found} == want


def test_long_chains(spark):
    """Clusters that join a large one each on its own, and pairs of pairs of pairs."""
    chain = [(3 * k + j, k * (k + 1) / 20 + j * 0.001) for k in range(60) for j in range(3)]
    nested = [(1000 + i, sum(((i >> k) & 1) * 3.0**k for k in range(7)) + 1e-3 * i * i) for i in range(128)]
    for rows, size in ((chain, 3), (chain, 2), (nested, 2), (nested, 4)):
        df = spark.createDataFrame([(i, [x], 1) for i, x in rows], "id long, v array<double>, b int")
        ids, x = [i for i, _ in rows], np.array([[x] for _, x in rows])
        got = {r.id: r.cluster for r in hierarchy.stable_clusters(df, "b", "id", "v", size, 1).collect()}
        assert {i: c for i, c in got.items() if c != -1} == brute(ids, tree_of(ids, x, 1), size)


def test_far_tiles_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.2, (100, 2)) + c for c in ((0, 0), (50, 0), (0, 50), (50, 50), (100, 100))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, v array<double>, b int")
    tiles = hierarchy.Tiles(df, "b", "id", "v", 40)
    all_pairs, compared = tiles.pairs.count(), []
    met = hierarchy.Tiles.met
    monkeypatch.setattr(hierarchy.Tiles, "met", lambda self, pairs, work, schema: (compared.append(pairs.count()), met(self, pairs, work, schema))[1])
    tiles.give_cores(tiles.cores(2))
    assert sum(compared) < all_pairs / 2
    compared.clear()
    hierarchy.spanning_tree(tiles)
    assert sum(compared) < all_pairs * 0.8


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, v array<double>, b int")
    assert hierarchy.stable_clusters(df, "b", "id", "v").count() == 0
    one = spark.createDataFrame([(1, [1.0], 1), (2, None, 1)], "id long, v array<double>, b int")
    assert {tuple(r) for r in hierarchy.stable_clusters(one, "b", "id", "v").collect()} == {(1, -1), (2, -1)}


def test_roots(spark):
    rows = [(i, i - 1 if i % 50 else None) for i in range(200)] + [(1000 + i, 0) for i in range(100)]
    got = {r.node: r.root for r in graphs.roots(spark.createDataFrame(rows, "node long, up long")).collect()}
    assert got == {i: i - i % 50 for i in range(200)} | {1000 + i: 0 for i in range(100)}


def test_running(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(g), i, int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(-9, 9, 300), strict=True))]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(7)
    for few in (0, 1000):
        monkeypatch.setattr(ordered, "FEW", few)
        for before in (False, True):
            got = ordered.running(df, {"s": ("sum", "v"), "m": ("max", F.col("v"))}, ["i"], ["g"], before)
            for r in got.collect():
                own = [v for g, i, v in rows if g == r.g and (i < r.i if before else i <= r.i)]
                assert (r.s, r.m) == ((sum(own), max(own)) if own else (None, None))

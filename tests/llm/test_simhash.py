import random
import re

import numpy as np
import pytest
import xxhash

from evidentia.llm import common, simhash
from evidentia.llm.components import connected_components
from evidentia.llm.queries import op10_simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(nodes, linked):
    root = {x: x for x in nodes}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((up(a), up(b)))
                root[y] = x
    return {x: up(x) for x in nodes}


def clouds(rng, n, centres, flips):
    middle = [rng.getrandbits(64) for _ in range(centres)]
    out = []
    for _ in range(n):
        x = rng.choice(middle)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return np.array(sorted(set(out)), np.uint64)


@pytest.mark.parametrize("text", ["", "One", "a b c d", "A b\tc d e\x1cf É g", "x y " * 300, "to be or not to be that is the question"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("flips", [2, 4, 7])
def test_local_links(flips, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    points = clouds(random.Random(flips), 700, 40, flips)
    members, visitors = points[::2], points[1::2]
    a, b = simhash.local_links(members, visitors, 4)
    assert (np.bitwise_count(a ^ b) >= 0).all()
    nodes = points.tolist()
    own = set(members.tolist())
    want = plain_components(nodes, lambda x, y: (x in own or y in own) and (x ^ y).bit_count() <= 4)
    pairs = set(zip(a.tolist(), b.tolist(), strict=True))
    got = plain_components(nodes, lambda x, y: (x, y) in pairs or (y, x) in pairs)
    assert got == want


def test_every_link_meets_in_one_shard():
    points = clouds(random.Random(9), 2500, 400, 5)
    shards = simhash.Shards(points[::3], 16)
    assert shards.leaves > 8
    who, shard, home = shards.place(points, 4)
    assert sorted(who[home]) == list(range(len(points)))
    at = {}
    for i, s in zip(who.tolist(), shard.tolist(), strict=True):
        at.setdefault(i, set()).add(s)
    own = dict(zip(who[home].tolist(), shard[home].tolist(), strict=True))
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4).tolist():
            assert own[j] in at[i] or own[i] in at[j]


@pytest.mark.parametrize("few", [1000, 2])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    monkeypatch.setattr(common, "FREQUENT", 20)
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(1, 40)] + [(5000, 5001 + i) for i in range(60)] + [(7000, 6000 + i) for i in range(60)] + [(100, 101), (101, 101), (200, 300), (300, 250)] + [(rng.randint(1000, 1060), rng.randint(1000, 1060)) for _ in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*pairs, (None, 5)], "a long, b long")).collect()}
    linked = {frozenset(p) for p in pairs}
    want = plain_components(sorted({x for p in pairs if p[0] != p[1] for x in p}), lambda a, b: frozenset((a, b)) in linked)
    assert got == want


def test_counted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 3)
    monkeypatch.setattr(common, "FREQUENT", 10)
    rng = random.Random(1)
    keys = [0] * 50 + [1] * 20 + [rng.randint(2, 40) for _ in range(40)]
    left = spark.createDataFrame(list(enumerate(keys)), "id long, k long")
    right = spark.createDataFrame([(k, keys.count(k), -k) for k in set(keys)], "k long, n long, x long")
    got = common.join_counted(left, right, "k", "n")
    assert sorted((r.id, r.k, r.x) for r in got.collect()) == [(i, k, -k) for i, k in enumerate(keys)] and "n" not in got.columns
    assert common.join_counted(left.limit(0), right.limit(0), "k", "n").count() == 0


def test_several_shards_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 120)
    monkeypatch.setattr(simhash, "VISITORS", 400)
    monkeypatch.setattr(simhash, "SAMPLE", (16, 500, 2000))
    monkeypatch.setattr(simhash, "PACK", 100)
    monkeypatch.setattr(common, "FEW", 5)
    points = clouds(random.Random(12), 2500, 300, 5)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.links(df)).collect()}
    want = plain_components(points.view(np.int64).tolist(), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert {x: got.get(x, x) for x in want} == want and len(set(want.values())) < 2000


def test_one_of_each_leaves_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 5), (1, "a b c", "x", 5), (2, "a b c", "y", 6), (None, "q r", "z", 7), (None, "q r", "z", 7)], "doc_id long, text string, place string, fp int")
    got = sorted(map(tuple, simhash.one_of_each(df).collect()), key=str)
    assert got == [(1, "a b c", "x", 5), (None, "q r", "z", 7)]


def test_query(spark, write_tables, monkeypatch):
    monkeypatch.setattr(common, "FEW", 2)
    monkeypatch.setattr(simhash, "SHARD", 8)
    monkeypatch.setattr(simhash, "VISITORS", 10)
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    texts = ["", None, " \t", "Alpha beta"]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base).upper() if rng.random() < 0.3 else " ".join(base))
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in op10_simhash(spark, write_tables(documents=spark.createDataFrame(rows + [(None, "alpha beta", "x")], "doc_id long, text string, fp string"))).collect()}
    assert len(got) == len(rows) + 1 and got[None].component_id == 3
    prints = {i: plain_fingerprint(t) for i, t, _ in rows}
    want = plain_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    for i, _, _ in rows:
        assert got[i].fingerprint == f"{prints[i]:016x}"
        assert got[i].component_id == want[i]
    assert len(set(want.values())) < len(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0

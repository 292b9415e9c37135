"""Ranks and components on small graphs, and on one with a hub."""

import random
from pathlib import Path

import pytest

from evidentia.operators import graphs


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def ranks_of(nodes, edges, alpha=0.85, rounds=200):
    edges, n = {e for e in edges if e[0] in nodes and e[1] in nodes}, len(nodes)
    out = {v: sum(s == v for s, _ in edges) for v in nodes}
    r = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        lost = sum(r[v] for v in nodes if not out[v]) / n
        got = dict.fromkeys(nodes, 0.0)
        for s, d in edges:
            got[d] += r[s] / out[s]
        r = {v: (1 - alpha) / n + alpha * (got[v] + lost) for v in nodes}
    return r


def test_pagerank_converges(spark, monkeypatch):
    monkeypatch.setattr(graphs, "FREQUENT", 3)
    monkeypatch.setattr(graphs, "FEW", 4)
    rng = random.Random(5)
    edges = [(rng.randrange(12), rng.randrange(20)) for _ in range(40)] + [(0, d) for d in range(1, 20)] + [(3, 99), (None, 1), (1, None)]
    got = {r["node"]: r["rank"] for r in graphs.pagerank(spark.range(20).withColumnRenamed("id", "node"), frame(spark, edges), "node", tolerance=1e-9).collect()}
    assert got == pytest.approx(ranks_of(set(range(20)), set(edges)), abs=1e-8)
    assert sum(got.values()) == pytest.approx(1.0)


def test_pagerank_stops_when_ranks_stand_still(spark, monkeypatch):
    written = []
    cut = graphs.cut_lineage
    monkeypatch.setattr(graphs, "cut_lineage", lambda *a: written.append(cut(*a)) or written[-1])
    graphs.pagerank(spark.range(4).withColumnRenamed("id", "node"), frame(spark, [(0, 1), (1, 2), (2, 3), (3, 0)]), "node").collect()
    # Nodes, links and starting ranks; a ring's ranks stand still in the first round.
    assert len(written) == 4
    left = [df for df in written if Path(df._written.removeprefix("file:")).exists()]
    assert len(left) == 3


def test_pagerank_of_nothing(spark):
    assert graphs.pagerank(spark.range(0).withColumnRenamed("id", "node"), frame(spark, []), "node").count() == 0


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graphs, "FREQUENT", 20)
    monkeypatch.setattr(graphs, "FEW", 50)
    edges = [(5, 1000 + i) for i in range(3000)] + [(10_000 + i, 10_001 + i) for i in range(20)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in graphs.components(frame(spark, edges)).collect()}
    assert got == {5: 5, 7: 7} | {1000 + i: 5 for i in range(3000)} | {10_000 + i: 10_000 for i in range(21)}
    assert graphs.components(frame(spark, [])).count() == 0

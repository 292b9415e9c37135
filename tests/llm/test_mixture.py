import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from evidentia.llm import mixture
from evidentia.llm.queries import op13_mixture


def shares(sizes, weights, total, most):
    """Targets by the rounds as stated."""
    target, open_, left = {}, list(sizes), total
    while open_:
        w = sum(weights[s] for s in open_)
        now = {s: left * weights[s] / w for s in open_}
        above = [s for s in open_ if now[s] > most * sizes[s]]
        if not above:
            return target | now
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def brute(rows, weights=(5, 2, 1), most=3, share=1.0, own=lambda r: 1.0):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    sizes = {s: sum(size(t) for _, t, *_ in by[s]) for s in order}
    turn = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = shares(sizes, turn, share * sum(sizes.values()), most)
    out = []
    for s in order:
        # Copies by weight within the source, at most ``most``, by rounds.
        scale, frozen = 0.0, set()
        while True:
            rest = sum(own(r) * size(r[1]) for k, r in enumerate(by[s]) if k not in frozen)
            if not rest:
                break
            scale = (target[s] - sum(most * size(by[s][k][1]) for k in frozen)) / rest
            new = {k for k, r in enumerate(by[s]) if own(r) * scale > most + 1e-9} - frozen
            if not new:
                break
            frozen |= new
        each = []
        for i, t, *more in by[s]:
            copies = min(scale * own((i, t, *more)), most)
            u = (int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            each.append((i, size(t), int(copies), copies - int(copies), u))
        left = target[s] - sum(n * whole for _, n, whole, _, _ in each)
        taken = [w for _, _, w, _, _ in each]
        for _, _, n, k in sorted((u / (1 - u) / (p / (1 - p)), -1 if i is None else i, n, k) for k, (i, n, _, p, u) in enumerate(each) if p > 0 and n > 0):
            if n <= left:
                taken[k] += 1
                left -= n
        out += [(i, n, sizes[s], round(target[s], 6), c, c * n) for (i, n, *_), c in zip(each, taken, strict=True)]
    return sorted(out, key=str)


def rounded(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.copies, r.taken) for r in df.collect()), key=str)


def documents(n=500):
    rng = random.Random(13)
    sources = ["b", "a", "B", "é", "z", None, "", "😀", "tiny", "empty"]
    rows = []
    for i in range(n):
        s = rng.choice(["a"] * 5 + sources)
        words = 0 if s == "empty" else rng.choice([0, 1, 5, 20, 50, 300])
        rows.append((i, rng.choice([" ", "\n", "\x0b\t", "  "]).join(["w x"] * words), s if s != "tiny" or i < 100 else "a", rng.choice([1.0, 1.0, 2.5, 9.0, None, 0.0])))
    return [*rows, (n, None, "a", 1.0), (n + 1, "w " * 20_000, "B", 1.0), (None, "one two", None, 1.0), (5, rows[5][1], rows[5][2], 1.0)]


def table(spark, rows):
    return spark.createDataFrame([(*r[:3], r[3] if len(r) > 3 else 1.0, 1, 2.0) for r in rows], "doc_id long, text string, source string, liking double, size int, target double").repartition(5)


@pytest.mark.parametrize(("share", "most"), [(1.0, 3), (0.4, 1), (2.5, 3)])
def test_equals_brute_force(spark, share, most):
    rows = documents()
    assert rounded(mixture.mix(table(spark, rows), share=share, most=most)) == brute(rows, share=share, most=most)


def test_documents_of_unequal_weight(spark):
    rows = documents()
    got = mixture.mix(table(spark, rows), weight_col="liking")
    assert rounded(got) == brute(rows, own=lambda r: r[3] or 0.0)
    assert all(r.copies <= 3 for r in got.collect())


def test_words_are_near_targets(spark):
    rows = documents(3000)
    got = mixture.mix(table(spark, rows)).collect()
    source, by = {i: s for i, _, s, _ in rows}, defaultdict(list)
    for r in got:
        by[source[r.doc_id]].append(r)
    for own in by.values():
        over = sum(r.taken for r in own) - own[0].target
        fewest = min(r.copies for r in own)
        assert over <= 1e-6 and -over < min((r.size for r in own if r.size and r.copies == fewest), default=1)
    assert all(r.taken <= 3 * r.size for r in got)


def test_odds_follow_weights(spark):
    """Of two kinds of documents alike in size, the one of twice the weight is drawn about twice as often."""
    rows = [(i, "w " * 10, "s", 2.0 if i % 2 else 1.0) for i in range(6000)]
    got = mixture.mix(table(spark, rows), share=0.3, weight_col="liking").collect()
    odd = sum(r.copies for r in got if r.doc_id % 2)
    assert abs(odd - 1200) < 80 and sum(r.taken for r in got) == 18_000


def test_query_and_sql(spark, write_tables):
    rows = [r for r in documents() if r[0] is not None]
    folder = write_tables(documents=table(spark, rows))
    got = rounded(op13_mixture(spark, folder))
    assert got == brute(rows) and got == rounded(op13_mixture(spark, folder))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(f"select doc_id, size, source_size, round(target, 6), copies, taken from ({mixture.ORACLE})").fetchall()
    assert sorted(want, key=str) == got


def test_empty_tables(spark):
    assert mixture.mix(table(spark, [])).count() == 0
    assert [tuple(r) for r in mixture.mix(table(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0.0, 0, 0)]
    assert mixture.mix(table(spark, []), weight_col="liking").count() == 0

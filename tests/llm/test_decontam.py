import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import decontam
from evidentia.llm.queries import op8_decontam

VOCABULARY = [f"w{i}" for i in range(300)]


def split(text):
    return re.findall(r"[^\W_]+", text.lower())


def cut(words, width):
    return Counter(" ".join(words[i : i + width]) for i in range(max(0, len(words) - width) + 1))


def brute(docs, items):
    """Every window that shares an aligned shingle with an item, by plain loops."""
    out = {}
    for item, text in items:
        own = split(text or "")
        if not own:
            continue
        width = min(5, len(own))
        want = cut(own, width)
        for doc, text in docs:
            words = split(text or "")
            starts = {max(0, min(at - place, len(words) - len(own))) for at in range(len(words) - width + 1) for place in range(len(own) - width + 1) if words[at : at + width] == own[place : place + width]}
            for start in starts:
                have = cut(words[start : start + len(own)], width)
                common = sum((want & have).values())
                s = common / (sum(want.values()) + sum(have.values()) - common)
                if s >= 0.8:
                    out[doc, item] = max(out.get((doc, item), (0, 0)), (s, -start))
    return {k: (s, -m) for k, (s, m) in out.items()}


def fixture(seed=1):
    rng = random.Random(seed)
    make = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [(i, " ".join(make(rng.randint(12, 60)))) for i in range(30)] + [(90, "one two three"), (91, ""), (92, None), (93, "!!")]
    docs = []
    for d in range(160):
        words = make(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items[:30])[1].split()
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["x"], [part[k], "y"]])
            if rng.random() < 0.2:
                part = part[: len(part) * 9 // 10]
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((d, (", " if d % 3 else "\n").join(words).title()))
    docs += [(500, None), (501, ""), (502, "say One, two - three!"), (503, "w1 " * 30_000), (None, items[0][1]), (504, items[1][1] + " " + items[1][1])]
    return docs, items


def every_window(docs, items):
    """The best of all windows of an item's size at all places."""
    out = {}
    for item, text in items:
        own = split(text or "")
        if not own:
            continue
        width = min(5, len(own))
        want = cut(own, width)
        for doc, text in docs:
            words = split(text or "")
            if len(words) < width or not set(cut(words, width)) & set(want):
                continue
            for start in range(max(1, len(words) - len(own) + 1)):
                have = cut(words[start : start + len(own)], width)
                common = sum((want & have).values())
                s = common / (sum(want.values()) + sum(have.values()) - common)
                if s >= 0.8:
                    out[doc, item] = max(out.get((doc, item), 0), s)
    return out


@pytest.mark.parametrize("seed", range(1, 9))
def test_windows_at_shared_shingles_miss_none(seed):
    docs, items = fixture(seed)
    docs = [d for d in docs if d[0] != 503]
    assert {k: s for k, (s, _) in brute(docs, items).items()} == every_window(docs, items)


def frames(spark, docs, items):
    return {
        "documents": spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("size", F.lit(1)),
        "benchmark": spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(0)),
    }


@pytest.mark.parametrize("broadcast", [10**6, 200])
def test_query_equals_brute_force_and_oracle(spark, write_tables, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST", broadcast)
    docs, items = fixture()
    folder = write_tables(**frames(spark, docs, items))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in op8_decontam(spark, folder).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 40 and (None, 0) in want and (502, 90) in want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    assert {r[:2]: r[2:] for r in con.execute(f"select doc_id, item_id, similarity, start from ({decontam.ORACLE})").fetchall()} == want


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), decontam.RADIUS):
            b ^= 1 << k
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    same = F.exists(F.zip_with(decontam.blocks(F.col("a")), decontam.blocks(F.col("b")), lambda x, y: x == y), lambda x: x)
    assert df.filter(~same).count() == 0
    assert df.filter(F.size(decontam.blocks(F.col("a"))) != decontam.RADIUS + 1).count() == 0


def test_simhash_is_the_majority(spark):
    rng = random.Random(5)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(9)]
    got = spark.createDataFrame([(hashes,)], "h array<long>").select(decontam.simhash(F.col("h"))).first()[0]
    assert all((got >> b & 1) == int(2 * sum(h >> b & 1 for h in hashes) > 9) for b in range(64))


@pytest.mark.parametrize("n", [1, 2, 40, 40_000])
def test_simhash_of_any_number(spark, n):
    rng = np.random.default_rng(n)
    hashes = rng.integers(-(1 << 63), 1 << 63, n).tolist()
    bits = np.unpackbits(np.array(hashes, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    want = int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])
    assert spark.createDataFrame([(hashes,)], "h array<long>").select(decontam.simhash(F.col("h"))).first()[0] == want


def test_similarity_is_weighted_jaccard(spark):
    rng = random.Random(8)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(1, 9))], [rng.choice("abcd") for _ in range(rng.randint(1, 9))]) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(decontam.similarity(F.col("a"), F.col("b"))).collect()]
    for (a, b), s in zip(rows, got, strict=True):
        common = sum((Counter(a) & Counter(b)).values())
        assert s == common / (len(a) + len(b) - common)


def test_long_items(spark):
    rng = random.Random(2)
    own = [rng.choice(VOCABULARY) for _ in range(12_000)]
    docs = spark.createDataFrame([(1, " ".join(["before", *own, "after"])), (2, "other words " * 9000)], "doc_id long, text string")
    items = spark.createDataFrame([("x", " ".join(own))], "item_id string, text string")
    assert [tuple(r) for r in decontam.contaminated(docs, items).collect()] == [(1, "x", 1.0, 1)]


def test_repeated_rows_and_empty_tables(spark):
    docs, items = fixture()
    t = frames(spark, docs[:20] * 2, items)
    one = decontam.contaminated(t["documents"], t["benchmark"]).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.start) for r in one} == brute(docs[:20], items) and len(one) == len(brute(docs[:20], items))
    assert decontam.contaminated(t["documents"].limit(0), t["benchmark"]).count() == 0
    assert decontam.contaminated(t["documents"], t["benchmark"].limit(0)).count() == 0

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from evidentia.llm import resample
from evidentia.llm.queries import op12_resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, share=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t, longest)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x, longest)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, n, fs in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[1:3]))
    drawn = len(fit) * share // 100
    out = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(fit)] + [(*r[:4], None) for r in rows if r[4] < least]
    return sorted(out, key=str)


def documents():
    rng = random.Random(12)
    words = ["the", "The", "of", "été", "naïve", "İx", "x1", "a_b", "q-r", "😀", "\x00", "日本", "z", "THE", "don't"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    return [*rows, (300, None), (301, ""), (302, "---"), (303, "word " * 30_000), (303, "other " * 25), (None, "the " * 40), *([(7, rows[7][1])] * 30)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], "doc_id long, text string, n int, score string").repartition(6)


def targets(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "item_id long, text string")


@pytest.mark.parametrize(("longest", "buckets", "share"), [(1, 10_000, 10), (3, 50, 33), (2, 70_000, 100)])
def test_equals_brute_force(spark, longest, buckets, share):
    wanted = ["naïve été naïve été", None, "x1 the 😀 日本 of"]
    got = resample.resample(table(spark, documents()), targets(spark, wanted), longest=longest, buckets=buckets, share=share)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(documents(), wanted, longest, buckets, share)


def test_ring_equals_checksums_of_joined_words():
    words = [b"a", b"bc", b"d", "é".encode(), b"f"]
    for longest in range(1, 7):
        want = [zlib.crc32(b" ".join(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        assert sorted(resample.ring(words, longest)) == sorted(want)


def test_query_and_sql(spark, write_tables):
    rows = [(i, t and t.replace("\x00", "_")) for i, t in dict(documents()).items() if i is not None]
    wanted = ["naïve été naïve été", None, "x1 the 😀 日本 of"]
    folder = write_tables(documents=table(spark, rows), benchmark=targets(spark, wanted))
    got = sorted(map(tuple, op12_resample(spark, folder).collect()), key=str)
    assert got == brute(rows, wanted) and sum(r[4] is not None for r in got) > 10
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    assert sorted(con.execute(f"select doc_id, n_features, weight, score, rank from ({resample.ORACLE})").fetchall(), key=str) == got


def test_draws_what_is_like_the_target(spark):
    rng = random.Random(3)
    text = lambda words: " ".join(rng.choice(words) for _ in range(50))
    rows = [(i, text(["red", "green", "blue"] if i % 10 == 0 else ["one", "two", "three", "four"])) for i in range(1000)]
    got = resample.resample(table(spark, rows), targets(spark, ["red green blue red"] * 20)).collect()
    assert sum(r.doc_id % 10 == 0 for r in got if r.rank is not None) > 60


def test_empty_tables(spark):
    assert resample.resample(table(spark, []), targets(spark, [])).count() == 0
    assert resample.resample(table(spark, [(1, "a " * 30)]), targets(spark, []), share=100).first()["rank"] == 1

import random
import re
from collections import Counter

import duckdb
import pytest

from evidentia.llm import phrases
from evidentia.llm.queries import op11_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=5, least=3, share=100, most=2000):
    counts, size = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            size[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {g: a for g, a in f.items() if a >= least}
        within = set()
        for g, a in often.items():
            for k in range(2, len(g)):
                within |= {p for p in (g[i : i + k] for i in range(len(g) - k + 1)) if 100 * a >= share * often[p]}
        found = []
        for g, a in often.items():
            if len(g) > 1 and g not in within:
                score, _, l, r = min((1000 * a * size[lang] // (often[g[:k]] * often[g[k:]]), k, often[g[:k]], often[g[k:]]) for k in range(1, len(g)))  # noqa: E741
                found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, size[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most])]  # noqa: E741
    return sorted(out)


def corpus(n=300):
    rng = random.Random(11)
    words = ["the", "The", "of", "Éa", "éa", "a\x0bb", "x\x1cy", " ", " ", "new", "york", "i", "İ", "ß", "😀", "d.e", "'", "-"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r", ";", "\x0c", "!?", " : "]
    rows = [("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    return [*rows, *([("we like New York in the spring a lot", "en")] * 5), (None, "en"), ("", None), ("\t  ", "de"), ("one " * 3000, "fr"), (".,;", "es")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 1, 2) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, id string, n int, a int").repartition(5)


@pytest.mark.parametrize("names", [phrases.NAMES, 0])
@pytest.mark.parametrize("share", [100, 60])
def test_equals_brute_force(spark, monkeypatch, names, share):
    """With names that are broadcast, and with all of them joined."""
    monkeypatch.setattr(phrases, "NAMES", names)
    rows = corpus()
    found = phrases.best(phrases.collocations(table(spark, rows), least=3, share=share))
    assert sorted(map(tuple, found.collect())) == brute(rows, share=share)


def test_bytes_bound_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(phrases, "NAME_BYTES", 100)
    rows = corpus(60)
    assert sorted(map(tuple, phrases.best(phrases.collocations(table(spark, rows), least=4, longest=3)).collect())) == brute(rows, 3, 4)


def test_first_ones(spark):
    rows = corpus()
    assert sorted(map(tuple, phrases.best(phrases.collocations(table(spark, rows), least=3), 7).collect())) == brute(rows, most=7)


def test_counts_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 40)
    rows = corpus()
    assert sorted(map(tuple, phrases.best(phrases.collocations(table(spark, rows), least=3)).collect())) == brute(rows)


def test_products_beyond_64_bits(spark):
    n = 10**12
    rows = spark.createDataFrame([(n, [n, n + 7], [n + 1, n + 3], 9 * n)], "n long, pre array<long>, suf array<long>, n_words long")
    got = rows.select(phrases.weakest(3, "pre", "suf", "n", "n_words").alias("c")).first().c
    assert tuple(got) == min((1000 * n * 9 * n // (x * y), k, x, y) for k, x, y in ((1, n, n + 3), (2, n + 7, n + 1)))


def test_query_and_sql(spark, write_tables):
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(60)) + rng.choice([".", "", ", a b c"]), rng.choice(["en", None])) for _ in range(500)]
    folder = write_tables(documents=table(spark, rows))
    got = sorted(map(tuple, op11_phrases(spark, folder).collect()))
    assert got == brute(rows, least=100) and len(got) > 10
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    assert sorted(con.execute(f"select lang, rank, phrase, a, l, r, n, score from ({phrases.ORACLE})").fetchall()) == got


@pytest.mark.parametrize("names", [phrases.NAMES, -1])
def test_empty_tables(spark, monkeypatch, names):
    monkeypatch.setattr(phrases, "NAMES", names)
    assert phrases.best(phrases.collocations(table(spark, []))).count() == 0
    assert phrases.best(phrases.collocations(table(spark, [(None, None)]))).count() == 0

import math
import random
import time
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import langid
from evidentia.llm.queries import op6_langid

WORDS = {
    "en": "the of and that which house water should through light never morning paper".split(),
    "de": "der und nicht wasser haus durch licht morgen papier sollte niemals welche schön".split(),
    "fr": "le et que maison eau lumière jamais matin papier devrait à travers laquelle".split(),
}


def sentence(rng, lang, n=12):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def greedy(text, sample):
    """Phrases by brute force over the whole text; a character that the sample lacks ends a phrase and is none."""
    n, i = bool(text), 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += k - 1
        if i < len(text) and text[i] not in sample:
            n += 1
            i += 1
        elif i < len(text):
            n += 1
    return int(n)


def parser_cases(rng):
    samples = {x: langid.fold(" ".join(sentence(rng, x) for _ in range(10))) for x in WORDS}
    texts = [langid.fold(sentence(rng, rng.choice(list(WORDS)), rng.randint(1, 40))) for _ in range(60)] + ["zzz", "a", "漢字 x", "", samples["en"], samples["de"] * 9, "the house of " * 300]
    return samples, texts


@pytest.mark.parametrize(("stretch", "step"), [(512, 1 << 22), (7, 100), (40, 1 << 22), (1, 50), (40, 500)])
@pytest.mark.parametrize("abreast", [0, 5, 1000])
@pytest.mark.parametrize("cells", [0, 1 << 26])
def test_phrase_counts_equal_brute_force(monkeypatch, stretch, step, abreast, cells):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    monkeypatch.setattr(langid, "STEP", step)
    monkeypatch.setattr(langid, "ABREAST", abreast)
    monkeypatch.setattr(langid, "DENSE_CELLS", cells)
    samples, texts = parser_cases(random.Random(1))
    got = langid.Parser(samples).phrases(texts)
    assert got.tolist() == [[greedy(t, samples[n]) for n in sorted(samples)] for t in texts]


def test_a_phrase_may_be_longer_than_any_block(monkeypatch):
    rng = random.Random(3)
    sample = langid.fold(" ".join(sentence(rng, "en") for _ in range(60)))
    monkeypatch.setattr(langid, "STEP", 700)
    assert len(sample) > 3000 and langid.Parser({"en": sample}).phrases([sample[7:2900], sample]).tolist() == [[1], [1]]


def test_predictions_equal_brute_force():
    samples, texts = parser_cases(random.Random(5))
    names = sorted(samples)
    for text, (lang, score) in zip(texts, langid.Parser(samples).predict(texts), strict=True):
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        cost = [greedy(text, samples[n]) * math.log(len(samples[n])) for n in names]
        assert lang == names[cost.index(min(cost))]
        assert abs(score - 1 / sum(math.exp(-8 * (c / min(cost) - 1)) for c in cost)) < 1e-9


def test_letters_are_those_of_unicode():
    for c in map(chr, range(0x20000)):
        if not 0xD800 <= ord(c) < 0xE000:
            assert langid.has_letter(c) == (unicodedata.category(c)[0] == "L"), hex(ord(c))
            if unicodedata.category(c)[0] != "L":
                assert not any(x.isalpha() and x not in c.lower() for x in langid.fold(c)) and (langid.fold(c) == "" or c.lower() != c)
    assert langid.fold("½a²b Ⅷ c٣") == "a b c"


def test_a_megabyte_is_read_whole(monkeypatch):
    rng = random.Random(6)
    samples, _ = parser_cases(rng)
    text = langid.fold("the house of never morning " * 40_000)
    start = time.process_time()
    got = langid.Parser(samples).phrases([text, "a"])
    assert time.process_time() - start < 10 and got[0, 1] > 1000


def test_long_rows_teach_by_parts(spark):
    rows = [(1, "aa bb " * 50_000, "x"), (2, "cc dd " * 100, "y"), (3, "ee ff " * 50_000, "y")]
    samples = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langid.SAMPLE_CHARS * 0.9 < len(samples["x"]) < langid.SAMPLE_CHARS * 1.1
    assert samples["y"].startswith("cc dd") and "ee ff" in samples["y"]


def test_lists_of_transitions_count_as_the_table_does(monkeypatch):
    rng = random.Random(2)
    samples = {x: langid.fold(" ".join(sentence(rng, x) for _ in range(10))) for x in WORDS} | {"none": ""}
    texts = [langid.fold(sentence(rng, rng.choice(list(WORDS)), rng.randint(1, 200))) for _ in range(60)] + ["zzz", "a", "漢字 x"]
    table = langid.Parser(samples)
    monkeypatch.setattr(langid, "DENSE_CELLS", 0)
    lists = langid.Parser(samples)
    assert table.flat is not None and lists.flat is None
    assert (table.phrases(texts) == lists.phrases(texts)).all()


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(140)}
    # The last ones are the rarest.
    rows = [(k * 10 + i, " ".join(rng.choice(words[x]) for _ in range(60)), x) for k, x in enumerate(words) for i in range(3 if k < 130 else 1)]
    samples = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(samples) == set(words)
    asked = spark.createDataFrame([(" ".join(rng.choice(words[x]) for _ in range(30)), x) for x in list(words)[120:]], "text string, lang string")
    assert all(r.lang_pred == r.lang for r in langid.predict(asked, samples).collect())


def test_automaton_accepts_substrings():
    text = "abcbcabbcab"
    automaton = langid.Automaton([ord(c) - 96 for c in text], 5)
    table = dict(zip(automaton.keys.tolist(), automaton.to.tolist(), strict=True))

    def accepts(s):
        state = 1
        for c in s:
            state = table.get(state * 5 + ord(c) - 96)
            if not state:
                return False
        return True

    every = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    rng = random.Random(0)
    assert all(map(accepts, every))
    assert all(accepts(s) == (s in every) for s in ("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(400)))


@pytest.mark.parametrize("text", [None, "", "12 34", "!?", "_", "½", "²³", "Ⅷ", "¼ ٣ 12"])
def test_undetermined(text):
    assert langid.Parser({"en": "the cat"}).predict([text]) == [("und", 0.0)]


def test_query(spark, write_tables):
    rng = random.Random(7)
    docs = [(i, sentence(rng, lang, rng.randint(4, 30)), lang, "s") for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(400))]
    extra = [(1000, None, "en", "s"), (1001, "123", "en", "s"), (1002, "the water and light", None, "s"), (None, "nicht durch", "de", "s"), (1003, "the house of " * 20_000, None, "s")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in op6_langid(spark, write_tables(documents=df)).collect()}
    assert len(got) == len(docs) + len(extra)
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert held and all(got[d[0]].held_out for d in held)
    assert np.mean([got[d[0]].lang_pred == d[2] for d in held]) > 0.97
    assert (got[1000].lang_pred, got[1001].lang_pred, got[1002].lang_pred, got[None].lang_pred, got[1003].lang_pred) == ("und", "und", "en", "de", "en")
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    samples = langid.fit(docs)
    assert samples == {}
    assert langid.predict(docs, samples).first().lang_pred == "und"
    assert langid.predict(docs.limit(0), samples).count() == 0


def test_repeated_rows_lose_no_language(spark):
    """Equal rows fall or stay together, so they count once."""
    rng = random.Random(8)
    rest = spark.createDataFrame([(i, sentence(rng, "en"), "en") for i in range(100, 150)], "doc_id long, text string, lang string")
    for doc_id in (1, 7):
        same = spark.range(20_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("der hund und die katze").alias("text"), F.lit("de").alias("lang"))
        samples = langid.fit(same.unionByName(rest))
        assert samples["de"] == "der hund und die katze" and len(samples["en"]) > 1000


def test_samples_are_the_first_distinct_rows_by_hash(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, "en"), "en") for i in range(30)] + [(i, sentence(rng, "de"), "de") for i in range(30, 45)]
    df = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    at = {(r.doc_id, r.text): r.at for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("at")).distinct().collect()}
    want = {x: " ".join(langid.fold(t) for _, t in sorted(((i, t) for i, t, y in rows if y == x), key=at.get)) for x in ("en", "de")}
    assert langid.fit(df) == want

import collections
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import toxicity
from evidentia.llm.queries import op3_toxicity

SYLLABLES = ["ba", "ko", "ri", "ten", "sul", "mo", "ga", "pen"]
INSULTS = ["stupid", "moron", "worthless"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.25
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    return toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.is_training())


@pytest.mark.parametrize(("disguised", "plain"), [("stup1d", "stupid"), ("m0r0n", "moron"), ("m.o.r.o.n", "moron"), ("stuuuupid", "stupid"), ("w0rthle$$", "worthless"), ("mor*n", "moron")])
def test_restores(model, disguised, plain):
    assert toxicity.restore(disguised, model.language) == plain


@pytest.mark.parametrize("text", ["you st u p i d one", "ko m o r o n ga", "a 5tup1d ri", "STUUUPID", "ba wor†hless m0r0n", "s t u p i d", "b a k o s t u p i d r i t e n g a p e n", "ba s t u p i d m o r o n ko", "w o r t h l e s s"])
def test_disguised_insults_score_high(model, text):
    assert toxicity.Scorer(model).score(text) >= 0.3


def readings(word, ends):
    """All readings of a lattice, by enumeration."""
    options = []
    for x in toxicity.lattice(word):
        if isinstance(x, int):
            options += [tuple("abcdefghijklmnopqrstuvwxyz")] * x
        else:
            options.append((*x, *(o + " " for o in x)) if ends else x)
    return itertools.product(*options)


def worth(reading, model, ends):
    a = b = 0
    total = 0.0
    for c in "".join(reading):
        z = toxicity.PLACE.get(c, 0)
        total += float(model[a, b, z]) + toxicity.LETTER * (c != " " or not ends)
        a, b = b, z
    return total + float(model[a, b, 0])


@pytest.mark.parametrize("ends", [False, True])
def test_readings_equal_enumeration(model, ends):
    rng = random.Random(4)
    alphabet = "stupidmoron10$.!|" if ends else "stupidmoron10$.!|*#("
    words = ["".join(c * rng.choice([1, 1, 1, 2, 3]) for c in rng.choices(alphabet, k=rng.randint(1, 6))) for _ in range(60)]
    words += [] if ends else ["*", "**", "***", "m*r*n", "a**b", "***d", "#*#"]
    for word in words:
        if sum(x for x in toxicity.lattice(word) if isinstance(x, int)) > 2 or len(word) > 8:
            continue
        got = toxicity.restore(word, model.language, ends)
        best = max(readings(word, ends), key=lambda r: worth(r, model.language, ends))
        assert abs(worth(got, model.language, ends) - worth(best, model.language, ends)) < 1e-4, (word, got, best)


def test_a_mask_has_as_many_letters_as_signs(model):
    for n in (1, 2, 3, 9, 40, 70, 200, 5000):
        got = toxicity.restore(f"s{'*' * n}d", model.language)
        assert len(got) == n + 2 and got[0] + got[-1] == "sd" and got.isalpha()
    # The steps that come again are those of the whole run.
    for n in (100, 300):
        one = toxicity.restore(f"s{'*' * n}d", model.language)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(toxicity, "CYCLE", 0)
            other = toxicity.restore(f"s{'*' * n}d", model.language)
        assert abs(worth(one, model.language, False) - worth(other, model.language, False)) < 1e-3 * n


MB = 1 << 20


@pytest.mark.parametrize("text", ["s t " * (MB // 4), "a" + "*" * MB + "b", "a" * MB, "1a" * (MB // 2), "a*" * (MB // 256), "s t u p i d " * (MB // 12), "stup1d! " * (MB // 8), "x" + "." * MB + "y"], ids=range(8))
def test_a_megabyte_is_read_whole(model, text):
    start = time.process_time()
    toxicity.Scorer(model).score(text)
    assert time.process_time() - start < 20


@pytest.mark.parametrize("text", [None, "", " ", "bako riten", "1 2 3 4 5 6", "!!!", "a" * 50_000, "ko 1234 ga5 $$$"])
def test_clean_texts_score_low(model, text):
    assert toxicity.Scorer(model).score(text) < 0.3


def test_language_model_counts_all_texts(spark):
    one = toxicity.triples("abc abd")
    at = lambda s: (toxicity.PLACE.get(s[0], 0) * toxicity.N + toxicity.PLACE.get(s[1], 0)) * toxicity.N + toxicity.PLACE.get(s[2], 0)
    assert one[at("abc")] == 1 and one[at(" ab")] == 2 and one.sum() == 7
    assert np.isfinite(toxicity.language_model(spark.createDataFrame([(None,)], "text string"))).all()


def test_query(spark, write_tables):
    docs, labels = corpus()
    rows = [*docs, (10_000, None, "en"), (10_001, "", "en"), (None, "moron stupid", "en")]
    folder = write_tables(
        documents=spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")),
        labels=spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"),
    )
    got = {r.doc_id: r for r in op3_toxicity(spark, folder).collect()}
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.98
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert got[10_000].score == got[10_001].score < 0.3 <= got[None].score


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first().score == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("alike", [True, False])
def test_an_id_of_many_rows_does_not_reach_the_driver_whole(spark, monkeypatch, alike):
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    docs, labels = corpus(200)
    hot = spark.range(30_000).select(F.lit(9_999).cast("long").alias("doc_id"), F.lit("moron bako") if alike else F.concat(F.lit("moron "), F.col("id").cast("string")))
    every = spark.createDataFrame(docs, "doc_id long, text string, lang string").select("doc_id", "text").union(hot)
    arrived = []
    was = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, y, prior, n: arrived.append((len(x), n.sum())) or was(x, y, prior, n))
    toxicity.fit(every, spark.createDataFrame([*labels, (9_999, 1)], "doc_id long, toxic int"))
    assert all(rows <= n <= 120 for rows, n in arrived)


def test_the_curve_weighs_rows_that_are_alike():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, 400) / 2
    y = (rng.random(400) < 1 / (1 + np.exp(2 - 2 * x))).astype(float)
    cells, n = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
    one = toxicity.logistic(x, y, 0.1, np.ones(400))
    assert np.allclose(one, toxicity.logistic(cells[:, 0], cells[:, 1], 0.1, n.astype(float)), atol=1e-9)


def test_marks_and_weights_equal_brute_force(spark):
    """Marks are the features far likelier in toxic rows, their weights the log of how much."""
    docs, labels = corpus(300, seed=5)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    reader, truth = toxicity.Reader(model.language), dict(labels)
    seen = {k: collections.Counter() for k in (0, 1)}
    for i, text, _ in docs:
        if i in truth:
            seen[truth[i]].update({f for w in reader.read(text) for f in toxicity.features(w)})
    many = {k: sum(1 for i, _, _ in docs if truth.get(i) == k) for k in (0, 1)}
    want = {}
    for f, t in seen[1].items():
        often, seldom = t / many[1], (seen[0][f] + 0.5) / (many[0] + 1)
        if t >= max(3, many[1] // 500) and often >= toxicity.LIFT * seldom and toxicity.likelihood_ratio(t, many[1], seen[0][f], many[0]) >= toxicity.SIGNIFICANT:
            want[f] = math.log(often / seldom)
    assert want and model.marks == pytest.approx(want)

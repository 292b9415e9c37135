import random
import re

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import bpe
from evidentia.llm.simhash import one_of_each

from .test_decontam import brute as brute_decontam
from .test_pii import PLAIN
from .test_simhash import plain_components, plain_fingerprint

INSULTS = ["stupid", "moron", "worthless", "scum"]


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "ten", "sul", "mo") for b in ("ga", "pen", "lo", "xi", "dra", "fu")]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(make(rng.randint(14, 40)))) for i in range(8)]
    docs, labels = [], []
    for i in range(500):
        text, bad = make(rng.randint(30, 90)), rng.random() < 0.2
        for _ in range(2 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        if i % 20 == 3:
            text += items[i % 8][1].split()
        if i % 15 == 4:
            text.insert(5, "someone@example.com")
        joined = " ".join(text)
        if docs and rng.random() < 0.15 and not bad:
            joined = rng.choice(docs)[1] or ""
        docs.append((i, joined, "en", "s", len(joined)))
        labels.append((i, 1, int(any(w in joined.split() for w in INSULTS))))
    docs += [(900, None, None, None, None), (901, None, "en", "s", None), (None, "alone without any name " * 3, "en", "s", 1), (None, "alone without any name " * 3, "en", "s", 1)]
    return docs, labels, items


def test_stages_equal_brute_force(spark, write_tables):
    docs, labels, items = corpus()
    folder = write_tables(
        documents=spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame(items, "item_id long, text string"),
    )
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in now.collect()]
        out = stage(spark, now, folder)
        if name != "bpe":
            assert out.columns == now.columns
            path = f"{folder}/{name}"
            out.write.parquet(path)
            out = spark.read.parquet(path)
        got = [tuple(r) for r in out.collect()]
        key = lambda r: tuple(str(x) for x in r)
        if name == "toxicity":
            want = [r for r in rows if not set(INSULTS) & set((r[1] or "").split())]
            assert sorted(got, key=key) == sorted(want, key=key)
        elif name == "simhash_near_dedup":
            prints = [plain_fingerprint(r[1]) for r in rows]
            root = plain_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
            groups = {}
            for r, p in zip(rows, prints, strict=True):
                groups.setdefault(root[p], []).append(r)
            want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
            assert sorted(got, key=key) == sorted(want, key=key) and len(want) < len(rows)
        elif name == "decontamination":
            bad = {d for d, _ in brute_decontam([r[:2] for r in rows], items)}
            assert bad and sorted(got, key=key) == sorted((r for r in rows if r[0] not in bad), key=key)
        elif name == "pii":
            hide = lambda t: t if t is None else re.sub(PLAIN["email"], "<email>", t)
            want = [(r[0], hide(r[1]), r[2], r[3], None if r[1] is None else len(hide(r[1]))) for r in rows]
            assert sorted(got, key=key) == sorted(want, key=key) and any("<email>" in (r[1] or "") for r in got)
        else:
            ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = {r[0]: library.encode_ordinary(r[1] or "") for r in rows}
            assert len(got) == len(rows)
            for r in out.collect():
                assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] and r.n_tokens == len(want[r.doc_id]) and r.round_trip
        now = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == {r.doc_id for r in now.select("doc_id").collect()}


def test_equal_ids_are_one_document(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "q r s t u v"), (None, "x y z")], "doc_id long, text string")
    assert sorted(map(str, one_of_each(df).collect())) == sorted(map(str, df.distinct().collect()))


ODD = ("score", "_score", "place", "_place", "fp", "_fp", "key", "_bad", "found", "id", "component_id", "spans", "text_sha256", "ids", "decoded", "Score", "n")


def test_clashing_columns_come_through(spark, write_tables):
    docs, labels, items = corpus()
    odd = [c for c in ODD if c != "Score"]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *(F.concat(F.lit("mine "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in odd))
    folder = write_tables(
        documents=df,
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("score", F.lit(1)).withColumn("text", F.lit("x")),
        benchmark=spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7)).withColumn("words", F.lit("y")),
    )
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == now.columns
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        rows = now.collect()
        assert rows and all(r[c] == f"mine {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in odd)
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).filter("round_trip").count() == len(rows)


def test_empty_tables(spark, write_tables):
    docs, labels, items = corpus()
    d = spark.createDataFrame(docs[:30], "doc_id long, text string, lang string, source string, n_chars long")
    few = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert corpus_pipeline.run(spark, write_tables(documents=d.limit(0), labels=few, benchmark=b)).count() == 0
    left = corpus_pipeline.run(spark, write_tables(documents=d, labels=few.limit(0), benchmark=b.limit(0)))
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in one_of_each(d).collect()}


def test_rows_without_an_id_are_judged_by_their_texts(spark, write_tables):
    docs, _, items = corpus()
    rows = [(None, items[0][1], "en", "s", 1), (None, "alone without any name " * 3, "en", "s", 1), (None, None, "en", "s", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = write_tables(benchmark=spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r.text) for r in corpus_pipeline.drop_contaminated(spark, d, folder).collect()) == ["None", "alone without any name " * 3]

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from evidentia.llm import bpe
from evidentia.llm.queries import op1_bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(5)
    some = ["", " ", "\n", "a", "  a", "a  b", "a   b", "a \n b", "it's we'll", "<|endoftext|>", "é漢😀", "x" * 4000, "ab" * 900, "!" * 700]
    return some + ["".join(rng.choice("abe'st  \n\t 　é漢😀0١9.,!-\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(800)]


def test_encoder_equals_library():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text, packed in zip(texts(), encoder.encode(texts()), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_one_tree_equals_rows_of_trees():
    rng, encoder = random.Random(1), bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    pieces = [bytes(rng.choice(b"abcdeinorst \xc3\xa9") for _ in range(rng.randint(2, 33))) for _ in range(500)]
    got = bpe.merge_many(pieces, encoder.byte_ids, encoder.pairs, 32)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [bpe.merge(p, RANKS) for p in pieces]


def test_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in texts()[:200]:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_query(spark, write_tables):
    rows = [(i, t, "x") for i, t in enumerate([*texts()[:60], None, "a b", "a b"])]
    got = {r.doc_id: r for r in op1_bpe(spark, write_tables(documents=spark.createDataFrame(rows, "doc_id long, text string, ids string"))).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_operator_keeps_columns_and_handles_empty_table(spark):
    df = spark.createDataFrame([(None, "hello world", 1.5)], "doc_id long, text string, ids double")
    out = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "ids"]
    assert out.select(bpe.ids_array(out.ids).alias("a")).first().a == LIBRARY.encode_ordinary("hello world")
    assert bpe.decode(out.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("text", ["", None])
def test_nothing_to_encode(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).first()
    assert (bytes(row.ids), bytes(row.decoded)) == (b"", b"")

"""Queries of the subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import ann, bpe, chat, decontam, langid, mixture, phrases, pii, resample, secrets, simhash, toxicity, urls
from evidentia.llm.common import held_out, read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    ranks = bpe.load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, tokenizers.PATTERN, drop=["text"])
    return bpe.decode(ids, ranks).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    return found.select("doc_id", *pii.digest(F.col("pii")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), toxicity.is_training())
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Given rules: host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of low quality are the bad ones to learn from."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("bad"))
    return urls.judge(read(spark, sf_dir, "pages"), labels, URL_RULES)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.render(rows.unionByName(own)))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    samples = langid.fit(docs, langid.is_training())
    out = langid.predict(docs.select("doc_id", "text"), samples)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents")).select("doc_id", *secrets.digest(F.col("found")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best(phrases.collocations(read(spark, sf_dir, "documents")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), longest=1)


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_urls": op4_urls,
    "op5_chat": op5_chat,
    "op6_langid": op6_langid,
    "op7_ann": op7_ann,
    "op8_decontam": op8_decontam,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
    "op11_phrases": op11_phrases,
    "op12_resample": op12_resample,
    "op13_mixture": op13_mixture,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op5_chat": chat.ORACLE,
    "op7_ann": ann.ORACLE,
    "op8_decontam": decontam.ORACLE,
    "op9_secrets": secrets.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op12_resample": resample.ORACLE,
    "op13_mixture": mixture.ORACLE,
}

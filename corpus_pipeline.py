"""A training corpus from raw documents: five stages over the operators of ``evidentia.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
Defined results: null texts are kept by the filters as empty ones are, and one of them by
near-dedup; a row without an id is judged by its text alone; texts of any length are worked on
whole; further columns of the documents come through all stages but the last unchanged, whatever
their names; without labels nothing is rejected as toxic, without a benchmark nothing as
contaminated, and of empty documents nothing comes out. See the operators for ties and repeated
rows.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, decontam, pii, simhash, toxicity
from evidentia.llm.common import cut_lineage, fresh, read, ship

#: Documents of this score and above are rejected.
TOXIC = 0.3


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject; it learns from the labels as the query does."""
    (score,) = fresh(docs, "score")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), toxicity.is_training())
    return toxicity.score(docs, model, out_col=score).filter(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    ship(spark)
    return simhash.one_of_each(docs)


def identity() -> Column:
    """The id as text; of a row without one, the digest of its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    (key,) = fresh(docs, "key")
    found = decontam.contaminated(docs.select(identity().alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    bad = cut_lineage(found.select(F.col("doc_id").alias(key)).distinct())
    return docs.withColumn(key, identity()).join(bad, key, "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    ship(spark)
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as packed token ids, with whether decoding gives the text back."""
    ship(spark)
    ranks = bpe.load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = docs.select("doc_id", "lang", "source", "n_chars", "text")
    summed = own.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    ids = bpe.encode(summed, ranks, tokenizers.PATTERN, drop=["text"])
    out = bpe.decode(ids, ranks, out_col="decoded")
    return out.select("doc_id", "lang", "source", "n_chars", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("toxicity", keep_civil),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", tokenise),
]

#: SQL can express neither the toxicity model nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next, and go when the one after is written."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Texts that describe expressions, and their vectors: words hashed into buckets, no model needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import words_of


def description(about: Column, topic: Column, group: Column, regime: Column, approximations: Column) -> Column:
    """Sentences on what an expression is; what is null, blank or the topic "other" is left out."""
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    said = lambda c, before, after: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(before), plain(c) if before[:1] != "V" and before[:1] != "A" else c, F.lit(after)))
    named = F.when(topic != "other", topic)
    return F.concat_ws(" ", F.when(F.trim(about) != "", about), said(named, "This formula predicts the ", "."), said(group, "Derived in the ", " approach."), said(regime, "Valid in the ", " regime."), said(approximations, "Approximations: ", "."))


def bucket(word: Column, dims: int) -> Column:
    """A word's bucket, from the first four digits of its digest."""
    return (F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("int") % dims).cast("int")


def word_vectors(df: DataFrame, item: str, text: str, dims: int = 64) -> DataFrame:
    """(item, vector): counts of words by bucket, of length one; rows without words have none."""
    words = df.select(item, F.explode(words_of(F.col(text))).alias("_w"))
    counts = words.select(item, bucket(F.col("_w"), dims).alias("_b")).groupBy(item, "_b").agg(F.count("*").cast("double").alias("_n"))
    cells = counts.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_m"), F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_s"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)) / F.col("_s"))
    return cells.select(item, vector.alias("vector"))


def like_each_other(df: DataFrame, item: str, text: str, low: float, dims: int = 64) -> DataFrame:
    """Pairs (item_a, item_b, cosine) of texts whose word vectors have a cosine of ``low`` or more."""
    from evidentia.operators.graphs import cut_lineage
    from evidentia.operators.vectors import similar_pairs

    # Vectors are read more than once.
    return similar_pairs(cut_lineage(word_vectors(df, item, text, dims)), item, "vector", low)

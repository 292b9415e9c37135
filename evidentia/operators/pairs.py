"""Pair joins between items of competing groups, and lookups that are joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators import strings


def cross_group_pairs(df: DataFrame, item: str, group: str, topic: Sequence[str], same_group: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs of items of one topic, smaller id first, of different groups unless ``same_group``.

    An equi-join on the topic; the order of ids and the groups are its residual condition.
    """
    side = lambda s: df.select(*topic, F.col(item).alias(f"{item}_{s}"), F.col(group).alias(f"{group}_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in keep))
    pairs = side("a").join(side("b"), list(topic)).filter(F.col(f"{item}_a") < F.col(f"{item}_b"))
    return pairs if same_group else pairs.filter(F.col(f"{group}_a") != F.col(f"{group}_b"))


def group_pairs(df: DataFrame, group: str) -> DataFrame:
    """Unordered pairs of distinct groups; meant for dimension tables."""
    names = df.select(group).distinct()
    return names.select(F.col(group).alias("a")).join(names.select(F.col(group).alias("b")), F.col("a") < F.col("b"))


def without_edges(pairs: DataFrame, edges: DataFrame, a: str, b: str, source: str, target: str) -> DataFrame:
    """Pairs that no edge joins in either direction."""
    both = edges.select(F.col(source).alias(a), F.col(target).alias(b)).unionAll(edges.select(F.col(target).alias(a), F.col(source).alias(b))).distinct()
    return pairs.join(both, [a, b], "left_anti")


def unprocessed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not among those processed."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def last_before(events: DataFrame, by: Sequence[str], order: Sequence[str], is_heading: Column, value: Column, default: str = "preamble") -> DataFrame:
    """As-of lookup: ``section`` is the value of the last heading at or before a row. One sort within the key, no range join."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("section", F.coalesce(F.last(F.when(is_heading, value), ignorenulls=True).over(w), F.lit(default)))


def contained_keys(keys: DataFrame, items: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of both tables where the key occurs in the name or the name's last path part in the key; by an index of grams, not by all pairs."""
    last = F.substring_index(name, "/", -1)
    parts = items.select(F.col(name), last.alias("_last")).distinct()
    within = strings.contained(parts, keys, "_last", key).join(parts, "_last").select(key, name)
    found = strings.contained(keys, items, key, name).unionByName(within).distinct()
    return keys.join(found, key).join(items, name)


def class_of(members: str) -> Column:
    """What sets of equal members have in common: the sorted members, comma-joined."""
    return F.array_join(F.array_sort(members), ",")


def set_classes(df: DataFrame, item: str, members: str) -> DataFrame:
    """(class, members, n): the distinct sets and how many items have each."""
    return df.groupBy(class_of(members).alias("class")).agg(F.first(members).alias("members"), F.count(item).alias("n"))


def overlapping_sets(df: DataFrame, item: str, members: str) -> DataFrame:
    """Ordered pairs (item_a, item_b) whose sets share a member while a's set is not within b's.

    The shared member is the join key, so only pairs that overlap are ever formed.
    """
    each = df.select(F.col(item), F.col(members), F.explode(members).alias("_m"))
    a = each.select(F.col(item).alias(f"{item}_a"), F.col(members).alias("_a"), "_m")
    b = each.select(F.col(item).alias(f"{item}_b"), F.col(members).alias("_b"), "_m")
    met = a.join(b, "_m").filter(F.col(f"{item}_a") != F.col(f"{item}_b"))
    return met.filter(F.size(F.array_except("_a", "_b")) > 0).select(f"{item}_a", f"{item}_b").distinct()


def recall(known: DataFrame, found: DataFrame, known_id: str, tags: str, keywords: str, text: str, least_hits: int = 2) -> DataFrame:
    """``known`` with ``hit``: some found row shares a tag and has ``least_hits`` keywords in its text. The shared tag is the join key."""
    k = known.select(known_id, F.col(keywords).alias("_kw"), F.explode(tags).alias("_tag"))
    f = found.select(F.col(text).alias("_text"), F.explode(tags).alias("_tag"))
    low = F.lower("_text")
    hits = F.size(F.filter("_kw", lambda w: low.contains(F.lower(w))))
    met = k.join(f, "_tag").filter(hits >= least_hits).select(known_id).distinct().withColumn("hit", F.lit(True))
    return known.join(met, known_id, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

"""Consensus, coverage, shared items, convergence and obstacles over (item, group, topic)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.scans import placed

#: A group agrees if its mean is within this share of the overall mean.
TOLERANCE = 0.1


def topics_by_groups(df: DataFrame, topic: str, group: str, least: int) -> DataFrame:
    """(topic, n_groups) of topics that at least ``least`` distinct groups cover."""
    return df.groupBy(topic).agg(F.countDistinct(group).alias("n_groups")).filter(F.col("n_groups") >= least)


def duplicate_clusters(df: DataFrame, content: Column, item: str, group: str, rank: str | None = None) -> DataFrame:
    """Clusters of items of equal content, two or more: size, distinct groups and the canonical item, of highest ``rank``, then smallest id."""
    best = F.max_by(item, F.struct(F.col(rank), -F.col(item))) if rank else F.min(item)
    out = df.withColumn("_key", F.sha2(content, 256)).groupBy("_key").agg(F.count("*").alias("size"), F.countDistinct(group).alias("n_groups"), best.alias("canonical"))
    return out.filter("size >= 2").select("canonical", "size", "n_groups", (F.col("n_groups") >= 2).alias("cross_group"))


def consensus(df: DataFrame, topic: str, group: str, value: str, tolerance: float = TOLERANCE, universal_at: int = 3) -> DataFrame:
    """Per topic: overall mean, population deviation, relative spread, groups that agree or not, and whether all of three or more agree."""
    groups = df.groupBy(topic, group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"), F.sum(F.col(value) * F.col(value)).alias("_q")).filter("_n > 0")
    mean = F.sum("_s") / F.sum("_n")
    totals = groups.groupBy(topic).agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum("_q") / F.sum("_n") - mean * mean, F.lit(0.0))).alias("std"))
    each = groups.join(totals, topic).withColumn("agrees", F.abs(F.col("_s") / F.col("_n") - F.col("mean")) / F.greatest(F.abs("mean"), F.lit(1e-30)) < tolerance)
    told = each.groupBy(topic).agg(F.count_if("agrees").alias("n_agree"), F.count_if(~F.col("agrees")).alias("n_disagree"))
    out = totals.join(told, topic)
    return out.withColumn("rel_spread", F.try_divide(F.col("std"), F.abs("mean"))).withColumn("universal", (F.col("n_disagree") == 0) & (F.col("n_agree") >= universal_at))


def disagreement(out: DataFrame) -> DataFrame:
    """Topics of ``consensus`` with disagreement, and how significant it is: the share of groups that agree."""
    return out.filter("n_disagree > 0").withColumn("significance", F.col("n_agree") / (F.col("n_agree") + F.col("n_disagree")))


def comparison_table(df: DataFrame, topic: str, group: str, value: str, order: str, tolerance: float = TOLERANCE, universal_at: int = 3) -> DataFrame:
    """Per topic: each group's first value by ``order``, their spread, and how many agree; all do if the spread is within tolerance."""
    firsts = df.filter(F.col(value).isNotNull()).groupBy(topic, group).agg(F.min_by(value, order).alias("_v"))
    totals = firsts.groupBy(topic).agg(F.count("*").alias("n_groups"), F.avg("_v").alias("mean"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    near = F.coalesce(F.try_divide(F.abs(F.col("_v") - F.col("mean")), F.abs("mean")) < tolerance, F.lit(False))
    out = totals.join(firsts.join(totals, topic).groupBy(topic).agg(F.count_if(near).alias("_near")), topic)
    out = out.withColumn("spread", F.try_divide(F.col("high") - F.col("low"), F.abs("mean")))
    close = F.coalesce(F.col("spread") < tolerance, F.lit(False))
    out = out.withColumn("n_agree", F.when(close, F.col("n_groups")).otherwise(F.col("_near"))).drop("_near")
    return out.withColumn("universal", (F.col("n_agree") == F.col("n_groups")) & (F.col("n_groups") >= universal_at))


#: Groups whose names meet a topic at once.
GROUPS = 1000


def coverage_gaps(df: DataFrame, topic: str, group: str) -> DataFrame:
    """Per topic that some but not all groups cover: the share as text, and the groups that lack it, sorted.

    Names of groups meet the topics in lists of about GROUPS, however many there are.
    """
    universe = df.select(group).distinct()
    total = universe.count()
    lists = max(1, -(-total // GROUPS))
    names = universe.groupBy(F.pmod(F.xxhash64(group), F.lit(lists)).alias("_list")).agg(F.collect_set(group).alias("_names"))
    have = df.groupBy(topic).agg(F.collect_set(group).alias("_have")).filter((F.size("_have") > 0) & (F.size("_have") < total))
    met = have.withColumn("_list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long")))).join(names, "_list")
    gaps = met.groupBy(topic).agg(F.array_sort(F.flatten(F.collect_list(F.array_except("_names", "_have")))).alias("_gap"), F.max(F.size("_have")).alias("_k"))
    return gaps.select(topic, F.concat_ws("/", F.col("_k").cast("string"), F.lit(str(total))).alias("coverage"), F.array_join("_gap", ",").alias("missing"))


#: Bits of one of Spark's bitmaps.
BITS = 32_768


def gap_rows(df: DataFrame, topic: str, group: str) -> DataFrame:
    """(topic, group): a row for each group that lacks a topic.

    Groups are numbered, so what a topic has is a bitmap for each BITS groups, put together before the
    shuffle; the bits that are not set become names again. Nulls are neither topics nor groups, but a
    topic that only the null group has is lacked by all.
    """
    groups = placed(df.select(group).filter(F.col(group).isNotNull()).distinct(), [group])
    total = groups.count()
    topics = df.filter(F.col(topic).isNotNull())
    numbered = topics.join(groups, group).select(topic, F.bitmap_bucket_number("place").alias("_list"), F.bitmap_bit_position("place").alias("_bit"))
    held = numbered.groupBy(topic, "_list").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    lists = F.sequence(F.lit(1).cast("long"), F.lit(max(1, -(-total // BITS))).cast("long"))
    every = topics.select(topic).distinct().withColumn("_list", F.explode(lists)).join(held, [topic, "_list"], "left")
    byte = lambda at: F.conv(F.hex(F.call_function("substring", F.col("_map"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = lambda at: F.coalesce(F.call_function("getbit", byte(at), at.bitwiseAND(F.lit(7))), F.lit(0).cast("byte")) == 1
    last = F.least(F.lit(BITS), F.lit(total) - (F.col("_list") - 1) * BITS).cast("int") - 1
    free = F.filter(F.sequence(F.lit(0), last), lambda at: ~is_set(at))
    each = every.filter(F.lit(total > 0)).select(topic, "_list", F.explode(free).alias("_bit"))
    lacked = each.select(topic, ((F.col("_list") - 1) * BITS + F.col("_bit") + 1).cast("int").alias("place"))
    return lacked.join(groups, "place").select(topic, group)


def shared_items(df: DataFrame, text: str, group: str, share: float = 0.8, least: int = 2) -> DataFrame:
    """Items, alike but for case and surrounding blanks, that ``max(least, int(share * groups))`` groups have; the longest original stands for them."""
    n = df.agg(F.greatest(F.floor(F.countDistinct(group) * share), F.lit(least)).alias("_need"))
    items = df.groupBy(F.lower(F.trim(F.col(text))).alias("item")).agg(F.countDistinct(group).alias("n_groups"), F.max(F.struct(F.length(text), F.col(text)))[text].alias("original"))
    return items.join(F.broadcast(n), F.col("n_groups") >= F.col("_need")).drop("_need")


def common_to_all(df: DataFrame, group: str, member: str) -> DataFrame:
    """Members that every group has: relational division by counting."""
    pairs = df.select(group, member).distinct()
    n = pairs.agg(F.countDistinct(group).alias("_groups"))
    return pairs.groupBy(member).agg(F.count("*").alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_groups")).select(member)


def convergence(df: DataFrame, topic: Sequence[str], group: str, premises: DataFrame, premise: str) -> DataFrame:
    """Topics that two or more groups reach: groups, premises all of them share, strength.

    ``premises`` has (group, premise). Strong: four or more without a shared premise; moderate: three or more; else weak.
    """
    reached = df.select(*topic, group).distinct()
    n = reached.groupBy(*topic).agg(F.count("*").alias("n_groups")).filter("n_groups >= 2")
    held = reached.join(premises.select(group, premise).distinct(), group).groupBy(*topic, premise).agg(F.count("*").alias("_n"))
    shared = held.join(n, list(topic)).filter("_n = n_groups").groupBy(*topic).agg(F.count("*").alias("n_shared"))
    out = n.join(shared, list(topic), "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0).cast("long")))
    strength = F.when((F.col("n_groups") >= 4) & (F.col("n_shared") == 0), "strong").when(F.col("n_groups") >= 3, "moderate").otherwise("weak")
    return out.withColumn("strength", strength)


def mark_spread(df: DataFrame, kind: str, group: str, least: int) -> DataFrame:
    """``df`` with ``is_universal``: whether at least ``least`` groups have rows of the row's kind."""
    wide = df.groupBy(kind).agg(F.countDistinct(group).alias("_n")).select(kind, (F.col("_n") >= least).alias("is_universal"))
    return df.join(wide, kind)


def members_of(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, members): the distinct members of each group, sorted."""
    return df.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members"))


def presence_matrix(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """One row per ``row``; a column per value, 1 where present, else 0. Values are given, so that no extra pass looks for them."""
    marks = [F.max(F.when(F.col(column) == v, 1).otherwise(0)).alias(v) for v in values]
    return df.groupBy(row).agg(*marks)


def pair_severity(df: DataFrame, a: str, b: str, severity: str, levels: Sequence[str], order: str, text: str) -> DataFrame:
    """Per unordered pair: worst severity (``levels`` from mild to grave), count and first text by ``order``."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, levels)), F.col(severity)), F.lit(0))
    pair = df.withColumn("a", F.least(a, b)).withColumn("b", F.greatest(a, b)).withColumn("_rank", rank)
    out = pair.groupBy("a", "b").agg(F.max("_rank").alias("_rank"), F.count("*").alias("n"), F.min_by(text, order).alias("first_text"))
    return out.select("a", "b", F.get(F.array(*map(F.lit, levels)), (F.col("_rank") - 1).cast("int")).alias("severity"), "n", "first_text")

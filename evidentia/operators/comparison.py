"""Comparison of expressions across groups, and what follows from it: novel matches, droppable premises, what sets a success apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import expressions as E
from evidentia.operators import pairs, ranking, strings
from evidentia.operators.graphs import cut_lineage, join_counted

#: Kinds of expressions that are compared with all, and within one topic.
ALL_KINDS, PREDICTED = ("prediction", "correction", "key_equation", "mapping"), ("prediction", "correction")


def scores(a: Column, b: Column, topic_a: Column, topic_b: Column, dimensions: dict[str, str] | None = None) -> dict[str, Column]:
    """Scores of a pair by level; a level that says nothing is null."""
    known = ranking.TOPIC_DIMENSIONS if dimensions is None else dimensions
    return {
        "structural": E.udf(E.structural_score, "double")(a, b),
        "dimensional": ranking.dimension_score(topic_a, topic_b, known),
        "numerical": E.udf(E.agreement, "double")(a, b),
        "limit": E.udf(E.limit_score, "double")(a, b),
    }


def compare_all(df: DataFrame, item: str, group: str, topic: str, expression: str, kind: str | None = None, least: float = 0.3, other: str = "other", other_least: float = 0.7, same_group: bool = False, kinds: Sequence[str] = ALL_KINDS) -> DataFrame:
    """(topic, item_a, item_b, levels, score, label) of pairs within a topic, best first.

    Pairs of a named topic are scored on all levels and kept from ``least`` on; of the topic
    ``other``, whose items may be of any sort, by structure alone from ``other_least`` on. Items
    of further kinds are left out before pairs are made.
    """
    rows = df.filter(F.col(kind).isin(list(kinds))) if kind else df
    found = pairs.cross_group_pairs(rows, item, group, [topic], same_group, keep=[expression])
    a, b, names = F.col(f"{expression}_a"), F.col(f"{expression}_b"), ("structural", "dimensional", "numerical", "limit")
    ids = [topic, f"{item}_a", f"{item}_b"]
    named = found.filter(F.col(topic) != other).select(*ids, *(c.alias(k) for k, c in scores(a, b, F.col(topic), F.col(topic)).items()))
    named = named.withColumn("score", ranking.weighted_mean({k: F.col(k) for k in names})).filter(F.col("score") >= least).withColumn("label", ranking.match_label(F.col("score")))
    rest = found.filter(F.col(topic) == other).select(*ids, E.udf(E.structural_score, "double")(a, b).alias("structural"))
    none = [F.lit(None).cast("double").alias(k) for k in names[1:]]
    rest = rest.filter(F.col("structural") >= other_least).select(*ids, "structural", *none, F.col("structural").alias("score"), F.lit("structural").alias("label"))
    return named.unionByName(rest).orderBy(F.desc("score"), f"{item}_a", f"{item}_b")


def compare_topic(df: DataFrame, item: str, group: str, topic: str, expression: str, kind: str, wanted: str, least: float = 0.3) -> DataFrame:
    """The same for predictions and corrections of one topic."""
    return compare_all(df.filter(F.col(topic) == wanted), item, group, topic, expression, kind, least, other="", kinds=PREDICTED)


def novel_matches(matches: DataFrame, items: DataFrame, citations: DataFrame, item: str, paper: str, group: str) -> DataFrame:
    """Matches (item_a, item_b, score) of different groups whose papers don't cite each other, the best of each pair of papers, best first.

    ``items`` has (item, paper, group); ``citations`` has (src, dst). Matches of items without a paper go.
    """
    side = lambda s: items.select(F.col(item).alias(f"{item}_{s}"), F.col(paper).alias(f"paper_{s}"), F.col(group).alias(f"group_{s}"))
    return best_of_papers(matches.join(side("a"), f"{item}_a").join(side("b"), f"{item}_b"), citations, item)


def novel_topic_matches(items: DataFrame, citations: DataFrame, item: str, paper: str, group: str, topic: Sequence[str], score: Column) -> DataFrame:
    """The same rows where all items of one topic match, with a ``score`` that follows from the topic's columns; without forming all of a topic's pairs."""
    firsts = cut_lineage(first_items(items, item, paper, group, topic))
    side = lambda s: firsts.select(*topic, F.col(item).alias(f"{item}_{s}"), F.col(paper).alias(f"paper_{s}"), F.col(group).alias(f"group_{s}"))
    met = side("a").join(side("b"), list(topic)).filter(F.col(f"{item}_a") < F.col(f"{item}_b"))
    return best_of_papers(met.withColumn("score", score), citations, item)


def first_items(items: DataFrame, item: str, paper: str, group: str, topic: Sequence[str]) -> DataFrame:
    """Items (topic, item, paper, group) of which the first pair (smaller item first) of any two papers in a topic is made, if groups and items must differ.

    A pair comes no later if one side gives way to the paper's first item that still differs from
    the other. So of each paper its first item is enough, with its first of another group; only if
    an item stands in several rows of a topic, the first ones of another item are needed too.
    """
    of = [*topic, paper]
    rows = items.select(*of, group, item).filter(" and ".join(f"{c} is not null" for c in (*of, group, item)))
    some = cut_lineage(rows.groupBy(*of, group).agg(F.min(item).alias(item)))
    repeated = not some.groupBy(*topic, item).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty()
    if repeated:
        later = rows.join(some.withColumnRenamed(item, "_i"), [*of, group]).filter(F.col(item) > F.col("_i")).groupBy(*of, group).agg(F.min(item).alias(item))
        some = cut_lineage(some.unionByName(later))
    one = F.struct(F.col(item).alias("i"), F.col(group).alias("g"))
    least = lambda name, ok: F.min(F.when(ok, one)).alias(name)
    other_group, other_item = lambda y: F.col(group) != F.col(f"{y}.g"), lambda y: F.col(item) != F.col(f"{y}.i")
    kept = some.groupBy(*of).agg(F.min(one).alias("_1"))
    kept = some.join(kept, of).groupBy(*of).agg(F.first("_1").alias("_1"), least("_2", other_group("_1")), least("_3", other_item("_1")))
    names = ["_1", "_2"]
    if repeated:
        kept = some.join(kept, of).groupBy(*of).agg(*(F.first(y).alias(y) for y in ("_1", "_2", "_3")), least("_4", other_group("_1") & other_item("_2")), least("_5", other_item("_1") & other_group("_3")))
        names += ["_3", "_4", "_5"]
    each = kept.select(*of, F.explode(F.array_distinct(F.array_compact(F.array(*names)))).alias("_y"))
    return each.select(*of, F.col("_y.i").alias(item), F.col("_y.g").alias(group))


def best_of_papers(rows: DataFrame, citations: DataFrame, item: str) -> DataFrame:
    """Of matches with papers and groups, those of different groups whose papers don't cite each other, the best of each pair of papers, best first.

    The best score comes first, by partial maxima, so that only matches that have it are sorted.
    """
    ids = [f"{item}_a", f"{item}_b"]
    rows = rows.filter("group_a <> group_b and paper_a is not null and paper_b is not null")
    rows = rows.select(F.struct(F.least("paper_a", "paper_b").alias("low"), F.greatest("paper_a", "paper_b").alias("high")).alias("_pair"), "score", *ids, "group_a", "group_b")
    best = cut_lineage(rows.groupBy("_pair").agg(F.max("score").alias("_best"), F.count("*").alias("_n")))
    near = join_counted(rows, best, "_pair", "_n").filter(F.col("score").eqNullSafe(F.col("_best")))
    out = near.groupBy("_pair", "score").agg(F.min(F.struct(*ids, "group_a", "group_b")).alias("_first")).select("_pair.low", "_pair.high", "score", "_first.*")
    cited = citations.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).distinct()
    out = out.join(cited, ["low", "high"], "left_anti")
    return out.select(*ids, "group_a", "group_b", F.col("low").alias("paper_low"), F.col("high").alias("paper_high"), "score").orderBy(F.desc("score"), *ids)


def droppable(df: DataFrame, text: str, status: str, score: str, least: float = 0.3, most: int = 10) -> DataFrame:
    """The ``most`` premises that are not verified and score above ``least``, best first; their number is that of a report's list."""
    found = df.filter(~F.col(status).eqNullSafe(F.lit("verified")) & (F.col(score) > least))
    return found.orderBy(F.desc(score), text).limit(most)


def obstacles_of(found: DataFrame, text: str, score: str, dropped: str) -> DataFrame:
    """Obstacle rows for droppable premises."""
    means = F.concat(F.lit("Droppability: "), F.format_number(score, 2), F.lit(". "), F.coalesce(F.col(dropped), F.lit("")))
    return found.select(F.lit("all").alias("theory_slug"), F.lit("shared_assumption").alias("obstacle_type"), F.col(text).alias("description"), F.lit(True).alias("is_universal"), means.alias("what_it_might_mean"))


def success_differential(df: DataFrame, group: str, text: str, success: str) -> DataFrame:
    """(text, side): premises of all groups but the successful one that it lacks (dropped), has too (shared), and its own that are not common to the others (unique)."""
    held = df.select(group, text).distinct()
    failed = held.filter(F.col(group) != success)
    n = failed.select(group).distinct().agg(F.count("*").alias("_n"))
    common = failed.groupBy(text).agg(F.count("*").alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).select(text, F.lit(True).alias("_common"))
    own = held.filter(F.col(group) == success).select(text, F.lit(True).alias("_own"))
    side = F.when(F.col("_own").isNull(), "dropped").when(F.col("_common").isNull(), "unique").otherwise("shared")
    return common.join(own, text, "full").select(text, side.alias("side"))


def recall_metric(hits: DataFrame, hit: str = "hit") -> DataFrame:
    """(found, total, recall) of rows with a flag."""
    n = F.count_if(F.col(hit))
    return hits.agg(n.alias("found"), F.count("*").alias("total"), F.try_divide(n, F.count("*")).alias("recall"))


def claimed(pairs_: DataFrame, claims: DataFrame, members: str, said: str, least: float = 0.5) -> DataFrame:
    """``pairs_`` (id, members array, text ``said``) with ``known``: some claim (a, b, description) is of two of the members, and over ``least`` of the shorter one's words are shared."""
    from evidentia.functions import text as X

    each = pairs_.select("id", F.explode(members).alias("a"), members, said)
    met = each.join(claims.select(F.col("a"), F.col("b"), F.col("description")), "a").filter(F.array_contains(members, F.col("b")))
    met = met.filter(F.coalesce(X.overlap(X.content_words(F.col(said)), X.content_words(F.col("description"))), F.lit(0.0)) > least)
    return pairs_.join(met.select("id").distinct().withColumn("known", F.lit(True)), "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def first_containing(asked: DataFrame, items: DataFrame, key: str, text: str, item: str, name: str) -> DataFrame:
    """(key, item): for each text the first item whose name contains it or is contained in it, but for case; texts without any are absent."""
    firsts = items.groupBy(F.lower(name).alias("_name")).agg(F.min(item).alias("_item"))
    said = asked.select(F.col(key), F.lower(text).alias("_said"))
    best = strings.substring_join(said, firsts, "_said", "_name").join(firsts, "_name").groupBy("_said").agg(F.min("_item").alias("_item"))
    return said.join(best, "_said").groupBy(key).agg(F.min("_item").alias(item))


def verified_conjectures(conjectures: DataFrame, flags: DataFrame, key: str = "id") -> DataFrame:
    """``conjectures`` with the flags (key, algebraic_verified, numerical_verified, dimensional_verified, counterexample_found, is_novel) that are known written in, and the status that follows."""
    from evidentia.operators.scans import sparse_update

    out = sparse_update(conjectures, flags, key)
    names = ("algebraic_verified", "numerical_verified", "dimensional_verified", "counterexample_found", "is_novel")
    return out.withColumn("status", ranking.status(*(F.col(c) for c in names)))

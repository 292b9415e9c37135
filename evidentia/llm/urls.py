"""URL filters: given rules first, then association rules mined from labels.

A URL becomes a set of tokens: labels of its host and their hyphenated parts, segments of its
path with digits masked, names of its query's parameters. A set of tokens is a rule if its pages
are bad often enough: by confidence, as a multiple of the share of bad pages among all labelled
ones, and by the likelihood ratio, so that chance makes no rules. Of these, sets that hold another
rule's add nothing and go. Rules are indexed by their rarest token: a page meets a rule only
through that token, and matches if it has all others. Equal token sets are matched once.

FP-growth finds the sets that are frequent among bad pages. It sees no more than it must, as
the sets double with each token that pages share: tokens that occur in the very same labelled
pages are one class, of which a rule needs one, whichever it is; classes that are rules by
themselves, and those of all labelled pages, can be in no wider rule; and a set has to be in as
many bad pages as would be significant if it were in no others. None of this loses a rule.

Only DataFrame operations, and the ML library's FP-growth. Defined results: a null URL, or
one without "://", has an empty host and path and no tokens; without bad labels, or without
others, no rule is mined and the method allows; contradicting labels of an id count as bad;
repeated rows get equal verdicts; URLs of any length are read whole; columns named like those
made here do not disturb; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import functools
import math
import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage

#: Share of the bad pages, and number of them, that a rule's tokens must occur in together.
MIN_SUPPORT, MIN_PAGES = 0.01, 5
#: How many times likelier than any labelled page a rule's page must be bad, and the likelihood ratio statistic at least.
MIN_LIFT, SIGNIFICANT = 2.0, 20.0

Rule = tuple[str, str, str]  # host, path, verdict


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """What follows the first "://" up to a slash, question mark or hash, with A-Z lower-cased."""
    raw = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens, sorted; none where the URL has no host."""
    full, labels = host(url), F.split(host(url), r"\.")
    parts = F.array_except(F.filter(F.split(full, r"[.-]"), lambda x: x != ""), labels)
    segments = F.filter(F.split(path(url), "[/.]"), lambda x: x != "")
    query = F.regexp_extract(after_scheme(url), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    masked = F.transform(segments, lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    every = F.concat(named("host:", labels), named("part:", parts), named("path:", masked), named("query:", keys))
    return F.when(full == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def fits(rule: Rule, full: Column, rest: Column) -> Column:
    return ((full == rule[0]) | full.endswith("." + rule[0])) & rest.startswith(rule[1])


def by_rules(rules: Sequence[Rule], full: Column, rest: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, nulls where none does; of equally long ones the first given."""
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    pick = lambda what: functools.reduce(lambda rest_, r: F.when(fits(r, full, rest), what(r)).otherwise(rest_), reversed(ranked), F.lit(None).cast("string"))
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def match(sets: DataFrame, rules: DataFrame, *keep: str) -> DataFrame:
    """(key, rule), and the columns ``keep`` of ``sets``, of every rule (rule, anchors, items) of whose classes ``items`` a set (key, items) has a token each; once for each of ``anchors``, the rarest class, that the set has."""
    index = rules.select("rule", F.explode("anchors").alias("anchor"), F.col("items").alias("wanted"))
    met = sets.select("key", "items", *keep, F.explode("items").alias("anchor")).join(index, "anchor")
    return met.filter(F.forall("wanted", lambda tokens_: F.arrays_overlap(tokens_, "items"))).select("key", "rule", *keep)


def likelihood_ratio(n: Column, bad: Column, total: int, guilty: int) -> Column:
    """Of ``n`` pages with ``bad`` bad ones, against those of all ``total``."""
    cells = ((bad, n * (guilty / total)), (n - bad, n * (1 - guilty / total)), (guilty - bad, (total - n) * (guilty / total)), (total - n - guilty + bad, (total - n) * (1 - guilty / total)))
    return 2 * functools.reduce(Column.__add__, (F.when(seen > 0.5, seen * F.ln(seen / due)).otherwise(0.0) for seen, due in cells))


def fewest(least: int, total: int, guilty: int, significant: float) -> int:
    """Bad pages, ``least`` or more, that a set must be in to be significant even if it is in no others; over ``guilty`` if none suffice."""

    def ratio(k: int) -> float:
        cells = ((k, k * guilty / total), (guilty - k, (total - k) * guilty / total), (total - guilty, (total - k) * (1 - guilty / total)))
        return 2 * math.fsum(seen * math.log(seen / due) for seen, due in cells if seen)

    ks = range(least, guilty + 1)
    return least + bisect.bisect_left(ks, significant - 1e-9, key=ratio)


def classes(sets: DataFrame, least: int) -> DataFrame:
    """(token, tokens, n, bad) of tokens of one and the same sets (key, items, n, bad), the first of them standing for all, that are in ``least`` bad pages.

    Sets are compared by their number and two digests of 64 bits.
    """
    each = sets.select("key", "n", "bad", F.explode("items").alias("token"))
    digests = (F.bit_xor(F.xxhash64("key")).alias("one"), F.bit_xor(F.xxhash64(F.lit("again"), "key")).alias("two"))
    by_token = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("often"), *digests).filter(F.col("bad") >= least)
    # The tokens of a class occur in one URL together.
    alike = by_token.groupBy("n", "bad", "often", "one", "two").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return alike.select(F.col("tokens")[0].alias("token"), "tokens", "n", "bad")


def together(sets: DataFrame, single: DataFrame, least: int) -> DataFrame:
    """(rule, anchors, items, n, bad) of sets of two or more of the classes ``single`` that ``least`` bad pages have, by their first tokens."""
    each = sets.filter("bad > 0").select("key", "bad", F.explode("items").alias("token"))
    shown = each.join(single.select("token"), "token").groupBy("key", "bad").agg(F.collect_list("token").alias("items")).filter(F.size("items") > 1)
    pages = cut_lineage(shown.select("items", F.explode(F.sequence(F.lit(1).cast("long"), "bad"))).select("items"))
    many = pages.count()
    none = sets.sparkSession.createDataFrame([], "rule string, anchors array<string>, items array<array<string>>, n long, bad long")
    if many < least:
        return none
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / many, minConfidence=1.0).fit(pages)
    found = model.freqItemsets.filter(F.size("items") > 1).select(F.array_sort("items").alias("names"), F.col("freq").alias("bad"))
    found = cut_lineage(found.withColumn("rule", F.array_join("names", " ")))
    rarest = found.select("rule", F.explode("names").alias("token")).join(single.select("token", "n"), "token").groupBy("rule").agg(F.min(F.struct("n", "token"))["token"].alias("anchor"))
    held = found.join(rarest, "rule").select("rule", F.array("anchor").alias("anchors"), F.transform("names", lambda x: F.array(x)).alias("items"), "bad")
    n = match(sets, held, "n").groupBy("rule").agg(F.sum("n").alias("n"))
    return held.join(n, "rule").select(none.columns)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT, min_pages: int = MIN_PAGES, significant: float = SIGNIFICANT) -> DataFrame:
    """Rules (rule, anchors, items, n, bad, confidence) from token sets with labels (items, bad as 0 or 1); none is part of another.

    ``items`` has a class of tokens each, any one of which will do.
    """
    sets = labelled.filter(F.size("items") > 0).groupBy(F.array_join("items", " ").alias("key"), "items").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    sets = cut_lineage(sets)
    total, guilty = sets.agg(F.sum("n"), F.sum("bad")).first()
    none = labelled.sparkSession.createDataFrame([], "rule string, anchors array<string>, items array<array<string>>, n long, bad long, confidence double")
    if not guilty or guilty == total:
        return none
    least = fewest(max(min_pages, math.ceil(min_support * guilty)), total, guilty, significant)
    if least > guilty:
        return none
    confidence, ratio = F.col("bad") / F.col("n"), likelihood_ratio(F.col("n"), F.col("bad"), total, guilty)
    is_rule = (confidence >= min(1.0, min_lift * guilty / total)) & (ratio >= significant)
    folded = cut_lineage(classes(sets, least))
    alone = folded.filter(is_rule).select(F.col("token").alias("rule"), F.col("tokens").alias("anchors"), F.array("tokens").alias("items"), "n", "bad")
    wide = cut_lineage(together(sets, folded.filter(~is_rule & (F.col("n") < total)), least).filter(is_rule))
    # Of two rules one of which is part of the other, the wider goes; its first tokens show it.
    wider = match(wide.select(F.col("rule").alias("key"), F.flatten("items").alias("items")), wide).filter("key <> rule").select(F.col("key").alias("rule")).distinct()
    members = folded.select("token", "tokens")
    named = wide.join(wider, "rule", "left_anti").select("*", F.explode(F.flatten("items")).alias("token")).join(members, "token")
    spelled = named.groupBy("rule", "n", "bad").agg(F.collect_list("tokens").alias("items"), F.max(F.when(F.array_contains("anchors", F.col("token")), F.col("tokens"))).alias("anchors"))
    return alone.unionByName(spelled).select("rule", "anchors", "items", "n", "bad", confidence.alias("confidence"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    **thresholds: float,
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (given one that decided), ``verdict`` and ``mined`` (whether a mined rule matches).

    ``labels`` has (id, bad); ids without a label teach nothing.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("items")).withColumn("key", F.array_join("items", " "))
    known = labels.filter("id is not null and bad is not null").groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    mined = mine(rows.join(known, F.col("page") == F.col("id")).select("items", "bad"), **thresholds)
    sets = rows.select("key", "items").filter(F.size("items") > 0).distinct()
    # Written, so that its size is known and a small one is sent to the pages rather than they to it.
    guilty = cut_lineage(match(sets, mined).select("key").distinct()).withColumn("mined", F.lit(True))
    name, verdict = by_rules(rules, F.col("host"), F.col("path"))
    out = rows.join(guilty, "key", "left").withColumn("mined", F.coalesce("mined", F.lit(False)))
    method = F.when(F.col("mined"), "block").otherwise("allow")
    return out.select(F.col("page").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "mined")

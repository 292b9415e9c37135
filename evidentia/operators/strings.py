"""Joins of texts: one contained in the other, and the one most alike, by indexes of grams instead of all pairs."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.graphs import cut_lineage, join_counted

#: Characters of a gram, and rows of a gram that meet in one group.
WIDTH, BLOCK = 3, 1000


def grams(text: Column, width: int) -> Column:
    """All runs of ``width`` characters, repeats included, in time linear in the text; the empty run for zero."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % width), F.lit(1)) if width else F.array(F.lit(""))


def meet(left: DataFrame, right: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, both sides' rows of a frequent key dealt to blocks, each block of one side met by each of the other."""
    count = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    sizes = cut_lineage(count(left, "_l").join(count(right, "_r"), key))
    pieces = lambda n: F.ceil(F.col(n) / block).cast("int")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        tagged = join_counted(df, sizes.select(key, pieces("_l").alias("_x"), pieces("_r").alias("_y"), F.col(own).alias("_count")), key, "_count")
        mine, theirs = ("_x", "_y") if own == "_l" else ("_y", "_x")
        number = F.pmod(F.xxhash64(*df.columns), F.col(mine)).cast("int")
        return tagged.withColumn(mine, number).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))

    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l"), [key, "_x", "_y"]).drop("_x", "_y")


def numbered(texts: DataFrame, number: str) -> DataFrame:
    """``texts`` with a number for each row; written, so that the numbers stay."""
    return cut_lineage(texts.select(F.monotonically_increasing_id().alias(number), "*"))


def contained(needles: DataFrame, texts: DataFrame, needle: str, text: str) -> DataFrame:
    """(needle, text): each distinct needle with each distinct text that contains it.

    A needle meets the texts that have its rarest gram, and no others; a needle shorter than a
    gram is a gram of its own width. So each needle is looked up once, and what it meets is tested
    exactly. Case counts. Nulls take no part, an empty needle is in every text; either table may
    be empty. The two columns' names must differ.
    """
    n = numbered(needles.select(F.col(needle).alias("_needle")).filter("_needle is not null").distinct(), "_n")
    h = numbered(texts.select(F.col(text).alias("_text")).filter("_text is not null").distinct(), "_h")
    size = F.least(F.length("_needle"), F.lit(WIDTH))
    widths = sorted(r[0] for r in n.select(size).distinct().collect()) or [WIDTH]
    held = h.select("_h", F.explode(F.array_distinct(F.concat(*(grams(F.col("_text"), w) for w in widths)))).alias("_g"))
    own = n.select("_n", F.explode(F.when(size < WIDTH, F.array("_needle")).otherwise(F.array_distinct(grams(F.col("_needle"), WIDTH)))).alias("_g"))
    asked = own.groupBy("_g").agg(F.count("*").alias("_count"))
    often = cut_lineage(asked.join(held.groupBy("_g").agg(F.count("*").alias("_f")), "_g", "left").select("_g", "_count", F.coalesce("_f", F.lit(0)).alias("_f")))
    rarest = join_counted(own, often, "_g", "_count").groupBy("_n").agg(F.min(F.struct("_f", "_g")).alias("_best")).filter("_best._f > 0")
    chosen = cut_lineage(rarest.join(n, "_n").select("_needle", F.col("_best._g").alias("_g")))
    met = meet(chosen, held, "_g").join(h, "_h").filter(F.col("_text").contains(F.col("_needle")))
    return met.select(F.col("_needle").alias(needle), F.col("_text").alias(text))


def substring_join(keys: DataFrame, items: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): distinct pairs of which either contains the other; as ``contained`` both ways."""
    return contained(keys, items, key, name).unionByName(contained(items, keys, name, key)).distinct()


def alike(least: float):
    """Share of matching characters of two texts by longest matching blocks; null below ``least``, which counts of characters often tell."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float | None:
            m = difflib.SequenceMatcher(None, x, y)
            if m.real_quick_ratio() < least or m.quick_ratio() < least:
                return None
            found = m.ratio()
            return found if found >= least else None

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


def tokens(texts: DataFrame, least: float) -> DataFrame:
    """(_side, _id, _len, _w, _t): grams of one or two characters, the k-th of a kind being its own token.

    Two texts with S characters in all and M matching ones, ratio 2M / S, share M characters; the
    blocks of matches are one more than the S - 2M others at most, so they share 3M - S - 1 pairs
    of characters. That is positive for texts longer than ``short``; pairs with a shorter one
    are found by characters.
    """
    pairs_share = 1.5 * least - 1
    short = (2 - least) / (2 * pairs_share) if pairs_share > 0 else math.inf
    kinds = []
    for width, which in ((1, F.col("_len") <= short * (2 - least) / least), (2, F.col("_len") > short)):
        if width == 1 or short < math.inf:
            part = texts if short == math.inf else texts.filter(which)
            kinds.append(part.select("_side", "_id", "_len", F.lit(width).alias("_w"), F.explode(grams(F.col("_low"), width)).alias("_g")))
    rows = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
    counted = rows.groupBy("_side", "_id", "_len", "_w", "_g").agg(F.count("*").alias("_k"))
    return counted.select("_side", "_id", "_len", "_w", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int"))).alias("_k"), "_g").select("_side", "_id", "_len", "_w", F.concat_ws(" ", "_w", "_k", "_g").alias("_t"))


def candidates(texts: DataFrame, least: float) -> DataFrame:
    """(a, b): numbers of texts of the sides a and b that may be ``least`` alike, by the prefix filter: the rarest tokens of both have one in common.

    ``texts`` has (_side, _id, _low, _len). A pair above the threshold shares at least the tokens
    that its shorter text may need at worst, so the first few of each, rarest first, must meet.
    """
    rows = cut_lineage(tokens(texts, least))
    often = cut_lineage(rows.groupBy("_t").agg(F.count("*").alias("_count"))).withColumn("_f", F.col("_count"))
    ranked = join_counted(rows, often, "_t", "_count").groupBy("_side", "_id", "_len", "_w").agg(F.sort_array(F.collect_list(F.struct("_f", "_t"))).alias("_all"))
    total = 2 * F.col("_len") / (2 - least)
    need = F.when(F.col("_w") == 1, total * least / 2).otherwise(total * (1.5 * least - 1) - 1)
    first = F.greatest(F.lit(1), F.size("_all") - F.ceil(need - 1e-9).cast("int") + 1)
    kept = cut_lineage(ranked.select("_side", "_id", "_len", F.explode(F.slice("_all", F.lit(1), first)).alias("_p")).select("_side", "_id", "_len", F.col("_p._t").alias("_t")))
    side = lambda s: kept.filter(F.col("_side") == s).select(F.col("_id").alias(s), F.col("_len").alias(f"_len_{s}"), "_t")
    near = 2 * F.least("_len_a", "_len_b") >= least * (F.col("_len_a") + F.col("_len_b"))
    return meet(side("a"), side("b"), "_t").filter(near).select("a", "b").distinct()


def best_alike(asked: DataFrame, names: DataFrame, said: str, name: str, order: str | None = None, least: float = 0.5) -> DataFrame:
    """(said, name, ratio): for each distinct text the name most like it, if ``least`` alike but for case.

    The very same name comes first, then the highest ratio of matching blocks, of equal ones the
    first by ``order`` (a column of ``names``; the name itself if none is given). Null and empty
    texts and names take no part; either table may be empty; repeated rows count once. ``least``
    is above 0; the two columns' names must differ.
    """
    by = F.min(order or name).alias("_order")
    held = names.filter(F.col(name) != "").groupBy(F.col(name).alias("_name")).agg(by)
    want = asked.select(F.col(said).alias("_said")).filter("_said <> ''").distinct()
    exact = want.join(held.select(F.col("_name").alias("_said")), "_said").select("_said", F.col("_said").alias("_name"), F.lit(1.0).alias("ratio"))
    rest = cut_lineage(want.join(held.select(F.col("_name").alias("_said")), "_said", "left_anti").select("_said", F.lower("_said").alias("_low")))
    a = numbered(rest.select("_low").distinct(), "a")
    firsts = held.groupBy(F.lower("_name").alias("_other")).agg(F.min(F.struct("_order", "_name")).alias("_first"))
    b = numbered(firsts.select("_other", "_first"), "b")
    texts = a.select(F.lit("a").alias("_side"), F.col("a").alias("_id"), "_low").unionByName(b.select(F.lit("b").alias("_side"), F.col("b").alias("_id"), F.col("_other").alias("_low")))
    met = cut_lineage(candidates(texts.withColumn("_len", F.length("_low")), least))
    counted = lambda df, end: cut_lineage(df.join(met.groupBy(end).agg(F.count("*").alias("_count")), end))
    both = join_counted(join_counted(met, counted(a, "a"), "a", "_count"), counted(b, "b"), "b", "_count")
    scored = both.select("_low", "_first", alike(least)("_low", "_other").alias("ratio")).filter("ratio is not null")
    best = scored.groupBy("_low").agg(F.min(F.struct((-F.col("ratio")).alias("_minus"), "_first")).alias("_b"))
    fuzzy = rest.join(best, "_low").select("_said", F.col("_b._first._name").alias("_name"), (-F.col("_b._minus")).alias("ratio"))
    return exact.unionByName(fuzzy).select(F.col("_said").alias(said), F.col("_name").alias(name), "ratio")

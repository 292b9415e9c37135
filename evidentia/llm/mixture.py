"""Mixing sources to target weights by Pareto order sampling.

Sources have weights and share a number of words; a source's share stops at ``most`` times its size, and
the excess goes to the others by weight, round by round. Within a source a document is expected
in as many copies as its share of the source's target asks for, ``most`` at the most. The whole part
of that number is certain. The fraction is its inclusion probability in a sample of fixed size: documents
are ranked by the odds of a random number over the odds of that probability, and in this order each is
taken whose words still fit into what the certain copies leave of the target. So what a source lacks in the end is less than its
smallest document that was not drawn.

The random number comes from a seed and the id, so reruns agree. Ranks and running sums are worked
out by ranges, so a source with any share of the rows is many tasks' work.

DataFrame operations only. Defined results: a null text has no words and is taken 0 words of; null is a
source of its own, the last one; a null id is an empty one for the random number; among equal ranks the smaller id, then
the smaller document comes first; repeated rows each count; further columns are ignored
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage, join_counted, running

#: A run of other characters than these is a word.
BLANKS = "\\x20\\x09-\\x0D"


def uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1, from the first 52 bits of a digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 13), 16, 10).cast("long")
    return (h + 0.5) / float(1 << 52)


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """``sources`` (key, size, weight) with ``target``: their part by weight of ``share`` of all sizes, ``most`` times a size at the most.

    Each round freezes the sources that are above and shares what they leave; a round is one
    aggregate, of which sums alone reach the driver.
    """
    level = -1.0
    cap = most * F.col("size")
    while True:
        above = F.col("weight") * level > cap if level >= 0 else F.lit(False)
        # The level at which those not above would share all that is left.
        full = F.sum(F.when(above, cap).otherwise(0))
        left, weights = sources.agg((share * F.sum("size") - full).alias("left"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("w")).first()
        now = left / weights if weights else level
        if not weights or now <= level:
            break
        level = now
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def expected(docs: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """``sources`` with ``scale``: a document is expected in ``scale`` times its weight copies, ``most`` at the most, so that a source's words are its target.

    Documents (key, size, weight) that are above are frozen round by round, all sources at once.
    """
    now = sources.withColumn("scale", F.lit(0.0))
    while True:
        both = docs.join(now.select("key", "scale"), "key")
        above = F.col("weight") * F.col("scale") > most
        sums = both.groupBy("key").agg(F.sum(F.when(above, most * F.col("size")).otherwise(0)).alias("full"), F.sum(F.when(above, 0.0).otherwise(F.col("weight") * F.col("size"))).alias("open"))
        new = now.join(sums, "key").withColumn("new", F.when(F.col("open") > 0, (F.col("target") - F.col("full")) / F.col("open")).otherwise(F.col("scale")))
        # What the rounding of sums adds is no rise.
        new = cut_lineage(new.withColumn("rises", F.col("new") > F.col("scale") * (1 + 1e-12)).withColumn("scale", F.greatest("scale", "new")).drop("full", "open", "new"))
        if new.filter("rises").isEmpty():
            return new.drop("rises")
        now = new.drop("rises")


def draw(pool: DataFrame) -> list[DataFrame]:
    """Tables that hold the rows of ``pool`` (id, key, size, whole, left, odds) with their ``copies``: one more than ``whole`` where a row, by its rank, fits into what is left to its key.

    A round takes of every key the first rows as far as they all fit; the next one goes
    on behind them with the rows that fit into what is then left.
    """
    out = []
    while not pool.isEmpty():
        ranked = running(pool, "before", "size", [F.col("odds"), F.col("id"), F.col("size")], ["key"])
        ranked = cut_lineage(ranked.withColumn("fits", F.col("before") + F.col("size") <= F.col("left")).drop("before"))
        out.append(ranked.filter("fits").withColumn("copies", F.col("whole") + 1))
        rest = ranked.groupBy("key").agg((F.first("left") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("left"), F.count("*").alias("rows"))
        rest = cut_lineage(join_counted(ranked.filter("not fits").drop("fits", "left"), cut_lineage(rest), "key", "rows"))
        out.append(rest.filter("size > left").withColumn("copies", F.col("whole")))
        pool = rest.filter("size <= left")
    return out


def mix(
    df: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    seed: int = 2024,
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of each row: its words and its source's, its source's target, how often it is taken, and words taken.

    Sources in order of code points, null last, have the ``weights`` in turn. ``weight_col``
    names positive weights of documents within their source, null counting as 0; without it all words of a
    source are as likely.
    """
    weight = F.coalesce(F.greatest(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    size = F.coalesce(F.regexp_count(text_col, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    # A key that is never null: a source's name, marked, or nothing.
    key = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    docs = cut_lineage(df.select(F.col(id_col).alias("id"), key.alias("key"), size.alias("size"), weight.alias("weight"), uniform(F.col(id_col), seed).alias("u")))
    grouped = cut_lineage(docs.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.lit(1).cast("long").alias("one")))
    order = [F.when(F.col("key") == "", 1).otherwise(0), F.col("key")]
    turn = (F.col("place") % len(weights)).cast("int")
    placed = cut_lineage(running(grouped, "place", "one", order).select("key", "size", "rows", F.get(F.array(*(F.lit(float(w)) for w in weights)), turn).alias("weight")))
    sources = targets(placed, share, most).withColumn("scale", F.coalesce(F.try_divide(F.col("target"), F.col("size")), F.lit(0.0))).select("key", "rows", F.col("size").alias("source_size"), "target", "scale")
    if weight_col:
        sources = expected(docs, sources, most)
    both = join_counted(docs, cut_lineage(sources), "key", "rows")
    copies = F.least(F.col("weight") * F.col("scale"), F.lit(float(most)))
    held = cut_lineage(both.withColumn("whole", F.floor(copies)).withColumn("chance", copies - F.col("whole")))
    left = cut_lineage(held.groupBy("key").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"), F.count("*").alias("rows")))
    held = join_counted(held, left, "key", "rows")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    held = cut_lineage(held.withColumn("odds", F.when((F.col("chance") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("left")), odds)))
    copies = [held.filter("odds is null").withColumn("copies", F.col("whole")), *draw(held.filter("odds is not null"))]
    every = reduce(DataFrame.unionByName, (c.select("id", "size", "source_size", "target", "copies") for c in copies))
    return every.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB SQL for the query's rows. The level at which the sources share is found from their order by cap over weight.
ORACLE = """
with recursive d as (select row_number() over () as row_no, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
  (('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:13])::bigint + 0.5) / 4503599627370496.0 as u from documents),
g as (select source, sum(size)::bigint as source_size from d group by source),
p as (select source, source_size, [5, 2, 1][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double as weight from g),
c as (select *, coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0) as full_,
  sum(weight) over (order by 3 * source_size / weight, source is null, encode(source) rows between current row and unbounded following) as open_, sum(source_size) over () as total from p),
l as (select max((total - full_)::double / open_) as level from c),
t as (select source, source_size, least(weight * level, 3.0 * source_size) as target from p, l),
e as (select d.*, source_size, target, case when source_size > 0 then least(target / source_size, 3.0) else 0.0 end as copies from d join t on d.source is not distinct from t.source),
w as (select *, floor(copies)::bigint as whole, copies - floor(copies) as chance from e),
r as (select *, target - sum(whole * size) over (partition by source) as left_ from w),
draw(round, row_no, source, doc_id, size, odds, rest, fits) as (
  select *, sum(size) over (partition by source order by odds, doc_id, size rows between unbounded preceding and current row) <= rest from (
    select 0, row_no, source, doc_id, size, (u / (1 - u)) / (chance / (1 - chance)) as odds, left_ as rest from r where chance > 0 and size > 0 and size <= left_)
  union all
  select *, sum(size) over (partition by source order by odds, doc_id, size rows between unbounded preceding and current row) <= rest from (
    select round + 1, row_no, source, doc_id, size, odds, rest from (
      select * exclude (rest), rest - coalesce(sum(size) filter (fits) over (partition by source), 0) as rest from draw) where not fits and size <= rest)),
o as (select row_no from draw where fits)
select doc_id, size, source_size, target, whole + (o.row_no is not null)::bigint as copies, size * (whole + (o.row_no is not null)::bigint) as taken from r left join o using (row_no)
"""

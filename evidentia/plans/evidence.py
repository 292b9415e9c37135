"""Consensus, coverage, convergence, obstacles and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import evidence, pairs, ranking
from evidentia.plans.registry import query, table
from evidentia.plans.relational import TRADE, trade_edges


@query("select p_name, count(distinct p_brand)::bigint as n_groups from part group by p_name having count(distinct p_brand) >= 15")
def topic_coverage_having(spark: SparkSession, d: str) -> DataFrame:
    return evidence.topics_by_groups(table(spark, d, "part"), "p_name", "p_brand", 15)


@query("select min(doc_id) as canonical, count(*)::bigint as size, count(distinct source)::bigint as n_groups, count(distinct source) >= 2 as cross_group from documents group by text having count(*) >= 2")
def exact_dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return evidence.duplicate_clusters(table(spark, d, "documents"), F.col("text"), "doc_id", "source")


@query("""
with g as (select event_type, user_id, avg(value) as m from events group by all), t as (select event_type, avg(value) as mean, stddev_pop(value) as std from events group by all)
select event_type, round(mean, 6) as mean, round(std, 6) as std, round(std / abs(mean), 6) as rel_spread, count(*) filter (abs(m - mean) / greatest(abs(mean), 1e-30) < 0.1)::bigint as n_agree,
 count(*) filter (not abs(m - mean) / greatest(abs(mean), 1e-30) < 0.1)::bigint as n_disagree from g join t using (event_type) group by event_type, mean, std
""")
def consensus_universality(spark: SparkSession, d: str) -> DataFrame:
    out = evidence.consensus(table(spark, d, "events"), "event_type", "user_id", "value")
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "std", "rel_spread")), "n_agree", "n_disagree")


@query("""
with g as (select p_type, p_brand, avg(p_retailprice) as m from part group by all), t as (select p_type, avg(p_retailprice) as mean from part group by all),
c as (select p_type, count(*) filter (abs(m - mean) / abs(mean) < 0.1) as a, count(*) as n from g join t using (p_type) group by p_type)
select p_type, a = n and n >= 3 as universal from c
""")
def universal_topics(spark: SparkSession, d: str) -> DataFrame:
    return evidence.consensus(table(spark, d, "part"), "p_type", "p_brand", "p_retailprice").select("p_type", "universal")


@query("""
with g as (select event_type, user_id, avg(value) as m from events group by all), t as (select event_type, avg(value) as mean from events group by all),
c as (select event_type, count(*) filter (abs(m - mean) / abs(mean) < 0.1) as a, count(*) as n from g join t using (event_type) group by event_type)
select event_type, round(a / n, 6) as significance from c where a < n
""")
def unexpected_disagreement(spark: SparkSession, d: str) -> DataFrame:
    out = evidence.disagreement(evidence.consensus(table(spark, d, "events"), "event_type", "user_id", "value"))
    return out.select("event_type", F.round("significance", 6).alias("significance"))


@query("""
with f as (select event_type, user_id, arg_min(value, event_id) as v from events group by all), t as (select event_type, avg(v) as mean, min(v) as low, max(v) as high from f group by all)
select event_type, count(*)::bigint as n_groups, round(mean, 6) as mean, low, high, round((high - low) / abs(mean), 6) as spread,
 (case when (high - low) / abs(mean) < 0.1 then count(*) else count(*) filter (abs(v - mean) / abs(mean) < 0.1) end)::bigint as n_agree
from f join t using (event_type) group by event_type, mean, low, high
""")
def comparison_table(spark: SparkSession, d: str) -> DataFrame:
    out = evidence.comparison_table(table(spark, d, "events"), "event_type", "user_id", "value", "event_id")
    return out.select("event_type", "n_groups", F.round("mean", 6).alias("mean"), "low", "high", F.round("spread", 6).alias("spread"), "n_agree")


@query("""
with b as (select distinct p_brand from part), h as (select distinct p_name, p_brand from part), n as (select distinct p_name from part),
m as (select p_name, string_agg(b.p_brand, ',' order by b.p_brand) as missing, count(*) as k from n cross join b where not exists (select 1 from h where h.p_name = n.p_name and h.p_brand = b.p_brand) group by p_name)
select p_name, ((select count(*) from b) - k)::varchar || '/' || (select count(*) from b)::varchar as coverage, missing from m
""")
def prediction_gaps(spark: SparkSession, d: str) -> DataFrame:
    return evidence.coverage_gaps(table(spark, d, "part"), "p_name", "p_brand")


@query("select p_name, p_brand from (select distinct p_name from part), (select distinct p_brand from part) except select p_name, p_brand from part")
def gap_rows(spark: SparkSession, d: str) -> DataFrame:
    """Brands that lack a name, a row for each."""
    return evidence.gap_rows(table(spark, d, "part"), "p_name", "p_brand")


@query("""
with c as (select count(distinct p_brand) as k from part)
select lower(trim(p_name)) as item, count(distinct p_brand)::bigint as n_groups, max(p_name) as original from part group by 1 having count(distinct p_brand) >= (select greatest(2, floor(k * 0.8)) from c)
""")
def shared_items(spark: SparkSession, d: str) -> DataFrame:
    return evidence.shared_items(table(spark, d, "part"), "p_name", "p_brand").select("item", "n_groups", "original")


@query("""
select p_name from (select distinct p_name, p_type from part) group by p_name having count(*) = (select count(distinct p_type) from part)
""")
def relational_division(spark: SparkSession, d: str) -> DataFrame:
    return evidence.common_to_all(table(spark, d, "part"), "p_type", "p_name")


@query("""
with r as (select distinct user_id, ts::date as day, event_type from events), n as (select user_id, day, count(*) as n_groups from r group by all having count(*) >= 2),
p as (select distinct event_type, (value / 100)::int as premise from events where value > 380),
h as (select user_id, day, premise, count(*) as k from r join p using (event_type) group by all), s as (select user_id, day, count(*) as n_shared from h join n using (user_id, day) where k = n_groups group by all)
select user_id, day, n_groups::bigint as n_groups, coalesce(n_shared, 0)::bigint as n_shared, case when n_groups >= 4 and coalesce(n_shared, 0) = 0 then 'strong' when n_groups >= 3 then 'moderate' else 'weak' end as strength
from n left join s using (user_id, day)
""")
def convergence_strength(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    premises = events.filter("value > 380").select("event_type", F.round(F.col("value") / 100).cast("int").alias("premise"))
    return evidence.convergence(events, ["user_id", "day"], "event_type", premises, "premise").select("user_id", "day", "n_groups", "n_shared", "strength")


@query("""
with w as (select p_type from part group by p_type having count(distinct p_brand) >= 25) select p_partkey, p_type in (select p_type from w) as is_universal from part
""")
def mark_universal(spark: SparkSession, d: str) -> DataFrame:
    return evidence.mark_spread(table(spark, d, "part"), "p_type", "p_brand", 25).select("p_partkey", "is_universal")


SEVERITY = """
sev as (select least(s_nationkey, c_nationkey) as a, greatest(s_nationkey, c_nationkey) as b, case when o_orderpriority = '1-URGENT' then 3 when o_orderpriority = '2-HIGH' then 2 else 1 end as r, o_orderkey, o_orderpriority
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where l_quantity >= 49 and s_nationkey <> c_nationkey)
"""


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").filter("l_quantity >= 49").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).filter("s_nationkey <> c_nationkey")
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "fundamental").when(F.col("o_orderpriority") == "2-HIGH", "major").otherwise("moderate")
    return evidence.pair_severity(joined.withColumn("level", level), "s_nationkey", "c_nationkey", "level", ["moderate", "major", "fundamental"], "o_orderkey", "o_orderpriority")


@query(f"""
with {SEVERITY} select a, b, ['moderate', 'major', 'fundamental'][max(r)] as severity, count(*)::bigint as n, arg_min(o_orderpriority, o_orderkey) as first_text from sev group by a, b
""")
def pair_severity(spark: SparkSession, d: str) -> DataFrame:
    return contradictions(spark, d)


@query("""
select source, max((lang = 'de')::int) as de, max((lang = 'en')::int) as en, max((lang = 'es')::int) as es, max((lang = 'fr')::int) as fr from documents group by source
""")
def presence_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evidence.presence_matrix(table(spark, d, "documents"), "source", "lang", ["de", "en", "es", "fr"])


@query("""
with p as (select a.p_partkey as p_partkey_a, b.p_partkey as p_partkey_b, a.p_type as ta, b.p_type as tb, abs(a.p_retailprice - b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice) as gap
 from part a join part b on a.p_name = b.p_name and a.p_size = b.p_size and a.p_partkey < b.p_partkey and a.p_brand <> b.p_brand),
s as (select p_partkey_a, p_partkey_b, 1 - gap as structural, case when ta = tb and ta in ('ECONOMY', 'SMALL') then 1.0 when ta not in ('ECONOMY', 'SMALL', 'LARGE') or tb not in ('ECONOMY', 'SMALL', 'LARGE') then 0.5
 when ta = tb then 1.0 when ta in ('ECONOMY', 'SMALL') and tb in ('ECONOMY', 'SMALL') then 0.8 else 0.0 end as dimensional, case when gap < 0.2 then 1.0 end as numerical from p),
w as (select p_partkey_a, p_partkey_b, (2 * structural + 1.5 * dimensional + coalesce(3 * numerical, 0)) / (3.5 + case when numerical is null then 0 else 3 end) as score from s)
select p_partkey_a, p_partkey_b, round(score, 6) as score, case when score > 0.9 then 'exact' when score > 0.7 then 'structural' when score > 0.5 then 'partial' when score > 0.3 then 'analogous' else 'none' end as label from w where score >= 0.3
""")
def weighted_match_score(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.cross_group_pairs(table(spark, d, "part"), "p_partkey", "p_brand", ["p_name", "p_size"], keep=["p_type", "p_retailprice"])
    gap = F.abs(F.col("p_retailprice_a") - F.col("p_retailprice_b")) / F.greatest("p_retailprice_a", "p_retailprice_b")
    known = {"ECONOMY": "x", "SMALL": "x", "LARGE": "y"}
    scores = {"structural": 1 - gap, "dimensional": ranking.dimension_score(F.col("p_type_a"), F.col("p_type_b"), known), "numerical": F.when(gap < 0.2, 1.0)}
    out = found.withColumn("score", ranking.weighted_mean(scores)).filter("score >= 0.3")
    return out.select("p_partkey_a", "p_partkey_b", F.round("score", 6).alias("score"), ranking.match_label(F.col("score")).alias("label"))


@query("""
with c as (select o_custkey, count(*) as hits, count(*) filter (o_totalprice > 400000) as cited from orders group by 1)
select c_custkey, (case when hits is null then 0.5 when cited >= 3 then 0.0 when cited >= 1 then 0.2 when hits >= 5 then 0.3 when hits >= 2 then 0.5 else 0.7 end)::double as novelty,
 case when hits = 0 then true when cited >= 3 then false end as is_novel from customer left join c on c_custkey = o_custkey
""")
def novelty_bands(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("hits"), F.count_if(F.col("o_totalprice") > 400000).alias("cited"))
    out = table(spark, d, "customer").join(found, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", ranking.novelty_band(F.col("hits"), F.col("cited")).alias("novelty"), ranking.is_novel(F.col("hits"), F.col("cited")).alias("is_novel"))


@query("""
with v(x) as (values (true), (false), (null::boolean)), t as (select a.x as a, b.x as b, c.x as c, e.x as e, n.x as n from v a, v b, v c, v e, v n)
select a, b, c, e, n, case when e is not null and e then 'disproved' when (a is not null and not a) or (b is not null and not b) or (c is not null and not c) then 'disproved' when n is not null and not n then 'known'
 when (a is not null and a) or (b is not null and b) then 'verified' when c is not null and c and n is not null and n then 'verified' else 'inconclusive' end as status from t
""")
def status_lattice(spark: SparkSession, d: str) -> DataFrame:
    flags = [True, False, None]
    rows = [(a, b, c, e, n) for a in flags for b in flags for c in flags for e in flags for n in flags]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, e boolean, n boolean")
    return df.withColumn("status", ranking.status(*(F.col(x) for x in "abcen")))


@query("""
with t as (select doc_id, lower(text) as x, greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), 1) as w from documents),
s as (select doc_id, least(((contains(x, 'the')::int + contains(x, 'tion')::int + contains(x, 'und')::int) / greatest(3 * 0.4, 1.0)), 1.0) as historical,
 (case when contains(x, 'password') then 0.0 else 1.0 end) as consistency, 0.5 * least(100 / w, 2.0) / 2.0 + 0.5 * least((contains(x, 'unify')::int + contains(x, 'unification')::int + contains(x, 'single')::int + contains(x, 'simpler')::int
 + contains(x, 'reduce')::int + contains(x, 'eliminate')::int + contains(x, 'remove')::int + contains(x, 'drop')::int + contains(x, 'one')::int + contains(x, 'emergent')::int + contains(x, 'derive')::int + contains(x, 'recover')::int
 + contains(x, 'explain')::int + contains(x, 'subsume')::int) / 3.0, 1.0) as simplification from t),
o as (select source, count(distinct lang) as langs, count(*) as n from documents group by source),
r as (select doc_id, (historical + 3 * consistency + 2 * simplification + 2 * least(langs / 4, 1.0) + 2 * (case when contains(x, '|') then 1.0 else 0.0 end) + (case when n >= 5 then 0.3 when n >= 2 then 0.5 else 0.7 end)) / 11 as score
 from s join t using (doc_id) join documents using (doc_id) join o using (source))
select doc_id, round(score, 6) as score, row_number() over (order by round(score, 6) desc, doc_id)::int as rank from r order by rank limit 50
""")
def premise_rank(spark: SparkSession, d: str) -> DataFrame:
    """The premises of best score: what the text says of itself, how widely its source converges (languages), whether it answers an obstacle, and how new it is."""
    docs = table(spark, d, "documents")
    found = docs.groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.count("*").alias("hits"))
    docs = docs.join(found, "source")
    text, current = F.col("text"), F.lit("w " * 100)
    from evidentia.operators.scans import vetoed

    scores = {
        "historical": X.keyword_score(text, ["the", "tion", "und"]),
        "consistency": F.when(vetoed(text, [["password"]]), 0.0).otherwise(1.0),
        "simplification": X.simplification(current, text),
        "convergence": F.least(F.col("langs") / 4, F.lit(1.0)),
        "obstacle": F.when(text.contains("|"), 1.0).otherwise(0.0),
        "novelty": ranking.novelty_band(F.col("hits"), F.lit(0)),
    }
    top = docs.select("doc_id", F.round(ranking.premise_score(scores), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)
    # The fifty rows of the top-k are ranked, not the table.
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("rows")).select(F.posexplode("rows").alias("at", "r"))
    return ranked.select("r.doc_id", (-F.col("r.s")).alias("score"), (F.col("at") + 1).alias("rank"))


@query("""
with c as (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z_-]{2,}'), lambda w: not list_contains(string_split('STOP', ' '), w))) as w from benchmark),
x as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z_-]{2,}'))) as w from documents), i as (select item_id, len(w) as n, unnest(w) as w from c),
o as (select doc_id, item_id, count(*) / n as s from x join i using (w) group by doc_id, item_id, n)
select doc_id, round(coalesce(max(s), 0.0), 6) as best from documents left join o using (doc_id) group by doc_id
""".replace("STOP", " ".join(X.STOP_WORDS)))
def content_word_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Each document's best share of a benchmark item's content words."""
    items = table(spark, d, "benchmark").select("item_id", F.array_distinct(X.content_words(F.col("text"))).alias("own")).filter("size(own) > 0")
    docs = table(spark, d, "documents").select("doc_id", "text")
    # Shared words are counted by a join on the word, which leaves out stop words as items have none; pairs without one score zero.
    words = docs.select("doc_id", F.explode(F.array_distinct(X.words_of(F.col("text")))).alias("w"))
    hits = words.join(items.select("item_id", F.size("own").alias("n"), F.explode("own").alias("w")), "w")
    score = hits.groupBy("doc_id", "item_id", "n").agg((F.count("*") / F.col("n")).alias("s")).groupBy("doc_id").agg(F.max("s").alias("best"))
    return docs.select("doc_id").join(score, "doc_id", "left").select("doc_id", F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"))


@query(f"""
with {TRADE}, r as (select n_nationkey, n_regionkey from nation) select a.n_regionkey as tag_a, b.n_regionkey as tag_b, count(*)::bigint as n
from trade join r a on src = a.n_nationkey join r b on dst = b.n_nationkey where a.n_regionkey <> b.n_regionkey group by all
""")
def group_flow(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators.graphs import group_flow as flow

    tags = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return flow(trade_edges(spark, d), tags, "n_nationkey", "n_regionkey", ignore="-1")

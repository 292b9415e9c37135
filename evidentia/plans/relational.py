"""Scans, predicates, joins, windows, set operations and mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import pairs, scans
from evidentia.operators.ranking import top_per_key
from evidentia.plans.registry import query, table

TAGS = {"spam": ["!!", "$$$"], "secret": ["password", "token"], "the_words": ["the the", "and and"]}
FLAGS = (("stupid", "idiot"), ("password",), ("nowhere at all",))


@query("select o_orderstatus, count(*)::bigint as n, count(distinct o_custkey)::bigint as customers from orders group by o_orderstatus")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query(" union all ".join(f"select '{t}' as table_name, count(*)::bigint as n from {t}" for t in ("nation", "customer", "supplier", "part", "orders", "documents")))
def table_summary(spark: SparkSession, d: str) -> DataFrame:
    return scans.counts(**{t: table(spark, d, t) for t in ("nation", "customer", "supplier", "part", "orders", "documents")})


@query("select * from customer where c_custkey = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return scans.lookup(table(spark, d, "customer"), "c_custkey", 42)


@query("select p_partkey, p_name, p_brand, p_size from part where p_type = 'ECONOMY' and p_brand in ('Brand#1', 'Brand#2') and p_size >= 10")
def dynamic_predicate_scan(spark: SparkSession, d: str) -> DataFrame:
    found = scans.scan_where(table(spark, d, "part"), equal={"p_type": "ECONOMY", "p_name": None}, among={"p_brand": ["Brand#1", "Brand#2"]}, least={"p_size": 10})
    return found.select("p_partkey", "p_name", "p_brand", "p_size")


@query("select doc_id, n_chars from documents where text ilike '%ATION Th%'")
def ilike_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("text").ilike("%ATION Th%")).select("doc_id", "n_chars")


@query("""
select o_orderkey, o_orderstatus, o_totalprice, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey where o_orderstatus in ('F', 'P')
""")
def prediction_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "P"))
    return o.join(table(spark, d, "customer"), o.o_custkey == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "o_totalprice", "c_name", "c_mktsegment")


@query("""
with t as (select doc_id, list_filter([case when contains(lower(text), '!!') or contains(lower(text), '$$$') then 'spam' end,
  case when contains(lower(text), 'password') or contains(lower(text), 'token') then 'secret' end,
  case when contains(lower(text), 'the the') or contains(lower(text), 'and and') then 'the_words' end], lambda x: x is not null) as tags from documents)
select doc_id, case when len(tags) = 0 then 'unclassified' else array_to_string(list_sort(tags), ',') end as tags from t
""")
def keyword_autotag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(scans.tag_by_keywords(F.col("text"), TAGS)), ",").alias("tags"))


@query("""
select doc_id, (contains(lower(text), 'stupid') and contains(lower(text), 'idiot')) or contains(lower(text), 'password') or contains(lower(text), 'nowhere at all') as vetoed from documents
""")
def red_flag_veto(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scans.vetoed(F.col("text"), FLAGS).alias("vetoed"))


@query("select doc_id, case when length(text) > 3000 then substring(text, 1, 1000) || '|cut|' || right(text, 1000) else text end as text from documents")
def middle_truncation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scans.middle_truncated(F.col("text"), 3000, "|cut|").alias("text"))


@query("""
select a.p_name, a.p_size, a.p_partkey as p_partkey_a, a.p_brand as p_brand_a, b.p_partkey as p_partkey_b, b.p_brand as p_brand_b
from part a join part b on a.p_name = b.p_name and a.p_size = b.p_size and a.p_partkey < b.p_partkey and a.p_brand <> b.p_brand
""")
def cross_group_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.cross_group_pairs(table(spark, d, "part"), "p_partkey", "p_brand", ["p_name", "p_size"])


@query("""
select a.p_name, a.p_size, a.p_partkey as p_partkey_a, a.p_brand as p_brand_a, b.p_partkey as p_partkey_b, b.p_brand as p_brand_b
from part a join part b on a.p_name = b.p_name and a.p_size = b.p_size and a.p_partkey < b.p_partkey
""")
def same_group_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.cross_group_pairs(table(spark, d, "part"), "p_partkey", "p_brand", ["p_name", "p_size"], same_group=True)


@query("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_name < b.n_name")
def group_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.group_pairs(table(spark, d, "nation"), "n_name")


TRADE = """
trade_all as (select s_nationkey as src, c_nationkey as dst, count(*) as n from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all),
trade as (select src, dst, n from trade_all where n >= 1.2 * (select avg(n) from trade_all))
"""


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """Supplier nation to customer nation, where trade is well above the average. Only keys are read and shuffled."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    # Lines shrink to a count per order and nation before they meet the orders.
    sold = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "src").agg(F.count("*").alias("k"))
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dst")
    every = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.sum("k").alias("n"))
    mean = every.agg(F.avg("n").alias("m"))
    return every.join(F.broadcast(mean)).filter("n >= 1.2 * m").select("src", "dst", "n")


@query(f"""
with {TRADE} select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_nationkey < b.n_nationkey
where not exists (select 1 from trade where (src = a.n_nationkey and dst = b.n_nationkey) or (src = b.n_nationkey and dst = a.n_nationkey))
""")
def uncited_pairs(spark: SparkSession, d: str) -> DataFrame:
    every = pairs.group_pairs(table(spark, d, "nation"), "n_nationkey")
    return pairs.without_edges(every, trade_edges(spark, d), "a", "b", "src", "dst")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def unprocessed_items(spark: SparkSession, d: str) -> DataFrame:
    return pairs.unprocessed(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("""
select event_id, coalesce(last_value(case when event_type = 'signup' then event_id::varchar end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), 'preamble') as section from events
""")
def asof_section(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.last_before(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id").cast("string"))
    return found.select("event_id", "section")


@query("""
select key, p_partkey from (values ('bolt'), ('a red widget'), ('new')) k(key) join part on contains(p_name, key) or contains(key, split_part(p_name, '/', -1))
""")
def substring_theta(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([("bolt",), ("a red widget",), ("new",)], "key string")
    return pairs.contained_keys(keys, table(spark, d, "part"), "key", "p_name").select("key", "p_partkey")


@query("""
with k(id, tag, kw) as (values (1, 'en', ['the', 'of']), (2, 'fr', ['zzz', 'qqq']), (3, 'de', ['und', 'der']), (4, 'xx', ['the', 'of']))
select id, exists (select 1 from documents where lang = tag and len(list_filter(kw, lambda w: contains(lower(text), w))) >= 2) as hit from k
""")
def known_recall(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(1, ["en"], ["the", "of"]), (2, ["fr"], ["zzz", "qqq"]), (3, ["de"], ["und", "der"]), (4, ["xx"], ["the", "of"])], "id int, tags array<string>, kw array<string>")
    docs = table(spark, d, "documents").select("text", F.array("lang").alias("tags"))
    return pairs.recall(known, docs, "id", "tags", "kw", "text").select("id", "hit")


@query("""
with s as (select o_custkey as id, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') as m from orders group by 1), c as (select m, count(*)::bigint as n from s group by m)
select a.m as set_a, b.m as set_b, a.n as n_a, b.n as n_b from c a join c b on a.m <> b.m and list_has_any(string_split(a.m, ','), string_split(b.m, ','))
and len(list_filter(string_split(a.m, ','), lambda x: not list_contains(string_split(b.m, ','), x))) > 0
""")
def composable_sets(spark: SparkSession, d: str) -> DataFrame:
    """Classes of customers by their set of priorities, paired where they share one and the first has one more; ``set_members`` has who is in which."""
    sets = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("m"))
    classes = pairs.set_classes(sets, "id", "m")
    met = pairs.overlapping_sets(classes, "class", "members")
    size = lambda s: classes.select(F.col("class").alias(f"class_{s}"), F.col("n").alias(f"n_{s}"))
    return met.join(size("a"), "class_a").join(size("b"), "class_b").select(F.col("class_a").alias("set_a"), F.col("class_b").alias("set_b"), "n_a", "n_b")


@query("select o_custkey as id, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') as class from orders group by 1")
def set_members(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("m"))
    return sets.select("id", pairs.class_of("m").alias("class"))


@query("""
select substring(sha256(source || ':' || lang || ':' || text), 1, 16) as content_hash, min(doc_id) as doc_id from documents
where substring(sha256(source || ':' || lang || ':' || text), 1, 16) not in (select substring(sha256(source || ':' || lang || ':' || text), 1, 16) from documents where doc_id % 2 = 0)
and doc_id % 2 = 1 group by 1
""")
def content_hash_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", scans.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("content_hash"))
    return scans.upsert_keep_first(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "content_hash", ["doc_id"]).select("content_hash", "doc_id")


@query("""
select c_custkey, c_name, case when c_custkey % 3 = 0 then 0.0 else c_acctbal end as c_acctbal, case when c_custkey % 3 = 0 and c_custkey % 2 = 0 then 'NONE' else c_mktsegment end as c_mktsegment from customer
""")
def sparse_update(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = customer.filter("c_custkey % 3 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, "NONE").alias("c_mktsegment"))
    return scans.sparse_update(customer, new, "c_custkey")


@query("""
select o_custkey, o_orderkey, o_totalprice, rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3
""")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return top_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


@query("""
select o_orderkey, k from (select o_orderkey, o_orderstatus || ':' || o_orderpriority as k, row_number() over (partition by o_orderstatus, o_orderpriority order by o_orderkey) as r from orders) where r <= 3
""")
def capped_per_key(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "orders").withColumn("k", F.concat_ws(":", "o_orderstatus", "o_orderpriority"))
    return top_per_key(keyed, ["k"], ["o_orderkey"], 3).select("o_orderkey", "k")


@query("""
select event_type, event_id, value, best from (select *, row_number() over (partition by event_type order by value desc, event_id) as r, max(value) over (partition by event_type) as best from events) where r <= 2
""")
def top_two_of_each_kind(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    best = events.groupBy("event_type").agg(F.max("value").alias("best"))
    return top_per_key(events, ["event_type"], [F.desc("value"), "event_id"], 2).join(best, "event_type").select("event_type", "event_id", "value", "best")


@query("select min(doc_id) as doc_id, substring(text, 1, 50) as head from documents group by 2")
def keep_first_by_head(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 50).alias("head"))
    return scans.keep_first(docs, ["head"], ["doc_id"])


@query("select user_id, arg_max(event_type, ts) as status from events group by user_id")
def phase_latest(spark: SparkSession, d: str) -> DataFrame:
    return scans.latest_status(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").withColumnRenamed("event_type", "status")


@query("""
with latest as (select o_orderpriority as phase, case when count(*) filter (o_orderstatus = 'F') > 0 then 'completed' end as status from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1)
select phase from (values (0, '1-URGENT'), (1, '2-HIGH'), (2, '6-NEXT')) p(i, phase) left join latest using (phase) where status is distinct from 'completed' order by i limit 1
""")
def next_pending_phase(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy(F.col("o_orderpriority").alias("phase"))
    latest = done.agg(F.when(F.count_if(F.col("o_orderstatus") == "F") > 0, "completed").alias("status"))
    return scans.next_pending(latest, ["1-URGENT", "2-HIGH", "6-NEXT"])


@query("select doc_id, lang, n_chars from documents order by (lang <> 'de'), (n_chars < 500), doc_id limit 40")
def priority_sort_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").orderBy(F.col("lang") != "de", F.col("n_chars") < 500, "doc_id").limit(40).select("doc_id", "lang", "n_chars")


@query("""
select distinct source_kind, item from (
select 'document' as source_kind, md5(lower(trim(text))) as item from documents
union all select 'benchmark', md5(lower(trim(text))) from benchmark
union all select 'part', md5(lower(trim(p_name))) from part)
""")
def tagged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of three sources with their kind, told apart by the digest of what they say but for case."""
    said = lambda name, kind, c: table(spark, d, name).select(F.lit(kind).alias("source_kind"), F.md5(F.lower(F.trim(c))).alias("item"))
    return said("documents", "document", "text").unionByName(said("benchmark", "benchmark", "text")).unionByName(said("part", "part", "p_name")).distinct()


@query("""
select coalesce(a.p_name, b.p_name) as p_name, case when a.p_name is null then 'only_then' when b.p_name is null then 'only_now' else 'matching' end as side
from (select distinct p_name from part where p_brand = 'Brand#1') a full join (select distinct p_name from part where p_brand = 'Brand#2') b using (p_name)
""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.operators.vectors import profile_difference

    part = table(spark, d, "part")
    return profile_difference(part.filter("p_brand = 'Brand#1'"), part.filter("p_brand = 'Brand#2'"), "p_name")


@query("""
select role, count(*)::bigint as calls, sum(length(text))::bigint as chars, round(sum(length(text)) * case when role = 'assistant' then 15.0 else 3.0 end / 1e6, 9) as cost from conversations group by role
""")
def cost_by_phase(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("role") == "assistant", 15.0).otherwise(3.0)
    out = table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("chars"))
    return out.withColumn("cost", F.round(F.col("chars") * price / 1e6, 9))

"""Symptom detectors, feature vectors, historical matches and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import symptoms as S
from evidentia.operators.vectors import nearest_profiles
from evidentia.plans.evidence import SEVERITY, contradictions
from evidentia.plans.registry import query, table

WATCHED = [("economy", ["ECONOMY"], "%bolt%"), ("large", ["LARGE", "SMALL"], "%RED w%")]
NULLS = [("no decay seen", 0.95), ("no violation seen", 0.95), ("no extra dimension seen", 0.9), ("no partner seen", 0.9)]
#: Part types with a part size of 40 and above count as "other".
ITEMS = "items as (select p_partkey, p_brand as grp, case when p_size >= 15 then 'other' else p_type end as topic, p_name as txt from part)"


def items(spark: SparkSession, d: str) -> DataFrame:
    topic = F.when(F.col("p_size") >= 15, "other").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("grp"), topic.alias("topic"), F.col("p_name").alias("txt"))


def out(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.round("confidence", 6))


def sql(kind: str, subject: str, n: str, sure: str, rest: str) -> str:
    return f"select '{kind}' as symptom_type, ({subject})::varchar as subject, ({n})::bigint as n, round(({sure})::double, 6) as confidence {rest}"


EPICYCLE = "with " + ITEMS + ", t as (select grp, count(*) as total, count(distinct topic) filter (topic <> 'other') as types, count(*) filter (topic = 'other') as others from items group by grp) " + sql(
    "EPICYCLE_ACCUMULATION", "grp", "total", "least(0.9, 0.4 + 0.1 * (total / greatest(types, 1)))", "from t where total >= 3 and (total / greatest(types, 1) > 5 or (others / total > 0.6 and total >= 5))"
)
COVER = "c as (select topic, count(distinct grp) as k from items where topic <> 'other' group by topic having count(distinct grp) >= 3)"
COINCIDENCE = f"with {ITEMS}, {COVER} " + sql("UNEXPLAINED_COINCIDENCE", "topic", "k", "least(0.95, 0.5 + 0.1 * k)", "from c")
UNIVERSAL = f"with {ITEMS}, {COVER} " + sql("UNIVERSAL_QUANTITY", "topic", "k", "case when k >= 4 then least(0.95, 0.5 + 0.1 * k) else least(0.8, 0.4 + 0.1 * k) end", "from c")
OBSTACLE = (
    "with o as (select user_id, event_type from events where value > 300), w as (select event_type, count(distinct user_id) as k from o group by 1 having count(distinct user_id) >= 3), r as (select user_id, count(*) as k from o group by 1 having count(*) >= 3 and count(distinct event_type) <= 3) "
    + sql("STRUCTURED_OBSTACLE", "event_type", "k", "least(0.9, 0.4 + 0.1 * k)", "from w")
    + " union all "
    + sql("STRUCTURED_OBSTACLE", "user_id", "k", "0.6", "from r")
)
VALUE = (
    f"with {ITEMS}, v as (select 'economy' as label, grp from items where topic in ('ECONOMY') or (txt ilike '%bolt%' and topic <> 'other') union all select 'large', grp from items where topic in ('LARGE', 'SMALL') or (txt ilike '%RED w%' and topic <> 'other')), "
    "k as (select label, count(distinct grp) as n from v group by 1) " + sql("UNEXPLAINED_VALUE", "label", "n", "least(0.9, 0.4 + 0.15 * n)", "from k")
)
MISMATCH = (
    f"with {SEVERITY}, p as (select a, b, max(r) as r, count(*) as k from sev group by a, b) "
    + sql("FRAMEWORK_MISMATCH", "a || '|' || b", "k", "case r when 3 then 0.9 when 2 then 0.7 else 0.5 end", "from p")
    + " union all "
    + sql("FRAMEWORK_MISMATCH", "'classical|quantum'", "1", "1.0", "")
)
PROLIFERATION = f"with {ITEMS}, g as (select count(distinct grp) as k from items) " + sql("PROLIFERATION_WITHOUT_SELECTION", "'groups'", "k", "least(0.95, 0.5 + 0.05 * k)", "from g where k >= 2")
DUAL = (
    sql("DUAL_DESCRIPTION", "s_nationkey || '|' || (s_suppkey % 7)", "1", "0.75", "from supplier where s_suppkey % 5 < 2")
    + " union all "
    + sql("DUAL_DESCRIPTION", "o_orderkey", "2", "least(0.95, 0.5 + 0.15 * ((o_orderkey % 2 = 0)::int + (o_orderkey % 3 = 0)::int + (o_orderkey % 5 = 0)::int))", "from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus <> 'F'")
)
NULL = " union all ".join(sql("NULL_RESULT", f"'{s}'", "1", str(c), "") for s, c in NULLS)


def counted(spark: SparkSession, d: str) -> DataFrame:
    """Brands by topics, with the watched values of their items: five detectors read this, and Spark works it out once."""
    return S.cells(items(spark, d), "grp", "topic", S.watched_labels("topic", "txt", WATCHED))


@query(EPICYCLE)
def symptom_epicycle(spark: SparkSession, d: str) -> DataFrame:
    return out(S.epicycles(counted(spark, d), "grp", "topic", n="n"))


@query(COINCIDENCE)
def symptom_coincidence(spark: SparkSession, d: str) -> DataFrame:
    return out(S.coincidences(counted(spark, d), "grp", "topic"))


@query(OBSTACLE)
def symptom_obstacle(spark: SparkSession, d: str) -> DataFrame:
    return out(S.structured_obstacles(table(spark, d, "events").filter("value > 300"), "user_id", "event_type"))


@query(UNIVERSAL)
def symptom_universal(spark: SparkSession, d: str) -> DataFrame:
    return out(S.universal_quantities(counted(spark, d), "grp", "topic"))


@query(VALUE)
def symptom_value(spark: SparkSession, d: str) -> DataFrame:
    return out(S.unexplained_values(counted(spark, d), "grp", F.col("labels")))


@query(MISMATCH)
def symptom_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return out(S.mismatches(contradictions(spark, d), known=["classical|quantum"]))


@query(PROLIFERATION)
def symptom_proliferation(spark: SparkSession, d: str) -> DataFrame:
    return out(S.proliferation(counted(spark, d), "grp"))


@query(DUAL)
def symptom_dual(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    claims = table(spark, d, "supplier").select(F.col("s_nationkey").alias("a"), (key % 7).alias("b"), F.when(key % 5 == 0, "agrees").when(key % 5 == 1, "maps_to").otherwise("disagrees").alias("kind"))
    o = F.col("o_orderkey")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "duality").when(F.col("o_orderpriority") == "2-HIGH", "equivalence").otherwise("limit")
    status = F.when(F.col("o_orderstatus") == "F", "disproved").otherwise("inconclusive")
    flags = [(o % k == 0).alias(c) for k, c in ((2, "algebraic"), (3, "numerical"), (5, "dimensional"))]
    conjectures = table(spark, d, "orders").select(o.cast("string").alias("title"), kind.alias("kind"), status.alias("status"), F.array(F.lit("x"), F.lit("y")).alias("groups"), *flags)
    return out(S.dual_descriptions(claims, conjectures))


@query(NULL)
def symptom_null(spark: SparkSession, d: str) -> DataFrame:
    return out(S.facts(table(spark, d, "region"), "NULL_RESULT", NULLS))


@query(" union all ".join(f"select * from ({x})" for x in (EPICYCLE, COINCIDENCE, OBSTACLE, UNIVERSAL, VALUE, NULL, MISMATCH, DUAL, PROLIFERATION)))
def symptoms_all(spark: SparkSession, d: str) -> DataFrame:
    detectors = (symptom_epicycle, symptom_coincidence, symptom_obstacle, symptom_universal, symptom_value, symptom_null, symptom_mismatch, symptom_dual, symptom_proliferation)
    return S.detect_all(*(f(spark, d) for f in detectors))


KINDS = ("click", "error", "purchase", "signup", "view")


def profiles(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("sure", F.col("value") / 500).withColumn("day", F.to_date("ts").cast("string"))
    return S.feature_vector(events, "user_id", "event_type", "sure", "event_type", "day", KINDS)


VECTOR = (
    "select user_id, ["
    + ", ".join(f"max((event_type = '{k}')::int)::double" for k in KINDS)
    + ", "
    + ", ".join(f"count(*) filter (event_type = '{k}')::double" for k in KINDS)
    + ", "
    + ", ".join(f"coalesce(max(value / 500) filter (event_type = '{k}'), 0.0)" for k in KINDS)
    + ", count(distinct event_type)::double, count(distinct ts::date)::double, count(*)::double, avg(value / 500)] as features from events group by user_id"
)


@query(f"select user_id, unnest(range(1, 20)) - 1 as pos, round(unnest(features), 6) as x from ({VECTOR})")
def symptom_vector(spark: SparkSession, d: str) -> DataFrame:
    return profiles(spark, d).select("user_id", F.posexplode("features").alias("pos", "x")).select("user_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"""
with v as ({VECTOR}), c as (select a.user_id, b.user_id as other, round(list_cosine_similarity(a.features, b.features), 9) as cosine from v a join v b on a.user_id <> b.user_id)
select user_id, other, cosine, rank from (select *, row_number() over (partition by user_id order by cosine desc, other)::int as rank from c) where rank <= 3
""")
def profile_knn(spark: SparkSession, d: str) -> DataFrame:
    """Each user's three most similar others."""
    v = profiles(spark, d)
    return nearest_profiles(v, v.withColumnRenamed("user_id", "other"), "user_id", "other", "features", 3, not_itself=True)


@query("""
with r as (select o_custkey, max(year(o_orderdate)) as year, count(*)::int as stuck, list(o_orderpriority order by o_orderkey) as s from orders group by 1),
k as (select o_custkey, year + o as year, greatest(1, stuck + o) as stuck, s[1 : greatest(1, floor(len(s) * i / 5)::int)] as s from r, (values (1, -20), (2, -10), (3, -5), (4, -1)) v(i, o))
select o_custkey, year::int as year, stuck, array_to_string(s, ',') as symptoms from k
""")
def time_slice_augment(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    records = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).alias("year"), F.count("*").cast("int").alias("stuck"), ordered.alias("symptoms"))
    return S.time_slices(records, "o_custkey", "year", "stuck", "symptoms").withColumn("symptoms", F.array_join("symptoms", ","))


@query("""
with r as (select o_custkey, list(o_orderpriority order by o_orderkey) as s from orders group by 1 having count(*) > 1)
select o_custkey, unnest([0, 1, 2])::int as copy, len(s)::int as n, true as one_or_two_fewer, true as in_order from r
""")
def random_drop_augment(spark: SparkSession, d: str) -> DataFrame:
    """Copies of records, with whether one or two symptoms are gone (but never all) and the rest stands in the old order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderpriority"]))
    records = table(spark, d, "orders").groupBy("o_custkey").agg(ordered.alias("symptoms"))
    left = S.random_drops(records, "o_custkey", "symptoms", 7).withColumnRenamed("symptoms", "kept").join(records, "o_custkey")
    fewer = F.size("symptoms") - F.size("kept")
    in_order = F.filter("symptoms", lambda x: F.array_contains("kept", x)) == F.col("kept")
    return left.select("o_custkey", "copy", F.size("symptoms").alias("n"), (fewer.between(1, 2) & (F.size("kept") > 0)).alias("one_or_two_fewer"), in_order.alias("in_order"))


_TEMPLATES = "[" + ", ".join(f"'{x}'" for x in S.SUGGESTIONS.values()) + "]"


@query(f"select p_partkey, replace({_TEMPLATES}[p_partkey % 8 + 1], '{{subject}}', p_name) as suggestion from part")
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, S.SUGGESTIONS))
    part = table(spark, d, "part").withColumn("error", F.get(kinds, (F.col("p_partkey") % 8).cast("int")))
    return S.suggestions(part, "error", "p_name").select("p_partkey", "suggestion")

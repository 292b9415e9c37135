"""Vector similarity, projections, clusters and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import clusters, hierarchy, leaders, vectors
from evidentia.plans.registry import query, table
from evidentia.plans.symptoms import VECTOR, profiles

COSINE = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(f"""
select a.vec_id as vec_id_a, b.vec_id as vec_id_b, round(1 - {COSINE}, 9) as distance from embeddings a join embeddings b on a.vec_id < b.vec_id and a.label <> b.label where 1 - {COSINE} > 0.55 and 1 - {COSINE} <= 0.65
""")
def cosine_near_miss(spark: SparkSession, d: str) -> DataFrame:
    found = vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.35, 0.45, "label")
    return found.select("vec_id_a", "vec_id_b", F.round(1 - F.col("cosine"), 9).alias("distance"))


@query(f"select a.vec_id as vec_id_a, b.vec_id as vec_id_b, round({COSINE}, 9) as cosine from embeddings a join embeddings b on a.vec_id < b.vec_id where {COSINE} >= 0.35")
def semantic_pairs(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.35).withColumn("cosine", F.round("cosine", 9))


@query(f"select b.vec_id, round({COSINE}, 9) as cosine from embeddings a, embeddings b where a.vec_id = 7 order by {COSINE} desc, b.vec_id limit 10")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.filter("vec_id = 7").select(F.col("embedding").alias("query"))
    return vectors.top_similar(rows, asked, "vec_id", "embedding", 10).withColumn("cosine", F.round("cosine", 9))


@query("select label, (unnest(range(1, 65)) - 1)::int as pos, round(unnest(m), 9) as mean from (select label, [" + ", ".join(f"avg(embedding[{i}]::double)" for i in range(1, 65)) + "] as m from embeddings group by label)")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return vectors.centroids(table(spark, d, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 9))


@query("""
with e as (select vec_id, unnest(range(1, 65)) as p, unnest(embedding)::double as x from embeddings), s as (select p, avg(x) as m, stddev_pop(x) as s from e group by p)
select vec_id, (p - 1)::int as pos, round((x - m) / case when s > 0 then s else 1 end, 6) as x from e join s using (p)
""")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.standardised(table(spark, d, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", F.posexplode("scaled").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""
select label, count(*)::bigint as size, count(distinct vec_id % 4)::bigint as n_groups, count(distinct vec_id % 6)::bigint as n_topics, count(distinct vec_id % 4) >= 2 as "cross", count(distinct vec_id % 4) >= greatest(3.0, count(*) / 2) as universal from embeddings group by label
""")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("g", F.col("vec_id") % 4).withColumn("t", F.col("vec_id") % 6)
    return vectors.cluster_summary(rows, "label", "g", "t")


def _axis(n: int, of: str) -> str:
    """The first eigenvector of a matrix (list of rows) by squaring it again and again: v{n}, its loadings' sum positive."""
    trace = "list_sum(list_transform(range(1, 65), lambda i: c[i][i]))"
    return f"""
s{n}(k, c) as (select 0, c from {of} union all select k + 1, list_transform(c, lambda r: list_transform(c, lambda s: list_dot_product(r, s) / ({trace} * {trace}))) from s{n} where k < 16),
u{n} as (select list_transform(range(1, 65), lambda i: c[i][i]) as d, c from s{n} where k = 16), w{n} as (select c[list_position(d, list_max(d))] as r from u{n}),
v{n} as (select list_transform(r, lambda x: x / sqrt(list_dot_product(r, r)) * case when list_sum(r) < 0 then -1 else 1 end) as v from w{n})"""


@query(f"""
with recursive e as (select vec_id, unnest(range(1, 65)) as p, unnest(embedding)::double as x from embeddings), z as (select a.p as i, b.p as j, covar_samp(a.x, b.x) as q from e a join e b using (vec_id) group by all),
c1 as (select list(r order by i) as c from (select i, list(q order by j) as r from z group by i)), {_axis(1, "c1")},
l1 as (select c, v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) as l from c1, v1), c2 as (select list_transform(c, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) as c from l1), {_axis(2, "c2")}
select vec_id, round(list_dot_product(embedding::double[], v1.v), 6) as axis_0, round(list_dot_product(embedding::double[], v2.v), 6) as axis_1 from embeddings, v1, v2
""")
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    return vectors.principal_axes(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", *(F.round(F.get("axes", F.lit(k)), 6).alias(f"axis_{k}") for k in (0, 1)))


@query("select user_id, 3::int as classes, true as sums_to_one, true as in_range from (select distinct user_id from events where user_id % 2 = 1)")
def forest_profile_predict(spark: SparkSession, d: str) -> DataFrame:
    """A forest fitted on half the users' profiles and asked about the others: whether it gives each a distribution over the three classes."""
    rows = profiles(spark, d).withColumn("label", (F.col("user_id") % 3).cast("int"))
    out = vectors.forest_probabilities(rows.filter("user_id % 2 = 0"), rows.filter("user_id % 2 = 1"), "user_id", "features", "label", trees=20)
    total = F.aggregate("probabilities", F.lit(0.0), lambda s, x: s + x)
    return out.select("user_id", F.size("probabilities").alias("classes"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"), F.forall("probabilities", lambda x: x.between(0, 1)).alias("in_range"))


@query(f"""
with v as ({VECTOR}), c as (select a.user_id as k, b.user_id as o, round(list_cosine_similarity(a.features, b.features), 9) as c from v a join v b on a.user_id <> b.user_id),
best as (select k, o, row_number() over (partition by k order by c desc, o) as r from c)
select count(*)::bigint as n, count(*) filter (k % 3 = o % 3)::bigint as n_right from best where r = 1
""")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return vectors.leave_one_out(profiles(spark, d).withColumn("label", F.col("user_id") % 3), "user_id", "features", "label")


@query("""
with recursive d as (select a.label as l, a.vec_id as a, b.vec_id as b, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))) as d
  from embeddings a join embeddings b on a.label = b.label),
c as (select a, list_sort(list(d))[least(3, count(*))] as core from d group by a),
e as (select d.a, d.b from d join c x on d.a = x.a join c y on d.b = y.a where greatest(d.d, x.core, y.core) <= 1.3),
r(n, m) as (select a, a from e union select e.b, r.m from r join e on e.a = r.n where r.m < e.b),
k as (select n, min(m) as m from r group by n), z as (select vec_id, coalesce(m, -1 - vec_id) as m from embeddings left join k on n = vec_id)
select vec_id, case when count(*) over (partition by m) >= 3 then m else -1 end::bigint as cluster from z
""")
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.density_clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding", cut=1.3)


@query()
def stable_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of each label's vectors that last longest in the whole hierarchy; no SQL, as merges and choices go on from each other."""
    return hierarchy.stable_clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query(f"""
with recursive near as materialized (select b.vec_id as b, list(a.vec_id order by a.vec_id) as before from embeddings a join embeddings b on a.vec_id < b.vec_id where {COSINE} >= 0.35 group by b.vec_id),
i as materialized (select vec_id, coalesce(before, []) as before, row_number() over (order by vec_id) as pos from embeddings left join near on b = vec_id),
pass as (select 0::bigint as pos, null::bigint as vec_id, null::bigint as leader, []::bigint[] as leading
  union all select i.pos, i.vec_id, coalesce(list_min(list_intersect(i.before, p.leading)), i.vec_id),
    case when list_has_any(i.before, p.leading) then p.leading else list_append(p.leading, i.vec_id) end from pass p join i on i.pos = p.pos + 1)
select vec_id, leader from pass where pos > 0
""")
def vector_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in order, each with the first earlier leader of cosine 0.35 or more, or itself; by rounds of many, where the SQL goes one by one."""
    return leaders.vector_leaders(table(spark, d, "embeddings"), "vec_id", "embedding", 0.35)

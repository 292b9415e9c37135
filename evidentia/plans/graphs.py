"""Graphs of trade between nations, and weights of groups that occur together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import graphs
from evidentia.plans.registry import query, table
from evidentia.plans.relational import TRADE, trade_edges

ROUNDS = 6


def tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("tag"))


@query(f"""
with {TRADE}, t as (select n_nationkey as v, n_regionkey as r from nation),
w as (select v, r, 3 as w from t union all select src, r, 2 from trade join t on dst = v union all select dst, r, 1 from trade join t on src = v)
select v as n_nationkey, sum(w)::bigint as score from (select v, r, max(w) as w from w group by all) group by v
""")
def bridge_score(spark: SparkSession, d: str) -> DataFrame:
    return graphs.bridge_scores(tags(spark, d), trade_edges(spark, d), "n_nationkey", "tag")


def _rounds() -> str:
    steps = ["r0 as (select n_nationkey as v, 1.0::double / (select count(*) from nation) as r from nation)"]
    for k in range(1, ROUNDS + 1):
        steps.append(f"""r{k} as (select n.n_nationkey as v, 0.15 / (select count(*) from nation) + 0.85 * (coalesce((select sum(p.r / o.k) from e join r{k - 1} p on p.v = e.s join o on o.s = e.s where e.d = n.n_nationkey), 0)
          + coalesce((select sum(r) from r{k - 1} where v not in (select s from o)), 0) / (select count(*) from nation)) as r from nation n)""")
    return ", ".join(steps)


@query(f"with {TRADE}, e as (select distinct src as s, dst as d from trade), o as (select s, count(*) as k from e group by s), {_rounds()} select v as n_nationkey, round(r, 9) as rank from r{ROUNDS}")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    out = graphs.pagerank(table(spark, d, "nation").select("n_nationkey"), trade_edges(spark, d), "n_nationkey", rounds=ROUNDS, tolerance=0.0)
    return out.withColumn("rank", F.round("rank", 9))


#: Rounds of the SQL below; its ranks then stand still to the eleventh digit.
STILL = 150


@query(f"""
with recursive l as (select distinct o_custkey % 97 as s, o_orderkey % 89 + 20 as d from orders where o_orderkey % 7 = 0), v as (select s as v from l union select d from l), o as (select s, count(*) as k from l group by s),
r(i, v, r) as (select 0, v, 1.0::double / (select count(*) from v) from v union all
select i + 1, v, 0.15 / count(*) over () + 0.85 * (got + sum(case when ends then r else 0 end) over () / count(*) over ()) from (
select any_value(x.i) as i, x.v, any_value(x.r) as r, any_value(x.ends) as ends, coalesce(sum(p.r / p.k), 0) as got from (select r.*, o.k is null as ends from r left join o on o.s = r.v) x
left join (select l.d, r.r, o.k from l join r on r.v = l.s join o on o.s = l.s) p on p.d = x.v where x.i < {STILL} group by x.v))
select v as node, round(r, 8) as rank from r where i = {STILL}
""")
def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of a graph with dead ends, drawn from the keys of orders, by rounds until they stand still."""
    edges = table(spark, d, "orders").filter("o_orderkey % 7 = 0").select((F.col("o_custkey") % 97).alias("src"), (F.col("o_orderkey") % 89 + 20).alias("dst"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graphs.pagerank(nodes, edges, "node", tolerance=1e-12, rounds=200).withColumn("rank", F.round("rank", 8))


@query(f"with {TRADE}, e as (select distinct src as s, dst as d from trade), o as (select s, count(*) as k from e group by s), {_rounds()} select v as n_nationkey, round(r, 9) as rank from r{ROUNDS} join nation on n_nationkey = v where n_regionkey < 3 order by r desc, v limit 5")
def most_influential(spark: SparkSession, d: str) -> DataFrame:
    ranks = graphs.pagerank(table(spark, d, "nation").select("n_nationkey"), trade_edges(spark, d), "n_nationkey", rounds=ROUNDS, tolerance=0.0)
    return graphs.most_influential(ranks, "rank", "n_nationkey", 5, table(spark, d, "nation").filter("n_regionkey < 3")).withColumn("rank", F.round("rank", 9))


@query("""
with s as (select distinct o_custkey, o_orderpriority as p from orders) select a.p as a, b.p as b, count(*)::bigint as weight from s a join s b on a.o_custkey = b.o_custkey and a.p < b.p group by all
""")
def connection_weights(spark: SparkSession, d: str) -> DataFrame:
    return graphs.pair_weights(table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("m")), "m")


@query("select distinct o_custkey, o_orderpriority as member from orders")
def bipartite_edges(spark: SparkSession, d: str) -> DataFrame:
    return graphs.bipartite(table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("m")), "o_custkey", "m")


@query("""
with recursive e as (select p_partkey as u, p_partkey + (p_size % 4) as v from part where p_size % 4 > 0), b as (select u, v from e union select v, u from e),
r(n, c) as (select u, u from b union select b.v, r.c from r join b on b.u = r.n and r.c < b.v) select n as node, min(c) as component from r group by n
""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").filter("p_size % 4 > 0")
    return graphs.components(part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size") % 4).alias("dst")))

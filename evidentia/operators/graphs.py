"""Graphs as tables of nodes and edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files_of(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and file system of a place."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut_lineage`` wrote and nothing reads any more; leaves others alone."""
    for df in tables:
        if hasattr(df, "_written"):
            where, system = files_of(df.sparkSession, df._written)
            system.delete(where, True)


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written in the folder that executors share (the session's checkpoint folder; the warehouse where that is unset and the session is one process) and read again.

    The table goes when the session ends; that of ``instead_of``, an earlier result that nothing else reads any more, at once.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder}/evidentia/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, system = files_of(spark, path)
    system.deleteOnExit(where)
    if instead_of is not None:
        drop(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


#: Keys that are broadcast at most, as each has more than this share of the rows; and rows of a key that no task minds.
FREQUENT, FEW = 10_000, 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, where no task gathers the rows of a frequent key.

    ``right`` has at most one row for a key, and in ``n`` how many rows of ``left`` have it; ``n`` is
    dropped. Both are written tables, as both are read more than once. A table of FREQUENT rows or fewer is broadcast
    as it is; of a larger one only keys with more than one in FREQUENT of all rows, which are fewer than FREQUENT.
    """
    rows, total, most = right.agg(F.count("*"), F.sum(n), F.max(n)).first()
    if rows <= FREQUENT:
        return left.join(F.broadcast(right.drop(n)), key, how)
    bound = max(FEW, (total or 0) // FREQUENT)
    if (most or 0) <= bound:
        return left.join(right.drop(n), key, how)
    hot, rest = right.filter(F.col(n) > bound).drop(n), right.filter(F.col(n) <= bound).drop(n)
    seldom = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how)
    return left.join(F.broadcast(hot), key).unionByName(seldom)


def roots(pointers: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, up) in which roots point to null: pointers jump to their targets' targets, so rounds are logarithmic in the depth.

    Nodes that have found their root rest, so no round gathers them again.
    """
    state = cut_lineage(pointers.select("node", F.coalesce("up", "node").alias("at"), F.col("up").isNull().alias("there")))
    while True:
        open_ = state.filter("not there")
        if open_.isEmpty():
            return state.select("node", F.col("at").alias("root"))
        asked = open_.groupBy("at").agg(F.count("*").alias("n"))
        target = cut_lineage(state.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("there").alias("arrived")).join(asked, "at"))
        moved = join_counted(open_, target, "at", "n").select("node", F.col("to").alias("at"), F.col("arrived").alias("there"))
        state = cut_lineage(state.filter("there").unionByName(moved), state)


def group_flow(edges: DataFrame, tags: DataFrame, node: str, tag: str, source: str = "src", target: str = "dst", ignore: str = "unclassified") -> DataFrame:
    """(tag_a, tag_b, n): edges between nodes of different tags. ``tags`` has a row per node and tag."""
    t = tags.filter(F.col(tag) != ignore)
    a = t.select(F.col(node).alias(source), F.col(tag).alias("tag_a"))
    b = t.select(F.col(node).alias(target), F.col(tag).alias("tag_b"))
    return edges.join(a, source).join(b, target).filter("tag_a <> tag_b").groupBy("tag_a", "tag_b").agg(F.count("*").alias("n"))


def bridge_scores(tags: DataFrame, edges: DataFrame, node: str, tag: str, source: str = "src", target: str = "dst", ignore: str = "unclassified") -> DataFrame:
    """(node, score): 3 for each own tag, 2 for each further tag of nodes it points to, 1 for each further tag of those that point to it."""
    t = tags.filter(F.col(tag) != ignore).select(F.col(node).alias("_n"), F.col(tag).alias("_t"))
    own = t.select("_n", "_t", F.lit(3).alias("_w"))
    cited = edges.join(t, edges[target] == t["_n"]).select(F.col(source).alias("_n"), "_t", F.lit(2).alias("_w"))
    citing = edges.join(t, edges[source] == t["_n"]).select(F.col(target).alias("_n"), "_t", F.lit(1).alias("_w"))
    # A tag counts once, by its strongest relation.
    best = own.unionAll(cited).unionAll(citing).groupBy("_n", "_t").agg(F.max("_w").alias("_w"))
    return best.groupBy(F.col("_n").alias(node)).agg(F.sum("_w").alias("score"))


def pagerank(nodes: DataFrame, edges: DataFrame, node: str, source: str = "src", target: str = "dst", alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): rank flows along edges until the ranks of all nodes together change by less than ``tolerance`` in a round, at most for ``rounds`` rounds.

    Rank of nodes without edges out is spread over all. Repeated nodes and edges count once; nulls, and edges
    from or to what is no node, take no part; of no nodes nothing comes out. A round reads the last one's table,
    which goes when the next is written. A node with very many edges out sends by a broadcast of its share,
    and what many send to one node is summed before it is shuffled.
    """
    every = cut_lineage(nodes.select(F.col(node).alias("v")).filter("v is not null").distinct())
    n = every.count()
    known = lambda df, end: df.join(every.select(F.col("v").alias(end)), end, "left_semi")
    # Every round reads the edges, so they are worked out once.
    links = cut_lineage(known(known(edges.select(F.col(source).alias("s"), F.col(target).alias("d")), "s"), "d").select("s", "d").distinct())
    out = links.groupBy("s").agg(F.count("*").alias("out"))
    ranks = cut_lineage(every.join(out, F.col("v") == F.col("s"), "left").select("v", "out", F.lit(1.0 / max(1, n)).alias("r"), F.lit(0.0).alias("moved")))
    for _ in range(rounds if n else 0):
        lost = (ranks.filter("out is null").agg(F.sum("r")).first()[0] or 0.0) / n
        share = ranks.filter("out is not null").select(F.col("v").alias("s"), "out", (F.col("r") / F.col("out")).alias("share"))
        sent = join_counted(links, share, "s", "out").groupBy(F.col("d").alias("v")).agg(F.sum("share").alias("got"))
        new = F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + F.lit(lost))
        ranks = cut_lineage(ranks.join(sent, "v", "left").select("v", "out", new.alias("r"), F.abs(new - F.col("r")).alias("moved")), ranks)
        if ranks.agg(F.sum("moved")).first()[0] < tolerance:
            break
    return ranks.select(F.col("v").alias(node), F.col("r").alias("rank"))


def most_influential(ranks: DataFrame, rank: str, node: str, k: int, among: DataFrame | None = None) -> DataFrame:
    """The ``k`` nodes of highest rank, of those in ``among`` if given."""
    rows = ranks.join(among.select(node).distinct(), node, "left_semi") if among is not None else ranks
    return rows.orderBy(F.desc(rank), node).limit(k)


def pair_weights(df: DataFrame, members: str) -> DataFrame:
    """(a, b, weight): how many rows' sets hold both."""
    pairs = df.select(F.explode(members).alias("a"), members).select("a", F.explode(members).alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))


def bipartite(df: DataFrame, item: str, members: str) -> DataFrame:
    """(item, member) edges."""
    return df.select(item, F.explode(members).alias("member")).distinct()


def components(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node's edges reach, by labels that spread and jump until none changes; nodes of any ordered type.

    The number of rounds is logarithmic for all but long thin paths, whose labels halve their distance each round.
    A node with very many edges, and a label that very many nodes have, are joined without one task
    that gathers their rows; a round's tables go when the next ones are written.
    """
    both = cut_lineage(edges.select(F.col(source).alias("u"), F.col(target).alias("v")).unionAll(edges.select(F.col(target).alias("u"), F.col(source).alias("v"))).filter("u is not null and v is not null").distinct())
    # Edges go both ways, so as many rows end in a node as start from it.
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("l"), "n", F.lit(True).alias("new")))
    while not labels.filter("new").isEmpty():
        near = join_counted(both, labels.select(F.col("u").alias("v"), "l", "n"), "v", "n").groupBy("u").agg(F.min("l").alias("m"))
        spread = labels.join(near, "u").select("u", "l", "n", F.least("l", "m").alias("m"))
        # The root that a node hung on takes the node's new label, then labels jump to their label's label.
        hooked = spread.groupBy("l").agg(F.min("m").alias("h")).select(F.col("l").alias("u"), "h")
        moved = cut_lineage(spread.join(hooked, "u", "left").select("u", "n", F.col("l").alias("was"), F.least("m", F.coalesce("h", "m")).alias("l")))
        held = moved.groupBy("l").agg(F.count("*").alias("k"))
        target_of = cut_lineage(moved.select(F.col("u").alias("l"), F.col("l").alias("j")).join(held, "l"))
        last = cut_lineage(join_counted(moved, target_of, "l", "k", "left").select("u", F.least("l", F.coalesce("j", "l")).alias("l"), "n", "was"), labels)
        drop(moved, target_of)
        labels = last.select("u", "l", "n", (F.col("l") != F.col("was")).alias("new"))
        labels._written = last._written
    drop(both)
    return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))

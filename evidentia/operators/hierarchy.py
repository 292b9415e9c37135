"""Density clusters by the whole hierarchy of mutual reachability, with no block in one task.

Vectors lie in tiles of neighbours, packed. Two tiles are compared only where the triangle bound of
their distances from a few pivots does not rule it out: for nearest neighbours first, then for shortest
links. A spanning tree grows by rounds: every component takes its shortest link to another one. The
tree is cut where both sides are large enough, which leaves regions and the few links between them; those links are put
into a hierarchy level by level, and what lasts longest is chosen.

All links are ordered by (far, a, b), so ties have one result. Inverse distances are whole numbers, so
sums are exact in any order and results do not depend on how rows are dealt.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators import graphs
from evidentia.operators.graphs import cut_lineage, join_counted, roots
from evidentia.operators.ordered import running
from evidentia.operators.tiles import Tiles, distances, unpack

#: Inverse distances count in units of this part of one.
UNIT = 10**9
WHOLE = "decimal(38,0)"
#: Links, whose number is checked, that one task may finish.
FINISH = 10_000


def inverse(far: Column) -> Column:
    return (UNIT / F.greatest(far, F.lit(1e-12))).cast(WHOLE)


def shortest_links(a: pd.Series, b: pd.Series, one: bool) -> pd.DataFrame:
    """Links (far, a, b), a < b, of the shortest spanning tree between two tiles, or within one, by mutual reachability; ties go to the smaller ids."""
    left, right = np.asarray(a["ids"]), np.asarray(b["ids"])
    far = np.maximum(np.maximum(distances(unpack(a, len(left)), unpack(b, len(right))), np.asarray(a["core"])[:, None]), np.asarray(b["core"])[None, :])
    ids = left if one else np.concatenate([left, right])
    n, m = len(ids), len(left)
    best, low, high = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    away = np.ones(n, bool)
    links = []
    at = 0
    for _ in range(n - 1):
        away[at] = False
        u = ids[at]
        span = slice(0, n) if one else slice(m, n) if at < m else slice(0, m)
        d = far[at] if one or at < m else far[:, at - m]
        others = ids[span]
        lo, hi = np.minimum(u, others), np.maximum(u, others)
        was, was_lo, was_hi = best[span], low[span], high[span]
        better = away[span] & ((d < was) | ((d == was) & ((lo < was_lo) | ((lo == was_lo) & (hi < was_hi)))))
        was[better], was_lo[better], was_hi[better] = d[better], lo[better], hi[better]
        open_ = np.flatnonzero(away)
        least = best[open_]
        ties = open_[least == least.min()]
        at = int(ties[np.lexsort((high[ties], low[ties]))[0]]) if len(ties) > 1 else int(ties[0])
        links.append((float(best[at]), int(low[at]), int(high[at])))
    return pd.DataFrame(links, columns=["far", "a", "b"])


def spanning_tree(tiles: Tiles) -> DataFrame:
    """Links (far, a, b) of each block's shortest spanning tree.

    Each round, a pair of tiles whose bound is not above the shortest link known out of some component that it
    touches gives its links, once; then every component takes its shortest link to another one. Once all pairs are
    settled and FINISH links or fewer are left, one task takes those.
    """
    schema = "far double, a long, b long"
    links = cut_lineage(tiles.met(tiles.pairs.filter("i = j"), shortest_links, schema))
    todo = tiles.pairs.filter("i < j")
    labels = cut_lineage(tiles.packed.select("tile", F.explode("ids").alias("id")).withColumn("comp", F.col("id")))
    tree = None
    while True:

        def known(links: DataFrame = links, labels: DataFrame = labels) -> tuple[DataFrame, DataFrame]:
            of = lambda end: labels.select(F.col("id").alias(end), F.col("comp").alias(f"comp_{end}"))
            out = cut_lineage(links.join(of("a"), "a").join(of("b"), "b").filter("comp_a <> comp_b").select("far", "a", "b", "comp_a", "comp_b"))
            ends = out.select(F.struct("far", "a", "b").alias("link"), F.explode(F.array(F.struct(F.col("comp_a").alias("u"), F.col("comp_b").alias("v")), F.struct(F.col("comp_b").alias("u"), F.col("comp_a").alias("v")))).alias("e"))
            best = ends.groupBy("e.u").agg(F.min(F.struct("link", "e.v")).alias("m")).select(F.col("u").alias("comp"), "m.link", "m.v")
            return out, cut_lineage(best)

        crossing, best = known()
        while not todo.isEmpty():
            sized = cut_lineage(labels.groupBy("comp").agg(F.count("*").alias("n")).join(best, "comp", "left").select("comp", F.coalesce("link.far", F.lit(float("inf"))).alias("reach"), "n"))
            spread = join_counted(labels, sized, "comp", "n").groupBy("tile").agg(F.max("reach").alias("reach"), F.min("comp").alias("first"), F.max("comp").alias("last"))
            side = lambda name, spread=spread: spread.select(F.col("tile").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("reach", "first", "last")))
            apart = cut_lineage(todo.join(side("i"), "i").join(side("j"), "j").filter("first_i <> last_i or first_j <> last_j or first_i <> first_j"))
            # A component that knows of no link yet asks the nearest tiles first.
            near = apart.select("least", F.explode(F.array("i", "j")).alias("tile")).groupBy("tile").agg(F.min("least").alias("near"))
            beside = lambda name, near=near: near.select(F.col("tile").alias(name), F.col("near").alias(f"near_{name}"))
            bound = lambda name: F.when(F.col(f"reach_{name}") < float("inf"), F.col(f"reach_{name}")).otherwise(F.col(f"near_{name}"))
            asked = cut_lineage(apart.join(beside("i"), "i").join(beside("j"), "j").select("block", "i", "j", "least", (F.col("least") <= F.greatest(bound("i"), bound("j"))).alias("now")))
            now, todo = asked.filter("now"), asked.filter("not now").drop("now")
            if now.isEmpty():
                break
            links = cut_lineage(crossing.select("far", "a", "b").unionAll(tiles.met(now, shortest_links, schema)))
            crossing, best = known(links)
        if best.isEmpty():
            break
        if todo.isEmpty() and crossing.count() <= FINISH:
            rest = crossing.groupBy().applyInPandas(lambda frame: kruskal(frame, "comp_a", "comp_b"), schema)
            return cut_lineage(rest if tree is None else tree.unionAll(rest), tree)
        taken = best.groupBy("link").agg(F.count("*").alias("n"), F.min("comp").alias("u"))
        tree = cut_lineage(taken.select("link.*") if tree is None else tree.unionAll(taken.select("link.*")), tree)
        # Of two components that take the same link, the smaller one is a root.
        root = taken.filter("n = 2").select(F.col("u").alias("comp"), F.lit(True).alias("is_root"))
        pointers = best.select("comp", "v").join(root, "comp", "left").select(F.col("comp").alias("node"), F.when(F.col("is_root").isNull(), F.col("v")).alias("up"))
        merged = roots(pointers).select(F.col("node").alias("comp"), "root")
        renamed = cut_lineage(labels.groupBy("comp").agg(F.count("*").alias("n")).join(merged, "comp", "left"))
        labels = cut_lineage(join_counted(labels, renamed, "comp", "n").select("tile", "id", F.coalesce("root", "comp").alias("comp")), labels)
        links = crossing.select("far", "a", "b")
    return tree if tree is not None else links.filter("false")


def grown(tree: DataFrame, min_size: int) -> DataFrame:
    """(id, o, far): of each item the first link, in order, by which it is in a component of ``min_size`` items or more; none where its block has fewer.

    From each item the component grows by its shortest link, again and again; of a member only
    its ``min_size`` - 1 shortest links can matter.
    """
    ends = tree.select("o", "far", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e")).select("e.id", F.struct("o", "far", "e.to").alias("link"))
    near = cut_lineage(ends.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("link")), 1, max(1, min_size - 1)).alias("links")))
    state = near.select("id", F.array("id").alias("seen"), F.col("links").alias("open"), F.lit(None).cast("struct<o:long,far:double>").alias("last"))
    for step in range(min_size - 1):
        taken = state.filter("size(open) > 0").withColumn("link", F.get("open", F.lit(0)))
        link = F.struct("link.o", "link.far")
        moved = taken.select("id", F.array_append("seen", F.col("link.to")).alias("seen"), F.slice("open", F.lit(2), F.greatest(F.size("open") - 1, F.lit(0))).alias("open"), F.when(F.col("last").isNull() | (F.col("link.o") > F.col("last.o")), link).otherwise(F.col("last")).alias("last"), F.col("link.to").alias("at"))
        if step == min_size - 2:
            return moved.select("id", "last.o", "last.far")
        joined = moved.join(near.select(F.col("id").alias("at"), "links"), "at")
        fresh = F.filter("links", lambda x: ~F.exists("seen", lambda y: y == x["to"]))
        state = cut_lineage(joined.withColumn("open", F.array_sort(F.concat("open", fresh))).select("id", "seen", "open", "last"))
    return state.select("id", F.lit(0).cast("long").alias("o"), F.lit(float("inf")).alias("far"))  # a single item is large enough


def lasting(tree: DataFrame, min_size: int) -> DataFrame:
    """(id, node) of items that are in a cluster that lasts, given the links (far, a, b) of spanning trees.

    A cluster is a component as links are taken in order; it lives from the link that joins it to
    another of at least ``min_size`` items back to the link that joins two such within it. It lasts as long as
    its items are in it, in inverse distance, and is kept if that is no less than what the kept ones within it
    last. A block's whole tree is none.
    """
    if tree.count() <= FINISH:
        return tree.groupBy().applyInPandas(lambda frame: pd.DataFrame(lasting_at_once(frame, min_size), columns=["id", "node"]), "id long, node string")
    numbered = cut_lineage(running(tree.withColumn("one", F.lit(1).cast("long")), {"o": ("sum", "one")}, ["far", "a", "b"]).select("o", "far", "a", "b"))
    large = cut_lineage(grown(numbered, min_size))
    side = lambda end: large.select(F.col("id").alias(end), F.col("o").alias(f"o_{end}"))
    judged = cut_lineage(numbered.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("splits", F.coalesce((F.col("o") > F.col("o_a")) & (F.col("o") > F.col("o_b")), F.lit(False))))
    region = cut_lineage(regions(judged.filter("not splits"), large.select("id")))
    named = lambda end: region.select(F.col("id").alias(end), F.col("region").alias(f"at_{end}"))
    links = cut_lineage(judged.filter("splits").join(named("a"), "a").join(named("b"), "b").select("o", inverse(F.col("far")).alias("inv"), F.col("at_a").alias("a"), F.col("at_b").alias("b")))
    events = cut_lineage(large.join(region, "id").select("id", "o", inverse(F.col("far")).alias("inv"), F.col("region").alias("at")))
    nodes, homes = condensed(links, events)
    return chosen(nodes, homes)


def kruskal(frame: pd.DataFrame, a: str, b: str) -> pd.DataFrame:
    """Links (far, a, b) of the shortest spanning forest between what the columns ``a`` and ``b`` name."""
    frame = frame.sort_values(["far", "a", "b"], ignore_index=True)
    root: dict[int, int] = {}
    kept = []
    for x, y in zip(frame[a].tolist(), frame[b].tolist(), strict=True):
        x, y = top(root, x), top(root, y)
        kept.append(x != y)
        root[x] = y
    return frame.loc[kept, ["far", "a", "b"]]


def top(root: dict[int, int], x: int) -> int:
    while root.setdefault(x, x) != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def lasting_at_once(frame: pd.DataFrame, min_size: int) -> list[tuple[int, str]]:
    """What ``lasting`` gives, of few links: the tree of merges, then clusters from its tops down, then what is kept from below."""
    frame = frame.sort_values(["far", "a", "b"])
    inverses = [int(Decimal(UNIT / max(x, 1e-12)).quantize(Decimal(1), ROUND_HALF_UP)) for x in frame["far"].tolist()]
    root: dict[int, int] = {}
    upper: dict[int, int] = {}
    merges: list[tuple[int, int, int, int]] = []  # left, right, inverse distance, size; items are -1 - their place
    ids = sorted({*frame["a"].tolist(), *frame["b"].tolist()})
    place = {x: k for k, x in enumerate(ids)}
    size = lambda n: merges[n][3] if n >= 0 else 1
    for a, b, now in zip(frame["a"].tolist(), frame["b"].tolist(), inverses, strict=True):
        x, y = top(root, a), top(root, b)
        left, right = upper.get(x, -1 - place[x]), upper.get(y, -1 - place[y])
        merges.append((left, right, now, size(left) + size(right)))
        root[y] = x
        upper[x] = len(merges) - 1
    # Of a cluster: its merge, birth, how long it lasts, the clusters within, and whether it is a whole tree.
    clusters: list[dict] = [{"at": n, "birth": 0, "lasts": 0, "in": [], "whole": True} for x, n in upper.items() if root[x] == x]
    todo = [(c["at"], k) for k, c in enumerate(clusters)]
    while todo:
        n, c = todo.pop()
        if n < 0:
            continue
        left, right, now, whole = merges[n]
        big = [k for k in (left, right) if size(k) >= min_size]
        if len(big) == 2:
            clusters[c]["lasts"] += whole * (now - clusters[c]["birth"])
            for k in big:
                clusters[c]["in"].append(len(clusters))
                todo.append((k, len(clusters)))
                clusters.append({"at": k, "birth": now, "lasts": 0, "in": [], "whole": False})
        else:
            clusters[c]["lasts"] += sum(size(k) for k in (left, right) if k not in big) * (now - clusters[c]["birth"])
            todo += [(k, c) for k in big]
    best, kept = [0] * len(clusters), [False] * len(clusters)
    for k in range(len(clusters) - 1, -1, -1):  # those within come later in the list
        c = clusters[k]
        inner = sum(best[x] for x in c["in"])
        kept[k] = not c["whole"] and (not c["in"] or c["lasts"] >= inner)
        best[k] = c["lasts"] if kept[k] else inner
    out, open_ = [], [k for k, c in enumerate(clusters) if c["whole"]]
    while open_:
        k = open_.pop()
        if not kept[k]:
            open_ += clusters[k]["in"]
            continue
        below = [clusters[k]["at"]]
        while below:
            n = below.pop()
            if n < 0:
                out.append((ids[-1 - n], str(k)))
            else:
                below += merges[n][:2]
    return out


def regions(links: DataFrame, items: DataFrame) -> DataFrame:
    """(id, region): components of links (o, a, b) of a forest, with items that have none; by rounds in which each component takes its first link."""
    labels = items.withColumn("region", F.col("id"))
    open_ = links.select("o", "a", "b")
    while not open_.isEmpty():
        ends = open_.select("o", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
        hubs = contracted(cut_lineage(ends.groupBy("e.u").agg(F.min(F.struct("o", "e.v")).alias("m")).select("u", "m.o", "m.v")))
        labels = cut_lineage(renamed(labels, hubs, "region"), labels if hasattr(labels, "_written") else None)
        open_ = cut_lineage(renamed(renamed(open_, hubs, "a"), hubs, "b").filter("a <> b"))
    return labels


def contracted(best: DataFrame) -> DataFrame:
    """(node, root) where every node u takes its first link (u, o, v); of two that take the same, the smaller is the root."""
    root = best.groupBy("o").agg(F.count("*").alias("n"), F.min("u").alias("u")).filter("n = 2").select("u", F.lit(True).alias("is_root"))
    return cut_lineage(roots(best.join(root, "u", "left").select(F.col("u").alias("node"), F.when(F.col("is_root").isNull(), F.col("v")).alias("up"))))


def renamed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` replaced by the root of names (node, root), a written table, where it has one; a frequent value is no single task's."""
    root = names.select(F.col("node").alias(column), F.col("root").alias("_root"))
    if names.limit(graphs.FREQUENT + 1).count() <= graphs.FREQUENT:
        joined = df.join(F.broadcast(root), column, "left")
    else:
        df = cut_lineage(df)
        joined = join_counted(df, cut_lineage(df.groupBy(column).agg(F.count("*").alias("_n")).join(root, column, "left")), column, "_n")
    return joined.withColumn(column, F.coalesce("_root", column)).drop("_root").select(*df.columns)


def condensed(links: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, parent, kept) of the hierarchy of links (o, inv, a, b) between regions, and homes (id, node) of items, given as events (id, o, inv, at): item ``id`` is in a cluster around ``at`` from ``o`` on.

    A level takes, at every vertex that others hang on by their own first links, these links in order, up to
    the first link there that is no vertex's first one. So each level's links at a vertex are a chain, worked by running
    sums, and what was a chain is a vertex of the next level: levels are logarithmic in the links.
    """
    zero = F.lit(0).cast(WHOLE)
    out_nodes, out_homes = [], []
    # A vertex: its cluster so far (cur), the sums of when its items left (gone), items, and what the kept ones within last (inner).
    vertices = None
    while not links.isEmpty():
        ends = links.select("o", "inv", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("o", "inv", "e.u", "e.v")
        first = cut_lineage(ends.groupBy("u").agg(F.min(F.struct("o", "inv", "v")).alias("m")).select("u", "m.*"))
        hubs = contracted(first)
        chain = first.join(hubs, F.col("u") == F.col("node")).filter("u <> root").select(F.col("o"), F.col("root").alias("hub"), F.col("u"), "inv")
        # A link that is no vertex's first one ends the chains at both its ends.
        later = links.join(chain.select("o"), "o", "left_anti").select("o", F.explode(F.array("a", "b")).alias("at"))
        bound = cut_lineage(renamed(later, hubs, "at").groupBy(F.col("at").alias("hub")).agg(F.min("o").alias("until")))
        whole = cut_lineage(chain.groupBy("hub").agg(F.count("*").alias("n")).join(bound, "hub", "left"))
        chain = cut_lineage(join_counted(cut_lineage(chain), whole, "hub", "n").filter("until is null or o < until").drop("until"))
        # Where each vertex goes at this level, with the link by which it goes; a hub is its own.
        goes = cut_lineage(chain.select(F.col("u").alias("at"), "hub", "o", "inv").unionByName(whole.select(F.col("hub").alias("at"), "hub", F.lit(None).cast("long").alias("o"), F.lit(None).cast(WHOLE).alias("inv"))))
        limits = whole.select("hub", "until")
        asked = events.groupBy("at").agg(F.count("*").alias("n"))
        target = cut_lineage(asked.join(goes.select("at", "hub", F.col("o").alias("joins")), "at", "left").join(limits, "hub", "left"))
        placed = cut_lineage(join_counted(events, target, "at", "n"))
        mine = F.coalesce(F.col("o") < F.col("joins"), F.lit(False))
        # Items that a vertex gets before it goes, or its hub before the chain's end.
        early = placed.filter("hub is not null").filter(mine)
        core = placed.filter("hub is not null").filter(~mine & (F.col("until").isNull() | (F.col("o") < F.col("until"))))
        rest = placed.filter("hub is null or (not coalesce(o < joins, false) and until is not null and o >= until)")
        known = goes.join(vertices, "at", "left") if vertices is not None else goes.select("*", F.lit(None).cast("string").alias("cur"), zero.alias("gone"), zero.alias("items"), F.lit(None).cast(WHOLE).alias("inner"))
        got = early.groupBy("at").agg(F.sum("inv").cast(WHOLE).alias("more_gone"), F.count("*").cast(WHOLE).alias("more_items"))
        full = known.join(got, "at", "left").select("at", "hub", "o", "inv", F.coalesce("cur", F.concat(F.lit("r"), F.col("at").cast("string"))).alias("cur"), (F.coalesce("gone", zero) + F.coalesce("more_gone", zero)).cast(WHOLE).alias("gone"), (F.coalesce("items", zero) + F.coalesce("more_items", zero)).cast(WHOLE).alias("items"), "inner")
        full = cut_lineage(full)
        out_homes.append(cut_lineage(join_counted(early.select("id", "at"), cut_lineage(early.groupBy("at").agg(F.count("*").alias("n")).join(full.select("at", "cur"), "at")), "at", "n").select("id", F.col("cur").alias("node"))))
        lasts = (F.col("gone") - F.col("items") * F.col("inv")).cast(WHOLE)
        kept = F.col("inner").isNull() | (lasts >= F.col("inner"))
        sides = full.filter("o is not null").withColumn("kept", kept).withColumn("best", F.when(kept, lasts).otherwise(F.col("inner")))
        new = F.concat(F.lit("l"), F.col("o").cast("string"))
        out_nodes.append(cut_lineage(sides.select(F.col("cur").alias("node"), new.alias("parent"), "kept")))
        # The chain's links and the hub's own items, in order; an item belongs to the last link before it.
        steps = sides.select("hub", "o", "inv", "items", "best", F.lit(None).cast("long").alias("id")).unionByName(core.select("hub", "o", "inv", F.lit(None).cast(WHOLE).alias("items"), F.lit(None).cast(WHOLE).alias("best"), "id"))
        steps = cut_lineage(running(cut_lineage(steps), {"after": ("max", F.when(F.col("id").isNull(), F.col("o")))}, ["o", "id"], ["hub"]).withColumn("after", F.coalesce("after", F.lit(0).cast("long"))))
        base = full.filter("o is null").select("hub", "cur", F.col("gone").alias("gone"), "items", "inner")
        own = steps.filter("id is not null")
        cur = F.when(F.col("after") > 0, F.concat(F.lit("l"), F.col("after").cast("string")))
        alone = cut_lineage(own.filter("after = 0").groupBy("hub").agg(F.count("*").alias("n")).join(base.select("hub", "cur"), "hub"))
        out_homes.append(cut_lineage(own.filter("after > 0").select("id", cur.alias("node")).unionAll(join_counted(own.filter("after = 0").select("id", "hub"), alone, "hub", "n").select("id", "cur"))))
        between = own.groupBy("hub", "after").agg(F.sum("inv").cast(WHOLE).alias("left_gone"), F.count("*").cast(WHOLE).alias("left_items")).withColumnRenamed("after", "o")
        # One row for each cluster of the chain: 0 is the hub's before its first link.
        rows = steps.filter("id is null").select("hub", "o", "inv", "items", "best").unionByName(base.select("hub", F.lit(0).cast("long").alias("o"), zero.alias("inv"), "items", F.lit(0).cast(WHOLE).alias("best")))
        rows = rows.join(between, ["hub", "o"], "left").select("hub", "o", "inv", "items", "best", F.coalesce("left_gone", zero).alias("left_gone"), F.coalesce("left_items", zero).alias("left_items"), (F.col("items") + F.coalesce("left_items", zero)).cast(WHOLE).alias("all_items"), F.lit(1).cast("long").alias("one"))
        rows = cut_lineage(running(cut_lineage(rows), {"total": ("sum", "all_items"), "sides": ("sum", "best"), "k": ("sum", "one")}, ["o"], ["hub"]))
        ahead = rows.select("hub", (F.col("k") - 1).alias("k"), F.col("o").alias("next"), F.col("inv").alias("next_inv"))
        rows = rows.join(ahead, ["hub", "k"], "left").join(base.select("hub", "cur", F.col("gone").alias("base_gone"), "inner"), "hub")
        at_start = (F.col("total") - F.col("left_items")).cast(WHOLE)
        gone = F.when(F.col("o") == 0, F.col("base_gone")).otherwise((at_start * F.col("inv")).cast(WHOLE)) + F.col("left_gone")
        rows = rows.withColumn("gone", gone.cast(WHOLE)).withColumn("lasts", (F.col("gone") - F.col("total") * F.col("next_inv")).cast(WHOLE))
        start = F.when(F.col("inner").isNull(), F.col("lasts")).otherwise(F.greatest("lasts", "inner"))
        rows = rows.withColumn("above", F.when(F.col("o") == 0, start).otherwise((F.col("lasts") - F.col("sides")).cast(WHOLE)))
        rows = cut_lineage(running(cut_lineage(rows), {"most": ("max", "above")}, ["o"], ["hub"], before=True))
        within = F.when(F.col("o") == 0, F.col("inner")).otherwise((F.col("sides") + F.col("most")).cast(WHOLE))
        node = F.when(F.col("o") == 0, F.col("cur")).otherwise(F.concat(F.lit("l"), F.col("o").cast("string")))
        rows = cut_lineage(rows.select("hub", node.alias("node"), "next", "gone", "total", "lasts", within.alias("within")))
        out_nodes.append(rows.filter("next is not null").select("node", F.concat(F.lit("l"), F.col("next").cast("string")).alias("parent"), (F.col("within").isNull() | (F.col("lasts") >= F.col("within"))).alias("kept")))
        tops = rows.filter("next is null").select(F.col("hub").alias("at"), F.col("node").alias("cur"), "gone", F.col("total").alias("items"), F.col("within").alias("inner"))
        # The next level: what waits keeps its vertex; what went is its hub.
        waiting = vertices.join(goes.select("at"), "at", "left_anti").unionByName(tops) if vertices is not None else tops
        vertices = cut_lineage(waiting)
        moved = goes.filter("o is not null").select(F.col("at").alias("node"), F.col("hub").alias("root"))
        events = cut_lineage(rest.select("id", "o", "inv", F.coalesce(F.when(F.col("joins").isNotNull(), F.col("hub")), F.col("at")).alias("at")))
        links = cut_lineage(renamed(renamed(links.join(chain.select("o"), "o", "left_anti"), moved, "a"), moved, "b").filter("a <> b"))
    spark = events.sparkSession
    nodes = spark.createDataFrame([], "node string, parent string, kept boolean")
    homes = spark.createDataFrame([], "id long, node string")
    for part in out_nodes:
        nodes = nodes.unionByName(part)
    for part in out_homes:
        homes = homes.unionByName(part)
    return nodes, homes


def chosen(nodes: DataFrame, homes: DataFrame) -> DataFrame:
    """(id, node): of the kept nodes around each item's home the topmost one. Pointers jump upwards and carry the highest kept node passed."""
    # A parent that is no row is a block's whole tree.
    inner = nodes.select(F.col("node").alias("has"))
    state = cut_lineage(nodes.join(inner, F.col("parent") == F.col("has"), "left").select("node", F.when(F.col("kept"), F.col("node")).alias("top"), F.col("has").alias("up")))
    known = state.select(F.col("node").alias("up"), F.col("top").alias("up_top"), F.col("up").alias("up_up"))
    while True:
        state = cut_lineage(state.join(known, "up", "left").select("node", F.coalesce("up_top", "top").alias("top"), F.col("up_up").alias("up")), state)
        if state.filter("up is not null").isEmpty():
            break
        known = state.select(F.col("node").alias("up"), F.col("top").alias("up_top"), F.col("up").alias("up_up"))
    asked = homes.groupBy("node").agg(F.count("*").alias("n"))
    told = cut_lineage(asked.join(state.filter("top is not null").select("node", "top"), "node"))
    return join_counted(cut_lineage(homes), told, "node", "n").select("id", F.col("top").alias("node"))


def stable_clusters(df: DataFrame, block: str, item: str, vector: str, min_size: int = 3, min_samples: int = 2, tile: int = 2048) -> DataFrame:
    """(item, cluster) by the whole hierarchy of mutual reachability: of nested clusters those that last longest, each named by its smallest item; -1 is noise.

    ``item`` is a whole number that is unique. Rows whose vector is null, empty or not finite are
    noise and take no part; null is a block of its own; a block's vectors have one length; an
    empty table gives an empty table.
    """
    tiles = Tiles(df, block, item, vector, tile)
    tiles.give_cores(cut_lineage(tiles.cores(min_samples)))
    found = cut_lineage(lasting(spanning_tree(tiles), min_size))
    first = cut_lineage(found.groupBy("node").agg(F.min("id").alias("cluster"), F.count("*").alias("n")))
    named = join_counted(found, first, "node", "n").select(F.col("id").alias("_id"), "cluster")
    own = df.select(item)
    return own.join(named, F.col(item).cast("long") == F.col("_id"), "left").select(item, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))

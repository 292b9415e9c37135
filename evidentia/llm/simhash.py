"""SimHash near-duplicates: exact links within a Hamming radius, by vantage-point trees.

A fingerprint per document; equal ones fall together first, so copies cost nothing more. A
tree over a bounded sample of fingerprints splits Hamming space into shards by distance to
vantage points. Each fingerprint lives in one shard and visits every later shard that the
triangle bound cannot exclude, so each linked pair meets in one shard. Fingerprints travel
packed, many to a row. Within a shard a second tree prunes branches by the same bound. A shard
returns a spanning forest of its links, never all pairs, and stars over these edges give the
components. No join gathers the rows of a frequent fingerprint or of a large component.

Defined results: a null text counts as empty; a text without words has fingerprint zero and
links like any other; texts of any length are read whole, in linear time; a null id keeps its
row and never names a component (the component of null ids alone is null); repeated rows each
keep their row; columns named like those made here do not disturb; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import add_columns, cut_lineage, fresh, join_counted
from evidentia.llm.components import connected_components

#: Fingerprints wanted in a shard, and of the sample that the shards' tree is built of: so many for each shard, at least, at most.
SHARD, SAMPLE = 8192, (16, 8192, 1 << 20)
#: Visitors that meet a shard's fingerprints in one task; more are dealt to several.
VISITORS = 65_536
#: Fingerprints that a task holds before it packs them by shard.
PACK = 1 << 16
#: Fingerprints of a leaf within a shard.
LEAF = 256


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    # bytes.lower() touches A-Z alone, bytes.split() cuts at blanks and 0x09-0x0D alone
    words = text.encode().lower().split()
    if not words:
        return 0
    parts = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) > shingle else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(p), seed) for p in parts), np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fp", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``df`` with the 64-bit fingerprint of each text as a long (its bits taken as signed)."""

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            values = np.array([fingerprint(t, shingle, seed) if t else 0 for t in texts.to_pylist()], np.uint64)
            return [pa.array(values.view(np.int64))]

        return fn

    return add_columns(df, [text_col], [T.StructField(out_col, T.LongType())], make)


def distances(points: np.ndarray, to: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


class Shards:
    """Vantage-point tree whose leaves are shards; inner nodes are (vantage, bound): near side up to the bound."""

    def __init__(self, sample: np.ndarray, wanted: int) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves = 0
        self.root = self.build(sample, wanted)

    def build(self, points: np.ndarray, wanted: int) -> int:
        """A non-negative number is an inner node, a negative one the shard ``-1 - n``."""
        best = None
        if wanted > 1 and len(points) > 8:
            for vantage in points[:: max(1, len(points) // 8)][:8]:
                d = distances(points, vantage)
                for bound in {int(np.median(d)), int(np.median(d)) - 1}:
                    near = int((d <= bound).sum())
                    # even halves first, then vantage points that few others are as far from as the bound
                    cost = abs(2 * near - len(points)) / len(points) + (np.abs(d - bound) <= 4).mean()
                    if 0 < near < len(points) and (best is None or cost < best[0]):
                        best = (cost, vantage, bound, d)
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, vantage, bound, d = best
        at = len(self.nodes)
        self.nodes.append((0, 0, 0, 0))
        near = self.build(points[d <= bound], (wanted + 1) // 2)
        far = self.build(points[d > bound], wanted // 2)
        self.nodes[at] = (int(vantage), bound, near, far)
        return at

    def place(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, home) of each point's own shard and of those after it that may hold a neighbour."""
        out, todo = [], [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, who, home = todo.pop()
            if not len(who):
                continue
            if node < 0:
                out.append((who, np.full(len(who), -1 - node), home))
                continue
            vantage, bound, near, far = self.nodes[node]
            d = distances(points[who], np.uint64(vantage))
            # A pair meets where its later member lives; leaves are numbered near side first.
            here = ((d <= bound) & home) | ((d - radius <= bound) & ~home)
            todo.append((near, who[here], home[here]))
            there = d + radius > bound
            todo.append((far, who[there], (home & (d > bound))[there]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: the least index of each component."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]


def local_links(members: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links among members and between members and visitors."""
    points = np.unique(np.concatenate([members, visitors]))
    label = np.arange(len(points))
    inner = np.unique(np.searchsorted(points, members))
    # Balls around a few members: their points are linked already and need not meet again.
    for vantage in inner[:: max(1, len(inner) // 32)]:
        ball = np.flatnonzero(distances(points, points[vantage]) <= radius)
        label = settle(label, ball, np.full(len(ball), vantage))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pending = 0
    todo = [(inner, np.arange(len(points)))]
    while todo:
        own, who = todo.pop()
        if not len(own) or not len(who):
            continue
        if len(own) > LEAF:
            for vantage in points[own[[0, len(own) // 2, -1]]]:
                d = distances(points[own], vantage)
                bound = int(np.median(d))
                bound -= bool((d <= bound).all())
                if (d <= bound).any() and (d > bound).any():
                    to = distances(points[who], vantage)
                    todo.append((own[d <= bound], who[to - radius <= bound]))
                    todo.append((own[d > bound], who[to + radius > bound]))
                    break
            else:
                todo += [(own[: len(own) // 2], who), (own[len(own) // 2 :], who)]
            continue
        common = np.bincount(np.unique(label[own], return_inverse=True)[1]).argmax()
        root = np.unique(label[own])[common]
        same = label[who] == root
        for mine, theirs in ((own, who[~same]), (own[label[own] != root], who[same])):
            if not len(mine):
                continue
            for at in range(0, len(theirs), 1 << 14):
                part = theirs[at : at + (1 << 14)]
                i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[mine][None, :]) <= radius)
                a, b = part[i], mine[j]
                new = label[a] != label[b]
                if new.any():
                    found.append((a[new], b[new]))
                    pending += int(new.sum())
                if pending > 1 << 18:
                    label, found, pending = settle(label, *map(np.concatenate, zip(*found, strict=True))), [], 0
    if found:
        label = settle(label, *map(np.concatenate, zip(*found, strict=True)))
    linked = np.flatnonzero(label != np.arange(len(points)))
    return points[linked], points[label[linked]]


def links(distinct: DataFrame, radius: int = 4, fp_col: str = "fp") -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints which chains of links connect.

    ``distinct`` has each fingerprint once, as a long.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    wanted = max(1, -(-n // SHARD))
    each, least, most = SAMPLE
    share = min(1.0, min(most, max(least, each * wanted)) / max(1, n))
    few = distinct.filter(F.pmod(F.xxhash64(fp_col), F.lit(1 << 30)) < share * (1 << 30)).select(fp_col).collect()
    sample = np.sort(np.array([r[0] for r in few], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xF1DE83E19937733D)
    shards = Shards(sample, wanted)
    # Of the fingerprints, this share of the sample visits a shard at most.
    some = sample[: SAMPLE[1]]
    visits = np.bincount(shards.place(some, radius)[1], minlength=1).max() / max(1, len(some))
    deals = max(1, round(n * visits / VISITORS))
    tree = spark.sparkContext.broadcast(shards)

    def packed(points: np.ndarray) -> pa.RecordBatch:
        """A row for each shard, deal and kind with the fingerprints' bytes; those at home go to every deal, visitors to one."""
        who, shard, home = tree.value.place(points, radius)
        deal = (points[who] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % deals
        deal[home] = 0
        key = (shard * deals + deal) * 2 + home
        order = np.argsort(key, kind="stable")
        key, values = key[order], points[who[order]]
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
            k, blob = int(key[a]), values[a:b].astype("<u8").tobytes()
            rows += [(k // 2 // deals, d, blob, k % 2 == 1) for d in (range(deals) if k % 2 else [k // 2 % deals])]
        cols = zip(*rows, strict=True) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["shard", "deal", "fps", "home"])

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for frame in frames:
            held.append(frame.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += len(held[-1])
            if size >= PACK:
                yield packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield packed(np.concatenate(held))

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        home = frame["home"].to_numpy(bool)
        members, visitors = (np.frombuffer(b"".join(frame["fps"][at]), "<u8").astype(np.uint64) for at in (home, ~home))
        a, b = local_links(members, visitors, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = distinct.select(F.col(fp_col).cast("long")).mapInArrow(place, "shard long, deal long, fps binary, home boolean")
    # The work is no matter of bytes, so the number of tasks is given: two for each group, as hashing spreads them unevenly.
    tasks = min(100_000, max(2 * shards.leaves * deals, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return placed.repartition(tasks, "shard", "deal").groupBy("shard", "deal").applyInPandas(within, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row per row of ``df``: its id, ``fp``, ``component`` (its smallest fingerprint) and ``component_id``, the smallest id that links reach."""
    rows = cut_lineage(fingerprints(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle=shingle).select("doc_id", "fp"))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    found = connected_components(links(distinct, radius))
    classes = cut_lineage(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component")))
    least = cut_lineage(classes.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size")))
    named = cut_lineage(join_counted(classes, least, "component", "size").select("fp", "n", "component", "component_id"))
    return join_counted(rows, named, "fp", "n").select(F.col("doc_id").alias(id_col), "fp", "component", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of ``df`` that stay if one document of each group of near-duplicates does: that of the smallest id.

    Rows of equal id are one document, of which the first text in order stays. Of a group of
    null ids alone, the row of the smallest fingerprint stays.
    """
    place, fp = fresh(df, "place", "fp")
    found = cut_lineage(near_duplicates(df, id_col, text_col, radius, shingle).withColumnRenamed(id_col, "id"))
    keep = found.filter("id = component_id").select(F.col("id").alias(id_col)).distinct()
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    named = df.join(keep, id_col, "left_semi").withColumn(place, first).filter(F.col(place) == 1).select(*df.columns)
    lost = found.filter("id is null and component_id is null and fp = component").select(F.col("fp").alias(fp)).distinct()
    without = fingerprints(df.filter(F.col(id_col).isNull()), text_col, fp, shingle).join(lost, fp)
    first = F.row_number().over(Window.partitionBy(fp).orderBy(text_col))
    return named.unionByName(without.withColumn(place, first).filter(F.col(place) == 1).select(*df.columns))

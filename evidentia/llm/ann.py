"""Nearest neighbours by a block matrix join.

Rows are packed into blocks: vectors scaled to unit length and rounded to int8, with their
originals beside them. Query blocks meet candidate blocks in an equi-join on a group of
candidate blocks, each candidate block once. For such a pair, one integer matrix product
gives all approximate cosines, and the rounding error of each is bounded:

    x = s_x (q_x + e_x), |e| <= 1/2  =>  |x.y - s_x s_y q_x.q_y| <= s_x s_y (|q_x|_1 / 2 + |q_y|_1 / 2 + d / 4)

Pairs whose upper bound reaches the k-th best lower bound of their query survive, and only they are
computed again in double precision. Heaps merge a query's best within a task, a window over
those few rows merges tasks. The search is exact.

Defined results: vectors that are null, of zero length, or hold null or non-finite
components take no part; those of a length other than the query's are no candidates; a
query never finds rows of its own id; repeated candidate ids keep their best row; rows with
a null id take no part; ties go to the smaller id; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block at most.
BLOCK = 2048
#: Queries whose heaps a task holds before it emits them.
HEAPS = 1 << 15
PACKED = "dim long, ids binary, vectors binary, codes binary, scales binary, sums binary"


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, and the sums of absolute codes."""
    # two divisions, so that very large and very small vectors neither overflow nor vanish
    top = np.abs(vectors).max(1, keepdims=True)
    unit = vectors / top
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.abs(codes.astype(np.int64)).sum(1)


def twins(ids: list[int], rows: list[np.ndarray], most: int) -> list[int]:
    """Places of a block without those of equal vectors that ``most`` smaller ids have: ties go to smaller ids, so those are in no result."""
    order = sorted(range(len(ids)), key=lambda n: ids[n])
    smaller: dict[bytes, set[int]] = {}
    keep = []
    for n in order:
        seen = smaller.setdefault(rows[n].tobytes(), set())
        if len(seen) < most:
            seen.add(ids[n])
            keep.append(n)
    return keep


def pack(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of usable vectors, by number of components; of equal ones in a block ``most`` stay."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, rows = held.pop(dim)
        if most:
            keep = twins(ids, rows, most)
            ids, rows = [ids[n] for n in keep], [rows[n] for n in keep]
        vectors = np.stack(rows)
        codes, scale, sums = quantise(vectors)
        cells = [np.array(ids, np.int64).tobytes(), vectors.tobytes(), codes.tobytes(), scale.tobytes(), sums.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["dim", "ids", "vectors", "codes", "scales", "sums"])

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i is None or not v.is_valid or not len(v) or v.values.null_count:
                continue
            row = np.asarray(v.values, dtype=np.float64)
            if not np.isfinite(row).all() or not row.any():
                continue
            ids, rows = held.setdefault(len(row), ([], []))
            ids.append(i), rows.append(row)
            if len(ids) >= BLOCK:
                yield block(len(row))
    for dim in list(held):
        yield block(dim)


def unpack(row: dict, side: str) -> tuple[np.ndarray, ...]:
    dim = row["dim"]
    read = lambda name, kind: np.frombuffer(row[f"{side}_{name}"], kind)
    return read("ids", np.int64), read("vectors", np.float64).reshape(-1, dim), read("codes", np.int8).reshape(-1, dim), read("scales", np.float64), read("sums", np.int64)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, components added in order; scaled first only where squares would overflow or vanish."""
    dot = lambda x, y: np.add.accumulate(x * y, axis=1)[:, -1]
    with np.errstate(all="ignore"):
        size = np.sqrt(dot(a, a) * dot(b, b))
        out = dot(a, b) / size
    odd = ~(np.isfinite(size) & (size > 1e-140) & np.isfinite(out))
    if odd.any():
        x, y = (v[odd] / np.abs(v[odd]).max(1, keepdims=True) for v in (a, b))
        out[odd] = dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))
    return out


def tile(query: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, cosine) of pairs that may be among a query's ``k`` nearest; ``floor`` has the k-th best so far."""
    ids, vectors, codes, scale, sums = query
    ids2, vectors2, codes2, scale2, sums2 = other
    dim = codes.shape[1]
    # Products of int8 codes are whole numbers that floats hold exactly up to 2**24 and doubles up to 2**53.
    kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
    product = (codes.astype(kind) @ codes2.astype(kind).T).astype(np.float64)
    unit = scale[:, None] * scale2[None, :]
    error = unit * (sums[:, None] / 2 + sums2[None, :] / 2 + dim / 4) + 1e-9
    product *= unit
    own = ids[:, None] == ids2[None, :]
    low = np.where(own, -np.inf, product - error)
    # Repeated ids could fill the k best, so the bound is that of distinct ids only if all are distinct.
    if len(np.unique(ids2)) == len(ids2) and len(ids2) >= k:
        floor = np.maximum(floor, np.partition(low, len(ids2) - k, axis=1)[:, len(ids2) - k])
    i, j = np.nonzero((product + error >= floor[:, None]) & ~own)
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        some = slice(at, at + (1 << 16))
        out[some] = cosines(vectors[i[some]], vectors2[j[some]])
    if len(np.unique(ids2)) == len(ids2) and len(i):
        order = np.lexsort((ids2[j], -out, i))
        first = np.flatnonzero(np.r_[True, np.diff(i[order]) > 0])
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        order = order[place < k]
        i, j, out = i[order], j[order], out[order]
    return i, j, out


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", groups: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine of each row for which ``is_query`` holds.

    ``groups`` is the number of groups of candidate blocks, each of which gets every query
    block once; more groups mean more tasks and more copies of the queries.
    """
    spark = df.sparkSession
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    queries = df.filter(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    names = ["ids", "vectors", "codes", "scales", "sums"]
    left = queries.mapInArrow(pack, PACKED).select("dim", *(F.col(n).alias(f"q_{n}") for n in names), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    right = rows.mapInArrow(partial(pack, most=k + 1), PACKED).select("dim", *(F.col(n).alias(f"c_{n}") for n in names), F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("part"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}

        def flush() -> pa.RecordBatch:
            flat = [(q, i, s) for q, heap in heaps.items() for s, i in heap]
            heaps.clear()
            q, i, s = zip(*flat, strict=True) if flat else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([-x for x in i], pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                query, other = unpack(row, "q"), unpack(row, "c")
                floor = np.array([heaps[q][0][0] if len(heaps.get(q, ())) == k else -np.inf for q in query[0].tolist()])
                i, j, score = tile(query, other, k, floor)
                for q, c, s in zip(query[0][i].tolist(), other[0][j].tolist(), score.tolist(), strict=True):
                    heap = heaps.setdefault(q, [])
                    # a heap of (score, -id): the least is the worst, ties worse for larger ids
                    twin = next((n for n, x in enumerate(heap) if x[1] == -c), None)
                    if twin is not None:
                        if heap[twin][0] < s:
                            heap[twin] = (s, -c)
                            heapq.heapify(heap)
                    elif len(heap) < k:
                        heapq.heappush(heap, (s, -c))
                    elif (s, -c) > heap[0]:
                        heapq.heapreplace(heap, (s, -c))
                if len(heaps) > HEAPS:
                    yield flush()
        yield flush()

    found = left.join(right, ["dim", "part"]).select("dim", *(f"{s}_{n}" for s in "qc" for n in names)).mapInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the query's rows, by brute force.
ORACLE = """
with v as (select vec_id, embedding::double[] as x from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(embedding, lambda y: y <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, max(list_cosine_similarity(q.x, c.x)) as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x) group by all),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

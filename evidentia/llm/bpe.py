"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged by a segment tree over its byte positions: a leaf
holds the rank of the pair that starts there, an inner node the leftmost minimum, the root
thus the next merge. A merge takes three point updates of logarithmic cost. Chunks between
blanks repeat in text, so their ids are memoised in a table of bounded size.

Defined results: a null or empty text has no ids and decodes to no bytes; texts of any
length are taken whole; a null list of ids decodes to null; column names that clash with
the output are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import add_columns

#: Entries of the memo of chunks and of that of pieces; full tables are emptied, results stay the same.
MEMO = 150_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one ``base64 rank`` pair a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always merge the leftmost pair of least rank."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1
    while size < n - 1:
        size *= 2
    none = size << 40
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    end = list(range(1, n + 1))
    before = list(range(-1, n))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            least = left if left < right else right
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    def pair(i: int, stop: int) -> int:
        rank = ranks.get(piece[i:stop])
        return none if rank is None else rank * size + i

    while tree[1] < none:
        i = tree[1] % size
        j = end[i]
        stop = end[i] = end[j]
        if j < n - 1:
            put(j, none)
        before[stop] = i
        put(i, pair(i, end[stop]) if stop < n else none)
        if before[i] >= 0:
            put(before[i], pair(before[i], stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Pairs:
    """Rank of the pair of two ids, by open addressing in arrays, so that many are looked up at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        rows = array("q")
        for t, rank in ranks.items():
            for k in range(1, len(t)):
                if t[:k] in ranks and t[k:] in ranks:
                    rows.extend((ranks[t[:k]], ranks[t[k:]], rank))
        left, right, rank = np.frombuffer(rows, np.int64).reshape(-1, 3).T if rows else np.zeros((3, 0), np.int64)
        self.bits = max(4, (2 * len(left)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, -1, np.int64)
        key = left << 32 | right
        slot, left_over = self.slot(key), np.arange(len(key))
        while len(left_over):
            at = slot[left_over]
            free = self.key[at] < 0
            self.key[at[free]] = key[left_over[free]]
            placed = self.key[at] == key[left_over]
            self.rank[at[placed]] = rank[left_over[placed]]
            left_over = left_over[~placed]
            slot[left_over] = slot[left_over] + 1 & (1 << self.bits) - 1

    def slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 where the pair is no token or an id is negative."""
        key = left << 32 | right
        slot = self.slot(key)
        found = self.key[slot]
        out = np.where(found == key, self.rank[slot], -1)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1
            found = self.key[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return np.where((left < 0) | (right < 0), -1, out)


def merge_many(pieces: list[bytes], byte_ids: np.ndarray, pairs: Pairs, size: int) -> list[bytes]:
    """Packed ids of pieces of 2 to ``size + 1`` bytes: ``merge`` on a row of segment trees, one merge in each a step."""
    n_rows, width = len(pieces), size + 1
    n = np.fromiter(map(len, pieces), np.int64, n_rows)
    token = byte_ids[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n_rows, width)]
    token = np.concatenate([token, np.full((n_rows, 1), -1, np.int64)], 1)
    place = np.arange(width + 1)
    token[place >= n[:, None]] = -1
    after = np.broadcast_to(np.minimum(place + 1, width), token.shape).copy()
    before = np.broadcast_to(place - 1, token.shape).copy()
    none = np.int64(size) << 32
    tree = np.full((n_rows, 2 * size), none, np.int64)
    rank = pairs(token[:, :size].ravel(), token[:, 1:width].ravel()).reshape(n_rows, size)
    tree[:, size:] = np.where(rank >= 0, rank * size + place[:size], none)
    level = size // 2
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level //= 2
    rows = np.flatnonzero(tree[:, 1] < none)
    while len(rows):
        root = tree[rows, 1]
        i, merged = root % size, root // size
        j = after[rows, i]
        k = after[rows, j]
        h = before[rows, i]
        token[rows, i], token[rows, j] = merged, -1
        after[rows, i], before[rows, k] = k, i
        right = pairs(merged, token[rows, k])
        left = pairs(np.where(h >= 0, token[rows, np.maximum(h, 0)], -1), merged)
        who = np.concatenate([rows, rows[j < size], rows[h >= 0]])
        leaf = size + np.concatenate([i, j[j < size], h[h >= 0]])
        ranks = np.concatenate([right, np.full(int((j < size).sum()), -1), left[h >= 0]])
        tree[who, leaf] = np.where(ranks >= 0, ranks * size + leaf - size, none)
        up = leaf >> 1
        while size > 1 and up[0]:
            tree[who, up] = np.minimum(tree[who, 2 * up], tree[who, 2 * up + 1])
            up >>= 1
        rows = rows[tree[rows, 1] < none]
    live = token >= 0
    packed = token[live].astype("<u4").tobytes()
    ends = (4 * np.cumsum(live.sum(1))).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Packed ids of many texts. Unknown pieces of a call are merged together."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.pairs = Pairs(ranks)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.runs = re.compile(r"\s ").search

    def learn(self, pieces: set[str]) -> None:
        """Put the packed ids of these pieces into the memo."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for text in pieces:
            raw = text.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.pieces[text] = rank.to_bytes(4, "little")
            elif len(raw) > 129:
                self.pieces[text] = np.array(merge(raw, self.ranks), "<u4").tobytes()
            else:
                by_size.setdefault(1 << (len(raw) - 2).bit_length(), []).append((text, raw))
        for size, group in by_size.items():
            step = (1 << 19) // size
            for at in range(0, len(group), step):
                part = group[at : at + step]
                self.pieces.update(zip([t for t, _ in part], merge_many([r for _, r in part], self.byte_ids, self.pairs, size), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        # No match of the pattern runs from a non-blank into a blank, so a text may be cut before
        # each blank that follows a non-blank; only runs of white space need the whole text.
        # A chunk's key ends in a blank if none stands before it.
        for memo in (self.pieces, self.chunks):
            if len(memo) >= MEMO:
                memo.clear()
        whole: dict[int, list[str]] = {}
        cut: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if self.runs(text):
                whole[i] = self.find(text)
            elif text:
                cut[i] = text.split(" ")
                cut[i][0] += " "
        found = {c: self.find(c[:-1] if c[-1:] == " " else " " + c) for c in set().union(*cut.values()).difference(self.chunks)}
        self.learn(set().union(*found.values(), *whole.values()).difference(self.pieces))
        get = self.pieces.__getitem__
        for c, pieces in found.items():
            self.chunks[c] = b"".join(map(get, pieces))
        out = [b""] * len(texts)
        for i, pieces in whole.items():
            out[i] = b"".join(map(get, pieces))
        get = self.chunks.__getitem__
        for i, chunks in cut.items():
            out[i] = b"".join(map(get, chunks))
        for memo in (self.pieces, self.chunks):
            for key in [k for k in found if len(k) > 200 and k in memo] if memo is self.chunks else [k for k in memo if len(k) > 200]:
                del memo[key]
        return out


class Decoder:
    """Bytes of many lists of packed ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size

    def decode(self, packed: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(packed), "<u4")
        size = self.size[ids]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        kind = np.int32 if max(total, len(self.blob)) < 1 << 31 else np.int64
        out = self.blob[np.arange(total, dtype=kind) + np.repeat((self.start[ids] - (stop - size)).astype(kind), size)].tobytes()
        ends = np.concatenate([[0], stop])[np.cumsum([0, *(len(x) // 4 for x in packed)])].tolist()
        return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", out_col: str = "ids", drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with the ids of each text, as little-endian unsigned 32-bit integers in a binary column.

    No special tokens: their strings in a text are ordinary text. ``ids_array`` unpacks the
    column. Columns in ``drop`` are not returned, so that texts need not come back.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        encoder = Encoder(shared.value, pattern)

        def fn(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(encoder.encode([t or "" for t in texts.to_pylist()]), pa.binary())]

        return fn

    return add_columns(df, [text_col], [T.StructField(out_col, T.BinaryType())], make, drop)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each list of packed ids stands for."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        decoder = Decoder(shared.value)

        def fn(ids: pa.Array) -> list[pa.Array]:
            packed = ids.to_pylist()
            return [pa.array([None if x is None else y for x, y in zip(packed, decoder.decode([x or b"" for x in packed]), strict=True)], pa.binary())]

        return fn

    return add_columns(df, [ids_col], [T.StructField(out_col, T.BinaryType())], make)


def ids_array(packed: Column) -> Column:
    """Packed ids as an array of longs."""
    digits = F.hex(packed)
    byte = lambda i, k: F.substr(digits, i * 8 + 2 * k + 1, F.lit(2))
    one = lambda i: F.conv(F.concat(*(byte(i, k) for k in (3, 2, 1, 0))), 16, 10).cast("long")
    at = F.sequence(F.lit(0), (F.length(packed) / 4).cast("int") - 1)
    return F.when(F.length(packed) == 0, F.array().cast("array<long>")).otherwise(F.transform(at, one))

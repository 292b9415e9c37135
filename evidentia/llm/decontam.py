"""Benchmark decontamination by SimHash over item-sized windows.

Texts become words (runs of letters and digits, lower-cased) and word shingles. A document
window that resembles an item shares a shingle with it, so windows are laid where a shingle
of an item occurs, aligned as that shingle stands in the item and as long as the item; tests
compare them with all windows at all places. Each window gets a 64-bit SimHash of its shingles, weighted by how often they occur. With the
fingerprint cut into ``RADIUS + 1`` blocks, two fingerprints that differ in ``RADIUS`` bits or
fewer agree in a block, so an equi-join on blocks finds all pairs within the radius. As blocks
of three bits agree by chance, a window carries the items that laid it, and the join is on item,
block and value: it meets no item that it shares no shingle with. What meets is verified exactly
by the weighted Jaccard similarity of the shingles.

At a similarity of 0.8 fingerprints differ in 9.7 bits on average with a standard deviation
of 2.9, so the radius of 20 loses fewer than one window in ten thousand at the very threshold.
The shared shingle finds the places, and the fingerprints leave few items to compare at each.

DataFrame operations only; texts and items of any length are read whole, an item's windows in
time about linear in its length. Defined results: null and wordless texts match nothing; items of
fewer than five words count as one shingle; windows are cut off at a document's ends; a
result row is a distinct document id and item id, with its best window, the earliest of
equally good ones; documents of equal id are told apart by text, and share result rows; null
ids are one more id; items of equal id and different texts are one item of several texts; further
columns, whatever their names, do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage

SHINGLE, LEAST, RADIUS = 5, 0.8, 20
#: Item shingles that are broadcast at once; more are dealt to several passes over the documents.
BROADCAST = 1_000_000

NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " ")), " ")


def shingles(of: Column, width: Column) -> Column:
    """Shingles of ``width`` words; one of all words where there are fewer."""
    last = F.greatest(F.size(of) - width, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(of, i + 1, width), " "))


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint of hashes, each counted as often as it occurs: a bit is set if it is in over half of them.

    Bits are counted four at a time, in 16-bit lanes of 16 numbers; of 32,768 hashes or more, two at a time in 32-bit lanes.
    """

    shift = lambda x, by: F.call_function("shiftrightunsigned", x, by)

    def counted(lanes: int) -> Column:
        width = 64 // lanes
        ones = F.lit(sum(1 << width * k for k in range(lanes)))
        zero = F.array_repeat(F.lit(0).cast("long"), width)
        add = lambda n, h: F.transform(n, lambda x, k: x + shift(h, k).bitwiseAND(ones))
        often = lambda n, b: shift(F.get(n, b % width), b - b % width).bitwiseAND(F.lit((1 << width) - 1))
        bit = lambda n, b: F.when(often(n, b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(hashes, zero, add, lambda n: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda fp, b: fp.bitwiseOR(bit(n, b))))

    return F.when(F.size(hashes) < 1 << 15, counted(4)).otherwise(counted(2))


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """The values of ``radius + 1`` blocks, whose widths differ by one bit at most."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return F.array(*(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays, an element's weight being how often it occurs; one pass over both in order."""
    side = lambda xs, one, other: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(one).alias("a"), F.lit(other).alias("b")))
    both = F.array_sort(F.concat(side(a, 1, 0), side(b, 0, 1)))
    zero = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))

    def step(at: Column, e: Column) -> Column:
        same = at["x"].eqNullSafe(e["x"])
        kept = lambda k: F.when(same, at[k] + e[k]).otherwise(e[k]).alias(k)
        return F.struct(e["x"].alias("x"), kept("a"), kept("b"), F.when(same, at["n"]).otherwise(at["n"] + F.least(at["a"], at["b"])).alias("n"))

    common = F.aggregate(both, zero, step, lambda at: at["n"] + F.least(at["a"], at["b"]))
    return common / (F.size(a) + F.size(b) - common)


def prints(df: DataFrame) -> DataFrame:
    """``df`` with the shingles, fingerprint and blocks of ``words``, given ``width``."""
    df = df.withColumn("shingles", shingles(F.col("words"), F.col("width")))
    df = df.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s)))
    df = df.withColumn("fp", simhash(F.col("hashes")))
    return df.withColumn("blocks", blocks(F.col("fp")))


def windows(docs: DataFrame, wanted: DataFrame, widths: list[int]) -> DataFrame:
    """Distinct windows (doc_id, text_hash, size, width, start, words, by) where wanted shingles (hash, width, size, place, item) occur; ``by`` has their items."""
    text = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    found = []
    for width in widths:
        # The words stay a reference within one stage: only matching rows copy their window out.
        at = text.filter(F.size("words") >= width).select("*", F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("at"))
        hashed = at.withColumn("hash", F.xxhash64(*(F.get("words", F.col("at") + k) for k in range(width))))
        met = hashed.join(F.broadcast(wanted.filter(F.col("width") == width)), "hash")
        start = F.greatest(F.least(F.col("at") - F.col("place"), F.size("words") - F.col("size")), F.lit(0))
        found.append(met.select("doc_id", "text_hash", "size", "width", "item", start.alias("start"), F.slice("words", start + 1, F.col("size")).alias("words")))
    every = reduce(DataFrame.unionAll, found).groupBy("doc_id", "text_hash", "size", "width", "start").agg(F.first("words").alias("words"), F.collect_set("item").alias("by"))
    # What comes next is work on few bytes, so the number of tasks is given.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    return every.repartition(tasks, "doc_id", "text_hash", "size", "start")


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, similarity, start) of each document (doc_id, text) with a window at least ``least`` similar to an item (item_id, text); ``start`` counts words."""
    docs = docs.select("doc_id", "text")
    parts = items.filter("text is not null").select("item_id", words(F.col("text")).alias("words")).filter("words[0] <> ''")
    parts = parts.withColumn("size", F.size("words")).withColumn("width", F.least(F.size("words"), F.lit(shingle)))
    parts = cut_lineage(parts.withColumn("item", F.xxhash64("item_id", "words")))
    # Each item's shingles at their places: what windows are laid by.
    each = parts.select("item", "size", "width", "words", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("width"))).alias("place"))
    hashed = reduce(lambda rest, k: F.when(F.col("width") == k, F.xxhash64(*(F.get("words", F.col("place") + i) for i in range(k)))).otherwise(rest), range(1, shingle + 1), F.lit(None).cast("long"))
    wanted = cut_lineage(each.select(hashed.alias("hash"), "width", "size", "place", "item").distinct())
    widths = sorted(r.width for r in wanted.select("width").distinct().collect())  # five values at most
    if not widths:
        kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
        return docs.sparkSession.createDataFrame([], f"{kinds}, similarity double, start int")
    passes = -(-wanted.count() // BROADCAST)
    laid = reduce(DataFrame.unionAll, (windows(docs, wanted.filter(F.pmod(F.xxhash64("hash"), F.lit(passes)) == k), widths) for k in range(passes)))
    left = prints(laid).withColumn("item", F.explode("by")).select("doc_id", "text_hash", "start", "item", "shingles", "fp", "blocks", F.posexplode("blocks").alias("block", "value"))
    right = prints(parts).select("item_id", "item", F.col("shingles").alias("own"), F.col("fp").alias("own_fp"), F.col("blocks").alias("own_blocks"), F.posexplode("blocks").alias("block", "value"))
    met = left.join(right, ["item", "block", "value"])
    first = F.array_position(F.zip_with("blocks", "own_blocks", lambda x, y: x == y), True) == F.col("block") + 1
    near = met.filter(first & (F.bit_count(F.col("fp").bitwiseXOR(F.col("own_fp"))) <= RADIUS))
    sure = near.withColumn("similarity", similarity(F.col("shingles"), F.col("own"))).filter(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before")))
    return sure.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.before")).cast("int").alias("start"))


def _sql_words(text: str) -> str:
    return f"string_split(trim(regexp_replace(lower({text}), '{NOT_WORD}', ' ', 'g'), ' '), ' ')"


#: DuckDB SQL for the query's rows.
ORACLE = f"""
with i as (select item_id, w, len(w) as size, least(len(w), {SHINGLE}) as width from (select item_id, {_sql_words("text")} as w from benchmark where text is not null) where w[1] <> ''),
d as (select doc_id, text, {_sql_words("text")} as w from documents where text is not null),
ip as (select item_id, size, width, unnest(range(0, size - width + 1)) as place, w from i),
ish as (select item_id, size, width, place, array_to_string(w[place + 1 : place + width], ' ') as s from ip),
dp as (select doc_id, text, w, width, unnest(range(0, len(w) - width + 1)) as p from d, (select distinct width from i) where len(w) >= width),
dsh as (select doc_id, text, w, width, p, array_to_string(w[p + 1 : p + width], ' ') as s from dp),
laid as (select distinct doc_id, text, item_id, size, width, greatest(least(p - place, len(w) - size), 0) as start, w from dsh join ish using (s, width)),
own as (select item_id, s, count(*) as n from ish group by all),
win as (select *, w[start + 1 : start + size] as v from laid),
wp as (select doc_id, text, item_id, width, start, v, unnest(range(0, greatest(len(v) - width, 0) + 1)) as k from win),
ws as (select doc_id, text, item_id, start, array_to_string(v[k + 1 : k + width], ' ') as s, count(*) as n from wp group by all),
tot as (select doc_id, text, item_id, start, sum(n) as n from ws group by all),
com as (select ws.doc_id, ws.text, ws.item_id, ws.start, sum(least(ws.n, own.n)) as c from ws join own on own.item_id = ws.item_id and own.s = ws.s group by all),
sim as (select com.doc_id, com.item_id, com.start, com.c::double / (tot.n + (select sum(n) from own where own.item_id = com.item_id) - com.c)::double as similarity
  from com join tot on com.doc_id is not distinct from tot.doc_id and com.text = tot.text and com.item_id = tot.item_id and com.start = tot.start)
select doc_id, item_id, max(similarity) as similarity, arg_min(start, struct_pack(a := -similarity, b := start))::int as start
from sim where similarity >= {LEAST} group by all
"""

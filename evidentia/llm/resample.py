"""Importance resampling towards a target distribution of hashed word features.

A streaming CRC ring scans each document once. It keeps running zlib states for the last ``longest``
starts of a run of words and extends each by a space and the next word, so every state is the
checksum of a run, and its bucket leaves the scan. The buckets of a document are written, packed;
corpus totals, gains of the buckets and weights of the documents come from them without another
look at the texts. The ring holds ``longest`` states whatever the text's length.

A document's score is its mean gain plus Gumbel noise drawn from its id, so the highest scores are a
sample without replacement that favours documents like the target.

Defined results: a null text has no words, weight 0 and no rank; a null id is the empty string for the
noise; rows alike in all of id, features, weight and score share their ranks in any order; texts of any
length are read whole; further columns are ignored whatever their names; an empty table gives an
empty table, and without a target all gains follow from counts of 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage, fresh, release, running, ship, slices

#: Bytes: A-Z become lower case; all else of ASCII but letters and digits parts words.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8; of ASCII only letters and digits make words, and all beyond it does."""
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split()


def ring(tokens: list[bytes], longest: int) -> list[int]:
    """CRC-32 of every run of up to ``longest`` words joined by a space, by where it ends."""
    if longest == 1:
        return [zlib.crc32(w) for w in tokens]
    out: list[int] = []
    states: list[int] = []
    for w in tokens:
        more = b" " + w
        states = [zlib.crc32(w), *(zlib.crc32(more, s) for s in states[: longest - 1])]
        out += states
    return out


def packed(buckets: int) -> str:
    """Numpy's type of packed bucket numbers."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


def scan(df: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(id, n_words, n_features, buckets) of each row, the bucket numbers packed."""
    kind = packed(buckets)
    schema = f"id {df.schema[id_col].dataType.simpleString()}, n_words long, n_features long, buckets binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, found = [], []
                for text in part.column("text").to_pylist():
                    own = words(text or "")
                    n.append(len(own))
                    found.append((np.array(ring(own, longest), np.uint32) % buckets).astype(kind).tobytes())
                size = np.dtype(kind).itemsize
                features = [len(x) // size for x in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(features, pa.int64()), pa.array(found, pa.binary())], ["id", "n_words", "n_features", "buckets"])
        release()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def totals(scanned: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name) how many features fall into a bucket; a task counts all its rows first."""
    kind = packed(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                n += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    return scanned.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(own: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the log of how much likelier it is in the target, each count raised by one."""
    every = own.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    counted = every.join(own, "bucket", "left").join(target, "bucket", "left").na.fill(0)
    whole = counted.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    real = lambda c, more: (F.col(c) + more).cast("double")
    ratio = real("t", 1) * real("all_s", buckets) / (real("s", 1) * real("all_t", buckets))
    return counted.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row of sums


def weigh(scanned: DataFrame, gain: list[int], buckets: int) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean of a document's gains."""
    kind = packed(buckets)
    known = scanned.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (np.frombuffer(x.as_buffer(), kind) for x in batch.column("buckets"))
            weight = [int(known.value[x].sum()) // len(x) if len(x) else 0 for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight, pa.int64())], ["id", "n_words", "n_features", "weight"])

    kinds = scanned.schema["id"].dataType.simpleString()
    return scanned.mapInArrow(run, f"id {kinds}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise times 1000, floored, from a seed and an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = 2,
    buckets: int = 10_000,
    share: int = 10,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of ``df``; ``rank`` numbers the drawn ones from 1 on, others have none.

    Of the documents of ``least_words`` words or more, ``share`` per cent are drawn, those of the
    highest scores, ties to the smaller id. ``target`` has texts in a column ``text``. The gains, one number a bucket,
    go through the driver.
    """
    ship(df.sparkSession)
    scanned = cut_lineage(scan(df, id_col, text_col, longest, buckets))
    wanted = scan(target.select(F.lit(0).alias("id"), "text"), "id", "text", longest, buckets)
    gain = [r.gain for r in gains(totals(scanned, buckets, "s"), totals(wanted, buckets, "t"), buckets).orderBy("bucket").collect()]
    scored = cut_lineage(weigh(scanned, gain, buckets).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), scanned)
    row = ["id", "n_features", "weight", "score"]
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * share // 100
    (place,) = fresh(scored, "place")
    # Rows alike in everything are counted first, as any number of them would be one task's.
    alike = cut_lineage(fit.groupBy(row).agg(F.count("*").alias("n")))
    order = [F.desc("score"), F.col("id"), F.col("n_features"), F.col("weight")]
    placed = running(alike, place, "n", order).select(*row, F.explode(F.sequence(F.col(place) + 1, F.col(place) + F.col("n"))).alias(place))
    rank = F.when(F.col(place) <= drawn, F.col(place)).alias("rank")
    rest = scored.filter(F.col("n_words") < least_words).select(*row, F.lit(None).cast("long").alias("rank"))
    return placed.select(*row, rank).unionAll(rest).withColumnRenamed("id", id_col)


def _sql_buckets(rows: str) -> str:
    return f"select b.bucket, count(*) as n from {rows} join b on b.w = {rows}.w group by all"


#: DuckDB SQL for the query's rows; the checksum goes byte by byte through the table of its polynomial.
ORACLE = f"""
with tab as (select list(c order by i) as tab from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from range(256) r(i))),
d as (select row_number() over () as row_no, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as ws from documents),
dw as (select row_no, unnest(ws) as w from d),
bw as (select unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) as w from benchmark),
h as (select w, hex(encode(w)) as h from (select w from dw union select w from bw)),
b as (select w, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295::bigint) % 10000 as bucket from h, tab),
s as ({_sql_buckets("dw")}), t as ({_sql_buckets("bw")}),
n as (select (select sum(n) from s)::double as s, coalesce((select sum(n) from t), 0)::double as t),
g as (select r.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (n.s + 10000) / ((coalesce(s.n, 0) + 1)::double * (n.t + 10000))))::bigint as gain
  from (select unnest(range(10000)) as bucket) r left join s using (bucket) left join t on t.bucket = r.bucket, n),
w as (select row_no, count(*) as n_features, floor(sum(gain) / count(*)::double)::bigint as weight from dw join b using (w) join g using (bucket) group by row_no),
scored as (select row_no, doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5) / 4294967296.0)))::bigint as score from d left join w using (row_no)),
ranked as (select row_no, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= n * 10 // 100 then place end as rank from scored left join ranked using (row_no)
"""

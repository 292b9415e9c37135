"""Collocations: phrases whose words occur together more often than their parts would by chance.

Hierarchical pair naming. Frequent words get numbers; then, length by length, two neighbouring
frequent phrases of k - 1 words that overlap in all but their outer words form a pair, pairs are
counted over the whole corpus, and each frequent one gets a number by which it replaces the two
at its place. A number's two parents, its first and its last k - 1 words, lead to how often each
part of a phrase occurs, for any cut, and from a phrase to those that hold it.

A part of a frequent phrase is frequent, so nothing that counts is lost on the way. Tasks count in
Arrow before anything is shuffled. The table of names goes to the tasks where its size, which is
checked, is below NAMES rows and NAME_BYTES; a larger one is joined by shuffle, in which a frequent
name is no single task's.

Defined results: a null text is empty, a null language ``und``; repeated rows count each; texts
and words of any length are read whole; further columns are ignored whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage, join_counted, release, ship, slices

#: Rows and bytes of a table of names that is broadcast.
NAMES, NAME_BYTES = 1_000_000, 64 << 20
#: Rows of a task's counts before they leave it.
HELD = 500_000
#: Where a piece ends; the token that stands for it, which is no word.
BREAK, END = "[.,;:!?\n\x0b\x0c\r]", "."
#: Groups that a language's phrases are ranked in before all are.
SALTS = 64


def tokens(texts: pa.Array) -> pa.ListArray:
    """Lower-cased words of each text, END where a piece ends, thus at last; empty strings are no words."""
    closed = pc.binary_join_element_wise(pc.ascii_lower(texts.fill_null("")), END, "")
    return pc.ascii_split_whitespace(pc.replace_substring_regex(closed, BREAK, f" {END} "))


def flat(column: pa.Array) -> np.ndarray:
    """All numbers of a column of lists, one after another."""
    return column.flatten().to_numpy()


def gathered(parts: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts (keys, n) of parts, summed as far as a task holds them."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        out = pa.concat_tables(held).group_by(keys).aggregate([("n", "sum")])
        return out.rename_columns([*keys, "n"]).select([*keys, "n"])

    for part in parts:
        held.append(part)
        if sum(t.num_rows for t in held) > HELD:
            held = [summed()]
            if held[0].num_rows > HELD / 2:
                yield from held[0].to_batches(max_chunksize=10_000)
                held = []
    if held:
        yield from summed().to_batches(max_chunksize=10_000)
    release()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of documents (lang, text)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for part in slices(batch):
                lists = tokens(part.column("text"))
                words = lists.flatten()
                rows = pa.table({"lang": part.column("lang").take(pc.list_parent_indices(lists)), "word": words})
                rows = rows.filter(pc.and_(pc.not_equal(words, ""), pc.not_equal(words, END)))
                yield rows.group_by(["lang", "word"]).aggregate([([], "count_all")]).rename_columns(["lang", "word", "n"])

    return docs.mapInArrow(lambda batches: gathered(parts(batches), ["lang", "word"]), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame) -> DataFrame:
    """(a, b, n) of neighbouring names in documents (ids), in which 0 is no name."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            x = flat(batch.column("ids"))
            at = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
            pairs = pa.table({"a": x[at], "b": x[at + 1]})
            yield pairs.group_by(["a", "b"]).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"])

    return docs.mapInArrow(lambda batches: gathered(parts(batches), ["a", "b"]), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def few(names: DataFrame, *texts: str) -> bool:
    """Whether a table of names may be broadcast."""
    size = sum((F.octet_length(c) for c in texts), F.lit(8))
    n, most = names.agg(F.count("*"), F.sum(size)).first()
    return n <= NAMES and (most or 0) <= NAME_BYTES


def replaced(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Documents (ids) of names: ``make`` gives a function from a batch to list offsets and names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                offsets, names = work(part)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.int64()))], ["ids"])
        release()

    return docs.mapInArrow(run, "ids array<long>")


def put_back(found: DataFrame) -> DataFrame:
    """Documents (ids) from rows (row, at, id), where a null id is no name."""
    one = F.struct("at", F.coalesce("id", F.lit(0).cast("long")).alias("id"))
    return found.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("all")).select(F.transform("all", lambda x: x["id"]).alias("ids"))


def joined(rows: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """Rows (row, at, keys) with the id of names (keys, n, id), null where there is none. A frequent name's rows meet it by broadcast."""
    key = F.struct(*keys).alias("key")
    held = cut_lineage(rows.select("row", "at", key))
    known = join_counted(held, cut_lineage(names.select(key, "id", "n")), "key", "n").select("row", "at", "id")
    return held.select("row", "at").join(known, ["row", "at"], "left")


def name_words(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Documents (lang, text) as numbers of names (lang, word, n, id); 0 for other words and where a piece ends."""
    if not few(names, "lang", "word"):

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("lang"), tokens(part.column("text"))], ["row", "lang", "words"])

        words = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "lang", "text").mapInArrow(split, "row long, lang string, words array<string>")
        every = words.select("row", "lang", F.posexplode(F.filter("words", lambda w: w != "")).alias("at", "word"))
        return put_back(joined(every, names, "lang", "word"))
    table = names.select("lang", "word", "id").toArrow()
    own = {lang: table.filter(pc.equal(table["lang"], lang)) for lang in table["lang"].unique().to_pylist()}
    known = docs.sparkSession.sparkContext.broadcast({lang: (t["word"].combine_chunks(), t["id"].to_numpy()) for lang, t in own.items()})

    def make() -> Callable:
        def work(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            lists = tokens(part.column("text"))
            words, rows = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            langs = part.column("lang").dictionary_encode()
            code, ids = langs.indices.to_numpy()[rows], np.zeros(len(words), np.int64)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                if lang in known.value:
                    at = np.flatnonzero(code == k)
                    value, number = known.value[lang]
                    place = pc.index_in(words.take(pa.array(at)), value_set=value).fill_null(-1).to_numpy()
                    ids[at] = np.where(place < 0, 0, number[place])
            real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            return np.concatenate([[0], np.cumsum(np.bincount(rows[real], minlength=part.num_rows))]), ids[real]

        return work

    return replaced(docs.select("lang", "text"), make)


def name_pairs(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Documents (ids) in which pairs of neighbours are replaced by the numbers of names (a, b, n, id); 0 for other pairs."""
    if not few(names):
        rows = docs.withColumn("row", F.monotonically_increasing_id())
        pairs = rows.select("row", F.posexplode(F.arrays_zip(F.col("ids").alias("a"), F.expr("slice(ids, 2, size(ids))").alias("b"))).alias("at", "x"))
        return put_back(joined(pairs.select("row", "at", "x.a", "x.b"), names, "a", "b"))
    table = names.select("a", "b", "id").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("a", "b", "id")))

    def make() -> Callable:
        a, b, number = known.value
        firsts, lasts = np.unique(a), np.unique(b)
        # Places among the first and the last halves make one key, whatever the size of the numbers.
        keys = np.searchsorted(firsts, a) * len(lasts) + np.searchsorted(lasts, b)
        order = np.argsort(keys)
        keys, number = keys[order], number[order]

        def place(values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = np.minimum(np.searchsorted(values, x), len(values) - 1)
            return p, values[p] == x

        def work(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            lists = part.column("ids")
            x = flat(lists)
            out = np.zeros(len(x), np.int64)
            at = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0)) if len(keys) else np.zeros(0, int)
            if len(at):
                (p, first), (q, last) = place(firsts, x[at]), place(lasts, x[at + 1])
                k, pair = place(keys, p * len(lasts) + q)
                fine = first & last & pair
                out[at[fine]] = number[k[fine]]
            offsets = lists.offsets.to_numpy()
            return offsets - offsets[0], out

        return work

    return replaced(docs, make)


def numbered(counts: DataFrame, least: int) -> DataFrame:
    """Counts of at least ``least``, written with a positive number ``id`` for each; numbers need not be without gaps."""
    return cut_lineage(counts.filter(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id() + 1))


def levels(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Counts (lang, word, n) of all words, and for each length the frequent phrases: (lang, word, n, id), then (a, b, n, id) with their parents' numbers."""
    words = cut_lineage(word_counts(docs))
    found = [numbered(words, least)]
    now = cut_lineage(name_words(docs, found[0]))
    for k in range(2, longest + 1):
        found.append(numbered(pair_counts(now), least))
        if k < longest:
            now = cut_lineage(name_pairs(now, found[-1]), now)
    return words, found


def weakest(length: int, pre: str, suf: str, n: str, total: str) -> Column:
    """(score, k, l, r) of the cut of lowest score: after k words, the first of them if several are. Products of 38 digits are exact."""
    exact = lambda c: c.cast("decimal(38,0)")

    def cut(k: int) -> Column:
        left, right = F.get(pre, F.lit(k - 1)), F.get(suf, F.lit(length - k - 1))
        score = F.call_function("div", exact(F.lit(1000)) * exact(F.col(n)) * exact(F.col(total)), exact(left) * exact(right))
        return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*(cut(k) for k in range(1, length))))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, share: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of 2 to ``longest`` words that occur ``least`` times or more.

    ``a``, ``l`` and ``r`` are how often the phrase and the two sides of its weakest cut occur,
    ``n`` how many words the language has. A phrase within a longer one that occurs at least
    ``share`` per cent as often is left out; the longer one need not be one word longer, but then
    one of that length occurs no less often.
    """
    ship(df.sparkSession)
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words, found = levels(docs, longest, least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n_words"))
    none = F.array().cast("array<long>")
    now = found[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("pre"), none.alias("suf"))
    out = []
    for k in range(2, longest + 1):
        side = lambda name, now=now: now.select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in now.columns if c != "id"))
        both = found[k - 1].join(side("a"), "a").join(side("b"), "b")
        now = cut_lineage(both.select("id", F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_phrase", "b_last").alias("phrase"), F.col("b_last").alias("last"), "n", F.concat("a_pre", F.array("a_n")).alias("pre"), F.concat("b_suf", F.array("b_n")).alias("suf")))
        kept = now
        if k < longest:
            longer = found[k].select(F.explode(F.array("a", "b")).alias("id"), F.col("n").alias("m")).groupBy("id").agg(F.max("m").alias("m"))
            kept = now.join(longer, "id", "left").filter(F.col("m").isNull() | (100 * F.col("m") < share * F.col("n")))
        scored = kept.join(totals, "lang").withColumn("cut", weakest(k, "pre", "suf", "n", "n_words"))
        out.append(scored.select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", F.col("n_words").alias("n"), "cut.score"))
    return reduce(DataFrame.unionAll, out)


def best(found: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language by score, count and phrase, with their rank; first of each of SALTS groups, so that no task ranks a language."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = salted.withColumn("rank", first).filter(F.col("rank") <= most).withColumn("rank", rank)
    return ranked.filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")



def _sql(longest: int = 5, least: int = 100, most: int = 2000) -> str:
    grams = " union all ".join(f"select lang, {k} as k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: w[i : i + {k} - 1])) as g from p where len(w) >= {k}" for k in range(1, longest + 1))
    cuts = " union all ".join(f"select c.lang, c.g, c.a, {j} as k, l.a as l, r.a as r from often c join often l on l.lang = c.lang and l.g = c.g[1:{j}] join often r on r.lang = c.lang and r.g = c.g[{j} + 1 : c.k] where c.k > {j}" for j in range(1, longest))
    return f"""
with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0b\\f\\r]')) as piece from documents),
p as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w from t),
size as (select lang, sum(len(w))::hugeint as n from p group by lang),
often as (select lang, k, g, count(*) as a from ({grams}) group by all having count(*) >= {least}),
longer as (select distinct s.lang, s.g from often s join often b on b.lang = s.lang and b.k = s.k + 1 and 100 * b.a >= 100 * s.a and (b.g[1:s.k] = s.g or b.g[2:b.k] = s.g)),
cut as ({cuts}),
scored as (select lang, g, a, n, min(struct_pack(score := (1000::hugeint * a * n) // (l::hugeint * r), k := k, l := l, r := r)) as c from cut join size using (lang) group by all),
kept as (select lang, array_to_string(g, ' ') as phrase, a, c.l as l, c.r as r, n::bigint as n, c.score::bigint as score from scored s where not exists (select 1 from longer x where x.lang = s.lang and x.g = s.g)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= {most}
"""


#: DuckDB SQL for the query's rows.
ORACLE = _sql()

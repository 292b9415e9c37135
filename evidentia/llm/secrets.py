"""Secrets in texts, judged by who else has them.

Detectors for assignments, access keys and long hexadecimal runs give the base spans, which
always stay. The method aggregates the hash of every candidate over the whole corpus, by
distinct repositories and distinct owners: what many owners hold, or very many repositories of
few owners, is an example that was copied around; the rest looks live. Candidates of further
shapes (tokens that services issue, private key headers) are added as ``other`` spans if they
look live and overlap no base span.

DataFrame operations only. Offsets are running sums of the lengths of the matches and of the
gaps between them, in code points, ends exclusive. Counts of a candidate that very many rows
hold reach them by broadcast. Defined results: a null text counts as empty; a null owner or
repository counts for none; repeated rows each keep their row; texts of any length, with any
number of matches, are read whole; columns named like those made here do not disturb; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage, join_counted

KINDS = ("assign", "access", "hex", "other")
#: Owners, and repositories, that a candidate may have and still look live.
MAX_OWNERS, MAX_REPOSITORIES = 3, 100

# Patterns that Java and RE2 read alike; upper and lower case are spelled out.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: Shorter runs fail as a whole and hold no longer one, so these two ask for the length at once.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
OTHER = "gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: Characters of an assigned value at least.
LEAST = 12

PIECE = "struct<kind:int,at:int,gap:int,size:int,secret:string>"


def pieces(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """For each match of a pattern the length of the gap before it, its own, and the text of ``group`` as the secret; a last gap has no secret."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), secret.alias("secret"))
    found = F.transform(rows, lambda x, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["whole"]), F.lit(0)).alias("size"), x["secret"].alias("secret")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{PIECE}>"))


def candidates(text: Column) -> Column:
    """The pieces of a text of all kinds."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(pieces(text, 0, ASSIGN, 2), pieces(text, 1, ACCESS), pieces(text, 2, HEX), pieces(text, 3, OTHER))


def located(each: DataFrame, *keep: str) -> DataFrame:
    """(row, kept columns, start, kind, end, base, hash) of pieces (row, x): secrets long enough, and ``other`` ones that overlap no base span."""
    before, now = Window.partitionBy("row", "x.kind").orderBy("x.at"), Window.partitionBy("row").orderBy("start", "kind")
    sizes = F.coalesce(F.sum("x.size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.sum("x.gap").over(before.rowsBetween(Window.unboundedPreceding, 0)) + sizes
    placed = each.repartition("row").select("row", *keep, "x.kind", "x.size", "x.secret", start.alias("start"))
    long = placed.filter(F.col("secret").isNotNull() & ((F.col("kind") > 0) | (F.length("secret") >= LEAST)))
    long = long.select("row", *keep, "start", "kind", (F.col("start") + F.col("size")).alias("end"), (F.col("kind") < 3).alias("base"), F.sha2("secret", 256).alias("hash"))
    # Of base spans, the last end before a span and the first start after it.
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(now.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(now.rowsBetween(1, Window.unboundedFollowing))
    clash = F.coalesce(F.col("reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("ahead") < F.col("end"), F.lit(False))
    return long.withColumn("reached", reached).withColumn("ahead", ahead).filter(F.col("base") | ~clash).drop("reached", "ahead")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners, n) of candidates (hash, repository, owner): distinct ones, counted in two steps, so that no task gathers a frequent hash, and all."""
    distinct = found.groupBy("hash").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"))
    return distinct.join(found.groupBy("hash").agg(F.count("*").alias("n")), "hash")


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "doc_id",
    owner_col: str = "source",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per row of ``df``: id and ``found``, an array of (start, kind, end, base, repositories, owners, live)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), candidates(F.col(text_col)).alias("raw"))
    # Texts are read once: what follows works on the candidates, written with a number for each row.
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    each = cut_lineage(located(rows.select("row", "repository", "owner", F.explode("raw").alias("x")), "repository", "owner"))
    known = cut_lineage(ownership(each))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    span = F.struct("start", "kind", "end", "base", "repositories", "owners", live.alias("live"))
    judged = join_counted(each, known, "hash", "n").filter(F.col("base") | live).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("found"))
    return rows.select("id", "row").join(judged, "row", "left").select(F.col("id").alias(id_col), F.coalesce("found", F.array().cast(judged.schema["found"].dataType)).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: Column) -> list[Column]:
    """Counts and digest of the base spans, all spans as text, how many look live or copied, and the most repositories and owners of one."""
    base = F.filter(found, lambda x: x["base"])
    count = lambda test, name: F.size(F.filter(found, test)).cast("long").alias(name)
    of_kind = lambda k: count(lambda x: x["base"] & (x["kind"] == k), f"n_{KINDS[k]}")
    kinds = [of_kind(k) for k in range(3)]
    most = lambda c: F.coalesce(F.array_max(F.transform(found, lambda x: x[c])), F.lit(0).cast("long")).alias(f"most_{c}")
    return [*kinds, F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans"), count(lambda x: x["live"], "n_live"), count(lambda x: ~x["live"], "n_copied"), most("repositories"), most("owners")]


def _sql_kind(kind: int, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    keep = f"length(s[i]) >= {LEAST}" if kind == 0 else "true"
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    return f"""
    select row_no, doc_id, source, {kind} as kind, {str(kind < 3).lower()} as base, s[i] as secret,
           {size("g[1:i]")} + {size("w[1:i-1]")} as a, {size("g[1:i]")} + {size("w[1:i]")} as b
    from (select *, unnest(range(1, len(w) + 1)) as i from (
        select row_no, doc_id, source, string_split_regex(text, '{quoted}') as g, regexp_extract_all(text, '{quoted}') as w, regexp_extract_all(text, '{quoted}', {group}) as s
        from rows_ where regexp_matches(text, '{quoted}')))
    where {keep}"""


#: DuckDB SQL for the query's rows.
ORACLE = f"""
with rows_ as (select row_number() over () as row_no, doc_id, source, coalesce(text, '') as text from documents),
raw as ({" union all ".join(_sql_kind(*x) for x in ((0, ASSIGN, 2), (1, ACCESS, 0), (2, HEX, 0), (3, OTHER, 0)))}),
fine as (select * from raw r where base or not exists (select 1 from raw q where q.row_no = r.row_no and q.base and q.a < r.b and r.a < q.b)),
owned as (select secret, count(distinct doc_id) as repositories, count(distinct source) as owners from fine group by secret),
verdict as (select *, owners <= {MAX_OWNERS} and repositories <= {MAX_REPOSITORIES} as live from owned),
judged as (select f.*, o.live, o.repositories, o.owners, list_extract({list(KINDS)}, f.kind + 1) || ':' || a || ':' || b as said from fine f join verdict o using (secret) where base or o.live),
agg as (select row_no, count(*) filter (base and kind = 0) as n_assign, count(*) filter (base and kind = 1) as n_access, count(*) filter (base and kind = 2) as n_hex,
    coalesce(string_agg(said, ',' order by a, kind) filter (base), '') as base_text, string_agg(said, ',' order by a, kind) as spans, count(*) filter (live) as n_live, count(*) filter (not live) as n_copied,
    max(repositories) as most_repositories, max(owners) as most_owners
  from judged group by row_no)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base_text, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied, coalesce(most_repositories, 0) as most_repositories, coalesce(most_owners, 0) as most_owners
from rows_ left join agg using (row_no)
"""

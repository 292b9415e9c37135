"""Text, LaTeX, HTML and JSON extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import latex, text as X
from evidentia.operators import strings as S
from evidentia.plans.registry import known, query, table

NUMBERS = ["d_s = 2", "value ≈ 1.98 here", "it gives -1.5 overall", "the ratio 3/2 holds", "no number", "x = . y 7/4", "equals 4", "→ −3"]


def strings(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def values(rows: list[str]) -> str:
    return "(values " + ", ".join("({}, '{}')".format(i, r.replace("'", "''")) for i, r in enumerate(rows)) + ") v(id, text)"


@query(f"""
with t as (select id, translate(lower(text), '−–', '--') as x from {values(NUMBERS)}), f as (select id, x, string_split(regexp_extract(x, '(-?[0-9]+/[0-9]+)', 1), '/') as p from t)
select id, coalesce(try_cast(regexp_extract(x, '(?:=|≈|→|\\\\approx|\\\\to|\\\\sim)\\s*(-?[0-9.]+)', 1) as double), try_cast(regexp_extract(x, '(?:equals?|gives?|yields?|predicts?|is)\\s+(-?[0-9.]+)', 1) as double), try_cast(p[1] as double) / try_cast(p[2] as double)) as number from f
""")
def number_from_text(spark: SparkSession, d: str) -> DataFrame:
    return strings(spark, NUMBERS).select("id", X.number_from_text(F.col("text")).alias("number"))


@query("""
with t as (select distinct l_discount / (1 + l_tax) as v from lineitem union select distinct l_quantity / 7.0 as v from lineitem),
f as (select v, min(k) as k from t, range(1, 21) r(k) where abs(round(v * k) / k - v) < 1e-6 group by v)
select round(t.v, 9) as v, case when k = 1 then round(t.v)::bigint::varchar when k is not null then round(t.v * k)::bigint::varchar || '/' || k::varchar end as fraction from t left join f using (v)
""")
def simple_fraction(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    rows = line.select((F.col("l_discount") / (1 + F.col("l_tax"))).alias("v")).union(line.select(F.col("l_quantity") / 7.0)).distinct()
    return rows.select(F.round("v", 9).alias("v"), X.simple_fraction(F.col("v")).alias("fraction"))


RULES = [("G_N", "G"), ("ell_P", "l_P"), ("hbar", "h"), ("[0-9]+", "#")]


@query("select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'the', 'G_N', 'g'), 'G_N', 'G', 'g'), 'hbar', 'h', 'g'), '[0-9]+', '#', 'g') as text from documents")
def regex_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.rewrite(F.col("text"), [("the", "G_N"), *RULES]).alias("text"))


MATH = [r"a \[ x^2 + y \] b \[ x^2 + y \]", "p $$ E = m c^2 $$ q $$ab$$", "none", "\\[\n z = 3 \n\\]"]


@query(f"""
with t as (select id, list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '(?s)\\\\\\[(.+?)\\\\\\]', 1), regexp_extract_all(text, '(?s)\\$\\$(.+?)\\$\\$', 1)), lambda x: trim(x, E' \\n')), lambda x: length(x) > 3)) as m from {values(MATH).replace(chr(10), "' || chr(10) || '")})
select id, array_to_string(list_sort(m), '|') as found from t
""")
def latex_display_math(spark: SparkSession, d: str) -> DataFrame:
    found = F.transform(latex.display_math(F.col("text")), lambda x: F.btrim(x, F.lit(" \n")))
    return strings(spark, MATH).select("id", F.array_join(F.array_sort(found), "|").alias("found"))


@query("""
select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) as heading, len(regexp_extract_all(html, '(<p[ >])'))::int as paragraphs from pages
""")
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    parts = latex.html_parts(F.col("html"))
    return table(spark, d, "pages").select("page_id", *(c.alias(k) for k, c in parts.items()))


@query("select event_type, count(*)::bigint as n, sum((props::json ->> 'k')::int)::bigint as total from events group by event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("p", X.json_props(F.col("props"), "k int"))
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


PAPER = [
    "\\documentclass{x}\\begin{document}intro % hidden \\begin{equation}no\\end{equation}\n\\section{First} see \\cite{a,b} and \\citep{c}\\begin{equation}\\label{eq:1} E = m c^2 \\end{equation} then \\begin{align*} a &= b \\end{align*}\n\\subsection{Main results} \\[ d_s = 2 \\] again \\[ d_s = 2 \\] 5\\% \\end{document} rest",
    "no math at all",
    "\\begin{eqnarray}x\\end{eqnarray} $$ S = \\frac{A}{4 G_N} $$",
]
CITING = [r"\cite{a,b} and \citep{c}", "none", r"\citet{b, a}\cite{a}", r"\cite{x:1,,y} \citex{z}", r"\cite{}"]


@query(
    known(
        "id int, latex varchar, environment varchar, label varchar, section varchar, before varchar, after varchar, position int",
        (0, 'E = m c^2', 'equation', 'eq:1', 'First', 'intro First see a,b and c', 'then align* a &= b align* Main results \\[ d_s = 2 \\] again \\[ d_s = 2 \\] 5\\%', 244),
        (0, 'a &= b', 'align*', '', 'First', 'intro First see a,b and c equation eq:1 E = m c^2 equation then', 'Main results \\[ d_s = 2 \\] again \\[ d_s = 2 \\] 5\\%', 526),
        (0, 'd_s = 2', 'displaymath', '', 'Main results', 'intro First see a,b and c equation eq:1 E = m c^2 equation then align* a &= b align* Main results', 'again \\[ d_s = 2 \\] 5\\%', 818),
        (2, 'S = \\frac{A}{4 G_N}', 'displaymath', '', 'preamble', 'eqnarrayx eqnarray', '', 561),
    )
)
def latex_equations(spark: SparkSession, d: str) -> DataFrame:
    return latex.equations(strings(spark, PAPER), "text").select("id", F.explode("equations").alias("e")).select("id", "e.*")


@query(
    known(
        "id int, place int, latex varchar, environment varchar, label varchar, section varchar, before varchar, after varchar, position int",
        (0, 1, 'd_s = 2', 'displaymath', '', 'Main results', 'intro First see a,b and c equation eq:1 E = m c^2 equation then align* a &= b align* Main results', 'again \\[ d_s = 2 \\] 5\\%', 818),
        (0, 2, 'E = m c^2', 'equation', 'eq:1', 'First', 'intro First see a,b and c', 'then align* a &= b align* Main results \\[ d_s = 2 \\] again \\[ d_s = 2 \\] 5\\%', 244),
        (2, 1, 'S = \\frac{A}{4 G_N}', 'displaymath', '', 'preamble', 'eqnarrayx eqnarray', '', 561),
    )
)
def key_equations(spark: SparkSession, d: str) -> DataFrame:
    return latex.key_equations(latex.equations(strings(spark, PAPER), "text"), "id", "equations", ["result", "conclusion"], 2)


@query(known("id int, keys varchar", (0, "a,b,c"), (1, ""), (2, "a,b"), (3, "x:1,y"), (4, "")))
def citation_keys(spark: SparkSession, d: str) -> DataFrame:
    return strings(spark, CITING).select("id", F.array_join(latex.citations(F.col("text")), ",").alias("keys"))


NOTATIONS = [
    (r"S = \frac{A}{4 G_N}", "S = ((A)/(4 G))"),
    (r"\ell_P^{2} \ln\left(x\right)", "l_P**(2) log(x)"),
    (r"\frac{1}{\frac{a}{b}}", "((1)/(((a)/(b))))"),
    (r"\sqrt{\hbar G_{N}}", "sqrt(hbar G)"),
    (r"\kappa^2 / (16 \pi) + \kappa x", "G + sqrt(16*pi*G) x"),
    (r"l_{\rm Pl} M_{\mathrm{Pl}} m_p", "l_P M_P M_P"),
    (r"\Lambda_{cc} - \lambda", "Lambda - Lambda"),
    (r"\gamma_{Immirzi} \beta_I", "gamma_I gamma_I"),
    (r"g_{\rm s}^2 l_s \alpha'", "g_s**2 sqrt(alpha_prime) alpha_prime"),
    (r"\theta_{NC} z_{HL} \to \infty", "theta_NC z_HL to oo"),
    (r"a \cdot b \times \exp\left[x\right]", "a * b * exp(x)"),
    (r"\alpha_{s} G_\mathrm{N} G_{\mathrm{N}}", "alpha_prime G G"),
]


@query(known("id int, plain varchar", *((i, plain) for i, (_, plain) in enumerate(NOTATIONS))))
def latex_to_expression(spark: SparkSession, d: str) -> DataFrame:
    return strings(spark, [said for said, _ in NOTATIONS]).select("id", latex.normalised(F.col("text")).alias("plain"))


INLINE = ["take $x + y$ and $x + y$ of $z$", r"a cost of \$5 and $$a + b$$", "$a b$ then $c = d$", "none"]


@query(known("id int, found varchar", (0, "x + y"), (1, ""), (2, "a b|c = d"), (3, "")))
def latex_inline_math(spark: SparkSession, d: str) -> DataFrame:
    return strings(spark, INLINE).select("id", F.array_join(latex.inline_math(F.col("text")), "|").alias("found"))


REPLIES = ['prose [1, 2] tail', '```json\n{"a": [1, {"b": "]"}]}\n```', "nothing", '[{"x": 1}, {"x"', '{"items": []}']


@query("select 0 as id, '[1, 2]' as found union all select 1, '{\"a\": [1, {\"b\": \"]\"}]}' union all select 2, null union all select 3, '{\"x\": 1}' union all select 4, '{\"items\": []}'")
def balanced_json(spark: SparkSession, d: str) -> DataFrame:
    return strings(spark, REPLIES).select("id", X.extract_json(X.code_fence(F.col("text"))).alias("found"))


@query("""
with w as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z_-]{2,}')) as w, unnest(range(1, 1 + len(regexp_extract_all(lower(text), '[a-z][a-z_-]{2,}')))) as i from benchmark),
k as (select item_id, w, row_number() over (partition by item_id order by length(w) desc, i) as r from w where not list_contains(string_split('STOP', ' '), w))
select b.item_id, coalesce(string_agg(w, ' ' order by r), '') as query from benchmark b left join (select * from k where r <= 8) k using (item_id) group by b.item_id
""".replace("STOP", " ".join(X.STOP_WORDS)))
def search_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", X.search_query(F.col("text")).alias("query"))


@query(
    known(
        "id int, p_name varchar, ratio double",
        (0, 'small ring', 0.888889),
        (1, 'blue bolt', 0.947368),
        (3, 'hot gear', 1.0),
    )
)
def fuzzy_best_match(spark: SparkSession, d: str) -> DataFrame:
    """The part name most like each of a few texts, if half alike; of names as much alike, the first by key."""
    asked = strings(spark, ["smal rng", "blue bolts", "zzzz", "hot gear"])
    found = S.best_alike(asked, table(spark, d, "part"), "text", "p_name", "p_partkey")
    return asked.join(found, "text").select("id", "p_name", F.round("ratio", 6).alias("ratio"))


#: The name that a page's host has below its domain.
HOST = r"://(?:[^/?#]*\.)?([^./?#]+)\.example\."


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.regexp_extract("url", HOST, 1).alias("host")).filter("host <> ''").distinct()


@query(f"""
with h as (select distinct regexp_extract(url, '{HOST}', 1) as host from pages) select distinct host, url from h join pages on contains(url, host) or contains(host, url) where host <> ''
""")
def substring_join(spark: SparkSession, d: str) -> DataFrame:
    """Every host's name with every url that names it, or is within it."""
    return S.substring_join(hosts(spark, d), table(spark, d, "pages"), "host", "url")


@query()
def fuzzy_join(spark: SparkSession, d: str) -> DataFrame:
    """For every host's name the benchmark word most like it, 0.6 at least; only Python can tell the ratio, so tests hold it against all pairs."""
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    return S.best_alike(hosts(spark, d), words, "host", "word", least=0.6)

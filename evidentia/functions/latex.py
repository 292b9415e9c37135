"""LaTeX and HTML sources: comments, equations with context, sections, citations, notation."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.text import rewrite

# Environments of displayed equations; starred forms are the same with a star.
ENVIRONMENTS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath")
def subscript(*names: str) -> str:
    either = "(?:" + "|".join(names) + ")"
    return rf"_(?:{either}(?![A-Za-z])|\{{(?:\\rm\s+)?{either}\}}|\{{\\(?:mathrm|rm|text)\{{{either}\}}\}}|\\mathrm\{{{either}\}})"


# What notation stands for, as rules in order. Subscripts may be bare, braced or in roman type.
NOTATION: Sequence[tuple[str, str]] = (
    # Newton's constant
    (r"\\kappa\^2\s*/\s*\(?\s*16\s*\\pi\s*\)?", "G"),
    (r"\\kappa\^2\s*/\s*\(?\s*8\s*\\pi\s*\)?", "2*G"),
    (r"\\kappa\^2", "16*pi*G"),
    (r"\\kappa(?![a-zA-Z])", "sqrt(16*pi*G)"),
    ("G" + subscript("N"), "G"),
    # Planck length and mass
    (r"(?:\\ell|(?<![A-Za-z\\])l)" + subscript("[pP]l?"), "l_P"),
    (r"(?<![A-Za-z\\])[mM]" + subscript("[pP]l?"), "M_P"),
    # Cosmological constant, Planck's constant, Immirzi parameter
    (r"\\Lambda(?:" + subscript("cc", "cosm") + ")?", "Lambda"),
    (r"\\lambda(?![a-zA-Z])", "Lambda"),
    (r"\\hbar", "hbar"),
    (r"\\(?:gamma|beta)" + subscript("I", "Immirzi"), "gamma_I"),
    # String theory, noncommutative geometry, anisotropic scaling
    (r"\\alpha'|\\alpha" + subscript("s"), "alpha_prime"),
    ("(?<![A-Za-z])g" + subscript("s"), "g_s"),
    ("(?<![A-Za-z])l" + subscript("s"), "sqrt(alpha_prime)"),
    (r"\\theta" + subscript("NC"), "theta_NC"),
    ("(?<![A-Za-z])z" + subscript("HL"), "z_HL"),
    # Delimiters, then common mathematics; fractions nest two deep
    (r"\\left\[", "("),
    (r"\\right\]", ")"),
    (r"\\left|\\right", ""),
    (r"\\(?:mathrm|rm|text)\s*\{([^{}]*)\}", "$1"),
    (r"\\d?frac\{([^{}]+)\}\{([^{}]+)\}", "(($1)/($2))"),
    (r"\\d?frac\{([^{}]+)\}\{([^{}]+)\}", "(($1)/($2))"),
    (r"\\sqrt\{([^{}]+)\}", "sqrt($1)"),
    (r"\\ln|\\log", "log"),
    (r"\\exp", "exp"),
    (r"\\pi", "pi"),
    (r"\\infty", "oo"),
    (r"\\cdot|\\times", "*"),
    (r"\^\{([^{}]*)\}", "**($1)"),
    (r"\^", "**"),
    (r"[{}]", ""),
    (r"\\([A-Za-z]+)", "$1"),
)
SECTION = r"\\(?:sub){0,2}section\*?\{([^}]+)\}"

EQUATIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("latex", T.StringType()),
            T.StructField("environment", T.StringType()),
            T.StructField("label", T.StringType()),
            T.StructField("section", T.StringType()),
            T.StructField("before", T.StringType()),
            T.StructField("after", T.StringType()),
            T.StructField("position", T.IntegerType()),
        ]
    )
)


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)(?<!\\)%.*$", "")


def body(text: Column) -> Column:
    """What the document environment holds, else the whole text."""
    inner = F.regexp_extract(text, r"(?s)\\begin\{document\}(.+?)\\end\{document\}", 1)
    return F.when(inner != "", inner).otherwise(text)


def display_math(text: Column) -> Column:
    """Distinct displayed equations between brackets or double dollars, of more than three characters."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"(?s)\\\[(.+?)\\\]"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1)))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) > 3))


def inline_math(text: Column) -> Column:
    """Distinct equations between single dollars, of more than a character; escaped and double dollars bound none."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(?<![\\$])\$(?!\$)([^$]+?)(?<![\\$])\$(?!\$)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) > 1))


def citations(text: Column) -> Column:
    """Distinct keys of citation commands, sorted."""
    groups = F.regexp_extract_all(text, F.lit(r"\\cite[tp]?\{([^}]+)\}"), F.lit(1))
    keys = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(keys, lambda x: F.trim(x)), lambda k: k != "")))


def normalised(text: Column) -> Column:
    """Notation rewritten to a plain expression; fractions nest two deep."""
    return F.trim(F.regexp_replace(rewrite(text, NOTATION), r"\s+", " "))


_ENVIRONMENT = re.compile(rf"\\begin\{{((?:{'|'.join(ENVIRONMENTS)})\*?)\}}(.*?)\\end\{{\1\}}", re.S)
_BRACKETS = re.compile(r"\\\[(.+?)\\\]|(?<!\\)\$\$(.+?)\$\$", re.S)


def _plain(text: str) -> str:
    return " ".join(re.sub(r"\\[a-zA-Z]+\{", " ", text).replace("{", "").replace("}", "").split())


def parse_equations(text: str | None, context: int = 300) -> list[dict]:
    """Distinct displayed equations in order of place, with label, section, context and place in thousandths."""
    text = text or ""
    heads = [(m.start(), m[1]) for m in re.finditer(SECTION, text)]
    found = [(m.start(), m.end(), m[1], m[2]) for m in _ENVIRONMENT.finditer(text)]
    taken = [(a, b) for a, b, _, _ in found]
    found += [(m.start(), m.end(), "displaymath", m[1] or m[2]) for m in _BRACKETS.finditer(text) if not any(a <= m.start() < b for a, b in taken)]
    out, seen = [], set()
    for start, end, kind, inner in sorted(found):
        label = re.search(r"\\label\{([^}]+)\}", inner)
        latex = re.sub(r"\\(?:label|tag)\{[^}]+\}", "", inner).strip()
        if len(latex) < 3 or latex in seen:
            continue
        seen.add(latex)
        section = next((name for at, name in reversed(heads) if at <= start), "preamble")
        out.append({"latex": latex, "environment": kind, "label": label[1] if label else "", "section": section, "before": _plain(text[max(0, start - context) : start]), "after": _plain(text[end : end + context]), "position": 1000 * start // max(1, len(text))})
    return out


def equations(df: DataFrame, text: str, out: str = "equations", context: int = 300) -> DataFrame:
    """``df`` with the displayed equations of its comment-free bodies, by Arrow batches, as their places matter."""
    @F.pandas_udf(EQUATIONS)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parse_equations(t, context))

    return df.withColumn(out, parse(body(without_comments(F.col(text)))))


def key_equations(df: DataFrame, item: str, equations_col: str, priority: Sequence[str], most: int) -> DataFrame:
    """The ``most`` equations of each item: those in priority sections first, then labelled ones, then by place."""
    each = df.select(item, F.posexplode(equations_col).alias("at", "e"))
    low = F.lower("e.section")
    prior = F.lit(False)
    for word in priority:
        prior = prior | low.contains(word)
    place = F.row_number().over(Window.partitionBy(item).orderBy(~prior, F.col("e.label") == "", "at"))
    return each.withColumn("place", place).filter(F.col("place") <= most).select(item, "place", "e.*")


def html_parts(html: Column) -> dict[str, Column]:
    """Title, first heading and number of paragraphs of a page."""
    return {
        "title": F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1),
        "heading": F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1),
        "paragraphs": F.size(F.regexp_extract_all(html, F.lit(r"(<p[ >])"), F.lit(1))),
    }

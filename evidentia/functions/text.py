"""Column functions over text: words, overlaps, numbers, fractions, JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no content.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during",
    "before", "after", "above", "below", "between", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "and", "but", "or", "if", "that", "this", "these", "those", "it", "its", "what", "which", "who",
    "whom",
]
# Words that signal a simpler premise.
SIMPLER = ("unify", "unification", "single", "simpler", "reduce", "eliminate", "remove", "drop", "one", "emergent", "derive", "recover", "explain", "subsume")
# Combinations of words that contradict established results.
RED_FLAGS = (
    ("violat", "lorentz invariance", "low energy"),
    ("break", "unitarity"),
    ("violat", "energy conservation"),
    ("contradict", "equivalence principle"),
    ("negative", "entropy"),
    ("superluminal", "signal"),
    ("violat", "second law"),
    ("perpetual motion",),
)


def words_of(text: Column) -> Column:
    """Words of three letters or more, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z_-]{2,})"), F.lit(1))


def content_words(text: Column) -> Column:
    """Words of three letters or more that are no stop words, repeats included."""
    return F.filter(words_of(text), lambda w: ~w.isin(*STOP_WORDS))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the smaller set; null if a set is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y)))


def containment(words: Column, reference: Column) -> Column:
    """Share of the reference's distinct words that the other text has; null if it has none."""
    r = F.array_distinct(reference)
    return F.try_divide(F.size(F.array_intersect(F.array_distinct(words), r)), F.size(r))


def keyword_score(text: Column, keywords: Sequence[str], share: float = 0.4) -> Column:
    """Keywords that occur, over ``share`` of their number (one at least), one at most."""
    low = F.lower(text)
    hits = reduce(Column.__add__, (low.contains(k).cast("int") for k in keywords))
    return F.least(hits / max(len(keywords) * share, 1.0), F.lit(1.0))


def best_label(text: Column, labelled: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Struct (score, label) of the best keyword score, the first label winning ties."""
    scored = F.array(*(F.struct(keyword_score(text, words).alias("score"), F.lit(-i).alias("_i"), F.lit(label).alias("label")) for i, (label, words) in enumerate(labelled)))
    best = F.array_max(scored)
    return F.struct(best["score"].alias("score"), best["label"].alias("label"))


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def simplification(current: Column, proposed: Column) -> Column:
    """Half the length ratio, capped at two and halved, half the hits among simplifying words, three being full."""
    ratio = F.greatest(word_count(current), F.lit(1)) / F.greatest(word_count(proposed), F.lit(1))
    hits = reduce(Column.__add__, (F.lower(proposed).contains(k).cast("int") for k in SIMPLER))
    return 0.5 * F.least(ratio, F.lit(2.0)) / 2.0 + 0.5 * F.least(hits / 3.0, F.lit(1.0))


def search_query(text: Column, most: int = 8) -> Column:
    """The longest content words, in order of length, then of occurrence."""
    ranked = F.array_sort(F.transform(content_words(text), lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.array_join(F.transform(F.slice(ranked, 1, most), lambda r: r["w"]), " ")


def number_from_text(text: Column) -> Column:
    """The number that a text states: after a sign of equality, else after a verb, else the first fraction."""
    low = F.translate(F.lower(text), "−–", "--")
    stated = F.regexp_extract(low, r"(?:=|≈|→|\\approx|\\to|\\sim)\s*(-?[0-9.]+)", 1)
    told = F.regexp_extract(low, r"(?:equals?|gives?|yields?|predicts?|is)\s+(-?[0-9.]+)", 1)
    parts = F.split(F.regexp_extract(low, r"(-?[0-9]+/[0-9]+)", 1), "/")
    ratio = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    return F.coalesce(stated.try_cast("double"), told.try_cast("double"), ratio)


def simple_fraction(value: Column, most: int = 20, tolerance: float = 1e-6) -> Column:
    """The fraction of least denominator up to ``most`` that a value is within tolerance of, as text; else null."""
    tried = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda d: F.struct(d.alias("d"), F.round(value * d).alias("n")))
    first = F.get(F.filter(tried, lambda t: F.abs(t["n"] / t["d"] - value) < tolerance), F.lit(0))
    n, d = first["n"].cast("long"), first["d"]
    return F.when(d == 1, n.cast("string")).when(d.isNotNull(), F.concat_ws("/", n.cast("string"), d.cast("string")))


def rewrite(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Regular expressions replaced one after another, in order."""
    return reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)


def code_fence(text: Column) -> Column:
    """What stands in the first fenced block, else the whole text, trimmed."""
    inner = F.regexp_extract(text, r"(?s)```[a-zA-Z]*\s*(.*?)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


def json_list(text: Column) -> Column:
    """A JSON list of strings; empty where it is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def balanced_json(text: str | None) -> str | None:
    """The first bracketed part of a text that parses as JSON; strings and nesting respected."""
    decoder = json.JSONDecoder()
    for at, c in enumerate(text or ""):
        if c in "[{":
            try:
                return text[at : decoder.raw_decode(text, at)[1]]
            except ValueError:
                continue
    return None


@F.pandas_udf(T.StringType())
def extract_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(balanced_json)


def lookup(table: Mapping[str, object], key: Column, default: object) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def json_props(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)

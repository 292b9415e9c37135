"""Joins of texts against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import strings
from evidentia.plans import catalogue

from .conftest import SF


def column(spark, name, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, at int")


def some(rng, n, letters, most):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("letters", ["ab", "abcde f", "aé😀?"])
def test_contained_equals_brute_force(spark, monkeypatch, letters):
    monkeypatch.setattr(strings, "BLOCK", 3)
    rng = random.Random(letters)
    keys, names = [*some(rng, 40, letters, 5), "", None, None], [*some(rng, 60, letters, 12), None, "x" * 3000]
    got = {tuple(r) for r in strings.substring_join(column(spark, "k", keys), column(spark, "n", names), "k", "n").collect()}
    assert got == {(k, n) for k in keys for n in names if None not in (k, n) and (k in n or n in k)}


def test_hot_gram_is_dealt(spark):
    left, right = column(spark, "t", ["x"] * 25).select("t", F.col("at").alias("a")), column(spark, "t", ["x"] * 31 + ["y"]).select("t", F.col("at").alias("b"))
    got = sorted((r["a"], r["b"]) for r in strings.meet(left, right, "t", block=4).collect())
    assert got == [(a, b) for a in range(25) for b in range(31)]


def test_no_nested_loop(spark, capsys):
    strings.contained(column(spark, "k", ["ab", "abcd"]), column(spark, "n", ["xabcdx"]), "k", "n").explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute(asked, names, least):
    out = {}
    for s in {s for s in asked if s}:
        if s in names:
            out[s] = (s, 1.0)
            continue
        best, ratio = None, 0.0
        for n in names:
            if n and (r := difflib.SequenceMatcher(None, s.lower(), n.lower()).ratio()) > ratio:
                best, ratio = n, r
        if best is not None and ratio >= least:
            out[s] = (best, ratio)
    return out


@pytest.mark.parametrize(("letters", "least"), [("abcA", 0.5), ("abcdefgh", 0.7), ("abcd", 0.8), ("abcdB", 0.95), ("aé😀b", 1.0)])
def test_best_alike_equals_brute_force(spark, letters, least):
    rng = random.Random(f"{letters} {least}")
    names = [*some(rng, 80, letters, 14), None, "", "b" * 400]
    asked = [*some(rng, 40, letters, 14), *(n[::-1] for n in names[:20]), *(n[:5] + "a" + n[5:] for n in names[:20]), *names[:5], None, "", "b" * 390]
    got = {r["s"]: (r["n"], r["ratio"]) for r in strings.best_alike(column(spark, "s", asked), column(spark, "n", names), "s", "n", "at", least).collect()}
    assert got == brute(asked, names, least)


def test_case_and_ties(spark):
    names = ["Abd", "ABC", "abe", "abc"]
    got = {r["s"]: r["n"] for r in strings.best_alike(column(spark, "s", ["abC", "abc", "abf"]), column(spark, "n", names), "s", "n", "at").collect()}
    assert got == {"abC": "ABC", "abc": "abc", "abf": "Abd"}


def test_empty_tables(spark):
    none, one = column(spark, "s", []), column(spark, "n", ["a"])
    assert strings.best_alike(none, one, "s", "n").count() == 0
    assert strings.best_alike(one.withColumnRenamed("n", "s"), none.withColumnRenamed("s", "n"), "s", "n").count() == 0
    assert strings.substring_join(none, one, "s", "n").count() == 0


def test_prefix_filter_leaves_out_pairs(spark):
    rng = random.Random(1)
    texts = [("a" if i % 2 else "b", i, w, len(w)) for i, w in enumerate(some(rng, 400, "abcdefghijklmnopqrstuvwxyz", 14)) if w]
    n = strings.candidates(spark.createDataFrame(texts, "_side string, _id long, _low string, _len int"), 0.8).count()
    assert n < 0.1 * 200 * 200


def test_query_equals_brute_force(spark):
    pages = [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select(F.regexp_extract("url", r"://(?:[^/?#]*\.)?([^./?#]+)\.example\.", 1)).distinct().collect()]
    words = sorted({r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))).collect()})
    got = {r["host"]: (r["word"], r["ratio"]) for r in catalogue.QUERIES["fuzzy_join"](spark, SF).collect()}
    assert got and got == brute(pages, words, 0.6)

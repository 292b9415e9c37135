"""Toxicity scores of texts whose insults may be disguised.

A noisy channel writes letters as look-alike signs, stretches them, spaces them out or masks
them. For a word that such a channel may have made, the alternatives of each sign form a
lattice, and Viterbi search finds the reading that a character language model likes best.
A masked run stands for as many letters as it has signs. Where blanks stand between signs or
pairs of them, the search also chooses where words end. The model counts character triples of
every text of the corpus. The restored words are then scored: features (words and their
beginnings) that mark toxic documents were learned from labelled documents; the log likelihood
ratios of a document's distinct marked words add up, and a logistic curve fitted on the same
labelled documents turns the sum into a probability. In what was spaced out, marked words count
wherever they begin, as word ends are least sure there.

Learning reads the labels of the rows given to ``fit`` only; no score looks at a label, a
language, a source or an id.

Defined results: null and empty texts get the model's base score; texts of any length, and words
of any length in them, are read whole, in linear time; without labels of both classes every score is the base score; labels that
contradict each other for an id count as toxic; null labels and ids teach nothing; an empty
table gives an empty table; clashing columns are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import add_columns, cut_lineage, held_out

#: Labelled rows of each class that features are learned from, at most about this many, chosen by hash of the id.
SAMPLE = 20_000
#: Tokens kept in the memo of a task; a full memo is emptied.
MEMO = 300_000
#: Lengths of word beginnings that are features, beside whole words.
PREFIXES = range(3, 8)
#: A feature must be this much likelier in toxic documents, and the likelihood ratio statistic this large.
LIFT, SIGNIFICANT = 5.0, 24.0

LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëíìîïñóòôöõøœúùûüýÿß"
# What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "¡": "i"}
# Signs that stand for one letter each, whichever.
MASKS = "*#"
DROPPED = frozenset(".-_'·~^")

INDEX = np.zeros(0x181, np.int64)
for _k, _c in enumerate(LETTERS):
    INDEX[ord(_c)] = _k + 1
N = len(LETTERS) + 1
PLACE = {c: k + 1 for k, c in enumerate(LETTERS)}

LEADING = re.compile(r"[^\w@$!|+*]*")
ODD = re.compile(r"[^\W_](?:[@$!|+*#€£¡.\-_'·~^0-9])+[^\W_]|[@$!|+0-9][^\W\d_]|[^\W\d_][@$0-9]|([^\W\d_])\1\1")
#: Single signs and pairs of them with blanks between, four or more; three must be single.
SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+*]){1,2}(?: (?:[^\W_]|[@$!|+*]){1,2}){3,}(?!\S)")
SINGLES = 3
#: Letters of a mark that is looked for in what was spaced out, at least.
LEAST = 4
#: What a letter of a reading is worth, so that short readings are not favoured: what an average letter costs.
LETTER = 2.5
#: Scores of the last steps of a masked run that are compared for a cycle.
CYCLE = 64


def core(token: str) -> str:
    """A token without signs at its ends that no word begins or ends with."""
    start, end = LEADING.match(token).end(), len(token)
    while end > start and not (token[end - 1].isalnum() or token[end - 1] in "_@$|+"):
        end -= 1
    return token[start:end]


def triples(text: str) -> np.ndarray:
    """Counts of the character triples of a text; all that is no letter is one boundary sign."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    at = INDEX[np.minimum(points, 0x180)]
    return np.bincount((at[:-2] * N + at[1:-1]) * N + at[2:], minlength=N**3) if len(at) > 2 else np.zeros(N**3, np.int64)


def language_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a character after two others, from all texts of ``df``; an array with a cell for each triple of letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                if text:
                    held.append(text)
                    size += len(text)
                if size > 1 << 20:
                    total += triples(" ".join(held))
                    held, size = [], 0
            if held:
                total += triples(" ".join(held))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["triple", "n"])

    rows = df.select(text_col).mapInArrow(count, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(N**3)
    for triple, k in rows:
        n[triple] = k
    n = n.reshape(N, N, N)
    one = n.sum((0, 1)) + 1
    two = n.sum(0) + 5 * one / one.sum()
    two /= two.sum(1, keepdims=True)
    three = n + 2 * two[None]
    return np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


def lattice(word: str) -> list[tuple[str, ...] | int]:
    """For each run of equal signs of a lower-case word, what it may stand for; of a masked run, how many letters."""
    out: list[tuple[str, ...] | int] = []
    for m in re.finditer(r"(.)\1*", word, re.S):
        sign, run = m[1], len(m[0])
        if sign in PLACE:
            out.append((sign, sign * 2) if run > 2 else (sign * run,))
        elif sign in MASKS:
            out.append(run)
        elif sign in LEET:
            out.append(tuple(c * k for c in LEET[sign] for k in ((1,) if run == 1 else (1, 2))))
        elif sign not in DROPPED:
            out.append((" ",))
    return out


class Masked:
    """Viterbi search through ``n`` letters of which nothing is known, a to z each.

    Scores are kept relative to the best one. They soon repeat, from where on all steps do, so
    a run of any length takes a bounded number of them.
    """

    def __init__(self, start: dict[tuple[int, int], tuple[float, object]], n: int, model: np.ndarray) -> None:
        self.n, self.paths = n, {k: p for k, (_, p) in start.items()}
        score = np.full((N, N), -np.inf)
        for (a, b), (s, _) in start.items():
            score[a, b] = s
        own = slice(1, 27)
        self.back: list[np.ndarray] = []
        self.cycle = 0
        seen: dict[bytes, int] = {}
        past: list[tuple[np.ndarray, float]] = []
        total = 0.0
        cube = model[own, own, own].astype(float)
        for step in range(n):
            by = model[:, :, own] if step == 0 else model[:, own, own] if step == 1 else cube
            every = score[:, :, None] + by
            self.back.append(every.argmax(0).astype(np.uint8))
            score = every.max(0)
            best = score.max()
            score, total = score - best, total + best
            if step >= 2:
                past.append((score, total))
                key = score.tobytes()
                if key in seen:
                    # Steps before + 1 to here are those that come again.
                    before = seen[key]
                    self.cycle = step - before
                    left = n - 1 - step
                    turns, rest = divmod(left, self.cycle)
                    kept = past[len(past) - 1 - self.cycle + rest]
                    total += turns * (total - past[len(past) - 1 - self.cycle][1]) + kept[1] - past[len(past) - 1 - self.cycle][1]
                    score = kept[0]
                    break
                seen[key] = step
                if len(past) > CYCLE:
                    old = past.pop(0)[0].tobytes()
                    if seen.get(old) == step - CYCLE:
                        del seen[old]
        self.score = score + total + LETTER * n

    def ends(self) -> dict[tuple[int, int], tuple[float, object]]:
        rows = range(1, 27) if self.n > 1 else range(N)
        return {(a, b): (float(s), (self, (a, b))) for i, a in enumerate(rows) for b, s in enumerate(self.score[i], 1) if s > -np.inf}

    def read(self, end: tuple[int, int]) -> tuple[str, object]:
        """The letters that lead to an end, and the path before them."""
        a, b = end
        out = []
        for step in range(self.n - 1, -1, -1):
            out.append(LETTERS[b - 1])
            if step >= len(self.back):
                step = len(self.back) - self.cycle + (step - len(self.back)) % self.cycle
            # rows and columns count from the first letter where both are letters of the run
            row = a - 1 if self.back[step].shape[0] == 26 else a
            before = int(self.back[step][row, b - 1])
            a, b = (before + 1 if step >= 2 else before), a
        return "".join(reversed(out)), self.paths[a, b]


def restore(word: str, model: np.ndarray, ends: bool = False) -> str:
    """The likeliest reading of a word, by Viterbi search over the last two letters; with ``ends``, of words that may end after any letter."""
    best: dict[tuple[int, int], tuple[float, object]] = {(0, 0): (0.0, None)}
    for options in lattice(word):
        if isinstance(options, int):
            best = Masked(best, options, model).ends()
            continue
        step: dict[tuple[int, int], tuple[float, object]] = {}
        for (a, b), (score, path) in best.items():
            for option in (*options, *(f"{o} " for o in options)) if ends else options:
                x, y, s = a, b, score
                for c in option:
                    z = PLACE.get(c, 0)
                    s += float(model[x, y, z]) + LETTER * (c != " " or not ends)
                    x, y = y, z
                if (x, y) not in step or s > step[x, y][0]:
                    step[x, y] = (s, (path, option))
        best = step
    path = max(((s + float(model[a, b, 0]), p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])[1]
    parts = []
    while path:
        before, option = path
        letters, path = before.read(option) if isinstance(before, Masked) else (option, before)
        parts.append(letters)
    return "".join(reversed(parts))


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) > k)]


class Reader:
    """Words of a text as the channel's input."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model

    def words(self, token: str) -> tuple[str, ...]:
        """What a token of lower case may say: its core, the words in it, and those of its restored reading."""
        plain = core(token)
        out = (plain,) if plain else ()
        if not plain.isalpha() or ODD.search(plain):
            out += tuple(re.findall(r"[^\W\d_]+", plain))
            if ODD.search(plain):
                out += tuple(restore(plain, self.model).split())
        return out

    def spaced(self, low: str) -> dict[str, tuple[str, ...]]:
        """Of what is spaced out in a text of lower case, the letters and the words in them."""
        out = {}
        for m in SPACED.finditer(low):
            if sum(map(len, m[0].split(" "))) <= 2 * (m[0].count(" ") + 1) - SINGLES:
                words = restore(m[0].replace(" ", ""), self.model, True).split()
                out["".join(words)] = tuple(words)
        return out

    def read(self, text: str) -> set[str]:
        """Distinct words, restored ones among them."""
        low = text.lower()
        return set().union(*map(self.words, set(low.split())), *self.spaced(low).values())


@dataclass
class Model:
    """What scoring needs; ``marks`` has the log likelihood ratio of a feature, ``curve`` intercept and slope."""

    language: np.ndarray
    marks: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float] | None = None


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.reader = model, Reader(model.language)
        self.memo: dict[str, tuple[tuple[str, float], ...]] = {}
        self.lengths = sorted({len(f.removeprefix("=")) for f in model.marks} - set(range(LEAST)))

    def mark(self, word: str) -> float:
        return max((self.model.marks.get(f, 0.0) for f in features(word)), default=0.0)

    def marked(self, token: str) -> tuple[tuple[str, float], ...]:
        """The words of a token that are marks, with their weight; of most tokens none."""
        got = self.memo.get(token)
        if got is None:
            got = tuple((w, m) for w in self.reader.words(token) if (m := self.mark(w)) > 0)
            if len(token) < 100:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[token] = got
        return got

    def marks_within(self, letters: str) -> dict[str, float]:
        """The strongest mark that begins at each letter."""
        marks, out = self.model.marks, {}
        for at in range(len(letters)):
            parts = (letters[at : at + n] for n in self.lengths if at + n <= len(letters))
            best = max(((marks.get(f, 0.0), f) for p in parts for f in ("=" + p, p)), default=(0.0, ""))
            if best[0] > 0:
                out[best[1]] = best[0]
        return out

    def evidence(self, text: str | None) -> float:
        if not text:
            return 0.0
        low = text.lower()
        found: dict[str, float] = {}
        for token in set(low.split()):
            if got := self.marked(token):
                found.update(got)
        within = {k: v for letters in self.reader.spaced(low) for k, v in self.marks_within(letters).items()}
        # an exact sum, so that equal texts get equal sums
        return math.fsum([*found.values(), *within.values()])

    def score(self, text: str | None) -> float:
        if self.model.curve is None:
            return 0.0
        a, b = self.model.curve
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, a + b * self.evidence(text)))))


def count_features(texts: DataFrame, language: np.ndarray, among: set[str] | None = None) -> DataFrame:
    """(feature, n) over the documents of ``texts``; feature "" counts the documents."""
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast((language, among))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, among = shared.value
        reader, total = Reader(language), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = {f for w in reader.read(text or "") for f in features(w)}
                total.update(found if among is None else found & among)
                total[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["feature", "n"])

    return texts.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def likelihood_ratio(t: int, toxic: int, c: int, clean: int) -> float:
    both = (t + c) / (toxic + clean)
    part = lambda k, n: (k * math.log(k / n / both) if k else 0.0) + ((n - k) * math.log((1 - k / n) / (1 - both)) if k < n and both < 1 else 0.0)
    return 2 * (part(t, toxic) + part(c, clean))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    The language model counts all texts. Labels are read of ids for which ``train`` (over
    ``doc_id``) holds; features are learned from about ``SAMPLE`` distinct rows (id and text) of
    each class or fewer: ids are thinned by hash, and where they bring many texts, so are those.
    """
    docs = docs.select("doc_id", "text")
    model = Model(language_model(docs))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(train if train is not None else F.lit(True)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return model
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE / n[1])).otherwise(min(1.0, SAMPLE / n[0]))
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # The sample's expected size is bounded by twice SAMPLE rows of two small columns. Its texts are written once and read three times.
    own = docs.join(F.broadcast(some), "doc_id").withColumn("at", F.xxhash64("doc_id", "text"))
    texts = cut_lineage(own.groupBy("doc_id", "at").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("at", "text", "toxic"))
    brought = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if max(brought.values(), default=0) > 2 * SAMPLE:  # an id with many texts
        share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE / brought.get(1, 1))).otherwise(min(1.0, SAMPLE / brought.get(0, 1)))
        texts = cut_lineage(texts.filter(F.pmod(F.xxhash64("at"), F.lit(1 << 20)) < share * (1 << 20)), texts)
    found = count_features(texts.filter("toxic = 1"), model.language)
    toxic = found.filter("feature = ''").agg(F.sum("n")).first()[0] or 0
    least = max(3, toxic // 500)
    t = {r.feature: r.n for r in found.filter((F.col("n") >= least) & (F.col("feature") != "")).collect()}
    if not t:
        return model
    c = {r.feature: r.n for r in count_features(texts.filter("toxic = 0"), model.language, set(t)).collect()}
    clean = c.pop("", 0)
    prior = n[1] / (n[0] + n[1])
    for f, k in t.items():
        often, seldom = k / toxic, (c.get(f, 0) + 0.5) / (clean + 1)
        if often >= LIFT * seldom and likelihood_ratio(k, toxic, c.get(f, 0), max(clean, 1)) >= SIGNIFICANT:
            model.marks[f] = math.log(often / seldom)
    pairs = evidence(texts, model).collect()
    model.curve = logistic(np.array([r.evidence for r in pairs]), np.array([r.toxic for r in pairs], float), prior, np.array([r.n for r in pairs], float))
    return model


def evidence(texts: DataFrame, model: Model) -> DataFrame:
    """(evidence, toxic, n) of the bounded sample ``texts``, which so many of its rows have."""
    return score(texts, model, out_col="evidence", what=Scorer.evidence).groupBy("evidence", "toxic").agg(F.count("*").alias("n"))


def logistic(x: np.ndarray, y: np.ndarray, prior: float, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a slight ridge; rows, each standing for ``n``, are weighted to the true share of toxic ones."""
    order = np.lexsort((y, x))  # so that sums don't depend on how rows arrive
    x, y, n = x[order], y[order], n[order]
    share = min(max(float(np.average(y, weights=n)), 1e-6), 1 - 1e-6)
    weight = n * np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    rows, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (weight * (y - p)) - 0.01 * w
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score", what: Callable[[Scorer, str | None], float] = Scorer.score) -> DataFrame:
    """``df`` with the probability that each text is toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def fn(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([what(scorer, t) for t in texts.to_pylist()], pa.float64())]

        return fn

    return add_columns(df, [text_col], [T.StructField(out_col, T.DoubleType())], make)


def is_training(doc_id: str = "doc_id") -> Column:
    return ~held_out(F.col(doc_id))

"""Language identification by cross-parsing.

A suffix automaton per language accepts every substring of a sample of its labelled text. A
text is parsed greedily into the longest phrases an automaton accepts; fewer phrases mean
closer language. Counts are normalised by the logarithm of each sample's size, as a longer
sample yields longer matches, and the language with the least normalised count wins, ties
going to the name that sorts first.

Every language with labelled text is learned. The automata are tables of transitions, or sorted
lists where many languages or letters would make these large. Many stretches of text walk them in
step, each as if a phrase began with it. Then the state that a stretch's predecessor ends in walks
on into it until it meets the state of the first walk, from where on both are the same; where it
does not meet it, the next stretch is walked anew. So the counts are those of the whole text,
however long its phrases. Only letters are compared; each run of other characters is one blank.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if nothing was
learned; rows with a null language or text teach nothing; repeated rows get equal results;
texts of any length are read whole, in linear time; clashing columns are replaced; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import add_columns, held_out

#: Characters of each language's sample, at least where there are so many, and rows it is drawn from at most, chosen by hash
#: of the id. Rows are taken whole; of one longer than all of the sample should be, PIECES parts from all over it stand for it.
SAMPLE_CHARS, SAMPLE_ROWS, PIECES = 40_000, 400, 40
#: Cells of a table of all transitions; beyond it, lists of transitions are searched, of about 1 MB a language.
DENSE_CELLS = 1 << 26
#: Characters of a stretch, and cells (characters by languages) of the stretches that walk in step at most.
STRETCH, STEP = 512, 1 << 21
#: Walks in step at least; fewer go one by one, which is faster then.
ABREAST = 48
# Numerals that are neither digits nor letters: what a pattern of word characters takes for letters. The planes beyond have none.
NUMERALS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isdigit() and unicodedata.category(c)[0] != "L")
NUMERALS += "".join(c for c in map(chr, range(0x20000)) if c.isdigit() and not c.isdecimal())
OTHER, NUMERAL = re.compile(r"[\W\d_]+"), re.compile(f"[{NUMERALS}]")
ODD_NUMERALS = frozenset(NUMERALS)
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def fold(text: str) -> str:
    low = text.lower()
    if not low.isascii() and not ODD_NUMERALS.isdisjoint(low):
        low = NUMERAL.sub(" ", low)
    return OTHER.sub(" ", low).strip()


class Automaton:
    """Suffix automaton of codes 1 and up. The root is state 1; no transition leads to state 0.

    ``keys`` has state * width + code of each transition, in order; ``to`` has the next states.
    """

    def __init__(self, codes: list[int], width: int) -> None:
        limit = 2 * len(codes) + 3
        moves: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        last = 1
        for c in codes:
            now = len(moves)
            moves.append({}), link.append(1), length.append(length[last] + 1)
            p = last
            while p and c not in moves[p]:
                moves[p][c] = now
                p = link[p]
            if p:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q])), link.append(link[q]), length.append(length[p] + 1)
                    while p and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        assert len(moves) <= limit
        self.states, self.width = len(moves), width
        self.keys = np.array([state * width + c for state, to in enumerate(moves) for c in sorted(to)], np.int64)
        self.to = np.array([to[c] for to in moves for c in sorted(to)], np.int64)


class Parser:
    """Phrase counts of texts under the automata of all languages."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(samples)
        letters = sorted(set().union(*samples.values()))
        # Codes: 0 fills rows up, 1 is a character that no sample has.
        self.code = {c: k + 2 for k, c in enumerate(letters)}
        width = len(letters) + 2
        self.lookup = np.ones(max(map(ord, letters), default=0) + 2, np.int16 if width < 1 << 15 else np.int32)
        for c, k in self.code.items():
            self.lookup[ord(c)] = k
        automata = [Automaton([self.code[c] for c in samples[n]], width) for n in self.names]
        # States are numbered through; 0 is "no way on".
        starts = np.cumsum([0, *(a.states for a in automata)])[:-1]
        self.width, self.roots = width, starts + 1
        self.keys = np.concatenate([*(a.keys + s * width for a, s in zip(automata, starts, strict=True)), np.array([np.iinfo(np.int64).max])])
        self.to = np.concatenate([*(a.to + s for a, s in zip(automata, starts, strict=True)), np.zeros(1, np.int64)])
        self.flat = None
        cells = sum(a.states for a in automata) * width
        if cells <= DENSE_CELLS:
            # One table holds all transitions if it is not too large.
            self.flat = np.zeros(max(1, cells), np.int32)
            self.flat[self.keys[:-1]] = self.to[:-1]
        # Where a phrase that begins with a character leads: its state, or the root if the sample has no such character.
        first = self.move(np.repeat(self.roots[:, None], width, 1), np.arange(width))
        self.first = np.where(first > 0, first, self.roots[:, None])
        self.weight = [math.log(max(2, len(samples[n]))) for n in self.names]

    def move(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next states; 0 where there is no way on."""
        key = state * self.width + codes
        if self.flat is not None:
            return self.flat[key]
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], 0)

    def encoded(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        return self.lookup[np.minimum(points, len(self.lookup) - 1)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Counts, a row for each folded text and a column for each language."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        most = max(1, STEP // STRETCH // len(self.names))
        ended, some = self.roots, []
        for i, text in enumerate(texts):
            codes = self.encoded(text)
            for at in range(0, len(codes), STRETCH):
                some.append((i, at, codes[at : at + STRETCH]))
                if len(some) == most:
                    ended = self.counted(some, ended, out)
                    some = []
        if some:
            self.counted(some, ended, out)
        return out + (np.array([len(t) for t in texts]) > 0)[:, None]

    def counted(self, some: list[tuple[int, int, np.ndarray]], before: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Adds the ends of phrases in stretches (text, place, codes) to ``out``, and returns the states at the end of the last."""
        count, ended = self.walk([codes for _, _, codes in some], np.array([at > 0 for _, at, _ in some]), before)
        np.add.at(out, [i for i, _, _ in some], count.T)
        return ended

    def walk(self, stretches: list[np.ndarray], goes_on: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of phrases in each language and stretch, and the states at the end of the last one.

        ``goes_on`` tells which stretches continue the one before them, and ``before`` has the
        states that the first one may continue.
        """
        sizes = np.array([len(x) for x in stretches])
        order = np.argsort(-sizes, kind="stable")
        column = np.argsort(order)
        many, languages, longest = len(stretches), len(self.names), int(sizes.max())
        grid = np.zeros((longest, many), np.int64)
        for k, codes in enumerate(stretches):
            grid[: len(codes), column[k]] = codes
        state = np.repeat(self.roots[:, None], many, 1)
        seen, stuck = np.zeros((longest, languages, many), np.int32), np.zeros((longest, languages, many), bool)
        live = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")
        for step, n in enumerate(live.tolist()):
            codes = grid[step, :n]
            to = self.move(state[:, :n], codes)
            off = to == 0
            if off.any():
                # A phrase ends before a character without a way on, and the character begins the next one.
                row, at = np.nonzero(off)
                to[row, at] = self.first[row, codes[at]]
            state[:, :n] = seen[step, :, :n] = to
            stuck[step, :, :n] = off
        ends = np.cumsum(stuck, 0, np.int16)
        count, last = ends[-1].astype(np.int64), state
        # The walks that go on from the stretch before: (language, stretch, state).
        todo = [(language, k, int(last[language, column[k - 1]] if k else before[language])) for k in np.flatnonzero(goes_on).tolist() for language in range(languages)]
        while todo:
            again = []
            for (language, k, _), (n, met, end) in zip(todo, self.continued(todo, grid, sizes, column, seen), strict=True):
                c = column[k]
                count[language, c] = n + (ends[-1, language, c] - ends[met, language, c] if met >= 0 else 0)
                if met < 0 and end != last[language, c]:
                    last[language, c] = end
                    if k + 1 < many and goes_on[k + 1]:
                        again.append((language, k + 1, end))
                elif met >= 0 and last[language, c] != seen[sizes[k] - 1, language, c]:
                    last[language, c] = seen[sizes[k] - 1, language, c]
                    if k + 1 < many and goes_on[k + 1]:
                        again.append((language, k + 1, int(last[language, c])))
            todo = again
        return count[:, column], last[:, column[-1]]

    def continued(self, todo: list[tuple[int, int, int]], grid: np.ndarray, sizes: np.ndarray, column: np.ndarray, seen: np.ndarray) -> list[tuple[int, int, int]]:
        """Of each walk, ends of phrases until it meets the state seen, the step where it does (-1 if it does not), and its last state."""
        if len(todo) < ABREAST:
            return [self.alone(language, state, grid[: sizes[k], column[k]].tolist(), seen[:, language, column[k]].tolist()) for language, k, state in todo]
        language, k, state = (np.array(x) for x in zip(*todo, strict=True))
        c, size = column[k], sizes[k]
        n, met, who = np.zeros(len(todo), np.int64), np.full(len(todo), -1), np.arange(len(todo))
        for step in range(len(grid)):
            who = who[size[who] > step]
            if not len(who):
                break
            codes = grid[step, c[who]]
            to = self.move(state[who], codes).astype(np.int64)
            off = np.flatnonzero(to == 0)
            to[off] = self.first[language[who[off]], codes[off]]
            n[who[off]] += 1
            state[who] = to
            same = to == seen[step, language[who], c[who]]
            met[who[same]] = step
            who = who[~same]
        return list(zip(n.tolist(), met.tolist(), state.tolist(), strict=True))

    def alone(self, language: int, state: int, codes: list[int], seen: list[int]) -> tuple[int, int, int]:
        """The same for one walk."""
        n, first, width = 0, self.first[language], self.width
        flat, keys, to = None if self.flat is None else memoryview(self.flat), memoryview(self.keys), memoryview(self.to)
        for step, code in enumerate(codes):
            key = state * width + code
            if flat is not None:
                state = flat[key]
            else:
                at = bisect_left(keys, key)
                state = to[at] if keys[at] == key else 0
            if not state:
                n, state = n + 1, int(first[code])
            if state == seen[step]:
                return n, step, state
        return n, -1, state

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        out = [("und", 0.0)] * len(texts)
        if self.names and known:
            counts = self.phrases([fold(texts[i]) for i in known]) * np.array(self.weight)
            for i, row in zip(known, counts, strict=True):
                best = int(row.argmin())
                # Softmax of negative relative code lengths: 1 when the others need many more phrases.
                rest = np.exp(-8 * (row / row[best] - 1))
                out[i] = (self.names[best], float(1 / rest.sum()))
        return out


def fit(df: DataFrame, train: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, str]:
    """Samples of folded text by language, from rows of ``df`` for which ``train`` holds.

    Each language's distinct rows (id and text) are counted, up to the few per cent that such a
    count may err, thinned by hash to a few times SAMPLE_ROWS, and the first of those in hash
    order kept, those longer than SAMPLE_CHARS last; whole texts join until SAMPLE_CHARS are
    reached. Repeated rows count once, so that they can't crowd out or lose a language.
    """
    known = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.filter(train if train is not None else F.lit(True)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("at"))
    n = known.groupBy("lang").agg(F.approx_count_distinct("at").alias("n"))
    thin = known.join(F.broadcast(n), "lang").filter(F.pmod("at", F.lit(1 << 30)) < F.lit(4.0 * SAMPLE_ROWS * (1 << 30)) / F.col("n"))
    size, part = F.length("text"), SAMPLE_CHARS // PIECES
    spread = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substr("text", (F.floor(k * (size - part) / (PIECES - 1)) + 1).cast("int"), F.lit(part)))
    thin = thin.groupBy("lang", "at").agg(F.first("text").alias("text"))
    thin = thin.select("lang", "at", (size > SAMPLE_CHARS).alias("long"), F.when(size > SAMPLE_CHARS, F.array_join(spread, " ")).otherwise(F.col("text")).alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("long", "at", "text"))
    # Whole texts, as few as reach the wanted size: sizes first, so that no more than those leave the executors.
    sized = thin.withColumn("place", place).filter(F.col("place") <= SAMPLE_ROWS)
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = sized.withColumn("before", before).filter(F.col("before") < SAMPLE_CHARS).select("lang", "place", "text").collect()
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.place)):
        out[r.lang] = (out.get(r.lang, "") + " " + fold(r.text)).strip()
    return out


#: The parser that a worker process has built last, by the digest of its samples: tasks of one query share it.
BUILT: dict[str, Parser] = {}


def parser_of(name: str, samples: Broadcast) -> Parser:
    if name not in BUILT:
        BUILT.clear()
        BUILT[name] = Parser(samples.value)
    return BUILT[name]


def predict(df: DataFrame, samples: dict[str, str], text_col: str = "text", out_cols: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the language of each text and how clearly it wins, from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(samples)
    name = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()

    def make():
        parser = parser_of(name, shared)

        def fn(texts: pa.Array) -> list[pa.Array]:
            got = parser.predict(texts.to_pylist())
            return [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]

        return fn

    return add_columns(df, [text_col], [T.StructField(out_cols[0], T.StringType()), T.StructField(out_cols[1], T.DoubleType())], make)


def is_training(doc_id: str = "doc_id") -> Column:
    return ~held_out(F.col(doc_id))

"""Personal data, found also behind disguises, with offsets in the source text.

Four detectors (email, ip, card, phone) run on the text itself: the base spans. The method
then adds spans. Transducers rewrite the text: homoglyphs become the ASCII characters they
imitate, spelled digits become digits, and "at" and "dot" disguises become signs. Every
piece that a transducer writes remembers the source characters it stands for, so a span of
the rewritten text maps back to the source. Base spans always stay. Spans that touch no
rewritten piece are dropped, and those that overlap a base span other than one of their kind
that they extend.

Defined results: a null text counts as empty, an empty text has no spans, texts of any
length are taken whole, in time about linear in their length, repeated rows get equal
results, clashing columns are replaced, an empty table gives an empty table. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import operator
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import add_columns

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))

# Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "υ": "u", "ι": "i", "κ": "k", "τ": "t", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u2007": " ", "\u2009": " ", "\u202f": " ",
}
# Full-width forms stand at a fixed distance from ASCII; other scripts' digits are ten in a row.
GLYPHS = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)} | {zero + d: str(d) for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
# Digit words of English, Spanish, German and French.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
# Words for signs.
SIGNS = {"at": "@", "arroba": "@", "arobase": "@", "dot": ".", "punto": ".", "punkt": ".", "point": ".", "plus": "+", "más": "+"}

# Endings that make an address in bare words credible.
ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "dev", "app", "ai", "xyz", "tech", "cloud", "eu", "de", "fr", "es", "it", "uk", "us", "ca", "co", "nl", "ch", "at", "be", "se", "no", "dk", "fi", "pl", "pt", "ru", "cz", "gr", "hu", "ro", "ie", "cn", "jp", "kr", "in", "br", "mx", "ar", "cl", "au", "nz", "za")

GLYPH = re.compile("[" + "".join(map(re.escape, map(chr, GLYPHS))) + "]")
WORD = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
AT_WORD, DOT_WORD = ("(?:" + "|".join(w for w, to in SIGNS.items() if to == sign) + ")" for sign in "@.")
PLUS_WORD = "(?:plus|más)"
#: Runs of digit words, also mixed with digits, dots and a plus.
SPELLED = rf"(?<![^\W_])(?:{PLUS_WORD}[\s-]+)?{WORD}(?:(?:[\s,-]+|\s*[.]\s*|[\s-]+{DOT_WORD}[\s-]+)(?:{WORD}|[0-9]+)(?![^\W_])){{3,}}"
#: A sign in brackets; blanks around it go too, but are no part of the pattern, which would read long runs of them again and again.
BRACKETED = rf"[\[({{<]\s*(?P<sign>{AT_WORD}|{DOT_WORD}|@|\.)\s*[\])}}>]"
DISGUISE = re.compile(rf"(?P<spelled>{SPELLED})|{BRACKETED}", re.I)
# What a disguise cannot lack, in lower case and quick to look for: two digit words or a word and
# digits, a bracketed sign, a bare "dot", or a bare "at" together with an ending.
TWO_DIGITS = re.compile(rf"{WORD}(?:[\s,.-]|{DOT_WORD})+(?:{WORD}|[0-9])")
BRACKETS = re.compile(rf"[\[({{<]\s*(?:{AT_WORD}|{DOT_WORD}|@|\.)\s*[\])}}>]")
DOT = re.compile(rf"\s{DOT_WORD}\s")
AT = re.compile(rf"\s{AT_WORD}\s")
ENDING = re.compile(rf"\.(?:{'|'.join(ENDINGS)})(?![a-z0-9-])")
#: The sign of an address, bare or not, between its parts, which are then read to its left (in the reversed text) and right.
BARE_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:\s+{AT_WORD}\s+|\s*@\s*)(?=[A-Za-z0-9-])", re.I)
_SAID = "|".join(w[::-1] for w, to in SIGNS.items() if to == ".")
LOCAL_LEFT = re.compile(rf"[A-Za-z0-9_%+-]++(?:(?:\s++(?:{_SAID})\s++|\.)[A-Za-z0-9_%+-]++)*+", re.I)
DOMAIN_RIGHT = re.compile(rf"[A-Za-z0-9-]++(?:(?:\s++{DOT_WORD}\s++|\.)[A-Za-z0-9-]++)*+", re.I)
BARE_DOT = re.compile(rf"\s+{DOT_WORD}\s+|\.", re.I)
BARE_DOT_WORD = re.compile(rf"\s+{DOT_WORD}\s+", re.I)
ENDS = frozenset(ENDINGS)
SPELLED_TOKEN = re.compile(rf"{PLUS_WORD}|{DOT_WORD}|\.|{WORD}|[0-9]+", re.I)
BLANK = frozenset(" \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0")

#: Characters without width, which vanish.
WIDTHLESS = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
# Letters among digits that look like one; a run needs eight true digits or more.
MIXED = re.compile(r"[0-9][OoIl|]|[OoIl|][0-9]")
MIXED_RUN = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl|]+(?:[ .-][0-9OoIl|]+)*(?![A-Za-z0-9])")
LOOKALIKES = str.maketrans("OoIl|", "00111")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Each sign decides by itself: the local part is the run before it, as far as the last address allows."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, last))
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four detectors, leftmost and not overlapping within a kind."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


class Rewritten:
    """A text as pieces; piece k begins at ``at[k]`` here and at ``source[k]`` of ``before``, and ``made[k]`` says that it was rewritten."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]) -> None:
        parts, self.at, self.source, self.made = [], [], [], []
        here = last = 0
        for start, end, new in edits:
            for a, piece, made in ((last, text[last:start], False), (start, new, True)):
                if piece:
                    self.at.append(here), self.source.append(a), self.made.append(made), parts.append(piece)
                    here += len(piece)
            last = end
        if last < len(text) or not parts:
            self.at.append(here), self.source.append(last), self.made.append(False), parts.append(text[last:])
        self.text, self.edits = "".join(parts), {start: end for start, end, _ in edits}

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span, and whether it touches a rewritten piece."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.source[i] + (0 if self.made[i] else start - self.at[i])
        b = self.edits[self.source[j]] if self.made[j] else self.source[j] + end - self.at[j]
        return a, b, any(self.made[i : j + 1]) or b - a != end - start


def latin(text: str) -> bool:
    """Whether all characters are among the first 256, none of which is a homoglyph."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def sign(word: str) -> str:
    return SIGNS.get(word.lower(), word)


def bare(text: str, low: str) -> list[tuple[int, int, str]]:
    """Edits of the bare signs of addresses, left to right; ``low`` is the text in lower case.

    Every sign reads outwards, as far as parts and dots go: a span between two signs is read
    twice at most, whatever the text.
    """
    if not (DOT.search(low) or ENDING.search(low) and AT.search(low)):
        return []
    back = text[::-1]
    out: list[tuple[int, int, str]] = []
    last = 0
    for m in BARE_AT.finditer(text):
        local = LOCAL_LEFT.match(back, len(text) - m.start())
        start = len(text) - local.end()
        if start < last or (start and text[start - 1] in LOCAL_CHARS):
            continue
        found = DOMAIN_RIGHT.match(text, m.end())
        dots = [(d.start(), d.end()) for d in BARE_DOT.finditer(text, m.end(), found.end())]
        stops = [a for a, _ in dots[1:]] + [found.end()]
        # The last part that is a known ending closes the address.
        close = next((k for k in range(len(dots) - 1, -1, -1) if text[dots[k][1] : stops[k]].lower() in ENDS), None)
        if close is None:
            continue
        out += [(*d.span(), ".") for d in BARE_DOT_WORD.finditer(text, start, m.start())]
        if m[0] != "@":
            out.append((*m.span(), "@"))
        out += [(a, b, ".") for a, b in dots[: close + 1] if b - a > 1]
        last = stops[close]
    return out


def transduce(text: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, new) of spelled digits and of at and dot disguises, left to right."""
    edits: list[tuple[int, int, str]] = []
    low, last = text.lower(), 0
    for m in DISGUISE.finditer(text) if BRACKETS.search(low) or TWO_DIGITS.search(low) else ():
        start, end = m.span()
        if m["spelled"] is None:
            while start > last and text[start - 1] in BLANK:
                start -= 1
            while end < len(text) and text[end] in BLANK:
                end += 1
            edits.append((start, end, sign(m["sign"])))
        else:
            edits.append((start, end, "".join(DIGITS.get(t.lower()) or sign(t) for t in SPELLED_TOKEN.findall(m[0]))))
        last = end
    edits = [e for e in edits if e[1] > e[0]]
    starts, ends = [a for a, _, _ in edits], [b for _, b, _ in edits]
    edits += [e for e in bare(text, low) if bisect_right(ends, e[0]) >= bisect_left(starts, e[1])]
    if MIXED.search(text):
        for m in MIXED_RUN.finditer(text):
            if sum(c.isdigit() for c in m[0]) >= 8:
                edits += [(m.start() + k, m.start() + k + 1, c.translate(LOOKALIKES)) for k, c in enumerate(m[0]) if c in "OoIl|"]
    if not text.isascii():
        edits += [(*m.span(), "") for m in WIDTHLESS.finditer(text)]
    edits.sort()
    out, last = [], 0
    for edit in edits:
        if edit[0] >= last:
            out.append(edit)
            last = edit[1]
    return out


class Taken:
    """Spans that don't overlap, in order; what overlaps a span is found by search."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def met(self, start: int, end: int) -> tuple[int, int]:
        """The range of the spans that overlap."""
        return bisect_right(self.ends, start), bisect_left(self.starts, end)

    def extends(self, start: int, end: int) -> bool:
        """Whether a span overlaps none here, or only such as lie within it, itself excluded."""
        i, j = self.met(start, end)
        if i >= j:
            return True
        return start <= self.starts[i] and self.ends[j - 1] <= end and (self.starts[i], self.ends[i]) != (start, end)

    def add(self, start: int, end: int) -> bool:
        i, j = self.met(start, end)
        if i < j:
            return False
        self.starts.insert(i, start), self.ends.insert(i, end)
        return True


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base), by kind, then start."""
    base = detect(text)
    out = [(*x, True) for x in base]
    plain = text.translate(GLYPHS) if not latin(text) and GLYPH.search(text) else text
    edits = transduce(plain)
    if edits or plain is not text:
        layers = [Rewritten(plain, edits)]
        # What was rewritten may complete an address whose other signs are bare.
        if edits and (more := bare(layers[0].text, layers[0].text.lower())):
            layers.append(Rewritten(layers[0].text, more))
        fixed = [Taken([(a, b) for k, a, b in base if k == kind]) for kind in range(len(KINDS))]
        got = [Taken([]) for _ in KINDS]
        # The deepest reading first; the one before adds what that lost by joining neighbours.
        for depth in range(len(layers), 0, -1):
            for kind, start, end in detect(layers[depth - 1].text):
                a, b, made = start, end, False
                for layer in layers[depth - 1 :: -1]:
                    a, b, here = layer.back(a, b)
                    made |= here
                if not made and plain[a:b] == text[a:b]:
                    continue
                if all(t.extends(a, b) if k == kind else operator.ge(*t.met(a, b)) for k, t in enumerate(fixed)) and got[kind].add(a, b):
                    out.append((kind, a, b, False))
        out.sort()
    return out


def find(df: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``df`` with an array of (kind, start, end, base), by kind as listed, then start."""

    def make():
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

        def fn(texts: pa.Array) -> list[pa.Array]:
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": x} for k, a, b, x in spans(t)] if t else [] for t in texts.to_pylist()]
            return [pa.array(rows, pa.list_(kind))]

        return fn

    return add_columns(df, [text_col], [T.StructField(out_col, SPANS)], make)


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by its kind in angle brackets; overlapping spans fuse under the first one's kind. A null text stays null."""

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([masked(t) if t else t for t in texts.to_pylist()], pa.string())]

        return fn

    order = df.columns
    return add_columns(df, [text_col], [T.StructField(text_col, T.StringType())], make).select(*order)


def masked(text: str) -> str:
    out, last = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b, _ in spans(text)):
        if start >= last:
            out += [text[last:start], f"<{KINDS[kind]}>"]
        last = max(last, end)
    return "".join(out) + text[last:]


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: Column) -> list[Column]:
    """Counts and digest of the base spans, and all spans as text."""
    base = F.filter(found, lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return [*map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(found).alias("spans")]

"""Chat formatting by incremental black-box rendering.

A template is a function from a list of (role, text) to a string; nothing is assumed of its
inside. Successive prefixes of a conversation are rendered, and each output is compared with
the one before: if it continues it, the new turn's span is what was added; if not, the
template rewrites history, the conversation is flagged, and the span begins where the two
outputs first differ. A turn's text is found by comparison too: the same turns are rendered
with a marker, of characters that the output has not, in the text's place, and what the two
outputs do not share at either end is the text as rendered. Where history is rewritten, all
texts are found in the last output.

Texts are escaped before rendering, reversibly, so that no control string of the template can
come from a text: a backslash goes before each backslash and inside each control string.
``parse`` reads turns back from the built-in template's output.

Defined results: a null or empty text, and a null role, count as empty; turns are ordered by
turn, then role, then text, nulls first; a row with a null conversation id is a conversation
of its own; repeated rows are turns of their own; a text that a template leaves out has an
empty span at the end, one that it repeats spans from its first place to its last; columns
named like those made here do not disturb; an empty table gives an empty table. Texts and
conversations of any length are taken whole. One task holds one conversation at a time, as a
template is a function of it, and renders it twice for each turn: the time of a conversation
grows with the square of its turns (2,000 turns of 100 characters: 1 second). Tasks get whole
conversations in sorted order, never a whole group of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

# Control strings of common chat templates.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|turn|>", "<|text|>", "<|end|>")
CONTROLS = re.compile("|".join(map(re.escape, (*CONTROL, "\\"))))
ESCAPED = re.compile(r"\\(.)", re.S)
ROLE, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

OUTPUT = "conv_id long, n_turns long, formatted string, spans array<struct<start:long,end:long,text_start:long,text_end:long,loss:boolean>>, rewrites_history boolean"


def escape(text: str) -> str:
    """A backslash before each backslash and after the first character of each control string."""
    return CONTROLS.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def turns_template(turns: Sequence[Turn]) -> str:
    """The built-in template; roles and texts come escaped."""
    return "<s>" + "".join(f"{ROLE}{role}{TEXT}{text}{END}" for role, text in turns)


def common_prefix(a: str, b: str, known: int = 0) -> int:
    """Length of the longest common prefix, of which ``known`` characters are known; by halving."""
    low, high = known, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def common_suffix(a: str, b: str, most: int) -> int:
    """Length of the longest common suffix up to ``most``, by halving."""
    low, high = 0, min(len(a), len(b), most)
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]:
            low = middle
        else:
            high = middle - 1
    return low


def text_span(template: Template, turns: Sequence[Turn], k: int, output: str, known: int = 0) -> tuple[int, int]:
    """Where the text of turn ``k`` stands in ``output``, which is the template's of ``turns``; ``known`` characters before are no part of it."""
    marker = "\ue000"
    while marker in output:
        marker = chr(ord(marker) + 1)
    marked = template([*turns[:k], (turns[k][0], marker), *turns[k + 1 :]])
    if marker not in marked:
        return len(output), len(output)
    start = common_prefix(output, marked, known if marked.startswith(output[:known]) else 0)
    return start, len(output) - common_suffix(output, marked, len(output) - start)


def locate(turns: Sequence[Turn], template: Template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The output, each turn's span and its text's in it, and whether any prefix's output is not a prefix of the next."""
    before, spans, texts, rewrites = template([]), [], [], False
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if now.startswith(before):
            start = len(before)
        else:
            rewrites = True
            start = common_prefix(before, now)
            # what the earlier turns' spans covered beyond this point was rewritten and is this turn's now
            spans = [(min(a, start), min(b, start)) for a, b in spans]
        spans.append((start, len(now)))
        if not rewrites:
            texts.append(text_span(template, turns[:k], k - 1, now, start))
        before = now
    if rewrites:
        texts = [text_span(template, turns, k, before) for k in range(len(turns))]
    return before, spans, texts, rewrites


def parse(output: str) -> list[Turn]:
    """Turns of the built-in template's output, unescaped."""
    out = []
    for piece in output.removeprefix("<s>").split(ROLE)[1:]:
        role, _, rest = piece.partition(TEXT)
        out.append((unescape(role), unescape(rest.removesuffix(END))))
    return out


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Runs of equal ids in sorted batches of (conv_id, role, text); a null id's run is one row."""
    now: object = ...
    turns: list[Turn] = []
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if turns and (conv != now or conv is None):
                yield now, turns
                turns = []
            now = conv
            turns.append((role or "", text or ""))
    if turns:
        yield now, turns


def render(df: DataFrame, template: Template = turns_template, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``df`` (conv_id, turn, role, text): output, spans and loss mask.

    ``spans`` has for each turn its span, the span of its escaped text, and whether the loss covers that text.
    """
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    # By hash; rows without an id are conversations of their own and spread by their texts. A conversation's rows then stand in order.
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    dealt = rows.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "formatted", "spans", "rewrites_history"]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], kind), pa.array(cols[4], pa.bool_())], names=names)

        for conv, turns in conversations(batches):
            safe = [(escape(r), escape(t)) for r, t in turns]
            output, spans, texts, rewrites = locate(safe, template)
            cells = [{"start": span[0], "end": span[1], "text_start": a, "text_end": b, "loss": role == loss_role} for (role, _), span, (a, b) in zip(turns, spans, texts, strict=True)]
            held.append((conv, len(turns), output, cells, rewrites))
            size += len(output)
            if size > 1 << 22:
                yield block()
                size = 0
        if held:
            yield block()

    return dealt.mapInArrow(run, OUTPUT)


def read_back(df: DataFrame) -> DataFrame:
    """From the built-in template's outputs alone: turns, masked texts and their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns = parse(row["formatted"])
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(row["formatted"][s["text_start"] : s["text_end"]]) for s in row["spans"] if s["loss"])
                out.append((row["conv_id"], len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"])))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return df.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_SAID = "</s>[INST] ok [/INST]"
_ESCAPES = "|".join(re.sub(r"([\\|\[\]])", r"\\\1", c) for c in (*CONTROL, "\\"))
_LONGER = lambda c: f"length({c}) + len(regexp_extract_all({c}, '{_ESCAPES}'))"
_ORDER = "order by turn nulls first, r nulls first, t nulls first"
#: DuckDB SQL for the query's rows: each match of a control string or backslash makes a text one longer.
ORACLE = f"""
with a as (select conv_id, turn, role as r, text as t from conversations union all select -1, 0, 'user', '{_SAID}' union all select -1, 1, 'assistant', '{_SAID}'),
c as (select *, coalesce(r, '') as role, coalesce(t, '') as text, case when conv_id is null then row_number() over () end as alone from a)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' {_ORDER}) filter (role = 'assistant'), '')) as loss_sha256,
  ({len("<s>")} + sum({len(ROLE + TEXT + END)} + {_LONGER("role")} + {_LONGER("text")}))::bigint as formatted_chars
from c group by conv_id, alone
"""

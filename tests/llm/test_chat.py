import hashlib
import random
import time

import pytest

from evidentia.llm import chat
from evidentia.llm.queries import op5_chat

NASTY = ["", "\\", "\\\\", "<", "<|end|>", "<\\|end|>", "<|end|", "|>", "[INST] ok [/INST]</s>", "<|turn|>user<|text|>x", "<s>", "a\nb", "é😀", "<<SYS>>", "assistant", "x" * 30_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escape_is_reversible_and_hides_controls():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice([*chat.CONTROL, "\\", "<", "|", "end", ">", "x", "[", "INST", "]"]) for _ in range(rng.randint(0, 8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        # nor may one arise where a marker follows
        assert (safe + chat.END).index(chat.END) == len(safe)
        assert not any(c in safe for c in chat.CONTROL)


def test_parse_reads_back():
    rng = random.Random(2)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", *NASTY[:12]]), rng.choice(NASTY[:15])) for _ in range(rng.randint(0, 6))]
        output, spans, texts, rewrites = chat.locate([(chat.escape(r), chat.escape(t)) for r, t in turns], chat.turns_template)
        assert not rewrites and chat.parse(output) == turns
        assert [chat.unescape(output[a:b]) for a, b in texts] == [t for _, t in turns]
        assert [output[a:b] for a, b in spans] == [chat.turns_template([(chat.escape(r), chat.escape(t))])[3:] for r, t in turns]


def test_rewriting_templates_are_detected():
    def trims(turns):  # keeps thoughts in the last answer only
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t.split('|')[-1]}" for k, (r, t) in enumerate(turns))

    turns = [("u", "hi"), ("a", "think|yes"), ("u", "more")]
    output, spans, texts, rewrites = chat.locate(turns, trims)
    assert rewrites and output == "[u]hi[a]yes[u]more"
    assert output[slice(*spans[0])] == "[u]hi" and output[spans[2][0] :].endswith("[u]more")
    assert [output[a:b] for a, b in texts] == ["hi", "yes", "more"]
    assert not chat.locate(turns[:2], trims)[3]


@pytest.mark.parametrize("text", ["end", "d", "|", ">", "<", "", "assistant", "|>", "text", "<|end|>", "\ue000", "end" * 3000])
@pytest.mark.parametrize("role", ["assistant", "", "end", "t"])
def test_masks_lie_on_texts_not_on_controls(text, role):
    turns = [("user", text), (role, text), ("user", text)]
    safe = [(chat.escape(r), chat.escape(t)) for r, t in turns]
    output, _, texts, _ = chat.locate(safe, chat.turns_template)
    at = 3
    for (r, t), span in zip(safe, texts, strict=True):
        at += len(chat.ROLE) + len(r) + len(chat.TEXT)
        assert span == (at, at + len(t))
        at += len(t) + len(chat.END)
    assert at == len(output)


def test_texts_of_odd_templates():
    turns = [("u", "aa"), ("a", "b")]
    assert chat.locate(turns, lambda ts: "".join(f"{t}-{r};" for r, t in ts))[2] == [(0, 2), (5, 6)]
    assert chat.locate(turns, lambda ts: "".join(f"{r};" for r, _ in ts))[2] == [(2, 2), (4, 4)]  # left out
    assert chat.locate(turns, lambda ts: "".join(f"{t}{r}{t};" for r, t in ts))[2] == [(0, 5), (6, 9)]  # repeated
    assert chat.locate(turns, lambda ts: f"{len(ts)}" + "".join(t for _, t in ts))[2:] == ([(1, 3), (3, 4)], True)


def test_long_conversations():
    turns = [("user", f"turn {k} " + "x" * 90) for k in range(2000)]
    start = time.process_time()
    output, _, texts, _ = chat.locate(turns, chat.turns_template)
    assert [output[a:b] for a, b in texts] == [t for _, t in turns] and time.process_time() - start < 20


@pytest.mark.parametrize("template", [chat.turns_template, lambda turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)])
def test_loss_mask_of_any_template(spark, template):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a\\b"), (1, 2, "assistant", "<|im_end|>")]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template).first()
    got = [chat.unescape(out.formatted[s.text_start : s.text_end]) for s in out.spans if s.loss]
    assert got == ["a\\b", "<|im_end|>"]


def test_query(spark, write_tables):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([*NASTY, None])) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(7, 99, "assistant", "twice"), (7, 99, "assistant", "twice"), (None, 0, "assistant", "lost"), (None, 0, "user", None), (8, None, "user", "first")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    every = op5_chat(spark, write_tables(conversations=df)).collect()
    got = {r.conv_id: r for r in every if r.conv_id is not None}
    # Each row without an id is a conversation.
    assert sorted((r.n_turns, r.turns_sha256, r.loss_chars) for r in every if r.conv_id is None) == sorted([(1, sha("assistant\nlost\n"), 4), (1, sha("user\n\n"), 0)])
    rows = [r for r in rows if r[0] is not None]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = [(role, text) for c, turn, role, text in sorted((x for x in rows if x[0] == conv), key=lambda x: tuple((y is not None, y or "") if not isinstance(y, int) else (True, y) for y in x[1:]))]
        loss = "".join(t or "" for role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == sha("".join(f"{role or ''}\n{t or ''}\n" for role, t in own))
        assert r.loss_sha256 == sha(loss) and r.formatted_chars > 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.render(df)).count() == 0

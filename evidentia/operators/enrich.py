"""Calls of a language model as joins: prompts are rows, answers come from a replay table or a given function.

Nothing here reaches a network. A cache of answers is keyed by the hash of phase and prompt,
so an answer that exists is never asked for again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import code_fence, extract_json
from evidentia.operators import pairs
from evidentia.operators.ranking import top_per_key
from evidentia.operators.scans import middle_truncated


def prompts(df: DataFrame, key: str, phase: str, prompt: Column) -> DataFrame:
    """(key, phase, prompt, prompt_hash) of each row."""
    rows = df.select(F.col(key), F.lit(phase).alias("phase"), prompt.alias("prompt"))
    return rows.withColumn("prompt_hash", F.sha2(F.to_json(F.struct("phase", "prompt")), 256))


def answered(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """``asked`` with ``response_text``, null where the cache has none."""
    return asked.join(cache.select("prompt_hash", "response_text").dropDuplicates(["prompt_hash"]), "prompt_hash", "left")


def patient(model: Callable[[str, str], str], tries: int = 8, wait: float = 5.0, most: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str, str], str | None]:
    """``model`` tried up to ``tries`` times, with waits that double up to ``most`` seconds; null if all fail, so that one prompt ends no job."""

    def call(phase: str, prompt: str) -> str | None:
        for k in range(tries):
            try:
                return model(phase, prompt)
            except Exception:  # whatever a backend raises
                if k + 1 < tries:
                    sleep(min(most, wait * 2**k))
        return None

    return call


def routed(models: Mapping[str, Callable[[str, str], str]], routes: Mapping[str, Sequence[str]], default: str) -> Callable[[str, str], str]:
    """A model that takes each phase to the first of its backends that there is, else to the default one, else to the first by name."""
    if not models:
        raise ValueError("no backend")

    def call(phase: str, prompt: str) -> str:
        name = next((b for b in (*routes.get(phase, ()), default, *sorted(models)) if b in models))
        return models[name](phase, prompt)

    return call


def ask(asked: DataFrame, cache: DataFrame, model: Callable[[str, str], str | None]) -> DataFrame:
    """New cache rows (prompt_hash, phase, response_text) for prompts without an answer, each distinct one asked once; what gets none makes no row."""
    missing = asked.dropDuplicates(["prompt_hash"]).join(cache, "prompt_hash", "left_anti").select("prompt_hash", "phase", "prompt")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"prompt_hash": frame["prompt_hash"], "phase": frame["phase"], "response_text": [model(p, t) for p, t in zip(frame["phase"], frame["prompt"], strict=True)]})

    return missing.mapInPandas(run, "prompt_hash string, phase string, response_text string").filter("response_text is not null")


def parsed(answers: DataFrame, key: str, item: str, wrappers: Sequence[str] = ("items", "results", "data")) -> DataFrame:
    """(key, fields of ``item``): the answers' JSON as rows. ``item`` is the schema of one; a list may stand alone or under a wrapper key; what isn't JSON gives no rows."""
    found = answers.withColumn("_json", extract_json(code_fence(F.col("response_text"))))
    alone = F.from_json("_json", f"array<struct<{item}>>")
    wrapped = [F.from_json(F.get_json_object("_json", f"$.{w}"), f"array<struct<{item}>>") for w in wrappers]
    starts = F.col("_json").startswith("[")
    rows = F.coalesce(F.when(starts, alone), *(F.when(~starts, w) for w in wrapped))
    return found.select(key, F.explode(rows).alias("_x")).filter("_x is not null").select(key, "_x.*")


# What is asked for at each step, as templates of columns; answers are JSON lists of the items below.
ASKED = {
    "extraction": "List the key formulas of {title} ({year}) as JSON with latex, formula_type, quantity_type, description, confidence.\n\n{content}",
    "normalization": "Write {latex} in standard notation, as JSON with normalized_latex and normalized_sympy.",
    "classification": "Is {latex}, after {before}, a key result? Answer in JSON with is_key_result, quantity_type, description, value.",
    "assumption_extraction": "List the premises of {title} as JSON with assumption_text, assumption_type, category.\n\n{content}",
    "obstacle_extraction": "List what stands in the way of {title}, as JSON with obstacle_type, description.\n\n{content}",
    "contradiction_finding": "Which premises contradict each other? JSON with assumption_a, assumption_b, severity, description.\n\n{a}:\n{list_a}\n\n{b}:\n{list_b}",
    "premise_tracing": "On which premises does {result} rest? JSON with assumption_text.",
    "shared_failure": "Group these premises by meaning, as JSON with name, members.\n\n{listed}",
    "success_comparison": "What does {success} do otherwise than the rest? JSON with key_differentiators.\n\n{listed}",
    "reframing": "{instruction}\n\nProblem: {problem}\n{evidence}\n\nJSON with current_premise, proposed_shift, evidence_for, evidence_against.",
    "conjecture": "State what {subject} suggests, as JSON with title, statement_latex, statement_natural, conjecture_type.",
    "dimension_check": "Are both sides of {latex} of one dimension? JSON with consistent.",
    "novelty_check": "Is {title} known? JSON with is_novel, reference.",
    "investigation": "Examine: {title}. {statement}. JSON with derivation, predictions, objections.",
    "narrative": "Summarise for a reader in the field.\n\n{listed}",
}
#: Ways to question a premise.
PATTERNS = {
    "drop_premise": "Drop the premise and see what remains.",
    "dual_description": "Look for a second description of the same thing.",
    "obstacle_as_feature": "Take the obstacle for a fact of nature.",
    "change_level": "Describe it at another level.",
    "invert_cause": "Swap cause and effect.",
}


def filled(phase: str, columns: Mapping[str, Column], templates: Mapping[str, str] = ASKED) -> Column:
    """The phase's template with columns put in; nulls are empty."""
    out = F.lit(templates[phase])
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
    return out


def extraction_prompts(papers: DataFrame, key: str = "id", most: int = 150_000) -> DataFrame:
    """Prompts for the formulas of papers (id, title, year, content); long ones keep their first and last third."""
    return prompts(papers, key, "extraction", filled("extraction", {"title": F.col("title"), "year": F.col("year"), "content": middle_truncated(F.col("content"), most)}))


def key_results(answers: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Rows of parsed classifications that are key results, their value added to the description."""
    found = answers.filter(F.coalesce("is_key_result", F.lit(False)))
    stated = F.when(F.col(value).isNotNull() & (F.trim(value) != ""), F.concat("description", F.lit(" = "), value)).otherwise(F.col("description"))
    return found.withColumn("description", stated)


def contradiction_prompts(premises: DataFrame, group: str, text: str, rank: str, most: int = 20) -> DataFrame:
    """A prompt for each unordered pair of groups, with the ``most`` premises of each by rank."""
    top = top_per_key(premises, [group], [F.desc(rank), text], most)
    lists = top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t")))), lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("listed"))
    side = lambda s: lists.select(F.col(group).alias(s), F.col("listed").alias(f"list_{s}"))
    met = pairs.group_pairs(lists, group).join(side("a"), "a").join(side("b"), "b").withColumn("pair", F.concat_ws("|", "a", "b"))
    return prompts(met, "pair", "contradiction_finding", filled("contradiction_finding", {c: F.col(c) for c in ("a", "b", "list_a", "list_b")}))


def reframing_prompts(problems: DataFrame, key: str, problem: str, evidence: str, patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """A prompt for each problem and pattern; ``key`` becomes key|pattern."""
    ways = problems.sparkSession.createDataFrame(list(patterns.items()), "pattern string, instruction string")
    each = problems.withColumn("_p", F.explode(F.array(*map(F.lit, patterns)))).join(F.broadcast(ways), F.col("_p") == F.col("pattern"))
    each = each.withColumn("asked", F.concat_ws("|", F.col(key).cast("string"), "pattern"))
    return prompts(each, "asked", "reframing", filled("reframing", {"instruction": F.col("instruction"), "problem": F.col(problem), "evidence": F.col(evidence)}))


def first_of_each(answers: DataFrame, key: str, order: Sequence[Column | str], most: int = 3) -> DataFrame:
    """At most ``most`` parsed rows of each prompt."""
    return top_per_key(answers, [key], order, most).drop("rank")


def worth_investigating(conjectures: DataFrame, most: int, statuses: Sequence[str] = ("verified", "inconclusive")) -> DataFrame:
    """The best conjectures of these statuses; their number is that of the deep look."""
    return conjectures.filter(F.col("status").isin(list(statuses))).orderBy(F.desc("combined_score"), "id").limit(most)


def numbered_sections(equations: DataFrame, item: str, text: str, order: Sequence[str]) -> DataFrame:
    """(item, listed): what a prompt lists of an item, numbered, in order."""
    place = F.row_number().over(Window.partitionBy(item).orderBy(*order))
    rows = equations.withColumn("_n", place).groupBy(item).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t")))).alias("_r"))
    return rows.select(item, F.array_join(F.transform("_r", lambda r: F.concat(r["_n"].cast("string"), F.lit(". "), r["t"])), "\n").alias("listed"))

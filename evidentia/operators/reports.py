"""Reports and console tables from rows that Spark has worked out; only a report's short lists meet in one place."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.sinks import report, section

# Marks of the statuses in a list of conjectures.
MARKS = {"verified": "✓", "disproved": "✗", "known": "●", "inconclusive": "?", "proposed": "○"}


def convergent(conjectures: DataFrame) -> DataFrame:
    """Conjectures that say something universal, or are verified."""
    return conjectures.filter((F.col("conjecture_type") == "universality") | (F.col("status") == "verified"))


def summary_lines(counts: Mapping[str, int]) -> str:
    return "\n".join(f"- {name}: {n}" for name, n in counts.items())


def counted(df: DataFrame, title: str, by: str, most: int = 100) -> DataFrame:
    """A section of counts by a column, in its order."""
    return section(df.groupBy(by).agg(F.count("*").alias("n")), title, F.concat(F.lit("- "), by, F.lit(": "), F.col("n").cast("string")), [by], most)


def ranked(conjectures: DataFrame, title: str, most: int = 100) -> DataFrame:
    """A section of conjectures, best first, with their marks, scores and statuses."""
    mark = F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))
    line = F.concat(F.lit("- ["), F.coalesce(F.try_element_at(mark, F.col("status")), F.lit("?")), F.lit("] "), "title", F.lit(" (score="), F.format_number("combined_score", 2), F.lit(", status="), "status", F.lit(")"))
    return section(conjectures, title, line, [F.desc("combined_score"), "title"], most)


def run_report(counts: Mapping[str, int], formulas: DataFrame, conjectures: DataFrame) -> str:
    """Summary of a run: table counts, formulas by framework, verified and known conjectures, all of them ranked."""
    head = conjectures.sparkSession.createDataFrame([("Summary", f"## Summary\n\n{summary_lines(counts)}")], "section string, text string")
    verified = section(conjectures.filter("status = 'verified'"), "Verified novel conjectures", F.concat(F.lit("- "), "title", F.lit(": "), F.coalesce("statement_natural", F.lit(""))), [F.desc("combined_score"), "title"], 100)
    known = section(conjectures.filter("status = 'known'"), "Rediscovered known connections", F.concat(F.lit("- "), "title"), ["title"], 100)
    return report("Report", [head, counted(formulas, "Formulas by framework", "theory_slug"), verified, known, ranked(conjectures, "All conjectures")])


def premise_report(conjectures: DataFrame, assumptions: DataFrame, shifts: DataFrame, contradictions: DataFrame, obstacles: DataFrame, top: int = 20, narrative: str = "") -> str:
    """Convergences, shared assumptions, best premise shifts, contradictions and obstacles, and a narrative if one is given."""
    shared = assumptions.groupBy(F.lower(F.trim("assumption_text")).alias("text")).agg(F.countDistinct("theory_slug").alias("n")).filter("n >= 2")
    parts = [
        section(convergent(conjectures), "Convergences", F.concat(F.lit("- "), "title"), ["title"], 100),
        section(shared, "Shared assumptions", F.concat(F.lit("- "), "text", F.lit(" ("), F.col("n").cast("string"), F.lit(" frameworks)")), [F.desc("n"), "text"], 100),
        section(shifts, "Premise shifts", F.concat(F.lit("- "), "proposed_shift", F.lit(" ("), F.format_number("score", 2), F.lit(")")), [F.desc("score"), "proposed_shift"], top),
        section(contradictions, "Contradictions", F.concat(F.lit("- ["), "severity", F.lit("] "), "description"), ["description"], 100),
        section(obstacles, "Obstacles", F.concat(F.lit("- "), "description"), ["description"], 100),
    ]
    return report("Premises", parts) + (f"\n{narrative}\n" if narrative else "")


def breakthrough_report(symptoms: DataFrame, matches: DataFrame, prediction: DataFrame, constraints: DataFrame, shifts: DataFrame, accuracy: float, dataset: int) -> str:
    """Symptoms by type, closest records, probable kinds of error, constraints and best shifts."""
    spark = symptoms.sparkSession
    tail = spark.createDataFrame([("Data", f"## Data\n\n- records: {dataset}\n- accuracy left out one by one: {accuracy:.2f}")], "section string, text string")
    parts = [
        counted(symptoms, "Symptoms", "symptom_type"),
        section(matches, "Closest records", F.concat(F.lit("- "), "field", F.lit(" ("), F.col("year").cast("string"), F.lit("): "), F.format_number("similarity", 2)), [F.desc("similarity"), "field"], 5),
        section(prediction, "Probable kinds of error", F.concat(F.lit("- "), "error", F.lit(": "), F.format_number("probability", 2)), [F.desc("probability"), "error"], 7),
        section(constraints, "What a new premise must reproduce", F.concat(F.lit("- "), "topic"), ["topic"], 100),
        section(shifts, "Premise shifts", F.concat(F.lit("- "), "proposed_shift"), [F.desc("score"), "proposed_shift"], 10),
        tail,
    ]
    return report("Breakthrough", parts)


def console_table(df: DataFrame, order: Sequence[Column | str], most: int = 20, width: int = 40) -> str:
    """The first ``most`` rows in order as a table for the console; cells are cut at ``width``."""
    rows = [[("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))[:width] for v in r] for r in df.orderBy(*order).limit(most).collect()]
    sizes = [max(map(len, column)) for column in zip(df.columns, *rows, strict=True)]
    line = lambda cells: " | ".join(c.ljust(n) for c, n in zip(cells, sizes, strict=True)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * n for n in sizes), *map(line, rows)])


def investigation_json(found: DataFrame, path: str, key: str = "id") -> None:
    """One JSON file row for each investigation, ordered within a file by its key."""
    found.sortWithinPartitions(key).write.mode("overwrite").json(path)


def investigation_text(row: Mapping[str, object]) -> str:
    return json.dumps(row, sort_keys=True, ensure_ascii=False, default=str)


def scatter_svg(df: DataFrame, x: str, y: str, label: str, most: int = 2000, size: int = 480) -> str:
    """A drawing of the first ``most`` points by label, a colour each; more than a page can show is left to the caller's choice of rows."""
    rows = [(float(r[x]), float(r[y]), str(r[label])) for r in df.select(x, y, label).dropna().orderBy(label, x, y).limit(most).collect()]
    labels = sorted({r[2] for r in rows})
    scaled = lambda v, values: round(20 + (size - 40) * (v - min(values)) / ((max(values) - min(values)) or 1), 1)
    xs, ys = [r[0] for r in rows], [r[1] for r in rows]
    dots = [f'<circle cx="{scaled(a, xs)}" cy="{round(size - scaled(b, ys), 1)}" r="3" fill="hsl({360 * labels.index(t) // len(labels)},60%,45%)"><title>{html.escape(t)}</title></circle>' for a, b, t in rows]
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}">', *dots, "</svg>"]) + "\n"


def heatmap_svg(df: DataFrame, row: str, column: str, value: str, most: int = 2000, cell: int = 24) -> str:
    """A drawing of a matrix given as cells (row, column, value), darker for larger values."""
    cells = [(str(r[row]), str(r[column]), float(r[value])) for r in df.select(row, column, value).dropna().orderBy(row, column).limit(most).collect()]
    down, across, top = sorted({c[0] for c in cells}), sorted({c[1] for c in cells}), max((abs(c[2]) for c in cells), default=1.0) or 1.0
    boxes = [f'<rect x="{across.index(b) * cell}" y="{down.index(a) * cell}" width="{cell}" height="{cell}" fill="hsl(210,60%,{round(95 - 60 * abs(v) / top)}%)"><title>{html.escape(f"{a} / {b}: {v:g}")}</title></rect>' for a, b, v in cells]
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{cell * len(across)}" height="{cell * len(down)}">', *boxes, "</svg>"]) + "\n"

"""Reports and exports: the rows are worked out by Spark, only short lists of lines meet in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a Parquet table, partitioned for the scans that filter by those columns."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def section(df: DataFrame, title: str, line: Column, order: Sequence[Column | str], most: int) -> DataFrame:
    """(section, text): a Markdown section of the first ``most`` rows in order; most is the length of a report's list."""
    top = df.orderBy(*order).limit(most).select(line.alias("_line"), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order if isinstance(c, str)] or [F.lit(0)]).alias("_o"))
    text = F.array_join(F.collect_list("_line"), "\n")
    return top.agg(text.alias("text")).select(F.lit(title).alias("section"), F.concat(F.lit(f"## {title}\n\n"), F.coalesce("text", F.lit(""))).alias("text"))


def report(title: str, sections: Sequence[DataFrame]) -> str:
    """Markdown of a title and the sections, in the order given."""
    return "\n\n".join([f"# {title}", *(s.first()["text"] for s in sections)]) + "\n"


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per node and edge, for files that other tools read."""
    one = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value"))
    return one.unionAll(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *edges.columns))))


def latex_document(title: str, authors: Sequence[str], abstract: str, sections: Sequence[tuple[str, str]]) -> str:
    """A LaTeX paper from its parts."""
    body = "\n\n".join(f"\\section{{{name}}}\n{text}" for name, text in sections)
    return f"\\documentclass{{article}}\n\\title{{{title}}}\n\\author{{{' and '.join(authors)}}}\n\\begin{{document}}\n\\maketitle\n\\begin{{abstract}}\n{abstract}\n\\end{{abstract}}\n\n{body}\n\\end{{document}}\n"

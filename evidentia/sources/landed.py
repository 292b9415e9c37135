"""Sources that land as files: papers, references and search hits as JSON, LaTeX trees and archives, PDF files, key=value settings. Nothing here calls a network."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators.scans import keep_first, tag_by_keywords
from evidentia.schema import schema


def papers(spark: SparkSession, path: str) -> DataFrame:
    """Paper records from JSON lines, with the fixed schema; no inference pass."""
    return spark.read.schema(schema("papers")).json(path)


def tiered(tiers: Mapping[int, DataFrame], key: str = "arxiv_id", recent: Mapping[int, int] = {}) -> DataFrame:  # noqa: B006
    """Union of tiers with their number, the lowest tier's row kept for each key; ``recent`` asks a tier for a year and later."""
    parts = []
    for tier, df in sorted(tiers.items()):
        df = df.filter(F.col("year") >= recent[tier]) if tier in recent else df
        parts.append(df.withColumn("tier", F.lit(tier)))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return keep_first(out, [key], ["tier", *(c for c in ("title",) if c in out.columns)])


def bridges(df: DataFrame, text: str, tags: Mapping[str, Sequence[str]], least: int = 2) -> DataFrame:
    """Rows that two or more tags' keywords occur in, with the tags."""
    return df.withColumn("theory_tags", tag_by_keywords(F.col(text), tags)).filter(F.size("theory_tags") >= least)


def tex_files(spark: SparkSession, path: str) -> DataFrame:
    """(project, name, text) of the .tex files under ``path``; a file's folder is its project."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tex").text(path, wholetext=True)
    full = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(full, r"([^/]+)/[^/]+$", 1).alias("project"), F.regexp_extract(full, r"([^/]+)\.tex$", 1).alias("name"), F.col("value").alias("text"))


def main_files(files: DataFrame) -> DataFrame:
    """One file per project: the one that begins a document, else the longest."""
    place = F.row_number().over(Window.partitionBy("project").orderBy(~F.col("text").contains(r"\begin{document}"), F.desc(F.length("text")), "name"))
    return files.withColumn("_p", place).filter("_p = 1").drop("_p")


def include_once(main: DataFrame, files: DataFrame) -> DataFrame:
    r"""``main`` with each \input and \include replaced by the file it names; one level a call. What names no file goes."""
    pattern = r"\\(?:input|include)\{([^}]+)\}"
    gaps = F.split("text", pattern, -1)
    names = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda n: F.regexp_replace(F.regexp_extract(n, r"([^/]+)$", 1), r"\.tex$", ""))
    each = main.withColumn("_gaps", gaps).withColumn("_names", names)
    parts = each.select("project", "name", F.posexplode("_gaps").alias("_at", "_gap"), F.col("_names")).withColumn("_file", F.get("_names", F.col("_at")))
    known = files.select("project", F.col("name").alias("_file"), F.col("text").alias("_body"))
    joined = parts.join(known, ["project", "_file"], "left")
    pieces = F.array_sort(F.collect_list(F.struct("_at", F.concat("_gap", F.coalesce("_body", F.lit(""))).alias("t"))))
    return joined.groupBy("project", "name").agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("text"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a key=value file; comments and blank lines skipped, quotes around values dropped. Spark skips files whose names begin with a dot, so it must have another name."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '#') and contains(line, '=')")
    value = F.regexp_replace(F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)), "^[\"']|[\"']$", "")
    return lines.select(F.trim(F.substring_index("line", "=", 1)).alias("key"), value.alias("value"))


def tex_archives(spark: SparkSession, path: str) -> DataFrame:
    """(project, name, text) of the .tex files in landed .tar, .tar.gz, .tgz and .gz archives; the archive's name is the project. What cannot be read gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").rlike(r"\.(tar|tgz|gz)$"))
    project = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.(tar\.gz|tar|tgz|gz)$", "")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(p, *part) for p, content in zip(frame["project"], frame["content"], strict=True) for part in tex_parts(bytes(content))]
            yield pd.DataFrame(found, columns=["project", "name", "text"])

    return files.select(project.alias("project"), "content").mapInPandas(unpack, "project string, name string, text string")


def tex_parts(content: bytes) -> list[tuple[str, str]]:
    """(name, text) of the .tex files in an archive, or of a lone compressed one."""
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as packed:
            members = [m for m in packed if m.isfile() and m.name.endswith(".tex")]
            return [(m.name.rsplit("/", 1)[-1].removesuffix(".tex"), packed.extractfile(m).read().decode("utf-8", "replace")) for m in members]
    except (tarfile.TarError, EOFError, OSError, zlib.error):
        pass
    try:
        return [("main", gzip.decompress(content).decode("utf-8", "replace"))]
    except (OSError, EOFError, zlib.error):
        return []


def references(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """(src, dst) edges from landed JSON lines (paper, references: list of ids), the first ``most`` of each paper; repeated and empty ids go."""
    rows = spark.read.schema("paper string, references array<string>").json(path)
    return rows.select(F.col("paper").alias("src"), F.explode(F.slice("references", 1, most)).alias("dst")).filter("src is not null and dst is not null and dst <> '' and src <> dst").distinct()


def search_hits(spark: SparkSession, path: str) -> DataFrame:
    """(query, hits, highly_cited) from landed JSON lines (query, data: list of papers with citationCount): how many works a search found, and how many of those are cited more than 20 times."""
    rows = spark.read.schema("query string, data array<struct<title:string,citationCount:int>>").json(path)
    cited = F.size(F.filter("data", lambda x: x["citationCount"] > 20))
    return rows.groupBy("query").agg(F.max(F.coalesce(F.size("data"), F.lit(0))).alias("hits"), F.max(F.coalesce(cited, F.lit(0))).alias("highly_cited"))


_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?P<one>(?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[(?P<many>(?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(?P<line>T\*|Td|TD|ET)", re.S)
_LITERAL = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
# Escapes in literal strings of a PDF.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_text(content: bytes) -> str:
    """The text that a PDF's content streams show, a stream after another, joined by newlines; fonts with encodings of their own are not decoded."""
    pages = []
    for m in _STREAM.finditer(content):
        data = m[2]
        if b"FlateDecode" in m[1]:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        elif b"/Filter" in m[1]:
            continue
        if b"BT" not in data:
            continue
        out = []
        for s in _SHOWN.finditer(data):
            if s["line"]:
                out.append(b"\n")
                continue
            parts = [s["one"]] if s["one"] is not None else _LITERAL.findall(s["many"])
            out += [_ESCAPE.sub(lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else _ESCAPES.get(e[1], e[1]), p) for p in parts]
        text = "\n".join(line.strip() for line in b"".join(out).decode("latin-1").splitlines() if line.strip())
        if text:
            pages.append(text)
    return "\n".join(pages)


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the landed PDF files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"name": frame["name"], "text": [pdf_text(bytes(c)) for c in frame["content"]]})

    return files.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("name"), "content").mapInPandas(read, "name string, text string")

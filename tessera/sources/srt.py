"""Scans of subtitle files, edit files, glossaries, reviews and the workspace."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import TIMING, is_number, strip

#: Line ends of an edit file, as Python's splitlines has them.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def files(spark: SparkSession, paths: list[str] | str, pattern: str | None = None) -> DataFrame:
    """(path, name, content) of files; ``path`` keeps spaces and has no scheme.

    Spark's scan leaves out empty files.  A list of plain paths (no folders) gets them back.
    """
    read = spark.read.format("binaryFile")
    if pattern:
        read = read.option("pathGlobFilter", pattern)
    path = F.regexp_replace("path", "^file:/*", "/")
    found = read.load(paths).select(path.alias("path"), "content")
    if isinstance(paths, list) and not pattern and not any(c in p for p in paths for c in "*?["):
        named = spark.createDataFrame([(re.sub("^file:/*", "/", p) if ":" in p.split("/")[0] else os.path.abspath(p),) for p in dict.fromkeys(paths)], "path string")
        found = named.join(found, "path", "left").select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def expand(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(paths, patterns without a match); patterns are expanded in order, plain paths pass through."""
    paths, missing = [], []
    for p in patterns:
        if any(c in p for c in "*?["):
            found = sorted(glob.glob(p))
            paths += found
            missing += [] if found else [p]
        else:
            paths.append(p)
    return paths, missing


def plain(content: Column) -> Column:
    """Text of file bytes: no byte order mark, line feeds only; null if it isn't UTF-8."""
    text = content.cast("string")
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n|\r", "\n")
    return F.when(F.is_valid_utf8(text), clean)


def parse_srt(texts: DataFrame, *keys: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Blocks (keys, pos, idx, timing, lines) and errors (keys, pos, code, detail) of subtitle texts.

    Chunks are parted by lines of nothing but spaces and tabs.  Codes: not_utf8 (null text), empty,
    short, bad_id, bad_timing; a faulty block stays.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"\A\n+", ""), r"\n+\z", "")
    void = strip(body) == ""
    chunks = texts.select(*keys, F.posexplode(F.when(~void, F.split(body, r"\n[ \t]*\n+", -1))).alias("at", "chunk"))
    blocks, errors = blocks_of(chunks.select(*keys, (F.col("at") + 1).alias("pos"), "chunk"), *keys)
    whole = texts.select(*keys, F.lit(0).alias("pos"), F.lit(0).alias("n"), F.when(F.col(text).isNull(), "not_utf8").when(void, "empty").alias("code"), F.lit("").alias("detail")).where("code is not null")
    return blocks, whole.unionByName(errors)


def blocks_of(chunks: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and their errors of chunks (keys, pos, chunk)."""
    lines = chunks.select(*keys, "pos", F.split("chunk", "\n", -1).alias("all"))
    short = F.size("all") < 2
    blocks = lines.select(
        *keys, "pos", strip(F.col("all")[0]).alias("idx"), F.when(short, "").otherwise(strip(F.get("all", F.lit(1)))).alias("timing"),
        F.when(short, F.array().cast("array<string>")).otherwise(F.slice("all", 3, F.greatest(F.size("all") - 2, F.lit(0)))).alias("lines"), short.alias("short"),
    )
    said = lambda when, code, detail: F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))
    faults = F.array_compact(F.array(
        said(F.col("short"), "short", F.lit("1")),
        said(~F.col("short") & ~is_number(F.col("idx")), "bad_id", F.col("idx")),
        said(~F.col("short") & ~F.col("timing").rlike(TIMING), "bad_timing", F.col("timing")),
    ))
    errors = blocks.select(*keys, "pos", F.posexplode(faults).alias("n", "e")).select(*keys, "pos", "n", "e.*")
    return blocks.drop("short"), errors


def read_srt(spark: SparkSession, paths: list[str] | str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`parse_srt` of files, keyed by path."""
    return parse_srt(files(spark, paths, pattern).select("path", plain(F.col("content")).alias("text")), "path")


def parse_edits(texts: DataFrame, *keys: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Edits (keys, line_no, idx, text) and problems (keys, line_no, code, detail) of ``ID | text`` files.

    Codes: not_utf8, malformed, repeated (from an ID's second line on), empty_text.  All lines of an ID
    stay; the last one counts, see :func:`last_edits`.
    """
    form = r"(?sU)^\s*(\p{Nd}+)\s*\|\s?(.*)$"
    lines = texts.select(*keys, F.posexplode(F.split(text, LINE_ENDS, -1)).alias("at", "line")).where(strip(F.col("line")) != "")
    fits = F.col("line").rlike(form)
    parts = lines.select(*keys, (F.col("at") + 1).alias("line_no"), "line", fits.alias("fits"), F.regexp_extract("line", form, 1).alias("idx"), strip(F.regexp_extract("line", form, 2)).alias("new"))
    edits = parts.where("fits").select(*keys, "line_no", "idx", F.col("new").alias("text"))
    turn = F.row_number().over(Window.partitionBy(*keys, "idx").orderBy("line_no"))
    say = lambda df, code, detail: df.select(*keys, "line_no", F.lit(code).alias("code"), detail.alias("detail"))
    problems = (
        say(parts.where("not fits"), "malformed", F.substring("line", 1, 60))
        .unionByName(say(edits.withColumn("turn", turn).where("turn > 1"), "repeated", F.col("idx")))
        .unionByName(say(edits.where("text = ''"), "empty_text", F.col("idx")))
        .unionByName(texts.where(F.col(text).isNull()).select(*keys, F.lit(0).alias("line_no"), F.lit("not_utf8").alias("code"), F.lit("").alias("detail")))
    )
    return edits, problems


def last_edits(edits: DataFrame, *keys: str) -> DataFrame:
    """The last line of each ID."""
    return edits.groupBy(*keys, "idx").agg(F.max_by("text", "line_no").alias("text"))


def read_edits(spark: SparkSession, path: list[str] | str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_edits(files(spark, path, pattern).select("path", "name", plain(F.col("content")).alias("text")), "path", "name")


SEPARATOR_CELL = "^:?-{3,}:?$"


def cells_of(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|", -1), strip)


def is_separator(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c == "") | F.replace(c, F.lit(" "), F.lit("")).rlike(SEPARATOR_CELL))


def parse_tables(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, section, table_no, row_no, line_no, cells map) of the pipe tables of Markdown texts.

    Comments don't count.  A line that doesn't begin with a pipe ends a table; its first line names the
    columns; separator lines, and lines of empty cells, are skipped.  ``section`` is the number of the
    last ``## N.`` heading, or null.
    """
    clean = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    lines = texts.select(*keys, F.posexplode(F.split(clean, "\n", -1)).alias("line_no", "line"))
    order = Window.partitionBy(*keys).orderBy("line_no") if keys else Window.orderBy("line_no")
    pipe = F.regexp_like(strip(F.col("line")), F.lit(r"^\|"))
    heading = F.regexp_extract("line", r"^##\s+(\d+)\.", 1)
    marked = lines.withColumn("pipe", pipe).withColumn("section", F.last(F.when(heading != "", heading.cast("int")), ignorenulls=True).over(order))
    table = marked.withColumn("table_no", F.sum((~F.col("pipe")).cast("int")).over(order)).where("pipe").withColumn("cells", cells_of(F.col("line"))).where(~is_separator(F.col("cells")))
    within = Window.partitionBy(*keys, "table_no").orderBy("line_no")
    rows = table.withColumn("row_no", F.row_number().over(within) - 1).withColumn("header", F.first("cells").over(within))
    n = F.least(F.size("header"), F.size("cells"))
    paired = F.map_from_entries(F.filter(F.arrays_zip(F.slice("header", F.lit(1), n).alias("k"), F.slice("cells", F.lit(1), n).alias("v")), lambda p: F.lit(True)))
    repeated = F.size(F.array_distinct(F.slice("header", F.lit(1), n))) < n
    # Of columns with one name the last counts.
    last = F.aggregate(F.sequence(F.lit(1), n), F.create_map().cast("map<string,string>"), lambda m, i: F.map_concat(F.map_filter(m, lambda k, v: k != F.element_at("header", i)), F.create_map(F.element_at("header", i), F.element_at("cells", i))))
    return rows.where("row_no > 0").select(*keys, "section", "table_no", "row_no", "line_no", "header", F.when(repeated, last).otherwise(paired).alias("cells"))


def options(cell: Column) -> Column:
    """Spellings of a cell, parted by slash, comma or fullwidth comma."""
    return F.filter(F.transform(F.split(cell, "[/,，]", -1), strip), lambda o: o != "")


STATUS, APPROVED = "Trạng thái", "x"  # fixed values: the status column's name and its mark


def rules_of(tables: DataFrame, source: str, target: str, approved_only: bool = True) -> DataFrame:
    """(line_no, cell, sources, targets) of the rows of tables that have both columns and a status."""
    needed = F.array(*map(F.lit, (source, target, STATUS)))
    rows = tables.where(F.size(F.array_except(needed, F.col("header"))) == 0)
    if approved_only:
        rows = rows.where(F.lower(F.coalesce(F.col("cells")[STATUS], F.lit(""))) == APPROVED)
    out = rows.select("line_no", F.col("cells")[source].alias("cell"), options(F.col("cells")[source]).alias("sources"), options(F.col("cells")[target]).alias("targets"))
    return out.where((F.size("sources") > 0) & (F.size("targets") > 0))


def glossary_lines(texts: DataFrame, sections: set[int] | None, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line_no, section, line) of a glossary without comments and title, tables compact; all or some sections."""
    clean = F.regexp_replace(text, r"(?s)<!--.*?-->\n?", "")
    lines = texts.select(*keys, F.posexplode(F.split(clean, "\n", -1)).alias("line_no", "line"))
    order = Window.partitionBy(*keys).orderBy("line_no") if keys else Window.orderBy("line_no")
    heading = F.regexp_extract("line", r"^##\s+(\d+)\.", 1)
    marked = lines.withColumn("section", F.last(F.when(heading != "", heading.cast("int")), ignorenulls=True).over(order))
    marked = marked.where((heading != "") | ~F.col("line").rlike(r"^#\s"))
    if sections is not None:
        marked = marked.where(F.col("section").isin(sorted(sections)))
    cells = cells_of(F.col("line"))
    compact = F.concat(F.lit("| "), F.array_join(F.when(is_separator(cells), F.transform(cells, lambda c: F.lit("---"))).otherwise(cells), " | "), F.lit(" |"))
    return marked.withColumn("line", F.when(F.regexp_like(strip(F.col("line")), F.lit(r"^\|")), compact).otherwise(F.col("line"))).select(*keys, "line_no", "section", "line")


def count_open(text: Column) -> Column:
    """Headings of a review whose last field is pending or unsure."""
    return F.regexp_count(text, F.lit(r"(?imdU)^###.*\|\s*(?:pending|unsure)\s*$"))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, mtime) of the subtitle files in a folder, without reading them."""
    path = F.regexp_replace("path", "^file:/*", "/")
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.srt").load(folder)
    return read.select(path.alias("path"), F.regexp_extract(path, r"([^/]*)\.srt$", 1).alias("stem"), F.col("modificationTime").alias("mtime"))


# Fixed value: a file's name and its language code.
NAME_AND_LANGUAGE = r"^(.+)\.([a-z]{2,3}(?:-[A-Za-z0-9]+)?)$"

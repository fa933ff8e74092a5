"""Operators over one relation of blocks (path, pos, idx, timing, lines)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import joined, quote, strip, timing_end


def in_range(start: int = 0, end: int = 0, pos: str = "pos") -> Column:
    """Positions from ``start`` to ``end``; 0 leaves a side open."""
    kept = F.lit(True)
    if start:
        kept = kept & (F.col(pos) >= start)
    return kept & (F.col(pos) <= end) if end else kept


def parse_ids(spec: str) -> list[tuple[int, int]]:
    """``57,63,120-125`` as number ranges; ValueError if it isn't one."""
    out = []
    for part in re.split(r"[,\s]+", spec.strip()):
        if not (m := re.fullmatch(r"(\d+)(?:-(\d+))?", part)):
            raise ValueError(f"not an ID list: {part!r}")
        out.append((int(m[1]), int(m[2] or m[1])))
    return out


def with_ids(ranges: list[tuple[int, int]], idx: str = "idx") -> Column:
    """Whether an ID is one of the ranges' numbers, written without leading zeros."""
    number = F.expr(f"try_cast({idx} AS DECIMAL(38, 0))")
    hit = F.lit(False)
    for low, high in ranges:
        hit = hit | number.between(low, high)
    return F.col(idx).rlike("^(0|[1-9][0-9]*)$") & hit


def info(blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_blocks, first_id, last_id, ends_at, n_empty)."""
    empty = strip(F.array_join("lines", "")) == ""
    return blocks.groupBy(*keys).agg(
        F.count("*").alias("n_blocks"), F.min_by("idx", "pos").alias("first_id"), F.max_by("idx", "pos").alias("last_id"),
        timing_end(F.max_by("timing", "pos")).alias("ends_at"), F.count_if(empty).alias("n_empty"),
    )


def text_rows(blocks: DataFrame, *keys: str, start: int = 0, end: int = 0) -> DataFrame:
    return blocks.where(in_range(start, end)).select(*keys, "pos", "idx", joined(F.col("lines")).alias("text"))


def part_of(size: int, pos: str = "pos") -> Column:
    if size < 1:
        raise ValueError("a part has at least one block")
    return F.ceil(F.col(pos) / size).cast("int")


def part_name(part: Column, suffix: str) -> Column:
    return F.concat(F.lit("part_"), F.when(part < 1000, F.lpad(part.cast("string"), 3, "0")).otherwise(part.cast("string")), F.lit(suffix))


def split_parts(blocks: DataFrame, *keys: str, size: int = 100) -> DataFrame:
    """(keys, part, name, first_pos, last_pos, first_id, last_id, n_blocks)."""
    return blocks.withColumn("part", part_of(size)).groupBy(*keys, "part").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("idx", "pos").alias("first_id"), F.max_by("idx", "pos").alias("last_id"), F.count("*").alias("n_blocks")
    ).withColumn("name", part_name(F.col("part"), ".srt"))


def find(blocks: DataFrame, pattern: str, *keys: str, regex: bool = False) -> DataFrame:
    """Blocks whose joined text has the pattern, in any case; ``regex`` takes Java syntax, named groups also as Python's."""
    own = pattern.replace("(?P<", "(?<") if regex else quote(pattern)
    rows = blocks.select(*keys, "pos", "idx", joined(F.col("lines")).alias("text"))
    return rows.where(F.col("text").rlike(f"(?iu){own}"))


def hits_by_file(hits: DataFrame, scanned: DataFrame, key: str = "path") -> DataFrame:
    """(key, times, n_blocks) of every file that was named, ``times`` of them, with hits or without; its blocks are read once and count each time."""
    named = scanned.groupBy(key).agg(F.count("*").alias("times"))
    found = hits.groupBy(key).agg(F.count("*").alias("n"))
    return named.join(found, key, "left").select(key, "times", (F.col("times") * F.coalesce("n", F.lit(0))).alias("n_blocks"))


def hit_totals(by_file: DataFrame) -> DataFrame:
    """(n_files, n_blocks): files as often as they were named."""
    return by_file.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("n_blocks"), F.lit(0)).alias("n_blocks"))


def render(blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys, srt): each document as the text of a subtitle file."""
    block = F.concat_ws("\n", F.array("idx", "timing"), F.col("lines"))
    rows = blocks.select(*keys, F.struct("pos", block.alias("block")).alias("b"))
    return rows.groupBy(*keys).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n"), F.lit("\n")).alias("srt"))

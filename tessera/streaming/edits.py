"""Edits as a stream: part files are taken in as they arrive.  An extension; the batch form is the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip


def read_edit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(name, idx, text) of every ``ID | text`` line of the folder's part files, as the files arrive."""
    lines = spark.readStream.format("text").option("pathGlobFilter", "part_*.txt").load(folder)
    form = r"(?sU)^\s*(\p{Nd}+)\s*\|\s?(.*)$"
    rows = lines.select(F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "^﻿", "").alias("line")).where(F.col("line").rlike(form))
    return rows.select("name", F.regexp_extract("line", form, 1).alias("idx"), strip(F.regexp_extract("line", form, 2)).alias("text"))


def edited_ids(edits: DataFrame) -> DataFrame:
    """Running number of lines of each ID; over one means that parts repeat it."""
    return edits.groupBy("idx").agg(F.count("*").alias("n"))

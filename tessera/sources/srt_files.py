"""Subtitle files as a data source: ``spark.read.format("srt")`` and ``df.write.format("srt")``.

Reading cuts files of any size into byte ranges, a task each.  A range begins behind its first anchor, a line
with text before a blank line: there a chunk ends whatever stood before, so that ranges agree on chunks
without reading each other's bytes.  Where a file's chunks begin to count is known from the ranges' counts.

Writing takes rows sorted by file and place; each task writes whole files into a folder beside the goal, and
the commit gives that folder its name.  A failed job leaves nothing.

Both go through ``pyarrow.fs``, so a path is a local one or a URI that it knows.
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.sources.srt import blocks_of

#: Bytes of a range, and of a step of reading.
SPLIT_BYTES, STEP = 32 << 20, 1 << 20
CHUNKS = "path string, range int, n int, last boolean, chunk binary"


END = re.compile(rb"\r\n?|\n")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def lines_of(f, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes without the end) of a file's lines from the first that begins at ``start`` or later."""
    place, held, skip, done, marked = max(0, start - 1), b"", start > 0, False, 0
    f.seek(place)
    while True:
        at = 0
        for m in END.finditer(held):
            if m.end() == len(held) and m[0] == b"\r" and not done:
                break  # its line feed may come in the next step
            if not skip:
                yield place + at - marked, held[at : m.start()]
            skip, at, marked = False, m.end(), 0
        place, held = place + at, held[at:]
        if done:
            if held and not skip:
                yield place - marked, held
            return
        first = start == 0 and place == 0 and not held
        data = f.read(STEP)
        held, done = held + data, not data
        if first and held.startswith(b"\xef\xbb\xbf"):
            place, held, marked = 3, held[3:], 3  # the first line begins with its mark


def blank(line: bytes) -> bool:
    return not line.strip(b" \t")


def chunks_of(f, start: int, end: int) -> Iterator[bytes]:
    """The chunks of a file that the range from ``start`` to ``end`` has.

    A chunk ends before a blank line; empty lines behind that one go too.  Lines of blanks among the latter
    begin a chunk.  At the end of the file empty lines don't count, and what is then the last line stays.
    """
    held: list[bytes] | None = [] if start == 0 else None  # None before the first anchor
    gap: list[bytes] = []  # blank lines that end the chunk if more comes
    previous, at, leading = None, 0, start == 0
    for place, line in lines_of(f, start):
        if leading and not line:
            continue
        leading = False
        if held is None:
            # An anchor's chunk belongs to the range before; one that begins at the range's end or later is the next range's.
            if previous is not None and at >= end:
                return
            if previous is not None and not blank(previous) and blank(line):
                held, gap = [], [line]
            previous, at = line, place
            continue
        if gap:
            if not line:
                gap.append(line)
                continue
            if held:
                yield b"\n".join(held)
                if at >= end and not blank(held[-1]):
                    return
            held, gap = [line], []
        elif held and blank(line):
            gap = [line]
            continue
        else:
            held.append(line)
        at = place
    if held:
        yield b"\n".join([*held, *gap]).rstrip(b"\n")


@dataclass
class Range(InputPartition):
    path: str
    number: int
    start: int
    end: int
    size: int


class SrtReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        if self.split < 1:
            raise ValueError("a range has at least one byte")

    def partitions(self) -> list[Range]:
        system, path = opened(self.path)
        one = system.get_file_info(path)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [one] if one.is_file else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and x.path.endswith(".srt")]
        store = self.path.removesuffix(path) if "://" in self.path and not self.path.startswith("file:") else ""
        return [Range(store + x.path, n, at, min(at + self.split, x.size), x.size) for x in sorted(files, key=lambda x: x.path) for n, at in enumerate(range(0, max(1, x.size), self.split))]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, path = opened(part.path)
        names = ["path", "range", "n", "last", "chunk"]

        def batch(first: int, own: list[bytes], last: bool) -> pa.RecordBatch:
            n = len(own)
            return pa.record_batch([pa.array([path] * n), pa.array([part.number] * n, pa.int32()), pa.array(range(first, first + n), pa.int32()), pa.array([last] * n, pa.bool_()), pa.array(own, pa.binary())], names)

        with system.open_input_file(path) as f:
            own, n, size = [], 0, 0
            for chunk in chunks_of(f, part.start, part.end):
                own.append(chunk)
                size += len(chunk)
                if size > STEP:
                    yield batch(n, own, False)
                    own, n, size = [], n + len(own), 0
            if own:
                yield batch(n, own, False)
            if part.number == 0:  # a row that says the file is there
                yield batch(-1, [b""], True)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class SrtWriter(DataSourceWriter):
    """Rows (name, pos, idx, timing, lines), sorted by name and pos, each name in one task."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staging = f"{self.path}.{uuid.uuid4().hex}.tmp"
        system, path = opened(self.path)
        if not overwrite and system.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)

    def write(self, rows: Iterator) -> Written:
        system, top = opened(self.staging)
        folder = f"{top}/{uuid.uuid4().hex}"  # of this attempt alone
        system.create_dir(folder, recursive=True)
        names, out, seen = [], None, set()
        try:
            for r in rows:
                if not names or r["name"] != names[-1]:
                    if r["name"] in seen or "/" in r["name"] or not r["name"].endswith(".srt"):
                        raise ValueError(f"rows of {r['name']!r} aren't together, or it is no file name")
                    if out:
                        out.close()
                    seen.add(r["name"])
                    names.append(r["name"])
                    out = system.open_output_stream(f"{folder}/{r['name']}")
                else:
                    out.write(b"\n")
                out.write(("\n".join([r["idx"], r["timing"], *r["lines"]]) + "\n").encode())
        finally:
            if out:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = opened(self.staging)
        written = [m for m in messages if m]
        names = [n for m in written for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("rows of one file came from several tasks")
        system.create_dir(f"{top}/files", recursive=True)
        for m in written:
            for name in m.names:
                system.move(f"{m.folder}/{name}", f"{top}/files/{name}")
        _, goal = opened(self.path)
        if self.overwrite and system.get_file_info(goal).type != fs.FileType.NotFound:
            system.move(goal, f"{top}/before")
        system.create_dir(posixpath.dirname(goal), recursive=True)
        system.move(f"{top}/files", goal)
        system.delete_dir(top)

    def abort(self, messages: list[Written | None]) -> None:
        system, top = opened(self.staging)
        if system.get_file_info(top).type != fs.FileType.NotFound:
            system.delete_dir(top)


class SrtSource(DataSource):
    """Format ``srt``.  Read options: path (a file or a folder), splitBytes.  Write options: path; mode overwrite replaces the folder."""

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> SrtReader:
        return SrtReader(self.options)

    def writer(self, schema, overwrite: bool) -> SrtWriter:
        return SrtWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SrtSource)


def scan(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Blocks (path, pos, idx, timing, lines) and errors (path, pos, code, detail) of a file or of a folder's ``.srt`` files.

    The rows of :func:`tessera.sources.srt.read_srt`, with a large file read by several tasks.
    """
    register(spark)
    chunks = spark.read.format("srt").option("splitBytes", split_bytes).load(path)
    text = F.col("chunk").cast("string")
    rows = chunks.select("path", "range", "n", "last", text.alias("text"), F.is_valid_utf8(text).alias("valid"))
    counts = rows.groupBy("path", "range").agg(F.count_if(~F.col("last")).alias("own"), F.bool_and("valid").alias("valid"), F.bool_and(F.col("text").rlike(r"(?U)\A\s*\z")).alias("void"))
    before = F.sum("own").over(Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy("path")
    places = counts.select("path", "range", F.coalesce(before, F.lit(0)).alias("before"), F.bool_and("valid").over(whole).alias("valid"), F.bool_and("void").over(whole).alias("void"))
    met = rows.drop("valid").join(places, ["path", "range"])
    texts = met.where("not last and valid and not void").select("path", (F.col("before") + F.col("n") + 1).cast("int").alias("pos"), F.col("text").alias("chunk"))
    blocks, errors = blocks_of(texts, "path")
    files = met.where("last").select("path", F.lit(0).alias("pos"), F.lit(0).alias("n"), F.when(~F.col("valid"), "not_utf8").when(F.col("void"), "empty").alias("code"), F.lit("").alias("detail")).where("code is not null")
    return blocks, files.unionByName(errors)


def write(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Blocks (name, pos, idx, timing, lines) as the files of a folder, which is there whole or not at all."""
    register(blocks.sparkSession)
    rows = blocks.select("name", "pos", "idx", "timing", "lines").repartition("name").sortWithinPartitions("name", "pos")
    rows.write.format("srt").mode("overwrite" if mode == "overwrite" else "append").save(path)  # the writer itself refuses a folder that is there


def remove(path: str) -> None:
    """Deletes a folder that :func:`write` made, if it is there."""
    system, top = opened(path)
    if system.get_file_info(top).type == fs.FileType.Directory:
        system.delete_dir(top)

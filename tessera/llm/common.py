"""Pieces that the corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one step in a Python worker takes on at once; a longer text is a step of its own.
STEP_BYTES = 4 << 20

_ours: str | None = None
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns, none of which ``df`` has in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for a broadcast if it has at most so many rows; else joins with it shuffle.

    ``df`` is a written table of a few numbers a row, so that the count is cheap and bounds the size.
    """
    return F.broadcast(df) if df.count() <= rows else df


#: Rows of one key from which a join takes them apart from the rest.
HUB = 1024


def join_hubs(rows: DataFrame, table: DataFrame, key: str, most: int = 4_000_000) -> DataFrame:
    """``rows`` joined with the written ``table`` (key, n, ...): one row for each key, n the rows it has in ``rows``.

    Keys of over ``HUB`` rows, so at most one in ``HUB`` rows, are joined by broadcast (up to ``most`` of
    them), and their rows stay where they are; no task gets a whole hub.  The other keys join by shuffle.
    """
    hubs = table.where(F.col("n") > HUB).drop("n")
    if hubs.isEmpty():
        return rows.join(table.drop("n"), key)
    hubs = small(hubs, most)
    return rows.join(hubs, key).unionByName(rows.join(hubs.select(key), key, "left_anti").join(table.drop("n"), key))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset in local mode, as in a test, it is a
    temporary folder of this process; on a cluster, whose machines don't share one, it has to be set.
    """
    global _ours
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _ours is None:
        _ours = tempfile.mkdtemp(prefix="tessera-")
    return f"file://{_ours}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: the lineage ends there and survives lost executors.

    The table goes when this process ends, or with :func:`forget`.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(forget)
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tables() -> int:
    """How many tables of :func:`written` there are; for :func:`release`."""
    return len(_written)


def release(since: int) -> None:
    """Deletes the tables written after the first ``since`` but for the last one, which must be all that is still read."""
    for spark, path in _written[since:-1]:
        delete(spark, path)
    del _written[since:-1]


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def forget() -> None:
    """Deletes the tables of :func:`written`; frames that read them can't be used any more."""
    while _written:
        try:
            delete(*_written.pop())
        except Exception:  # the session has ended; the cluster's own cleaning of its shared folder is left
            return

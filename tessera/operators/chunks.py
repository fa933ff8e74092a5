"""Order within pairs of any length: windows see a chunk of positions, and a row a chunk carries what chunks share.

A chunk is ``CHUNK`` positions of a pair.  Rows are dealt out by (pair, chunk), so that a long pair is many
tasks' work; only its chunks' summaries, one in ``CHUNK`` of its rows, meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a chunk.
CHUNK = 4096


def chunk_of(pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / CHUNK).cast("long")


def numbered(rows: DataFrame, name: str, key: str = "pair", pos: str = "pos") -> DataFrame:
    """``rows`` (one for each position) with ``name``: the how manieth of its pair each is, by position."""
    dealt = rows.withColumn("_chunk", chunk_of(pos)).repartition(key, "_chunk")
    counts = dealt.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    later = counts.select(key, "_chunk", before.alias("_before")).where("_before > 0")  # of the pairs with several chunks
    own = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(pos))
    return dealt.withColumn(name, own).join(later, [key, "_chunk"], "left").withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("int")).drop("_chunk", "_before")


def with_neighbours(rows: DataFrame, *columns: str, key: str = "pair", pos: str = "pos") -> DataFrame:
    """``rows`` (one for each position) with ``before`` and ``after``: structs of the columns of the rows next to each in its pair, or null."""
    own = F.struct(*columns)
    dealt = rows.withColumn("_chunk", chunk_of(pos)).repartition(key, "_chunk")
    ends = dealt.groupBy(key, "_chunk").agg(F.min_by(own, pos).alias("_first"), F.max_by(own, pos).alias("_last"))
    order = Window.partitionBy(key).orderBy("_chunk")
    edges = ends.select(key, "_chunk", F.lag("_last").over(order).alias("_left"), F.lead("_first").over(order).alias("_right")).where("_left is not null or _right is not null")
    inside = Window.partitionBy(key, "_chunk").orderBy(pos)
    near = dealt.withColumns({"before": F.lag(own).over(inside), "after": F.lead(own).over(inside)})
    # The first row of a chunk has none before it there, the last one none after it: what the other chunks' ends are for.
    met = near.join(edges, [key, "_chunk"], "left")
    return met.withColumns({"before": F.coalesce("before", "_left"), "after": F.coalesce("after", "_right")}).drop("_chunk", "_left", "_right")


#: Keys that part the order of all pairs, and so the ranges of pairs that one window sees, at most.
SPLITS = 1000


def output_numbers(rows: DataFrame, name: str, key: str = "pair", pos: str = "pos") -> DataFrame:
    """``rows`` (one for each key and position) with ``name``: each one's number from 1 in the order of all keys and positions.

    Chunks are counted, the counts are added up within ranges of keys and over the ranges; no task sees all
    rows or all keys.  The ranges' ends are a sample of the keys by hash.
    """
    dealt = rows.withColumn("_chunk", chunk_of(pos)).repartition(key, "_chunk")
    counts = dealt.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    ends = sorted(r[0] for r in rows.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key)).limit(SPLITS).collect())
    kind = dict(rows.dtypes)[key]
    at = F.size(F.filter(F.lit(ends).cast(f"array<{kind}>"), lambda x: x <= F.col(key))) if ends else F.lit(0)
    ranged = counts.withColumn("_range", F.coalesce(at, F.lit(-1)))  # null keys come first
    before = lambda by, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy("_range").agg(F.sum("_n").alias("_n")).select("_range", before([], ["_range"]).alias("_base"))  # at most SPLITS rows
    offsets = ranged.withColumn("_before", before(["_range"], [F.asc_nulls_first(key), "_chunk"])).join(F.broadcast(ranges), "_range")
    offsets = offsets.select(F.col(key).alias("_key"), F.col("_chunk").alias("_c"), (F.col("_before") + F.col("_base")).alias("_offset"))
    own = dealt.withColumn(name, F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(pos)))
    met = own.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_c")))
    return met.withColumn(name, (F.col(name) + F.col("_offset")).cast("long")).drop("_chunk", "_key", "_c", "_offset")

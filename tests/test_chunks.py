"""Long pairs in chunks against whole-pair windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import chunks, lint, pairing


@pytest.fixture
def short_chunks(monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 5)


@pytest.fixture
def blocks(spark):
    """Pairs of 1 to 60 blocks with gaps of all sizes, whole chunks left out among them."""
    rng = random.Random(8)
    rows = [(pair, pos, f"t{pair}.{pos}") for pair, n in enumerate([1, 2, 5, 6, 11, 60, 60]) for pos in sorted(rng.sample(range(1, 4 * n + 1), n))]
    return spark.createDataFrame(rows, "pair long, pos int, text string")


def test_numbered(blocks, short_chunks):
    got = chunks.numbered(blocks, "n")
    want = blocks.withColumn("n", F.row_number().over(Window.partitionBy("pair").orderBy("pos")))
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_neighbours(blocks, short_chunks):
    by = Window.partitionBy("pair").orderBy("pos")
    want = blocks.withColumns({"b": F.lag("text").over(by), "a": F.lead("text").over(by)})
    got = chunks.with_neighbours(blocks, "text").select("pair", "pos", "text", F.col("before.text").alias("b"), F.col("after.text").alias("a"))
    key = lambda r: (r["pair"], r["pos"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


@pytest.mark.parametrize("splits", [1, 3, 1000])
def test_output_numbers(spark, blocks, short_chunks, monkeypatch, splits):
    monkeypatch.setattr(chunks, "SPLITS", splits)
    rows = blocks.withColumn("pair", F.when(F.col("pair") != 3, F.concat(F.lit("p"), "pair")))
    got = chunks.output_numbers(rows, "n").select("pair", "pos", "n").collect()
    order = sorted(got, key=lambda r: (r["pair"] is not None, r["pair"] or "", r["pos"]))
    assert [r["n"] for r in order] == list(range(1, rows.count() + 1))


def test_empty_relation(spark, short_chunks):
    none = spark.createDataFrame([], "pair long, pos int, text string")
    assert chunks.numbered(none, "n").collect() == [] == chunks.output_numbers(none, "n").collect() and chunks.with_neighbours(none, "text").collect() == []


def sides(spark, n):
    """One pair of ``n`` blocks; every 100th is changed in time, every 1,000th left as it was, the last one is missing."""
    rows = spark.range(1, n + 1, numPartitions=4).select(F.lit(1).alias("pair"), F.col("id").cast("int").alias("pos"))
    text = F.concat(F.lit("line "), F.col("pos").cast("string"))
    block = lambda time, line: rows.select("pair", "pos", F.col("pos").cast("string").alias("idx"), time.alias("timing"), F.array(line).alias("lines"))
    stamp = F.lit("00:00:01,000 --> 00:00:02,000")
    src = block(stamp, text)
    dst = block(F.when(F.col("pos") % 100 == 0, "00:00:01,000 --> 00:00:03,000").otherwise(stamp), F.when(F.col("pos") % 1000 == 0, text).otherwise(F.concat(text, F.lit(" new"))))
    return src, dst.where(F.col("pos") < n)


def test_one_long_pair(spark):
    """A pair of 20,000 blocks is the work of several tasks, and its issues are those of the whole."""
    n = 20_000
    src, dst = sides(spark, n)
    issues = pairing.validate(src, dst, target="en")
    assert {(r["kind"], r["count"]) for r in issues.groupBy("kind").count().collect()} == {("timing_changed", n // 100 - 1), ("block_count", 1), ("untranslated", 1)}
    assert {(r["kind"], r["detail"]) for r in issues.where("step in (2, 10)").collect()} == {("block_count", f"{n} -> {n - 1}"), ("untranslated", str(n // 1000 - 1))}
    (verdict,) = pairing.judged(src, dst, target="en").collect()
    assert (verdict["n_errors"], verdict["n_warnings"], verdict["passed"]) == (n // 100, 1, False)
    changed = pairing.diff(src, dst)
    assert [r["n"] for r in changed.orderBy("pos").select("n").collect()] == list(range(1, n - n // 1000 + 1))
    near = lint.neighbourhoods(dst).where("pos = 4096").collect()[0]["near"]
    assert near == "line 4095 new / line 4096 new / line 4097 new"
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", False)  # it would put what is this small into one partition
        spread = [len(p) for p in pairing.side_by_side(src, dst).select("pos").rdd.glom().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(spread) == n and max(spread) < 0.8 * n

"""Mixing sources to target weights, as DataFrame operations only.

Documents get hash-random keys.  A source's keys are cut into ranges, the tokens of the ranges are
summed and the sums prefix-summed per source: this names the range in which the budget ends.  Only the
documents of that range are sorted, as keys and sizes, and the prefix sums over them give the exact cut.
A small table with each source's whole epochs and cut then decides every document where it lies.  The
number of ranges grows with the rows, so that about ``RANGE_ROWS`` rows are sorted whatever the input; a
hot source is spread over all ranges, and no text moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, small, written

#: Rows of a range, if one source had them all; ranges at least.
RANGE_ROWS, LEAST_RANGES = 16384, 256
#: Hexadecimal digits of MD5 that make a key, of which RANGE_DIGITS choose the range.
KEY_DIGITS, RANGE_DIGITS = 15, 7
#: Sources whose cuts, a few numbers each, are broadcast at most; more join by shuffle.
MOST_SOURCES = 100_000
#: What words are made of.
WORD = r"[^\x20\x09-\x0D]"


def count_words(text: Column) -> Column:
    """Number of runs of anything but space and U+0009-U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn and share ``share`` times all sizes.
    A target stops at ``cap`` times its source's size and the excess goes to the others by weight: all
    targets are ``weight * level`` or the stop, and the level is the one at which they add up.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("stop", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    stopped = F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sharing = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - stopped) / sharing)
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    levels = levels.withColumn("level", first)
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("stop")).otherwise(F.col("weight") * F.col("level"))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def ordered(documents: DataFrame, id_column: str, text_column: str, seed: str) -> tuple[Column, Column]:
    """The random key of a row, and what orders rows of one key: id, text hash.

    The key depends on the id alone; null ids go by their texts, so that they don't share one key.
    """
    text, ident = quoted(text_column).cast("string"), quoted(id_column).cast("string")
    name = F.coalesce(ident, F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    key = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}")).cast("binary")), 1, KEY_DIGITS), 16, 10).cast("long")
    return key, F.struct(F.coalesce(ident, F.lit("")).alias("id"), F.xxhash64(text).alias("text_hash"))


def cuts_of(documents: DataFrame, source: Column, key: Column, tie: Column, size: Column, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """A written table, one row a source: what the mix takes of its documents.

    name (of :func:`plan_mix`), source_size, target, epochs (whole ones), left (tokens of the last epoch),
    and the cut: cut_key and cut_tie of the first document that isn't wholly taken in the last epoch (null:
    all are), the tokens before it, and how many rows equal it.  Only documents in the range of keys that
    holds their source's cut are ordered: about a range's rows, whatever the input.
    """
    ranges = max(LEAST_RANGES, documents.count() // RANGE_ROWS)
    part = F.shiftright(F.shiftright(key, 4 * (KEY_DIGITS - RANGE_DIGITS)) * F.lit(ranges), 4 * RANGE_DIGITS)
    sums = written(documents.groupBy(source.alias("source"), part.alias("range")).agg(F.sum(size).alias("size")), "range-sums")
    goals = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    goals = goals.withColumn("epochs", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    goals = goals.withColumn("left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goals = written(goals.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name"), "source_size", "target", "epochs", "left"), "goals")
    upto = F.sum("size").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = sums.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name"), "range", "size").withColumn("before", upto - F.col("size"))
    cut_range = summed.join(goals, "name").where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("size") > F.col("left"))).select("name", "range", "before", "left")
    n_name, n_range, n_key, n_before, n_left = fresh(documents, "name", "range", "key", "before", "left")
    cut_range = written(cut_range.toDF(n_name, n_range, n_before, n_left), "cut-ranges")
    inside = documents.withColumns({n_name: name_of(source), n_range: part, n_key: key}).join(small(cut_range, MOST_SOURCES), [n_name, n_range])
    inside = inside.select(*[F.col(c).alias(a) for c, a in ((n_name, "name"), (n_before, "before"), (n_left, "left"), (n_key, "key"))], tie.alias("tie"), size.alias("size"))
    rows = inside.groupBy("name", "before", "left", "key", "tie", "size").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("name").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("rows")).over(order)).where(F.col("upto") > F.col("left"))
    first = rows.groupBy("name").agg(F.min_by(F.struct("key", "tie", "rows", (F.col("upto") - F.col("size") * F.col("rows")).alias("before")), F.struct("upto", "key", "tie")).alias("cut"))
    first = first.select("name", F.col("cut.key").alias("cut_key"), F.col("cut.tie").alias("cut_tie"), F.col("cut.before").alias("cut_before"), F.col("cut.rows").alias("cut_rows"))
    return written(goals.join(first, "name", "left"), "cuts")


def name_of(source: Column) -> Column:
    """A source's name in joins: never null, and null is no other source's."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(rows: DataFrame, by: str, into: str) -> DataFrame:
    """``rows`` with a number from 0, gapless within each value of ``by``.

    Rows are written first, sorted by ``by`` in each file; a row's number is what the files before hold
    of its value plus its place in its own file.  So no value's rows need to meet in one task.
    """
    tied = rows.select(quoted(by).alias("by"), F.struct(*map(quoted, rows.columns)).alias("row")).sortWithinPartitions("by")
    tied = written(tied, "tied-rows").select("by", "row", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    counts = tied.groupBy("by", "file").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    earlier = F.coalesce(F.sum("rows").over(Window.partitionBy("by").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.select("by", "file", (earlier - F.col("first")).alias("shift")), "tied-counts")
    return tied.join(small(counts, MOST_SOURCES), ["by", "file"]).select("row.*", (F.col("place") + F.col("shift")).alias(into))


def plan_mix(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", size: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix"
) -> tuple[DataFrame, dict[str, str]]:
    """``documents`` with helper columns; the dict has their names: size, source_size, target, taken, copies.

    ``taken``: the tokens that the mix takes of the document: all of them in each whole epoch of its
    source's target, and in the last epoch those before the cut in the random order of the source.  A
    source's taken tokens are its target, rounded.  ``copies``: how often the document is taken if
    documents stay whole; the one at the cut counts if its middle lies before the cut.  Neither is more
    than ``cap`` times the document, ``cap`` rounded up.

    ``size`` is the number of words unless given; null texts have 0.  Null sources are one source.  Null
    ids are ordered by their texts, rows with one id by text hash.  The order depends on ids, texts and
    ``seed`` alone, so reruns agree; rows that repeat both id and text are interchangeable, and which of
    them the cut takes may differ.  Extra columns stay, whatever their names.  No row is shuffled where
    sources are at most ``MOST_SOURCES``.
    """
    text, source = quoted(text_column), quoted(source_column)
    spare = None if size is not None else ~F.coalesce(text.cast("string").rlike(WORD), F.lit(False))
    size = F.coalesce((count_words(text) if size is None else size).cast("long"), F.lit(0))
    key, tie = ordered(documents, id_column, text_column, seed)
    parts = ("name", "source_size", "target", "epochs", "left", "cut_key", "cut_tie", "cut_before", "cut_rows")
    names = dict(zip((*parts, "key", "number", "size", "taken", "copies"), fresh(documents, *parts, "key", "number", "size", "taken", "copies"), strict=True))
    c = {k: F.col(v) for k, v in names.items()}
    cuts = cuts_of(documents, source, key, tie, size, weights, share, cap)
    several = cuts.where(F.col("cut_rows") > 1).limit(1).count() > 0
    cuts = cuts.select(*[F.col(p).alias(names[p]) for p in parts])
    rows = documents.withColumns({names["name"]: name_of(source), names["key"]: key}).join(small(cuts, MOST_SOURCES), names["name"])
    at_cut = F.coalesce((c["key"] == c["cut_key"]) & (tie == c["cut_tie"]), F.lit(False))
    if several:  # rows that equal the cut share what is left before it, in the order of their numbers
        rows = rows.where(~at_cut).withColumn(names["number"], F.lit(0).cast("long")).unionByName(numbered(rows.where(at_cut), names["name"], names["number"]))
    else:
        rows = rows.withColumn(names["number"], F.lit(0).cast("long"))
    before = c["cut_key"].isNull() | (c["key"] < c["cut_key"]) | (c["key"] == c["cut_key"]) & (tie < c["cut_tie"])
    some = F.least(F.greatest(c["left"] - c["cut_before"] - c["number"] * size, F.lit(0)), size)
    taken = c["epochs"] * size + F.when(before, size).when(at_cut, some).otherwise(F.lit(0))
    # Words are counted only at the cut; elsewhere it matters only whether there are any.
    once = F.when(before, True).when(at_cut, 2 * some >= size).otherwise(False).cast("int")
    copies = F.when(size == 0 if spare is None else spare, (c["target"] > 0).cast("int")).otherwise(c["epochs"].cast("int") + once)
    out = rows.select(*map(quoted, documents.columns), size.alias(names["size"]), c["source_size"], c["target"], taken.cast("long").alias(names["taken"]), copies.alias(names["copies"]))
    return out, {k: names[k] for k in ("size", "source_size", "target", "taken", "copies")}


def mix(documents: DataFrame, **how) -> DataFrame:
    """The mix itself, of whole documents: each as many times as it is taken, columns as they were.

    A document without tokens is taken once if its source is.  Documents are repeated where they lie.
    """
    planned, names = plan_mix(documents, **how)
    (again,) = fresh(planned, "again")
    repeated = planned.where(F.col(names["copies"]) > 0).withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(names["copies"]))))
    return repeated.select(*map(quoted, documents.columns))


#: The same in DuckDB's SQL, for (3, 1, 2), 150 % and 2.
ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 15) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2.0::DOUBLE * source_size AS stop FROM s),
l AS (SELECT *, stop / weight AS ratio,
             (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
              - coalesce(sum(stop) OVER (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / CAST(sum(weight) OVER (ORDER BY stop / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
f AS (SELECT arg_min(level, struct_pack(a := ratio, b := rank)) AS level FROM l WHERE ratio > level),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL OR ratio <= f.level THEN stop ELSE weight * f.level END AS target FROM l LEFT JOIN f ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before,
             CAST(floor(t.target / greatest(t.source_size, 1)) AS BIGINT) AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       epochs * size + least(greatest(CAST(round(target - epochs * source_size) AS BIGINT) - before, 0), size) AS taken
FROM p
"""

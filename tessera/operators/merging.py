"""Edits back onto the source's blocks, and how far the parts of an edit have come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators.blocks import part_name, part_of
from tessera.sources.srt import last_edits

KEEP = "="  # fixed value: the text that keeps a block as it is
#: IDs that a report of a merge names of each kind, and extra ones that it names of a part.
SHOWN_IDS, SHOWN_EXTRA = 20, 5


def merged(blocks: DataFrame, edits: DataFrame, *keys: str) -> DataFrame:
    """The blocks with the edits' texts (keys, idx, text; one per ID); IDs and timings stay.

    `` / `` parts lines.  A block without an edit keeps its lines, as one marked with ``KEEP`` does;
    ``kept`` tells the latter.
    """
    new = F.transform(F.split("text", " / ", -1), strip)
    joined = blocks.join(edits.select(*keys, "idx", "text"), [*keys, "idx"], "left")
    kept = F.coalesce(F.col("text") == KEEP, F.lit(False))
    return joined.select(*keys, "pos", "idx", "timing", F.when(kept | F.col("text").isNull(), F.col("lines")).otherwise(new).alias("lines"), kept.alias("kept"))


def missing(blocks: DataFrame, edits: DataFrame, *keys: str) -> DataFrame:
    """Blocks without an edit, one row per block."""
    return blocks.select(*keys, "pos", "idx").join(edits.select(*keys, "idx"), [*keys, "idx"], "left_anti")


def extra(blocks: DataFrame, edits: DataFrame, *keys: str) -> DataFrame:
    """IDs of edits that no block has."""
    return edits.select(*keys, "idx").distinct().join(blocks.select(*keys, "idx"), [*keys, "idx"], "left_anti")


def in_several_parts(edits: DataFrame, *keys: str) -> DataFrame:
    """(keys, idx, name) for each part after the first that has an ID; parts go by ``name``."""
    each = edits.select(*keys, "idx", "name").distinct()
    first = each.groupBy(*keys, "idx").agg(F.min("name").alias("first"))
    return each.join(first, [*keys, "idx"]).where("name > first").select(*keys, "idx", "name")


def combined(edits: DataFrame, *keys: str) -> DataFrame:
    """One text per ID: the last line of the last part."""
    return edits.groupBy(*keys, "idx").agg(F.max_by("text", F.struct("name", "line_no")).alias("text"))


def id_number(idx: str = "idx") -> Column:
    """An ID as the number that orders it."""
    return F.expr(f"try_cast({idx} AS DECIMAL(38, 0))")


def merge_problems(blocks: DataFrame, edits: DataFrame, problems: DataFrame, *keys: str) -> DataFrame:
    """All that stops a merge: (keys, step, name, place, code, detail); empty if it may be written.

    step, name and place order them: lines by number, IDs of other parts and extra ones by number,
    missing ones by their block's position.
    """
    said = lambda df, step, name, place, code, detail: df.select(*keys, F.lit(step).alias("step"), name.alias("name"), place.cast("decimal(38,0)").alias("place"), code.alias("code"), detail.alias("detail"))
    none, idx = F.lit(""), F.col("idx")
    out = said(problems, 1, F.col("name"), F.col("line_no"), F.col("code"), F.col("detail"))
    out = out.unionByName(said(in_several_parts(edits, *keys), 2, F.col("name"), id_number(), F.lit("other_part"), idx))
    out = out.unionByName(said(missing(blocks, edits, *keys), 3, none, F.col("pos"), F.lit("missing"), idx))
    return out.unionByName(said(extra(blocks, edits, *keys), 4, none, id_number(), F.lit("extra"), idx))


def listed(problems: DataFrame, *keys: str, most: int = SHOWN_IDS) -> DataFrame:
    """(keys, step, code, n, ids): the missing and the extra IDs of :func:`merge_problems`, the first ``most`` of n named."""
    own = problems.where(F.col("code").isin("missing", "extra"))
    n = F.row_number().over(Window.partitionBy(*keys, "step").orderBy("place", "detail"))
    named = F.array_sort(F.collect_list(F.when(F.col("turn") <= most, F.struct("turn", "detail"))))
    out = own.withColumn("turn", n).groupBy(*keys, "step", "code").agg(F.count("*").alias("n"), named.alias("ids"))
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda x: x["detail"]), ", "))


def part_states(blocks: DataFrame, edits: DataFrame, problems: DataFrame, present: DataFrame, *keys: str, size: int = 100) -> DataFrame:
    """(keys, part, name, first_pos, last_pos, state, n_problems, n_missing, first_missing, n_extra, extra_ids) of each expected part.

    ``present``: (keys, name) of the part files that exist.  States: done, todo, error.  ``extra_ids``: the
    first ``SHOWN_EXTRA`` extra IDs by number.
    """
    own = blocks.withColumn("part", part_of(size)).withColumn("name", part_name(F.col("part"), ".txt"))
    expected = own.groupBy(*keys, "part", "name").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    texts = last_edits(edits, *keys, "name").select(*keys, "name", "idx")
    # Surplus parts are not in `expected`, so their IDs drop out in the last join.
    both = own.select(*keys, "name", "idx", "pos").join(texts.withColumn("edited", F.lit(True)), [*keys, "name", "idx"], "full_outer")
    coverage = both.groupBy(*keys, "name").agg(
        F.count_if(F.col("edited").isNull()).alias("n_missing"), F.min_by("idx", F.when(F.col("edited").isNull(), F.col("pos"))).alias("first_missing"), F.count_if(F.col("pos").isNull()).alias("n_extra"),
        F.array_sort(F.collect_list(F.when(F.col("pos").isNull(), F.struct(id_number().alias("number"), "idx")))).alias("extra_ids"),
    )
    faults = problems.groupBy(*keys, "name").agg(F.count("*").alias("n_faults"))
    there = present.select(*keys, "name").distinct().withColumn("there", F.lit(True))
    out = expected.join(coverage, [*keys, "name"]).join(faults, [*keys, "name"], "left").join(there, [*keys, "name"], "left")
    n = F.coalesce("n_faults", F.lit(0)) + (F.col("n_missing") > 0).cast("int") + (F.col("n_extra") > 0).cast("int")
    state = F.when(F.col("there").isNull(), "todo").when(n > 0, "error").otherwise("done")
    return out.withColumn("state", state).withColumn("n_problems", F.when(F.col("there").isNull(), 0).otherwise(n).cast("long")).select(*keys, "part", "name", "first_pos", "last_pos", "state", "n_problems", "n_missing", "first_missing", "n_extra", F.array_join(F.transform(F.slice("extra_ids", 1, SHOWN_EXTRA), lambda x: x["idx"]), ", ").alias("extra_ids"))


def progress(states: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_done, n_parts, next_part): how many parts are done, and the first that isn't; null if all are."""
    todo = F.col("state") != "done"
    return states.groupBy(*keys).agg(F.count_if(~todo).alias("n_done"), F.count("*").alias("n_parts"), F.min_by("name", F.when(todo, F.col("part"))).alias("next_part"))


def surplus_parts(present: DataFrame, n_parts: DataFrame, *keys: str) -> DataFrame:
    """Part files named after the last expected one; ``n_parts``: (keys, parts)."""
    return present.join(n_parts, list(keys)).where(F.col("name") > part_name(F.col("parts"), ".txt")).select(*keys, "name")

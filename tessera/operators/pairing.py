"""Operators over a source and a target relation of blocks that share ``pair`` and ``pos``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import CJK_LEFT, MARKUP, SPELLED_SHORTCUT, VIETNAMESE_LEFT, joined, loose_key, strip
from tessera.operators.blocks import in_range, with_ids
from tessera.operators.chunks import chunk_of, numbered

#: Errors and warnings that a report shows of one pair.
SHOWN = {"error": 50, "warning": 30}


def zipped(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Blocks at the same position side by side: pair, pos, s and d; what only one side has is left out."""
    side = lambda df, name: df.select("pair", "pos", F.struct("idx", "timing", "lines").alias(name))
    return side(src, "s").join(side(dst, "d"), ["pair", "pos"])


def counts(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(pair, n_src, n_dst)."""
    both = src.select("pair", F.lit(1).alias("s"), F.lit(0).alias("d")).unionByName(dst.select("pair", F.lit(0).alias("s"), F.lit(1).alias("d")))
    return both.groupBy("pair").agg(F.sum("s").alias("n_src"), F.sum("d").alias("n_dst"))


def aligned(src: DataFrame, dst: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zipped blocks of the pairs with as many blocks on either side, the other pairs with their counts)."""
    sizes = counts(src, dst)
    same = F.col("n_src") == F.col("n_dst")
    return zipped(src, dst).join(sizes.where(same).select("pair"), "pair", "left_semi"), sizes.where(~same)


def diff(src: DataFrame, dst: DataFrame, loose: bool = False) -> DataFrame:
    """Changed blocks: (pair, pos, src_id, dst_id, src_text, dst_text, n: the how manieth of its pair)."""
    key = loose_key if loose else (lambda lines: lines)
    changed = zipped(src, dst).where(~key(F.col("s.lines")).eqNullSafe(key(F.col("d.lines"))))
    plain = lambda c: joined(F.col(c), trimmed=False)
    return numbered(changed.select("pair", "pos", F.col("s.idx").alias("src_id"), F.col("d.idx").alias("dst_id"), plain("s.lines").alias("src_text"), plain("d.lines").alias("dst_text")), "n")


def diff_counts(src: DataFrame, dst: DataFrame, loose: bool = False) -> DataFrame:
    """(pair, changed, total)."""
    key = loose_key if loose else (lambda lines: lines)
    return zipped(src, dst).groupBy("pair").agg(F.count_if(~key(F.col("s.lines")).eqNullSafe(key(F.col("d.lines")))).alias("changed"), F.count("*").alias("total"))


def pair_rows(both: DataFrame, start: int = 0, end: int = 0, ids: list[tuple[int, int]] | None = None) -> DataFrame:
    """(pair, pos, id, src, dst) of zipped blocks; ``ids`` go before the range."""
    s, d = F.col("s.idx"), F.col("d.idx")
    kept = both.withColumn("src_id", s).where(with_ids(ids, "src_id") if ids is not None else in_range(start, end))
    return kept.select("pair", "pos", F.when(s == d, s).otherwise(F.concat_ws("≠", s, d)).alias("id"), joined(F.col("s.lines")).alias("src"), joined(F.col("d.lines")).alias("dst"))


def block_text(lines: Column) -> Column:
    return strip(F.array_join(lines, "\n"))


def side_by_side(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(pair, pos, s, d) of all blocks, null where a side has none; one shuffle by chunks of positions."""
    own = F.struct("idx", "timing", "lines")
    none = F.lit(None).cast("struct<idx:string,timing:string,lines:array<string>>")
    both = src.select("pair", "pos", own.alias("s"), none.alias("d")).unionByName(dst.select("pair", "pos", none.alias("s"), own.alias("d")))
    dealt = both.withColumn("chunk", chunk_of()).repartition("pair", "chunk")
    return dealt.groupBy("pair", "chunk", "pos").agg(F.first("s", ignorenulls=True).alias("s"), F.first("d", ignorenulls=True).alias("d")).drop("chunk")


def issue(when: Column, pos: Column, step: int, ident: Column, severity: str, kind: str, detail: Column) -> Column:
    own = F.struct(pos.cast("int").alias("pos"), F.lit(step).alias("step"), ident.alias("id"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    return F.when(when, own)


def block_issues(src: DataFrame, dst: DataFrame, target: str | None) -> DataFrame:
    """(pair, in_src, in_dst, same, found): of each block whether a side has it, whether it is left as it was, and its issues."""
    both = side_by_side(src, dst).withColumns({"st": block_text(F.col("s.lines")), "dt": block_text(F.col("d.lines"))})
    st, dt, sid, did, pos = F.col("st"), F.col("dt"), F.col("s.idx"), F.col("d.idx"), F.col("pos")
    in_src, in_dst = F.col("s").isNotNull(), F.col("d").isNotNull()
    met = in_src & in_dst
    found = [
        issue(met & (sid != did), pos, 3, sid, "error", "id_changed", F.concat_ws(" -> ", sid, did)),
        issue(met & (F.col("s.timing") != F.col("d.timing")), pos, 4, sid, "error", "timing_changed", F.concat_ws(" => ", F.col("s.timing"), F.col("d.timing"))),
        issue(met & (st != "") & (dt == ""), pos, 5, did, "error", "dst_empty", F.lit("")),
        issue(met & dt.rlike(MARKUP), pos, 6, did, "warning", "markup", F.substring(dt, 1, 60)),
        issue(met & dt.rlike(SPELLED_SHORTCUT), pos, 7, did, "warning", "bad_shortcut", F.regexp_extract(dt, SPELLED_SHORTCUT, 0)),
    ]
    if target:
        found.append(issue(met & dt.rlike(CJK_LEFT), pos, 8, did, "warning", "cjk_left", F.substring(dt, 1, 60)))
        if target == "en":
            found.append(issue(met & dt.rlike(VIETNAMESE_LEFT), pos, 9, did, "warning", "vietnamese_left", F.substring(dt, 1, 60)))
    same = met & (st != "") & (st == dt) & (F.length(st) > 3)
    return both.select("pair", in_src.alias("in_src"), in_dst.alias("in_dst"), F.coalesce(same, F.lit(False)).alias("same"), F.array_compact(F.array(*found)).alias("found"))


def pair_issues(blocks: DataFrame, target: str | None) -> DataFrame:
    """(pair, n_errors, n_warnings, found): the issues that a pair has as a whole, and how many its blocks have."""
    of = lambda severity: F.sum(F.size(F.filter("found", lambda x: x["severity"] == severity))).cast("long")
    totals = blocks.groupBy("pair").agg(F.count_if("in_src").alias("n_src"), F.count_if("in_dst").alias("n_dst"), F.count_if("same").alias("same"), of("error").alias("n_errors"), of("warning").alias("n_warnings"))
    found = [issue(F.col("n_src") != F.col("n_dst"), F.lit(0), 2, F.lit(""), "error", "block_count", F.concat_ws(" -> ", "n_src", "n_dst"))]
    if target:
        found.append(issue(F.col("same") > 0, F.lit(1 << 30), 10, F.lit(""), "warning", "untranslated", F.col("same")))
    return totals.select("pair", "n_errors", "n_warnings", F.array_compact(F.array(*found)).alias("found"))


def validate(src: DataFrame, dst: DataFrame, target: str | None = None, src_errors: DataFrame | None = None, dst_errors: DataFrame | None = None) -> DataFrame:
    """Issues (pair, pos, step, id, severity, kind, detail); pair, pos and step order them.

    Errors: src_format, dst_format, block_count, id_changed, timing_changed, dst_empty.  Warnings:
    markup, bad_shortcut, with a ``target`` also cjk_left and untranslated (one per pair), and
    vietnamese_left if it is ``en``.
    """
    blocks = block_issues(src, dst, target)  # both readers share its shuffle
    out = blocks.select("pair", F.inline("found")).unionByName(pair_issues(blocks, target).select("pair", F.inline("found")))
    for step, kind, errors in ((0, "src_format", src_errors), (1, "dst_format", dst_errors)):
        if errors is not None:
            detail = F.concat_ws(":", "pos", "code", "detail")
            own = errors.select("pair", F.lit(0).alias("pos"), F.lit(step).alias("step"), F.lit("").alias("id"), F.lit("error").alias("severity"), F.lit(kind).alias("kind"), detail.alias("detail"))
            out = out.unionByName(own)
    return out


def judged(src: DataFrame, dst: DataFrame, target: str | None = None) -> DataFrame:
    """(pair, n_errors, n_warnings, passed) of every pair that either side has, in the one pass of :func:`validate`."""
    of = lambda severity: F.size(F.filter("found", lambda x: x["severity"] == severity))
    totals = pair_issues(block_issues(src, dst, target), target)
    return totals.select("pair", (F.col("n_errors") + of("error")).alias("n_errors"), (F.col("n_warnings") + of("warning")).alias("n_warnings")).withColumn("passed", F.col("n_errors") == 0)


def shown(issues: DataFrame, limits: dict[str, int] = SHOWN) -> DataFrame:
    """The first issues of each pair and severity."""
    n = F.row_number().over(Window.partitionBy("pair", "severity").orderBy("pos", "step", "id", "detail"))
    limit = F.coalesce(*[F.when(F.col("severity") == s, k) for s, k in limits.items()])
    first = issues.withColumn("n", n).where(F.col("n") <= max(limits.values()))  # a plain number, so that it holds before the shuffle too
    return first.where(F.col("n") <= limit)


def verdicts(issues: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, n_errors, n_warnings, passed) of all ``pairs``; a pair passes without errors."""
    totals = issues.groupBy("pair").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return pairs.select("pair").distinct().join(totals, "pair", "left").select("pair", zero("e").alias("n_errors"), zero("w").alias("n_warnings"), (zero("e") == 0).alias("passed"))

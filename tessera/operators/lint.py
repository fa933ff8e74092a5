"""Lint: what a machine can see missing in a translation, neighbours of a block counting as the block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import combos, count_cjk, duration, has_word, joined, latin_terms, nfkc, numbers, one_digit, strip
from tessera.operators.blocks import in_range
from tessera.operators.chunks import with_neighbours

# Names in the source, what may stand for them in the target, and the label.
KEYS = [
    ("空格键", "(?iu)space|phím cách|dấu cách", "space"),
    ("回车", "(?iu)enter|return", "enter"),
    ("退格键", "(?iu)backspace", "backspace"),
    ("删除键", "(?iuU)delete|del\\b", "delete"),
]
MOUSE = [
    ("(?iu)左键|左击|鼠标左|left[- ]?click|left mouse", "(?iu)trái|left", "left"),
    ("(?iu)右键|右击|鼠标右|right[- ]?click|right mouse", "(?iu)phải|right", "right"),
    ("(?iu)中键|middle[- ]?(?:click|mouse)", "(?iu)giữa|cuộn|middle|wheel|scroll", "middle"),
]
SKIPPED = ["ok"]
KINDS = ["number", "key", "mouse", "latin_term", "fast_read"]


def neighbourhoods(dst: DataFrame, normal: bool = False) -> DataFrame:
    """(pair, pos, near): the joined text of each block with the one before and the one after.

    ``normal`` adds near_n, its NFKC: each block's own, joined, since nothing composes across a slash.
    """
    rows = dst.select("pair", "pos", joined(F.col("lines")).alias("near"))
    if normal:
        rows = rows.withColumn("near_n", nfkc(F.col("near")))
    texts = rows.columns[2:]
    near = with_neighbours(rows, *texts)
    return near.select("pair", "pos", *[F.concat_ws(" / ", f"before.{c}", c, f"after.{c}").alias(c) for c in texts])


def lint(both: DataFrame, dst: DataFrame, start: int = 0, end: int = 0, cps: float = 20.0, glossary_terms: list[str] = (), kinds: list[str] = KINDS) -> DataFrame:
    """Issues (pair, pos, step, id, kind, detail) of the asked ``kinds``.

    ``both``: aligned blocks; ``dst``: all target blocks, since neighbours outside the range count too.
    ``glossary_terms``: source spellings that are the glossary's business.  The detail of fast_read has
    characters a second and seconds, their exact values rounded half to even to 0 and 1 digits.
    """
    rows = both.where(in_range(start, end)).select("pair", "pos", F.col("s.idx").alias("id"), F.col("s.timing").alias("timing"), joined(F.col("s.lines")).alias("st"), F.col("d.lines").alias("lines"))
    asked = lambda *names: any(n in kinds for n in names)
    if asked("number", "key", "mouse", "latin_term"):
        rows = rows.join(neighbourhoods(dst, normal=True), ["pair", "pos"]).withColumn("st_n", nfkc(F.col("st")))
    one = lambda step, kind, detail: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), detail.alias("detail"))
    none, parts = F.array().cast("array<struct<step:int,kind:string,detail:string>>"), []
    several = lambda when, issue: F.when(when, F.array(issue)).otherwise(none)
    if asked("number"):
        by_size = lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)
        rows = rows.withColumn("lost", F.when(F.col("st_n").rlike(r"\p{Nd}"), F.array_sort(F.array_except(numbers(F.col("st_n")), numbers(F.col("near_n"))), by_size)))
        parts.append(several(F.size("lost") > 0, one(1, "number", F.array_join("lost", ", "))))
    if asked("key"):
        parts.append(F.transform(F.array_except(combos(F.col("st_n")), combos(F.col("near_n"))), lambda c: one(2, "key", c)))
        parts += [several(F.col("st").rlike(s) & ~F.col("near").rlike(d), one(3, "key", F.lit(name))) for s, d, name in KEYS]
    if asked("mouse"):
        parts += [several(F.col("st").rlike(s) & ~F.col("near").rlike(d), one(4, "mouse", F.lit(name))) for s, d, name in MOUSE]
    if asked("latin_term"):
        skip = sorted({w.lower() for w in [*SKIPPED, *glossary_terms]})  # a hash set, however many
        kept = lambda w: (F.length(w) >= 2) & w.rlike(r"^[\x00-\x7F]+$") & ~F.lower(w).isin(skip) & ~has_word(w, F.col("near_n"))
        # Only a text with as many CJK characters as Latin terms counts, which is cheaper to see than words are to find.
        cjk = count_cjk(F.col("st"))
        rows = rows.withColumn("terms", F.when(cjk > 0, latin_terms(F.col("st_n")))).withColumn("gone", F.when((F.size("terms") > 0) & (cjk >= F.size("terms")), F.array_distinct(F.filter("terms", kept))))
        parts.append(several(F.size("gone") > 0, one(5, "latin_term", F.array_join("gone", ", "))))
    if cps and asked("fast_read"):
        seconds = duration(F.col("timing"))
        rate = F.length(F.array_join(F.transform("lines", strip), " ")) / F.when(seconds > 0, seconds)
        parts.append(several(F.coalesce(rate > cps, F.lit(False)), one(6, "fast_read", F.concat_ws(" ", F.bround(rate, 0).cast("long"), one_digit(seconds)))))
    return rows.select("pair", "pos", "id", F.inline(F.flatten(F.array(*parts)) if parts else none))


def lint_counts(issues: DataFrame) -> DataFrame:
    """(kind, n, first, rank): issues of each kind, in the order in which the kinds first come."""
    counts = issues.groupBy("kind").agg(F.count("*").alias("n"), F.min(F.struct("pair", "pos", "step")).alias("first"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy("first")))  # of five kinds

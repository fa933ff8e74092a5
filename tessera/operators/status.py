"""Progress of a workspace: every name with its source, cleaned and translated files, in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status(names: DataFrame, cleaned_verdicts: DataFrame, translated_verdicts: DataFrame, reviews: DataFrame, languages: list[str] = ()) -> DataFrame:
    """(name, stage, language, state, stale, review, n_open, review_old) per name and cell.

    ``names``: (name, stage raw/cleaned/trans, language or null, mtime).  Verdicts: (name[, language],
    passed), null for unreadable.  ``reviews``: (name, language, n_open, mtime).  States: present,
    absent, no_source, pass, fail, unreadable.  Every name has a cell for each language that is known
    (``languages``) or that a file has; these codes, the columns of the table, are all that is collected.
    """
    has = names.groupBy("name").agg(
        F.bool_or(F.col("stage") == "raw").alias("raw"), F.bool_or(F.col("stage") == "cleaned").alias("cleaned"), F.max(F.when(F.col("stage") == "cleaned", F.col("mtime"))).alias("cleaned_at")
    )
    verdict = lambda passed: F.when(passed.isNull(), "unreadable").when(passed, "pass").otherwise("fail")
    nothing = [F.lit(False).alias("stale"), F.lit(None).cast("string").alias("review"), F.lit(None).cast("long").alias("n_open"), F.lit(False).alias("review_old")]
    row = lambda df, stage, language, state, *more: df.select("name", F.lit(stage).alias("stage"), language.alias("language"), state.alias("state"), *(more or nothing))
    none = F.lit(None).cast("string")
    raw = row(has, "raw", none, F.when(F.col("raw"), "present").otherwise("absent"))
    checked = has.join(cleaned_verdicts.select("name", "passed"), "name", "left")
    clean = row(checked, "cleaned", none, F.when(~F.col("cleaned"), "absent").when(~F.col("raw"), "present").otherwise(verdict(F.col("passed"))))
    files = names.where("stage = 'trans'").select("name", "language", F.col("mtime").alias("at"))
    codes = sorted({*languages, *(r[0] for r in files.select("language").distinct().collect())})
    cells = has.withColumn("language", F.explode(F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>")))
    cells = cells.join(files, ["name", "language"], "left").join(translated_verdicts.select("name", "language", "passed"), ["name", "language"], "left")
    cells = cells.join(reviews.select("name", "language", F.col("n_open").alias("open"), F.col("mtime").alias("reviewed_at")), ["name", "language"], "left")
    judged = F.col("at").isNotNull() & F.col("cleaned")
    reviewed = judged & F.col("reviewed_at").isNotNull()
    state = F.when(F.col("at").isNull(), "absent").when(~F.col("cleaned"), "no_source").otherwise(verdict(F.col("passed")))
    translated = row(
        cells, "trans", F.col("language"), state, F.coalesce(judged & (F.col("cleaned_at") > F.col("at")), F.lit(False)).alias("stale"),
        F.when(reviewed, F.when(F.col("open") > 0, "progressing").otherwise("done")).alias("review"), F.when(reviewed, F.col("open")).cast("long").alias("n_open"),
        F.coalesce(reviewed & (F.col("at") > F.col("reviewed_at")), F.lit(False)).alias("review_old"),
    )
    return raw.unionByName(clean).unionByName(translated)

"""Language ID of web pages by Bayesian evidence fusion.

Four pieces of evidence multiply: the page's text under character models counted over all documents,
the language that its markup declares, its address suffix, and a prior of its host.  What a
declaration or a suffix says is learnt from all pages at once, from how they go with the text's own
verdict.  A host's prior is its pages' verdicts, smoothed towards its site's, which are smoothed
towards its suffix's and those towards all pages': grouped aggregates at each level.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hubs, quoted, small, written
from .url_filter import host_and_path

#: Slots of hashed byte trigrams; languages whose models a worker holds at once.  More take further passes over a page.
SLOTS, GROUP = 1 << 16, 64
#: Rows of a table of declarations or suffixes that are broadcast at most; more are joined by shuffle.
MOST_SAID = 200_000
#: A text's log-likelihood counts as so many independent trigrams at most: neighbours depend on each other.
EFFECTIVE = 40
#: Weight of the level above in a host's prior, in pages; added to each count of a declaration or suffix.
STRENGTH, PSEUDO = 5.0, 0.5
#: What opens a hidden part, and what closes it.
HIDDEN = regex.compile(r"(?i)<(script|style)\b|<(!)--")
CLOSES = {"script": regex.compile(r"(?i)</script\s*>"), "style": regex.compile(r"(?i)</style\s*>"), "!": regex.compile("-->")}
TAG = regex.compile(r"(?s)<[^<>]*>")
#: Letters count, everything else is a space; A-Z become a-z.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def shown(markup: str) -> str:
    """A page without scripts, styles and comments; one that nothing closes stays.

    Every character is passed a few times at most: what was looked for in vain isn't looked for again.
    """
    out, at, open_ended = [], 0, set()
    for m in HIDDEN.finditer(markup):
        kind = (m[1] or m[2]).lower()
        if m.start() < at or kind in open_ended:
            continue
        end = CLOSES[kind].search(markup, m.end())
        if end is None:
            open_ended.add(kind)
            continue
        out += [markup[at : m.start()], " "]
        at = end.end()
    return "".join([*out, markup[at:]])


def visible(markup: str | None) -> str:
    """The text of a page: scripts, styles, comments and tags go, entities become characters."""
    return html.unescape(TAG.sub(" ", shown(markup or "")))


def trigrams(text: str | None) -> np.ndarray:
    """Slots of the byte trigrams of the text's words, each word between single spaces."""
    data = b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()) + b" "
    if len(data) < 3:
        return np.zeros(0, np.int64)
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    return (((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def count_trigrams(documents: DataFrame, text_column: str, language_column: str) -> DataFrame:
    """(language, slot, n) over all documents; null languages and texts are left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, language in zip(batch["text"], batch["language"], strict=True):
                if language not in held and len(held) == GROUP:  # hand on what there is
                    yield from out(held)
                    held = {}
                counts = held.setdefault(language, np.zeros(SLOTS, np.int64))
                counts += np.bincount(trigrams(text), minlength=SLOTS)
        yield from out(held)

    def out(held: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for language, counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"language": language, "slot": at.astype(np.int32), "n": counts[at]})

    slim = documents.select(quoted(text_column).cast("string").alias("text"), quoted(language_column).cast("string").alias("language")).where(F.col("text").isNotNull() & F.col("language").isNotNull())
    return slim.mapInPandas(count, "language string, slot int, n long").groupBy("language", "slot").agg(F.sum("n").alias("n"))


def models(documents: DataFrame, text_column: str = "text", language_column: str = "lang") -> tuple[list[str], list]:
    """Languages, sorted, and their log-probabilities of each slot, ``GROUP`` languages in one broadcast array."""
    counts = written(count_trigrams(documents, text_column, language_column), "trigrams")
    languages = sorted(r[0] for r in counts.select("language").distinct().collect())  # the result names them all
    groups = []
    for at in range(0, len(languages), GROUP):
        own = languages[at : at + GROUP]
        table = np.full((len(own), SLOTS), 0.5)
        for r in counts.where(F.col("language").isin(own)).groupBy("language").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("times")).toLocalIterator():
            table[own.index(r["language"]), r["slots"]] += r["times"]
        groups.append(documents.sparkSession.sparkContext.broadcast(np.log(table / table.sum(1, keepdims=True)).astype(np.float32)))
    return languages, groups


def text_evidence(markup: Column, groups: list) -> Column:
    """Array of log-likelihoods of a page's visible text, one per language, the best one 0."""

    def scorer(group) -> Column:
        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            log_p = group.value
            for batch in batches:
                rows = []
                for m in batch:
                    t = trigrams(visible(m))
                    if not len(t):
                        rows.append([0.0] * len(log_p))
                        continue
                    mean = log_p @ np.bincount(t, minlength=SLOTS).astype(np.float32) / len(t)
                    rows.append((mean * min(len(t), EFFECTIVE)).tolist())
                yield pd.Series(rows)

        return score(markup.cast("string"))

    return F.concat(*map(scorer, groups))


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def summed(n: int, column: str = "p") -> list[Column]:
    return [F.sum(F.col(column)[i]).alias(f"s{i}") for i in range(n)]


def as_array(n: int) -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(n)])


def likelihood(pages: DataFrame, evidence: str, n: int, name: str) -> DataFrame:
    """(evidence, array of log p(evidence | language)): counts of the text's verdicts, plus ``PSEUDO`` each."""
    counts = pages.groupBy(evidence).agg(*summed(n))
    whole = pages.agg(*summed(n), F.count_distinct(evidence).alias("kinds"))
    whole = whole.select(*[F.col(f"s{i}").alias(f"t{i}") for i in range(n)], "kinds")
    both = counts.join(F.broadcast(whole))  # one row
    return both.select(F.col(evidence).alias(f"{evidence}_"), F.array(*[F.log((F.col(f"s{i}") + PSEUDO) / (F.col(f"t{i}") + PSEUDO * (F.col("kinds") + 1))) for i in range(n)]).alias(name))


def identify(pages: DataFrame, documents: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """One row per page: id, language, probability, declared, suffix, host.

    ``documents`` teach the character models.  A page without text, declaration or host has no evidence
    of that kind; without any it gets the pages' overall prior's language.  Null ids and repeated pages
    are pages like any other.  Ties go to the language that sorts first.  Without labelled documents the
    language is null; without pages there is no row.  Pages and texts of any length are taken whole; other
    columns aren't read, whatever their names.
    """
    languages, groups = models(documents, text_column, language_column)
    host, _ = host_and_path(quoted(url_column))
    declared = F.lower(F.regexp_extract(quoted(html_column), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    base = pages.select(quoted(id_column).alias("id"), host.alias("host"), F.coalesce(declared, F.lit("")).alias("declared"), quoted(html_column).alias("html"))
    base = base.withColumn("suffix", F.regexp_extract("host", r"([^.:]+)(?::\d+)?$", 1)).withColumn("site", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    if not languages:
        return base.select("id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), "declared", "suffix", "host")
    n = len(languages)
    base = base.withColumn("text", text_evidence(F.col("html"), groups)).drop("html")
    base = base.withColumn("text", F.transform("text", lambda x: x - F.array_max("text"))).withColumn("p", softmax(F.col("text")))
    base = written(base, "page-evidence")

    def smooth(level: DataFrame, above: Column | None) -> Column:
        total = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(n)])
        over = (lambda i: F.lit(1.0 / n)) if above is None else (lambda i: above[i])
        return F.array(*[(F.col(f"s{i}") + STRENGTH * over(i)) / (total + STRENGTH) for i in range(n)])

    sums = written(base.groupBy("suffix", "site", "host").agg(*summed(n), F.count("*").alias("pages")), "host-sums")
    every = sums.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
    every = every.select(smooth(every, None).alias("over"))
    up = lambda *keys: sums.groupBy(*keys).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
    by_suffix = up("suffix").join(F.broadcast(every))  # one row
    by_suffix = by_suffix.select("suffix", smooth(by_suffix, F.col("over")).alias("over"))
    by_site = up("suffix", "site").join(by_suffix, "suffix")
    by_site = by_site.select("site", "suffix", smooth(by_site, F.col("over")).alias("over"))
    by_host = sums.join(by_site, ["suffix", "site"])
    by_host = written(by_host.select("host", smooth(by_host, F.col("over")).alias("prior"), F.col("pages").alias("n")), "host-priors")
    saying = written(likelihood(base, "declared", n, "says"), "declared-odds")
    ending = written(likelihood(base, "suffix", n, "ends"), "suffix-odds")
    said = base.join(small(saying, MOST_SAID), F.col("declared") == F.col("declared_")).join(small(ending, MOST_SAID), F.col("suffix") == F.col("suffix_"))
    joined = join_hubs(said, by_host, "host")
    part = lambda c, key, i: F.when(F.col(key) == "", 0.0).otherwise(F.col(c)[i])
    fused = F.array(*[F.col("text")[i] + F.log(F.col("prior")[i]) + part("says", "declared", i) + part("ends", "suffix", i) for i in range(n)])
    judged = joined.withColumn("p", softmax(fused))
    best = F.array_position(F.col("p"), F.array_max("p")).cast("int")
    return judged.select("id", F.element_at(F.array(*map(F.lit, languages)), best).alias("language"), F.array_max("p").alias("probability"), "declared", "suffix", "host")

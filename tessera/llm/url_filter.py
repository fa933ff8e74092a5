"""URL filter: rules first, then the ratio of two character models.

The models are variable-order Markov models with Witten-Bell smoothing, one of the URLs that rules
accept and one of those they reject.  All counts are grouped aggregates over every such URL, all
look-ups are joins, so nothing is broadcast that grows with the data.  The cut on the length-normalised
log-likelihood difference is calibrated on a fifth of those URLs, which the models don't see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hubs, lower_ascii, quoted, small, written

#: Longest context; symbols that the lowest order spreads over; what pads a URL's start and ends it.
ORDER, ALPHABET, START, END = 4, 256, "\u0002", "\u0003"
#: One in FOLDS of the rules' URLs calibrates; width of a score's bin and the bins' outer ends.
FOLDS, STEP, OUTER = 5, 0.01, 20
#: Rows of a table of short contexts that are broadcast at most; more are joined by shuffle.
MOST_SHORT = 500_000
#: The rules (host, then path), and their verdicts.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased): after the first ``://`` up to ``/``, ``?``, ``#``; path: then up to ``?``, ``#``.  Else both empty."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda g: F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)([^?#]*)", g)
    return lower_ascii(part(1)), part(2)


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}"), rule).otherwise(out)
    return out


def grams(rows: DataFrame, *kept: str) -> DataFrame:
    """``kept`` and gram (``ORDER`` + 1 characters) for each character of ``address`` and its end."""
    text = F.concat(F.lit(START * ORDER), F.col("address"), F.lit(END))
    at = F.explode(F.sequence(F.lit(1), F.char_length("address") + 1))
    return rows.select(*kept, text.alias("text"), at.alias("at")).select(*kept, F.substring(F.col("text"), F.col("at"), F.lit(ORDER + 1)).alias("gram"))


def suffixes(table: DataFrame) -> DataFrame:
    """One row per order k: the gram's last k characters before its last one, and that one too."""
    return table.select("*", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")).withColumn("own", F.substring(F.col("gram"), F.lit(ORDER + 1) - F.col("k"), F.col("k") + 1)).withColumn("context", F.substring(F.col("gram"), F.lit(ORDER + 1) - F.col("k"), F.col("k")))


def gram_scores(training: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, score): difference of the log-likelihoods of each asked gram's last character.

    ``training`` has address, good (boolean), times; ``asked`` has distinct grams.  Witten-Bell: of order k,
    p = (n(own) + d(context) p of order k - 1) / (n(context) + d(context)), d counting distinct successors.
    """
    seen = grams(training, "good", "times").groupBy("gram").agg(*[F.sum(F.when(F.col("good") == g, F.col("times")).otherwise(0)).alias(n) for n, g in (("good", True), ("bad", False))])
    own = written(suffixes(seen).groupBy("k", "own").agg(F.first("context").alias("context"), F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-grams")
    whole = lambda c: (F.sum(c).alias(f"n_{c}"), F.count(F.when(F.col(c) > 0, 1)).alias(f"d_{c}"))
    context = written(own.groupBy("k", "context").agg(*whole("good"), *whole("bad")), "url-contexts")
    # Of one and two characters there are few, whatever the data, and each stands in a large part of the
    # rows: their tables are broadcast.  Longer keys are many, each in few rows, and join by shuffle.
    rows, own = suffixes(asked), own.select("k", "own", "good", "bad")
    short = rows.where("k <= 1").join(small(own.where("k <= 1"), MOST_SHORT), ["k", "own"], "left")
    long = rows.where("k > 1").join(own.where("k > 1"), ["k", "own"], "left")
    few = short.unionByName(long.where("k = 2")).join(small(context.where("k <= 2"), MOST_SHORT), ["k", "context"], "left")
    asked = few.unionByName(long.where("k > 2").join(context.where("k > 2"), ["k", "context"], "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    step = F.struct("k", *[zero(f"{x}{c}") for c in ("good", "bad") for x in ("", "n_", "d_")])
    chain = asked.groupBy("gram").agg(F.array_sort(F.collect_list(step)).alias("chain"))

    def log_p(c: str) -> Column:
        def up(p: Column, s: Column) -> Column:
            n = s[f"n_{c}"] + s[f"d_{c}"]
            return F.when(n == 0, p).otherwise((s[c] + s[f"d_{c}"] * p) / n)

        return F.log(F.aggregate("chain", F.lit(1.0 / ALPHABET), up))

    return chain.select("gram", (log_p("good") - log_p("bad")).alias("score"))


def scored_addresses(labelled: DataFrame) -> DataFrame:
    """(address, score, times, good, held_out) of each distinct address; ``labelled`` has address and good (null: no rule)."""
    each = written(labelled.groupBy("address", "good").agg(F.count("*").alias("times")).withColumn("held_out", F.pmod(F.xxhash64("address"), F.lit(FOLDS)) == 0), "addresses")
    training = each.where(F.col("good").isNotNull() & ~F.col("held_out"))
    places = grams(each.select("address").distinct(), "address")
    asked = written(places.groupBy("gram").agg(F.count("*").alias("n")), "asked-grams")
    scores = written(gram_scores(training, asked.select("gram")).join(asked, "gram"), "gram-scores")
    mean = join_hubs(places, scores, "gram").groupBy("address").agg(F.avg("score").alias("score"))  # every address begins alike
    return each.join(mean, "address")


def best_cut(scored: DataFrame) -> float:
    """The cut with the least sum of both error rates on the held-out URLs; the middle one of several.

    The driver sees counts per bin, ``2 OUTER / STEP`` bins at most.  Without URLs of both kinds it is 0.
    """
    spot = F.least(F.greatest(F.round(F.col("score") / STEP), F.lit(-OUTER / STEP)), F.lit(OUTER / STEP)).cast("int")
    seen = scored.where(F.col("good").isNotNull() & F.col("held_out")).groupBy(spot.alias("spot")).agg(F.sum(F.when(F.col("good"), F.col("times")).otherwise(0)).alias("good"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("times"))).alias("bad")).orderBy("spot").collect()
    good, bad = sum(r["good"] for r in seen), sum(r["bad"] for r in seen)
    if not good or not bad:
        return 0.0
    errors, lost, kept = [], 0, bad
    for low, high in zip(seen, [*seen[1:], None], strict=True):
        lost, kept = lost + low["good"], kept - low["bad"]
        errors.append((lost / good + kept / bad, (low["spot"] + (high["spot"] if high else low["spot"] + 1)) / 2))
    least = min(e for e, _ in errors)
    cuts = [c for e, c in errors if e <= least + 1e-12]
    return cuts[len(cuts) // 2] * STEP


def filter_urls(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", rules: dict[str, str] | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, score, verdict.

    The verdict is the longest fitting rule's; without one it is ``allow`` if the score of host and path
    lies above the calibrated cut.  If the rules accept or reject no URL at all, pages without a rule
    are allowed.  Null URLs and those without ``://`` have empty host and path and are scored as such; a
    score equal to the cut is rejected.  URLs of any length are taken whole, one row per character.
    Repeated rows and null ids stay, an empty table gives no rows, and other columns aren't read.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(quoted(url_column))
    parts = pages.select(quoted(id_column).alias("id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("address", F.concat("host", "path"))
    verdict = F.coalesce(*[F.when(F.col("rule") == r, v) for r, v in rules.items()]) if rules else F.lit(None).cast("string")
    parts = written(parts.withColumn("ruled", verdict), "urls")
    scored = written(scored_addresses(parts.select("address", (F.col("ruled") == "allow").alias("good"))), "scored-urls")
    kinds = {r[0] for r in scored.where(F.col("good").isNotNull() & ~F.col("held_out")).select("good").distinct().collect()}
    cut = best_cut(scored) if len(kinds) == 2 else float("-inf")
    one = written(scored.groupBy("address").agg(F.max("score").alias("score"), F.sum("times").alias("n")), "address-scores")
    judged = join_hubs(parts, one, "address").withColumn("verdict", F.coalesce("ruled", F.when(F.col("score") > cut, "allow").otherwise("block")))
    return judged.select("id", "host", "path", "rule", "score", "verdict")

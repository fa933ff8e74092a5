"""Blocks against rules: glossary terms and recurring recognition errors.

Few rules come as a literal list, each with patterns compiled once; a block meets them all in one
projection.  Many rules are a table with an index: each spelling stands under one of its keys, a block's
text has keys of its own, and only where they are equal the pattern is tried.

A key is two runs of characters of ``RUN`` that follow each other, one whole run, or one or two characters
beside each other that are neither in ``RUN`` nor white space.  All case forms of a character of ``RUN`` are
in ``RUN``, and all of ``RUN`` bounds words, so that a term that stands in a text has its runs there as whole
runs in the same order, and its other characters side by side: no hit is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import joined, let, term_pattern, term_pattern_of
from tessera.operators.blocks import in_range


#: Rules that one projection unrolls at most; more go through the index.  Bytes of an index that is broadcast.
MANY, INDEX_BYTES = 200, 64 << 20

#: Fixed value: characters of which every case form bounds words (K and Å have a form, a unit's sign, that doesn't).
RUN = "0-9A-JL-Za-jl-zÀ-ÄÆ-äæ-ſƠơƯưḀ-ỿ"

RULES = "rule_no int, cell string, sources array<string>, targets array<string>"


@dataclass(frozen=True)
class Rule:
    cell: str
    sources: tuple[str, ...]
    targets: tuple[str, ...]


def fetch(table: DataFrame) -> list[Rule]:
    """Rules from (line_no, cell, sources, targets), in file order; a glossary is one file's tables."""
    return [Rule(r["cell"], tuple(r["sources"]), tuple(r["targets"])) for r in table.orderBy("line_no").collect()]


def _each(rules: list[Rule], make) -> Column:
    return F.array_compact(F.array(*[make(n, r) for n, r in enumerate(rules)]))


def glossary_violations(both: DataFrame, rules: list[Rule], start: int = 0, end: int = 0) -> DataFrame:
    """(pair, pos, id, rule_no, cell, hit, wanted, src, dst): a source term stands in the source, none of its targets in the target."""
    rows = both.where(in_range(start, end)).select("pair", "pos", F.col("s.idx").alias("id"), joined(F.col("s.lines")).alias("src"), joined(F.col("d.lines")).alias("dst"))
    if len(rules) > MANY:
        found = indexed_violations(both.where(in_range(start, end)), rules_frame(both.sparkSession, rules))
        return found.select("pair", "pos", "id", "src", "dst", "rule_no", "cell", "hit", "wanted")
    if not rules:
        return rows.where("false").select("pair", "pos", "id", F.lit(0).alias("rule_no"), F.lit("").alias("cell"), F.lit("").alias("hit"), F.lit("").alias("wanted"), "src", "dst")

    def make(n, rule):
        source, target = term_pattern(rule.sources), term_pattern(rule.targets)
        found = F.struct(F.lit(n).alias("rule_no"), F.lit(rule.cell).alias("cell"), F.regexp_extract("src", source, 0).alias("hit"), F.lit(" / ".join(rule.targets)).alias("wanted"))
        return F.when(F.col("src").rlike(source) & ~F.col("dst").rlike(target), found)

    return rows.select("pair", "pos", "id", "src", "dst", F.inline(_each(rules, make)))


def violation_counts(violations: DataFrame) -> DataFrame:
    """(cell, n, first, rank): violations of each term, most first, then the one that comes first."""
    counts = violations.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct("pair", "pos", "rule_no")).alias("first"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first")))  # over a glossary's terms


def asr_hits(blocks: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """(keys, pos, idx, rule_no, hit, wanted, text): a wrong spelling is left when the right ones are blanked."""
    rows = blocks.select(*keys, "pos", "idx", joined(F.col("lines")).alias("text"))
    if len(rules) > MANY:
        return indexed_asr(blocks, rules_frame(blocks.sparkSession, rules), *keys).select(*keys, "pos", "idx", "text", "rule_no", "hit", "wanted")
    if not rules:
        return rows.where("false").select(*keys, "pos", "idx", F.lit(0).alias("rule_no"), F.lit("").alias("hit"), F.lit("").alias("wanted"), "text")

    def make(n, rule):
        wrong, blanked = term_pattern(rule.sources), F.regexp_replace("text", term_pattern(rule.targets), "\0")
        found = F.struct(F.lit(n).alias("rule_no"), F.regexp_extract(blanked, wrong, 0).alias("hit"), F.lit(" / ".join(rule.targets)).alias("wanted"))
        return F.when(blanked.rlike(wrong), found)

    return rows.select(*keys, "pos", "idx", "text", F.inline(_each(rules, make)))


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(n, r.cell, list(r.sources), list(r.targets)) for n, r in enumerate(rules)], RULES)


def folded(text: Column) -> Column:
    """One form of all case forms, character by character: one capital sharp s, no sigma of word ends, no dot that a capital I leaves."""
    upper = F.translate(F.upper(F.translate(text, "ẞ", "ß")), "ς", "Σ")  # the outer one changes nothing, but lower over upper would be made lower alone
    return F.translate(F.lower(upper), "ς\u0307", "σ")


def runs_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"[{RUN}]+"), 0), folded)


def pairs_of(runs: Column) -> Column:
    return F.zip_with(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.slice(runs, F.lit(2), F.size(runs)), lambda a, b: F.concat(a, F.lit(" "), b))


def others_of(text: Column, size: int) -> Column:
    """The ``size`` characters beside each other outside of ``RUN`` and white space, everywhere in a text."""
    pieces = F.filter(F.regexp_extract_all(text, F.lit(rf"(?U)[^{RUN}\s]+"), 0), lambda p: F.length(p) >= size)
    return F.transform(F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (size - 1)), lambda i: F.substring(p, i, size)))), folded)


def keys_of(text: Column) -> Column:
    runs = let(runs_of(text), lambda r: F.concat(r, pairs_of(r)))
    return F.array_distinct(F.concat(runs, others_of(text, 1), others_of(text, 2)))


def index_of(rules: DataFrame) -> DataFrame:
    """(key, rule columns): a row for each rule and key; a spelling's key is the one that the fewest spellings have, of those the longest.

    Spellings with runs go by two of them, or the one that they have, others by two characters or one.
    """
    each = rules.select("*", F.explode(F.array_distinct("sources")).alias("_s"))
    spelling = F.col("_s")
    own = F.array_distinct(F.coalesce(*[F.when(F.size(k) > 0, k) for k in (pairs_of(runs_of(spelling)), runs_of(spelling), others_of(spelling, 2), others_of(spelling, 1))]))
    keyed = each.select("rule_no", "_s", F.explode(own).alias("key"))
    rare = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("_n")), "key")
    chosen = rare.groupBy("rule_no", "_s").agg(F.min(F.struct("_n", (-F.length("key")).alias("_l"), "key")).alias("m")).select("rule_no", F.col("m.key").alias("key")).distinct()
    return chosen.join(rules, "rule_no")


def candidates(rows: DataFrame, text: str, rules: DataFrame, *keys: str) -> DataFrame:
    """``rows`` (one for each of ``keys``) beside the rules that a key of their text leads to, each once.

    An index of up to ``INDEX_BYTES`` goes to the rows.  A larger one meets their keys by shuffle, and the
    texts come in only where a key was found.
    """
    index = index_of(rules)
    texts = F.concat(F.array("cell", "wanted", "source_re", "target_re"), "sources", "targets")
    row = F.aggregate(texts, F.lit(200), lambda n, x: n + F.octet_length(F.coalesce(x, F.lit(""))))
    total = rules.agg(F.sum(F.size("sources") * row.cast("long"))).first()[0] or 0  # a row for each spelling at most
    own = rows.withColumn("key", F.explode(keys_of(F.col(text))))
    if total <= INDEX_BYTES:
        return own.join(F.broadcast(index), "key").drop("key")
    met = own.select(*keys, "key").join(index.select("key", "rule_no"), "key").select(*keys, "rule_no").distinct()
    return met.join(rows, list(keys)).join(rules, "rule_no")


def indexed_violations(both: DataFrame, rules: DataFrame) -> DataFrame:
    """:func:`glossary_violations` for a table of rules (rule_no, cell, sources, targets), without its order."""
    rows = both.select("pair", "pos", F.col("s.idx").alias("id"), joined(F.col("s.lines")).alias("src"), joined(F.col("d.lines")).alias("dst"))
    met = candidates(rows, "src", with_patterns(rules), "pair", "pos")
    kept = met.where(F.regexp_like("src", F.col("source_re")) & ~F.regexp_like("dst", F.col("target_re")))
    return kept.select("pair", "pos", "id", "rule_no", "cell", F.expr("regexp_extract(src, source_re, 0)").alias("hit"), "wanted", "src", "dst").dropDuplicates(["pair", "pos", "rule_no"])


def indexed_asr(blocks: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """:func:`asr_hits` for a table of rules: blanking takes runs and other characters away but makes no new ones."""
    rows = blocks.select(*keys, "pos", "idx", joined(F.col("lines")).alias("text"))
    met = candidates(rows, "text", with_patterns(rules), *keys, "pos").where(F.regexp_like("text", F.col("source_re")))
    left = met.withColumn("left", F.expr("regexp_replace(text, target_re, '\\0')")).where(F.regexp_like("left", F.col("source_re")))
    return left.select(*keys, "pos", "idx", "rule_no", F.expr("regexp_extract(left, source_re, 0)").alias("hit"), "wanted", "text").dropDuplicates([*keys, "pos", "rule_no"])


def with_patterns(rules: DataFrame) -> DataFrame:
    return rules.select("rule_no", "cell", "sources", "targets", term_pattern_of(F.col("sources")).alias("source_re"), term_pattern_of(F.col("targets")).alias("target_re"), F.array_join("targets", " / ").alias("wanted"))

"""The rule index against every rule tried on every block."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import rules as R

BLOCKS = "pair long, pos int, idx string, timing string, lines array<string>"
PIECES = ["kick", "Kick", "Kick", "k", "ab", "AB", "Åb", "Åb", "é", "É", "c++", "C++", "图", "层", "图层", "ſt", "ST", "ß", "ẞ", "Σας", "σασ", "İx", "ix", "ə", "Ə", "mặt nạ", "MẶT NẠ", "-", ".", "9", " ", " ", "\t", "(", "Ⱥq", "ⱥq"]


def cases(seed):
    rng = random.Random(seed)
    some = lambda most: "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, most))).strip() or "ab"
    rules = [R.Rule(f"cell{n}", tuple(some(3) for _ in range(rng.randrange(1, 4))), tuple(some(3) for _ in range(rng.randrange(1, 3)))) for n in range(60)]
    blocks = [(n % 3, n, str(n), "", [some(9) for _ in range(rng.randrange(1, 3))]) for n in range(80)]
    edits = [(n % 3, n, str(n), "", [some(9)]) for n in range(80)]
    return rules, blocks, edits


@pytest.mark.parametrize("seed, index_bytes", [(1, 64 << 20), (2, 64 << 20), (3, 0)])
def test_index_loses_no_hit(spark, monkeypatch, seed, index_bytes):
    monkeypatch.setattr(R, "INDEX_BYTES", index_bytes)
    rules, src, dst = cases(seed)
    src, dst = spark.createDataFrame(src, BLOCKS), spark.createDataFrame(dst, BLOCKS)
    side = lambda df, name: df.select("pair", "pos", F.struct("idx", "timing", "lines").alias(name))
    both, table = side(src, "s").join(side(dst, "d"), ["pair", "pos"]), R.rules_frame(spark, rules)
    columns = ["pair", "pos", "id", "rule_no", "cell", "hit", "wanted", "src", "dst"]
    want = sorted(map(tuple, R.glossary_violations(both, rules).select(columns).collect()))
    assert len(want) > 50 and sorted(map(tuple, R.indexed_violations(both, table).select(columns).collect())) == want
    columns = ["pair", "pos", "idx", "rule_no", "hit", "wanted", "text"]
    want = sorted(map(tuple, R.asr_hits(src, rules, "pair").select(columns).collect()))
    assert len(want) > 20 and sorted(map(tuple, R.indexed_asr(src, table, "pair").select(columns).collect())) == want


def test_many_rules_go_by_the_index(spark, monkeypatch):
    rules, src, _ = cases(4)
    blocks = spark.createDataFrame(src, BLOCKS)
    plain = sorted(map(tuple, R.asr_hits(blocks, rules, "pair").collect()))
    monkeypatch.setattr(R, "MANY", 10)
    found = R.asr_hits(blocks, rules, "pair")
    assert sorted(map(tuple, found.collect())) == plain
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_no_rules_and_no_blocks(spark):
    rules, src, _ = cases(5)
    blocks, none = spark.createDataFrame(src, BLOCKS), spark.createDataFrame([], R.RULES)
    assert R.indexed_asr(blocks, none, "pair").collect() == [] == R.indexed_asr(blocks.where("false"), R.rules_frame(spark, rules), "pair").collect()


def test_patterns_of_columns_are_those_of_lists(spark):
    rules, src, _ = cases(6)
    texts = spark.createDataFrame([(" ".join(b[4]),) for b in src], "t string")
    table = R.with_patterns(R.rules_frame(spark, rules)).select("rule_no", "source_re").collect()
    for r in table[:20]:
        plain = T.term_pattern(rules[r["rule_no"]].sources)
        assert texts.where(F.regexp_extract("t", plain, 0) != F.regexp_extract("t", r["source_re"], 0)).count() == 0


def test_run_characters_have_all_their_forms():
    """Every character that folds like one of RUN is in RUN and bounds words."""
    run, latin = re.compile(f"[{R.RUN}]"), re.compile(f"[{T.LATIN}]")
    letters = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff"]
    one = lambda c: c.upper() if len(c.upper()) == 1 else c  # noqa: E731  as Java folds a character
    fold = lambda c: one(c).lower()[0]
    of_run = {fold(c) for c in letters if run.match(c)}
    assert all(run.match(c) and latin.match(c) for c in letters if fold(c) in of_run)


@pytest.mark.parametrize("terms, text, hit", [(["ab", "ab c"], "x AB c", "AB c"), (["層"], "a層b", "層"), (["a層"], "ba層", ""), (["層b"], "層bc", ""), (["+a"], "b+a", "+a"), (["é"], "né", "")])
def test_bounds_of_terms(spark, terms, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(F.regexp_extract("t", T.term_pattern(terms), 0)).first()[0] == hit

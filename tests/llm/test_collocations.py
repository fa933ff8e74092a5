"""Phrase mining against a plain count of every n-gram."""

import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", small)]


def brute(rows, max_n, least, percent, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates, found = {g: a for g, a in own.items() if len(g) > 1 and a >= least}, []
        holds = lambda x, g: any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1))
        for g, a in candidates.items():
            score, _, left, right = min((1000000 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            if not any(len(x) > len(g) and 100 * b >= percent * a and holds(x, g) for x, b in candidates.items()):
                found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(spark, rows, schema="lang string, text string", **kw):
    found = collocations.collocations(spark.createDataFrame(rows, schema), **kw)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()))


TEXTS = [
    ("en", "Big red dog. big red dog, big  red\tdog; the big red cat\nbig red"),
    ("en", None), ("en", ""), (None, " .,; \n"), (None, "é É é É é. a a a a a a"), ("und", "a a\x0ba a\x0ca a\ra a"),
    ("fr", "le chat le chat le chat. un chat"), ("fr", "le chat le chat le chat. un chat"), ("", "x y x y"), ("it", "mot un mot un mot un"),
]


@pytest.mark.parametrize("max_n, least, percent, top", [(3, 2, 50, 2000), (2, 1, 50, 3), (4, 1, 100, 5), (5, 2, 1, 9)])
def test_equals_plain_count(spark, max_n, least, percent, top):
    assert mined(spark, TEXTS, max_n=max_n, least=least, percent=percent, top=top) == brute(TEXTS, max_n, least, percent, top)


def test_empty_table_and_other_columns(spark):
    assert mined(spark, [], least=1) == []
    rows = [(lang, text, "phrase", 1, "n") for lang, text in TEXTS]
    assert mined(spark, rows, "lang string, text string, phrase string, f int, N string", least=2) == brute(TEXTS, 3, 2, 50, 2000)


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7), ("en", "a b", big - 1)], "lang string, phrase string, f long")
    (row,) = collocations.scored(counts, 3).collect()
    assert row["score"] == 1000000 * (big - 1) ** 2 // (big * (big + 7)) and (row["l"], row["r"]) == (big, big + 7)


def joined(found):
    return {g.decode(): int(n) for grams, counts, _ in found for g, n in zip(grams.to_pylist(), counts, strict=True)}


def plain_grams(data, max_n):
    return Counter(" ".join(w[i : i + k]) for w in pieces(data.decode()) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "cc", "é", " ", "\t", ".", "\n", " a b"]), max_size=60), st.sampled_from([7, 20, 64]), st.integers(2, 4))
def test_slices_lose_nothing(parts, window, max_n):
    data, kept, got = "".join(parts).encode(), collocations.WINDOW, Counter()
    try:
        collocations.WINDOW = window
        for own, context in collocations.slices(data, max_n):
            got.update(joined(collocations.count_grams(own, max_n, context)))
    finally:
        collocations.WINDOW = kept
    assert got == plain_grams(data, max_n)


def test_long_text_and_many_names(spark):
    """Words beyond what one number can code, in one long piece."""
    data = " ".join(f"w{i % 70000}" for i in range(140_001)).encode()
    assert joined(collocations.count_grams(data, 4)) == plain_grams(data, 4)

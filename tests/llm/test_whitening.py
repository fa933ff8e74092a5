"""Whitening against plain numpy on whole numbers."""

import math

import numpy as np
import pytest

from tessera.llm import whitening
from tessera.llm.common import table
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, most):
    """By id: (n, deviation, |whitened|, explained) of the rows of one length."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * min(max(c, -(2.0**56)), 2.0**56)) + 1000000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    gap = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    c = np.array([[g / n for g in r] for r in gap])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    first = np.argsort(-values, kind="stable")[:most]
    with np.errstate(all="ignore"):
        w = c @ vectors[:, first] / np.sqrt(values[first])
    return [(i, n, sum(g * g for g in r), np.abs(a), values[first] / values.sum()) for (i, _), r, a in zip(kept, gap, w, strict=True)]


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    want = {(i, k + 1): (n, d, w[k], e[k]) for i, n, d, w, e in brute(rows, 32) for k in range(len(w))}
    found = QUERIES["op12_whitening"](spark, SF)
    assert found.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = found.collect()
    assert len(got) == len(want) and {(r["vec_id"], r["component"]) for r in got} == set(want)
    for r in got:
        n, d, w, e = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, d)
        assert abs(r["whitened"]) == pytest.approx(w, rel=1e-6, abs=1e-7) and r["explained"] == pytest.approx(e, rel=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    by = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    mean = np.array([[by[i, k] for k in range(1, 33)] for i, _ in rows]).mean(axis=0)
    assert np.abs(mean).max() < 1e-9


ODD = [
    (1, [0.5, 1.0, -2.0]), (2, [0.25, 0.0, 3.0]), (2, [0.25, 0.0, 3.0]), (None, [1.0, 1.0, 1.0]), (9007199254740993, [0.1, -0.7, 0.3]), (4, [0.0, 0.0, 0.0]),
    (5, None), (6, [1.0, None, 2.0]), (7, [1.0, float("nan"), 2.0]), (8, [float("inf"), 0.0, 0.0]),
]


def test_odd_rows(spark):
    rows = [(i, v, "x", 1.0) for i, v in ODD]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, c string, whitened double")).collect()
    want = brute(ODD, 32)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for r, (i, n, d, w, e) in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert r[:3] == (i, n, d) and np.abs(r[3]) == pytest.approx(w, rel=1e-6, abs=1e-7) and r[4] == pytest.approx(list(e)) and r[5] < 1e-9


def test_vectors_without_variance(spark):
    """Equal rows, one row, a constant entry, vectors of other lengths, huge entries."""
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [7.0]), (4, []), (5, [1e300, -1e300, 1.0, 0.0]), (6, [-1e300, 5.0, 1.0, 0.5])]
    got = {r["id"]: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    assert [abs(w) if w is not None else w for w in got[1]["whitened"]] == [pytest.approx(1), None] and got[1]["explained"] == [1, 0]
    assert tuple(got[3])[1:] == (1, 0, [None], [None], None)
    assert got[5]["n"] == 2 and got[5]["deviation"] is None and abs(got[5]["whitened"][0]) == pytest.approx(1)


def test_empty_table(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []

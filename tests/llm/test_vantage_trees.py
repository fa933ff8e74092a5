"""Nearest neighbours against all distances."""

import math
import random

import numpy as np
import pytest

from tessera.llm import vantage_trees
from tessera.llm.vantage_trees import Coarse, Index, Shard, distances, vantage_order


def brute(queries, vectors, k):
    ok = lambda i, v: i is not None and v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)
    kept, out = {(i, tuple(c + 0.0 for c in v)) for i, v in vectors if ok(i, v)}, []
    for q, a in {(i, tuple(c + 0.0 for c in v)) for i, v in queries if ok(i, v)}:
        near = sorted((float(distances(np.array([b]), np.array(a))[0]), i) for i, b in kept if i != q and len(a) == len(b))
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def searched(spark, queries, vectors, k, factor=1.0):
    schema = "vec_id long, embedding array<double>, v string, leaf int"
    frame = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    found = Index(frame(vectors), k).search(frame(queries), factor)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    return sorted(map(tuple, found.collect()))


@pytest.fixture
def tiny(monkeypatch):
    """Many shards of few rows, small leaves, few queries a copy."""
    for name, n in (("SHARD_BYTES", 1), ("SHARD_ROWS", 20), ("LEAF", 4), ("ASKS", 3)):
        monkeypatch.setattr(vantage_trees, name, n)


def test_odd_rows(spark):
    rows = [
        (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0]), (200, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 4.0]),
        (6, None), (7, []), (8, [0.0, 0.0]), (9, [1.0, None]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (None, [1.0, 0.0]), (300, [0.0, 0.0]),
        (9007199254740993, [2.0, 0.0]), (9007199254740992, [2.0, 0.0]), (12, [-0.0, 5.0]), (13, [0.0, 5.0]), (400, [7.0]),
    ]
    for k in (1, 3, 10):
        queries = [r for r in rows if r[0] is not None and r[0] % 100 == 0 or r[0] == 9007199254740993]
        assert searched(spark, queries, rows, k) == brute(queries, rows, k)
    assert searched(spark, [], rows, 3) == [] and searched(spark, [], [], 3) == []
    with pytest.raises(ValueError):
        searched(spark, rows[:1], rows, 3, 0.5)


def test_shards_and_copies(spark, tiny):
    """A third of all rows are one vector, many others lie at equal distances."""
    rng = random.Random(5)
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(100)] + [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(100, 200)] + [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(200, 320)]
    queries = [r for r in rows if r[0] % 9 == 0]
    got, want = searched(spark, queries, rows, 5), brute(queries, rows, 5)
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == [r[3] for r in want]


def test_factor_and_recall():
    """Factor one is exact; a larger one looks at fewer vectors and still finds most neighbours among clusters."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.05, (400, 8)) for c in rng.normal(0, 1, (10, 8))])
    order, near, far = vantage_order(points)
    shard = Shard(points[order], near, far, [np.array([i]) for i in order])
    queries = points[::97]
    exact = [[i for _, i in sorted((d, i) for i, d in enumerate(distances(points, q)))[:10]] for q in queries]
    seen = {}
    for factor in (1.0, 2.0):
        looked, plain = 0, vantage_trees.distances

        def counted(p, q):
            nonlocal looked
            looked += len(p)
            return plain(p, q)

        vantage_trees.distances = counted
        try:
            got = [[i for _, i in shard.nearest(q, 10, float("inf"), factor)] for q in queries]
        finally:
            vantage_trees.distances = plain
        recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, exact, strict=True)])
        seen[factor] = (recall, looked)
    assert seen[1.0][0] == 1 and seen[2.0][0] >= 0.9
    assert seen[2.0][1] <= seen[1.0][1] < 0.5 * len(points) * len(queries)


def test_coarse_tree_leaves_out_no_neighbour():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(c, 0.1, (300, 4)) for c in rng.normal(0, 1, (8, 4))])
    tree = Coarse(points, 16)
    home = tree.home(points)
    assert set(home) == set(range(tree.leaves)) and tree.leaves > 8
    left = 0
    for q in points[::50]:
        bound = np.sort(distances(points, q))[10]
        leaves = tree.within(q, bound, 1.0)
        left += tree.leaves - len(leaves)
        assert set(home[distances(points, q) <= bound]) <= set(leaves)
    assert left > 0
    assert Coarse(np.ones((100, 3)), 9).leaves == 1

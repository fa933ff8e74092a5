"""The pipeline's stages, each against a brute-force version on the stage's own input."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import simhash_dedup, toxicity
from tessera.llm.common import table, written

from .test_operators import brute_hits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return [(df.columns, df.collect()) for df in out]


def test_columns_stay(steps):
    for columns, _ in steps[:-1]:
        assert columns == steps[0][0]
    assert steps[-1][0] == [*steps[0][0], "shard", "slot"]


def test_toxic_documents_go(spark, steps):
    rows = steps[0][1]
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    learns = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    slots = toxicity.Slots()
    known = [labels[i] for i in labels if learns(i)]
    positive = [slots.text(r["text"]) for r in rows if learns(r["doc_id"]) and labels.get(r["doc_id"]) == 1]
    model = toxicity.train(positive, [slots.text(r["text"]) for r in rows if learns(r["doc_id"])], sum(known) / len(known))
    kept = [r["doc_id"] for r in rows if model.score([slots.text(r["text"])])[0] < 0.7]
    assert sorted(r["doc_id"] for r in steps[1][1]) == sorted(kept)


def test_one_of_each_group_stays(steps):
    rows = sorted(steps[1][1], key=lambda r: r["doc_id"])
    sets = [set(simhash_dedup.shingle_hashes(r["text"], 5).tolist()) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = simhash_dedup.roots(len(rows), np.array([a for a, _ in near], int), np.array([b for _, b in near], int))
    assert sorted(r["doc_id"] for r in steps[2][1]) == [r["doc_id"] for i, r in enumerate(rows) if root[i] == i]


def test_contaminated_documents_go(spark, steps):
    items = [(str(r["item_id"]), r["text"]) for r in table(spark, SF, "benchmark").collect()]
    clean = []
    for r in steps[2][1]:
        n, hit, _ = brute_hits(r["text"], items)
        if not (hit and 20 * hit >= n):
            clean.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in steps[3][1]) == sorted(clean)


def test_sources_are_mixed(steps):
    rows = steps[3][1]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows}
    sources = sorted({r["source"] for r in rows})
    sums = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    weigh = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    low, high = 0.0, 2.0 * sum(sums.values())
    for _ in range(200):  # the level at which the stopped targets add up
        level = (low + high) / 2
        low, high = (level, high) if sum(min(weigh[s] * level, 2 * sums[s]) for s in sources) < 1.5 * sum(sums.values()) else (low, level)
    want = Counter()
    for s in sources:
        goal = min(weigh[s] * low, 2 * sums[s])
        left, before = round(goal - goal // sums[s] * sums[s]), 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: hashlib.md5(f"{r['doc_id']}:mix".encode()).hexdigest()[:15]):
            n = size[r["doc_id"]]
            want[r["doc_id"]] = int(goal // sums[s]) + (2 * min(max(left - before, 0), n) >= n)
            before += n
    assert Counter(r["doc_id"] for r in steps[4][1]) == +want


def test_shards_are_even(steps):
    rows, placed = steps[4][1], steps[5][1]
    assert Counter(r["doc_id"] for r in placed) == Counter(r["doc_id"] for r in rows)
    sizes = Counter()
    for r in placed:
        sizes[r["shard"]] += len(r["text"].encode()) + 1
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 3 * max(len(r["text"].encode()) for r in rows)
    for s in sizes:
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sum(r["shard"] == s for r in placed)))


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == steps[-1][0]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[-1][1]))

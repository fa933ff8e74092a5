"""Nearest neighbours by vantage-point trees, one a shard, pruned by the triangle inequality.

A coarse tree, fitted on a bounded sample, deals all vectors out to shards that hold what lies together;
each shard has a tree of its own, whose nodes are rows of a written table.  A query searches the shard
that it falls into, which bounds the distance of its neighbours, and then those other shards that the
bound leaves.  A branch, or a shard, is left out if its least possible distance times ``factor`` exceeds
the bound: factor one is exact, larger ones search less.

Defined results: vectors that are null, empty or zero, or hold null or non-finite entries, and rows with a
null id, take no part.  A query meets vectors of its own number of entries.  Rows that repeat id and vector
are one row; equal vectors are searched once and keep their smallest ids, which is all that a query can
return; a query's own id is never returned.  Equal distances rank by id.  Fewer candidates than asked are
all returned; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written

#: Vectors, and bytes of them, that the coarse tree is fitted on at most.
SAMPLE, SAMPLE_BYTES = 8192, 32 << 20
#: Bytes of the vectors of a shard, and how many it has however long they are.
SHARD_BYTES, SHARD_ROWS = 2 << 20, 256
#: Vectors that a tree's leaf scans at once; sample vectors that a coarse leaf has at least; queries that one copy of a shard answers.
LEAF, COARSE_LEAF, ASKS = 128, 8, 4096
#: The place of a query among a shard's rows, behind all nodes.
QUERY = 1 << 30
#: What rounding can make of a distance, relative to it.
SLACK = 1e-9

KEY = ["dims", "leaf", "part"]


def usable(vector: Column) -> Column:
    entries = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & entries & F.exists(vector, lambda x: x != 0)


def cleaned(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): what takes part, each row once."""
    rows = df.select(quoted(id).alias("id"), quoted(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False))).distinct()


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances, in double precision; a row's result doesn't depend on the other rows."""
    return np.sqrt(np.square(points - to).sum(axis=1))


def stacked(column, dims: int) -> np.ndarray:
    return np.concatenate([np.asarray(x, np.float64) for x in column]).reshape(-1, dims) if len(column) else np.empty((0, dims))


def far_point(points: np.ndarray, rng: np.random.Generator) -> int:
    """Of a few points the one whose distances to the others spread most."""
    tried, others = rng.choice(len(points), min(len(points), 8), replace=False), points[rng.choice(len(points), min(len(points), 64), replace=False)]
    return int(tried[np.argmax([distances(others, points[i]).var() for i in tried])])


class Coarse:
    """The tree over shards of the vectors with ``dims`` entries; a node is (vantage, radius, inside, outside), a leaf its number."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.leaves = 0
        self.root = self.grown(points, max(1, min(leaves, len(points) // COARSE_LEAF)), np.random.default_rng(len(points)))

    def grown(self, points: np.ndarray, leaves: int, rng: np.random.Generator):
        if leaves > 1:
            vantage = points[far_point(points, rng)]
            d = distances(points, vantage)
            radius = float(np.quantile(d, (leaves // 2) / leaves, method="lower"))
            if (d > radius).any():
                return vantage, radius, self.grown(points[d <= radius], leaves // 2, rng), self.grown(points[d > radius], leaves - leaves // 2, rng)
        self.leaves += 1
        return self.leaves - 1

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into."""
        out, todo = np.zeros(len(points), np.int32), [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if isinstance(node, int):
                out[own] = node
            elif len(own):
                inside = distances(points[own], node[0]) <= node[1]
                todo += [(node[2], own[inside]), (node[3], own[~inside])]
        return out

    def within(self, point: np.ndarray, bound: float, factor: float) -> list[int]:
        """Leaves that may hold points nearer than ``bound``."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, int):
                out.append(node)
                continue
            d = float(distances(node[0][None], point)[0])
            slack = SLACK * (d + node[1])
            todo += [node[2]] if factor * (d - node[1] - slack) <= bound else []
            todo += [node[3]] if factor * (node[1] - d - slack) <= bound else []
        return out


def vantage_order(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, near, far) of a tree over points: a node's range holds its vantage point, the inner half, the outer half.

    ``near`` is the greatest distance of the inner half to the vantage point, ``far`` the least of the outer
    one; a range of up to ``LEAF`` points is a leaf.
    """
    order, near, far, rng = np.arange(len(points)), np.zeros(len(points)), np.zeros(len(points)), np.random.default_rng(len(points))
    todo = [(0, len(points))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            continue
        own = order[lo:hi]
        first = far_point(points[own], rng)
        own[0], own[first] = own[first], own[0]
        d = distances(points[own[1:]], points[own[0]])
        by = np.argsort(d, kind="stable")
        order[lo + 1 : hi] = own[1:][by]
        mid = middle(lo, hi)
        near[lo], far[lo] = d[by[mid - lo - 2]], d[by[mid - lo - 1]]
        todo += [(lo + 1, mid), (mid, hi)]
    return order, near, far


def middle(lo: int, hi: int) -> int:
    """Where the outer half of a node's range begins."""
    return (lo + 1 + hi) // 2


class Shard:
    """A shard's tree as its rows give it."""

    def __init__(self, points: np.ndarray, near: np.ndarray, far: np.ndarray, ids: list[np.ndarray]):
        self.points, self.near, self.far, self.ids = points, near, far, ids

    def nearest(self, query: np.ndarray, k: int, bound: float, factor: float) -> list[tuple[float, int]]:
        """The first ``k`` (distance, id) of those at most ``bound`` away."""
        best: list[tuple[float, int]] = []
        todo = [(0.0, 0, len(self.points))]
        while todo:
            least, lo, hi = heapq.heappop(todo)
            if factor * least > bound:
                break
            if hi - lo <= LEAF:
                d = distances(self.points[lo:hi], query)
                found = np.flatnonzero(d <= bound)
            else:
                d = distances(self.points[lo : lo + 1], query)
                found = np.flatnonzero(d <= bound)
                mid, far, slack = middle(lo, hi), self.far[lo], SLACK * (d[0] + self.far[lo])
                heapq.heappush(todo, (max(least, d[0] - self.near[lo] - slack), lo + 1, mid))
                heapq.heappush(todo, (max(least, far - d[0] - slack), mid, hi))
            if len(found):
                best = heapq.nsmallest(k, best + [(float(d[i]), int(x)) for i in found for x in self.ids[lo + i]])
                if len(best) == k:
                    bound = min(bound, best[-1][0])
        return best


def router(trees: dict[int, Coarse], factor: float, others: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds ``leaves`` to rows with dims and v: the leaf each falls into, or the ``others`` that its ``bound`` leaves."""

    def leaves(dims: int, own: pd.DataFrame) -> list[list[int]]:
        points = stacked(own["v"], dims)
        if dims not in trees:
            return [[] if others else [0]] * len(own)
        home = trees[dims].home(points)
        if not others:
            return [[h] for h in home]
        return [[x for x in trees[dims].within(p, b, factor) if x != h] for p, b, h in zip(points, own["bound"], home, strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                yield own.assign(leaves=leaves(int(dims), own))

    return run


def planted(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's vectors in the order of its tree."""
    rows = rows.sort_values("mark", kind="stable", ignore_index=True)
    order, near, far = vantage_order(stacked(rows["v"], int(rows["dims"].iloc[0])))
    return rows.iloc[order].assign(place=np.arange(len(rows)), near=near, far=far)[[*KEY, "place", "v", "ids", "near", "far"]]


def answers(k: int, factor: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows sorted by shard, each shard's tree before its queries: (ask, mark, found)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, shard = None, [], None
        for batch in batches:
            for own_key, own in batch.groupby([*KEY, "turn"], sort=False):
                if own_key != key:
                    key, held, shard = own_key, [], None
                tree, asked = own[own["place"] < QUERY], own[own["place"] == QUERY]
                if len(tree):
                    held.append(tree)
                if len(asked) and held:
                    rows, held = pd.concat(held, ignore_index=True), []
                    shard = Shard(stacked(rows["v"], int(own_key[0])), rows["near"].to_numpy(), rows["far"].to_numpy(), list(rows["ids"]))
                if len(asked) and shard:
                    found = [shard.nearest(np.asarray(v, np.float64), k, b, factor) for v, b in zip(asked["v"], asked["bound"], strict=True)]
                    yield pd.DataFrame({"ask": asked["ask"], "mark": asked["mark"], "found": [[{"d": d, "id": i} for d, i in x] for x in found]})

    return run


class Index:
    """Trees over all usable vectors of a table; ``k``: the most neighbours that will be asked for."""

    def __init__(self, vectors: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding"):
        self.k = k
        n = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        first = cleaned(vectors, id, vector).withColumn("n", n).where(F.col("n") <= k + 1)  # the limit holds before the shuffle too
        classes = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        classes = written(classes.select(F.size("v").alias("dims"), F.xxhash64("v").alias("mark"), "v", "ids"), "vector-classes")
        total, dims = classes.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(1))).first()
        size = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * dims)))
        sample = classes.select("dims", "v").orderBy("mark", "v").limit(size).toPandas()
        rows = max(SHARD_ROWS, SHARD_BYTES // (8 * dims))
        self.trees = {int(d): Coarse(stacked(own["v"], int(d)), -(-total // rows)) for d, own in sample.groupby("dims")}
        routed = classes.mapInPandas(router(self.trees, 1.0, False), f"{ddl(classes)}, leaves array<int>").withColumn("leaf", F.col("leaves")[0]).drop("leaves")
        routed = written(routed, "vector-leaves")
        #: How many parts, each with a tree of its own, a leaf has.
        self.parts = written(routed.groupBy("dims", "leaf").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts")), "vector-parts")
        dealt = routed.join(self.parts, ["dims", "leaf"]).withColumn("part", F.pmod(F.xxhash64("mark"), F.col("parts")).cast("int"))
        self.nodes = written(dealt.drop("parts").groupBy(*KEY).applyInPandas(planted, "dims int, leaf int, part int, place int, v array<double>, ids array<bigint>, near double, far double"), "vantage-trees")

    def meet(self, asks: DataFrame, factor: float) -> DataFrame:
        """(ask, mark, found) of asks (ask, mark, dims, v, bound, leaf): the first ``k`` + 1 of each, over the parts of its leaf."""
        asks = written(asks, "vector-asks")
        turns = asks.groupBy("dims", "leaf").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("turns"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        shards = self.nodes.join(turns, ["dims", "leaf"]).withColumn("turn", each("turns")).drop("turns").withColumns({"ask": F.lit(0).cast("bigint"), "mark": F.lit(0).cast("bigint"), "bound": F.lit(0.0)})
        own = asks.join(turns, ["dims", "leaf"]).withColumn("turn", F.pmod(F.xxhash64("ask", "mark"), F.col("turns")).cast("int")).drop("turns")
        own = own.join(self.parts, ["dims", "leaf"]).withColumn("part", each("parts")).drop("parts")
        own = own.withColumns({"place": F.lit(QUERY), "ids": F.lit(None).cast("array<bigint>"), "near": F.lit(0.0), "far": F.lit(0.0)})
        both = shards.unionByName(own).repartition(*KEY, "turn").sortWithinPartitions(*KEY, "turn", "place")
        found = both.mapInPandas(answers(self.k + 1, factor), "ask bigint, mark bigint, found array<struct<d:double,id:bigint>>")
        return found.select("ask", "mark", F.inline("found"))

    def first(self, found: DataFrame) -> DataFrame:
        """The first ``k`` + 1 of all that was found for an ask."""
        n = F.row_number().over(Window.partitionBy("ask", "mark").orderBy("d", "id"))
        return found.withColumn("n", n).where(F.col("n") <= self.k + 1)

    def search(self, queries: DataFrame, factor: float = 1.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score): each query's ``k`` nearest, its own id left out."""
        if factor < 1:
            raise ValueError("a factor below one searches more than all")
        asking = written(cleaned(queries, id, vector), "vector-queries")
        asks = written(asking.groupBy("v").agg(F.min("id").alias("ask")).withColumns({"mark": F.xxhash64("v"), "dims": F.size("v")}), "vector-asked")
        schema = "ask bigint, mark bigint, dims int, v array<double>, bound double, leaves array<int>"
        columns = ["ask", "mark", "dims", "v", "bound"]
        leaf = lambda rows, others: rows.select(columns).mapInPandas(router(self.trees, factor, others), schema).select(*columns, F.explode("leaves").alias("leaf"))
        home = written(self.first(self.meet(leaf(asks.withColumn("bound", F.lit(float("inf"))), False), factor)), "vector-home")
        bounds = home.where(F.col("n") == self.k + 1).select("ask", "mark", F.col("d").alias("bound"))
        rest = asks.join(bounds, ["ask", "mark"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        away = self.meet(leaf(rest, True), factor)
        best = self.first(home.drop("n").unionByName(away)).groupBy("ask", "mark").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("found"))
        mine = asking.join(asks.select("v", "ask", "mark"), "v").select("id", "ask", "mark").join(best, ["ask", "mark"])
        kept = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, self.k)
        out = mine.select(F.col("id").alias("query_id"), F.posexplode(kept).alias("at", "x"))
        return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d QUALIFY rank <= 10
"""

"""Whitening of embeddings: principal components of unit variance, by the covariance of exactly centred rows.

Entries become whole numbers, whose sums are exact, so that a centred row is the quotient of two exact whole
numbers.  MLlib's RowMatrix multiplies the centred rows up over the cluster; the covariance, a square of the
number of entries, is decomposed on the driver, and its components go to every task that projects rows.

Defined results: vectors that are null or hold null or non-finite entries are dropped, zero vectors and rows
with a null id stay, repeated rows count as often as they stand.  Vectors of each length are a table of
their own; empty ones have no components and so no rows.  An entry beyond ``LARGEST`` in size counts as that.
A component without variance (beside the first one's, by what doubles can tell) has a null ``whitened``;
``explained`` is null if nothing varies.  A deviation beyond 64 bits is null.  Equal rows have equal results;
an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, written

#: Steps of an entry in 1, and the whole number that stands for 0.
STEPS, ZERO = 64, 1_000_000
#: The greatest entry that counts as it is: its whole number has 64 bits.
LARGEST = 2.0**56


def whole(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, x): each usable vector in whole numbers."""
    rows = df.select(quoted(id).alias("id"), quoted(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = lambda c: F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))
    return rows.select("id", F.transform("v", lambda c: F.floor(held(c) * STEPS) + F.lit(ZERO).cast("bigint")).alias("x"))


@dataclass
class Sums:
    """Of the vectors of one length: how many, their exact sums, the most that n * x - sum can be in size."""

    n: int
    sums: list[int]
    most: int


def summed(xs: DataFrame) -> dict[int, Sums]:
    """:class:`Sums` by length; what comes to the driver is a row for each dimension."""
    each = xs.select(F.size("x").alias("dims"), F.posexplode("x").alias("at", "x"))
    totals = each.groupBy("dims", "at").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(19, 0)")).alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    out: dict[int, Sums] = {}
    for r in sorted(totals.collect(), key=lambda r: (r["dims"], r["at"])):
        own, s = out.setdefault(r["dims"], Sums(r["n"], [], 0)), int(r["s"])
        own.sums.append(s)
        own.most = max(own.most, r["n"] * r["hi"] - s, s - r["n"] * r["lo"], r["n"] * max(abs(r["lo"]), abs(r["hi"])))
    return out


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow column."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def centring(of: dict[int, Sums]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, x) to (id, dims, n, deviation, c): c the centred entries, each the quotient of exact whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("x"))
            for dims in filter(None, pc.unique(sizes).to_pylist()):
                own, fit = batch.filter(pc.equal(sizes, dims)), of[dims]
                kind = np.int64 if dims * fit.most**2 < 1 << 63 else object  # whole numbers of any size where 64 bits don't do
                gap = fit.n * matrix(own.column("x"), dims).astype(kind) - np.array(fit.sums, kind)
                deviation = pa.array([int(s) if s < 1 << 63 else None for s in (gap * gap).sum(axis=1)], pa.int64())
                rows = len(own)
                yield pa.record_batch([own.column("id"), pa.repeat(pa.scalar(dims, pa.int32()), rows), pa.repeat(pa.scalar(fit.n, pa.int64()), rows), deviation, lists((gap / fit.n).astype(np.float64))], ["id", "dims", "n", "deviation", "c"])

    return run


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The sum of the outer products of an array column, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


@dataclass
class Components:
    """Unit eigenvectors (columns) of the greatest eigenvalues of a covariance, those eigenvalues, and its trace."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt(e), not a number where there is no variance."""
        least = len(self.vectors) * np.finfo(float).eps * max(self.values[0], 0)
        real = self.values > least
        return np.where(real, 1 / np.sqrt(np.where(real, self.values, 1)), np.nan)


def components(covariance: np.ndarray, most: int) -> Components:
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    first = np.argsort(-values, kind="stable")[:most]
    return Components(np.ascontiguousarray(vectors[:, first]), values[first], float(np.trace(covariance)))


def projecting(found: Components) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Centred rows with ``whitened`` in place of c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = found.vectors * found.scale
        for batch in batches:
            c = matrix(batch.column("c"), len(to))
            # A sum for each row by itself, so that equal rows have equal results whatever stands beside them.
            w = np.stack([(c * to[:, k]).sum(axis=1) for k in range(to.shape[1])], axis=1)
            yield pa.record_batch([*(batch.column(x) for x in ("id", "dims", "n", "deviation")), lists(w)], ["id", "dims", "n", "deviation", "whitened"])

    return run


def identity_error(rows: DataFrame, real: int, n: int) -> float | None:
    """The largest entry of the covariance of the first ``real`` whitened components, less the identity."""
    if not real:
        return None
    first = rows.select(F.slice("whitened", 1, real).alias("w"))
    means = first.select(F.posexplode("w").alias("at", "w")).groupBy("at").agg(F.avg("w").alias("mean")).orderBy("at").collect()
    centred = first.select(F.zip_with("w", F.lit([r["mean"] for r in means]), lambda w, m: w - m).alias("w"))
    return float(np.abs(gramian(centred, "w") / n - np.eye(real)).max())


def whiten(vectors: DataFrame, most: int = 32, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened array, explained array, identity_error) of each usable vector, by up to ``most`` components.

    n: vectors of its length; deviation: the sum of the squares of n * x - sum; explained: each component's
    share of the variance.
    """
    spark, xs = vectors.sparkSession, whole(vectors, id, vector)
    kind = dict(xs.dtypes)["id"]
    of = summed(xs)
    centred = written(xs.mapInArrow(centring(of), f"id {kind}, dims int, n bigint, deviation bigint, c array<double>"), "centred")
    out = [whitened(spark, centred.where(F.col("dims") == dims), own.n, kind, most) for dims, own in sorted(of.items())]
    schema = f"id {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def whitened(spark: SparkSession, centred: DataFrame, n: int, kind: str, most: int) -> DataFrame:
    found = components(gramian(centred, "c") / n, most)
    rows = written(centred.mapInArrow(projecting(found), f"id {kind}, dims int, n bigint, deviation bigint, whitened array<double>"), "whitened")
    share = [float(e / found.trace) if found.trace > 0 else None for e in found.values]
    error = identity_error(rows, int(np.isfinite(found.scale).sum()), n)
    null = F.transform("whitened", lambda w: F.when(~F.isnan(w), w))
    return rows.select("id", "n", "deviation", null.alias("whitened"), F.array(*map(F.lit, share)).cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error"))

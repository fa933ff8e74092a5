"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy on confirmed toxic texts
and unlabelled texts.  The risk is the class-prior-corrected one whose negative part may not fall below
zero: ``prior E_p[l(f)] + max(0, E_u[l(-f)] - prior E_p[l(-f)])``.  Only features that are surely more
frequent in the confirmed texts than in the unlabelled ones get a weight; for that, all unlabelled
texts are counted.  The samples that train it are bounded; scoring covers every whole text in the
executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, quoted, written
from .decontaminate import WORD_BYTES

#: Slots for hashed features: whole words, and beginnings of so many bytes.
SLOTS = 1 << 20
BEGINNINGS = range(3, 9)
#: Confirmed toxic rows that train, in expectation at most; bytes of their features at most.
POSITIVES, SAMPLE_BYTES = 3000, 64 << 20
#: Bytes of distinct feature sets that the driver takes; more of them stay on the executors, a job for each round.
PATTERN_BYTES = 16 << 20
ROUNDS, RATE, DECAY = 150, 0.1, 5e-4
#: Confirmed texts in which a feature must stand, the least factor by which it must be more frequent in
#: them, and how many standard errors below the estimate that factor is read.
LEAST_TEXTS, LEAST_LIFT, SURE = 3, 2.0, 2.5
#: Words that a worker remembers; when full, it starts anew.
REMEMBERED = 150_000


def word_slots(word: bytes) -> list[int]:
    return [xxhash.xxh32_intdigest(x) % SLOTS for x in (word, *(b"^" + word[:k] for k in BEGINNINGS if len(word) > k))]


def distinct_words(text: str | None) -> set[bytes]:
    """Words of a text: A-Z lower-cased; ASCII letters, digits, anything beyond ASCII.  Long texts go in steps."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    found, at = set(), 0
    while at < len(data):
        end = len(data) if len(data) - at <= STEP_BYTES else data.find(b" ", at + STEP_BYTES)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


class Slots:
    """The distinct slots of texts, of all slots or only of those with a weight."""

    def __init__(self, only: np.ndarray | None = None):
        self.only, self.known = only, {}

    def word(self, word: bytes) -> tuple[int, ...]:
        own = self.known.get(word)
        if own is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            own = tuple(s for s in word_slots(word) if self.only is None or self.only[s])
            self.known[word] = own
        return own

    def text(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        for w in distinct_words(text):
            if own := self.word(w):
                found.update(own)
        return np.fromiter(sorted(found), np.int32, len(found))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability that each row is toxic; an empty row has the bias alone."""
        f = np.array([self.weights[r].sum() for r in rows], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Patterns:
    """Rows of features, positions among those with a weight, each with the number of times that it stands."""

    def __init__(self, rows: list[np.ndarray], times: np.ndarray, size: int):
        self.size, self.times, self.n = size, times, float(times.sum())
        self.index = np.concatenate([*rows, np.zeros(0, np.int32)])
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def spread(self, each: np.ndarray) -> np.ndarray:
        """A number for each row, added up at the row's features and, last, over all rows."""
        return np.concatenate([np.bincount(self.index, weights=each[self.row], minlength=self.size), [each.sum()]])

    def sums(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """(sum of the loss of each row if it were clean, that sum's gradient)."""
        f = np.bincount(self.row, weights=w[self.index], minlength=len(self.times)) + w[-1]
        return float((self.times * np.logaddexp(0, f)).sum()), self.spread(self.times * sigmoid(f))


class RemotePatterns:
    """:class:`Patterns` that stay where they are: a table (pattern, times)."""

    def __init__(self, table: DataFrame, n: int, size: int):
        self.table, self.n, self.size = table, float(n), size

    def sums(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        size = self.size

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                loss, gradient = Patterns(unpacked(batch["pattern"]), batch["times"].to_numpy(float), size).sums(w)
                yield pd.DataFrame({"at": np.arange(size + 2), "part": [*gradient, loss]})

        added = self.table.mapInPandas(part, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).toArrow()
        out = np.zeros(size + 2)
        out[added.column("at").to_numpy()] = added.column("part").to_numpy()
        return float(out[-1]), out[:-1]


def unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in column]


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """:func:`descend` over rows of slots, features chosen by counts in these rows.  Without rows every score is near zero."""
    if not positive or not unlabelled:
        return Model(np.zeros(SLOTS), -10.0)
    used = np.flatnonzero(frequent(slot_counts(positive), len(positive), slot_counts(unlabelled), len(unlabelled), SURE))
    of = lambda rows: Patterns([at_of(used, r) for r in rows], np.ones(len(rows)), len(used))
    return descend(of(positive), of(unlabelled), prior, used)


def at_of(used: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Positions in ``used`` of those slots that are in it; both sorted."""
    at = np.searchsorted(used, slots)
    return at[(at < len(used)) & (used[np.minimum(at, len(used) - 1)] == slots)].astype(np.int32) if len(used) else np.zeros(0, np.int32)


def descend(positive: Patterns, unlabelled: Patterns | RemotePatterns, prior: float, used: np.ndarray) -> Model:
    """Minimises the non-negative risk of the logistic loss by Adam over all rows; ``used``: the slots of the positions."""
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = -2.0
    own = positive.spread(positive.times)  # the loss of a row as toxic is the one as clean less its sum of weights
    for t in range(1, ROUNDS + 1):
        loss_p, s_p = positive.sums(w)
        loss_u, s_u = unlabelled.sums(w)
        negative = loss_u / unlabelled.n - prior * loss_p / positive.n
        if negative >= 0:
            g = prior * (s_p - own) / positive.n - prior * s_p / positive.n + s_u / unlabelled.n
        else:  # the negative part went below zero: step back out of it
            g = prior * s_p / positive.n - s_u / unlabelled.n
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(SLOTS)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]))


GRID = 1 << 40


def low(name: Column, share: float) -> Column:
    """True for about this share of names, by their hash."""
    return F.pmod(F.xxhash64(name, F.lit(7)), F.lit(GRID)) < int(GRID * min(1.0, share))


def sample(rows: DataFrame, most_bytes: int = SAMPLE_BYTES) -> list[np.ndarray]:
    """Slots of the rows (``doc_id``, ``text``), each (doc_id, text) once, in the order of a hash.

    Rows are taken while their slots fit ``most_bytes``; the rows behind them are left out, so that a few
    very long texts can't fill the driver.
    """

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        slots = Slots()
        return pd.Series([slots.text(t).tobytes() for t in texts])

    name = F.xxhash64("doc_id", "text")
    each = written(rows.groupBy(name.alias("name")).agg(F.first("text").alias("text")).select("name", packed(F.col("text")).alias("slots")), "sampled")
    sizes = each.select("name", F.octet_length("slots").alias("bytes"))
    order = Window.orderBy(F.xxhash64("name"), "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = sizes.withColumn("upto", F.sum("bytes").over(order)).where(F.col("upto") <= most_bytes)  # at most some thousand rows
    found = each.join(F.broadcast(kept.select("name")), "name").select("slots").toArrow().column("slots")
    return [np.frombuffer(x.as_buffer(), np.int32) for x in found]


def slots_in(rows: DataFrame, only: np.ndarray) -> DataFrame:
    """(slots) of each row (``text``): those of the slots ``only`` (a mask) that stand in it, packed."""
    used = np.flatnonzero(only).astype(np.int32)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.zeros(SLOTS, bool)
        wanted[used] = True
        slots = Slots(wanted)
        for batch in batches:
            yield pd.DataFrame({"slots": [slots.text(t).tobytes() for t in batch["text"]]})

    return rows.select("text").mapInPandas(packed, "slots binary")


def count_slots(rows: DataFrame) -> np.ndarray:
    """In how many of the rows (``slots``, packed) each slot stands."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times = np.zeros(SLOTS, np.int64)
        for batch in batches:
            times += np.bincount(np.frombuffer(b"".join(batch["slots"]), np.int32), minlength=SLOTS)
        some = np.flatnonzero(times)
        yield pd.DataFrame({"slot": some, "times": times[some]})

    out = np.zeros(SLOTS, np.int64)
    found = rows.mapInPandas(count, "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    out[found.column("slot").to_numpy()] = found.column("times").to_numpy()
    return out


def patterns(rows: DataFrame, used: np.ndarray) -> DataFrame:
    """(pattern, times): the distinct sets of features with a weight, as positions in ``used``, and how many rows have each."""

    def restricted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"pattern": [at_of(used, s).tobytes() for s in unpacked(batch["slots"])]})

    return rows.mapInPandas(restricted, "pattern binary").groupBy("pattern").agg(F.count("*").alias("times"))


def frequent(of_p: np.ndarray, n_p: int, of_u: np.ndarray, n_u: int, sure: float) -> np.ndarray:
    """Slots that are ``LEAST_LIFT`` times as frequent in the confirmed texts, ``sure`` standard errors below the estimate."""
    out = of_p >= LEAST_TEXTS
    of_p, of_u = of_p[out], of_u[out]
    lift = np.log((of_p + 0.5) / (n_p + 1)) - np.log((of_u + 0.5) / (n_u + 1)) - sure * np.sqrt(1 / (of_p + 0.5) + 1 / (of_u + 0.5))
    out[out] = lift > np.log(LEAST_LIFT)
    return out


def slot_counts(rows: list[np.ndarray]) -> np.ndarray:
    """In how many of the rows each slot stands."""
    out = np.zeros(SLOTS, np.int64)
    for r in rows:
        out[r] += 1
    return out


def fit(
    documents: DataFrame, labels: DataFrame, trains: Column, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", positives: int | None = None
) -> Model:
    """The classifier from the documents for which ``trains`` (over ``doc_id``) holds.

    Confirmed toxic: label 1, about ``positives`` rows at most (else ``POSITIVES``), chosen by hash, and no more
    than their features fill ``SAMPLE_BYTES``.  Unlabelled: every document, repeated ones as often as they stand.
    The class prior is the share of label 1 among the labelled documents.  A document with several labels is
    toxic if one of them is 1; a confirmed (id, text) that repeats is taken once.  Null ids and labels are left
    out of training, null texts are empty.  Only the confirmed documents' texts are shuffled.
    """
    positives = positives or POSITIVES
    own = documents.select(quoted(id_column).alias("doc_id"), quoted(text_column).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & trains)
    known = labels.select(quoted(id_column).alias("doc_id"), quoted(label_column).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & trains)
    known = written(known.groupBy("doc_id").agg(F.max("label").alias("label")), "known-labels")
    counts = known.agg(F.count("*"), F.count(F.when(F.col("label") == 1, 1))).first()
    prior = counts[1] / counts[0] if counts[0] else 0.0
    toxic = known.where((F.col("label") == 1) & low(F.col("doc_id"), positives / max(1, counts[1]))).select("doc_id")
    positive = sample(own.join(F.broadcast(toxic), "doc_id", "left_semi"))  # about `positives` ids
    if not positive:
        return train([], [], prior)
    of_p = slot_counts(positive)
    rows = written(slots_in(own, of_p >= LEAST_TEXTS), "text-slots")
    n = rows.count()
    used = np.flatnonzero(frequent(of_p, len(positive), count_slots(rows), n, SURE))
    sets = written(patterns(rows, used), "feature-sets")
    size = sets.agg(F.sum(F.octet_length("pattern") + 8)).first()[0] or 0
    if size <= PATTERN_BYTES:
        held = sets.toArrow()
        unlabelled = Patterns(unpacked(x.as_buffer() for x in held.column("pattern")), held.column("times").to_numpy().astype(float), len(used))
    else:
        unlabelled = RemotePatterns(sets, n, len(used))
    return descend(Patterns([at_of(used, r) for r in positive], np.ones(len(positive)), len(used)), unlabelled, prior, used)


def learns(ident: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 3, is not 1; a null id has no such remainder."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def toxicity(text: Column, model: Model) -> Column:
    """Score (0 to 1) of a string column; null and empty texts have the score of no words."""
    used = np.flatnonzero(model.weights).astype(np.int32)
    values, bias = model.weights[used], model.bias

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, only = np.zeros(SLOTS), np.zeros(SLOTS, bool)
        weights[used], only[used] = values, True
        held, slots = Model(weights, bias), Slots(only)
        for batch in batches:
            yield pd.Series(held.score([slots.text(t) for t in batch]))

    return score(text.cast("string"))


def score_documents(documents: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **how) -> Column:
    """The score as a column for ``documents``, its model learnt from the rows that :func:`learns` allows."""
    return toxicity(quoted(text_column), fit(documents, labels, learns(F.col("doc_id")), id_column=id_column, text_column=text_column, **how))


def remove_toxic(documents: DataFrame, labels: DataFrame, *, least: float = 0.7, **how) -> DataFrame:
    """``documents`` without those that score ``least`` or more, columns and other rows as they were."""
    return documents.where(score_documents(documents, labels, **how) < least)

"""Benchmark decontamination with suffix arrays over the training text.

Each executor takes the documents it reads in shards of a few megabytes.  A shard's words become
integers of the benchmark's vocabulary, and a sorted array of the suffixes that can start a match
(every one whose first words all are benchmark words) is its suffix array.  Every benchmark suffix of
``window`` words is looked up by binary search; the range found holds all its places.  Hits on
neighbouring places join into the longest verbatim matches.

A benchmark goes to the executors in blocks of about ``BLOCK_BYTES``, one after another: the driver and a
worker hold one block at a time, and each block is a pass over the documents.  With one block no row is
shuffled; with several, what the passes find is joined to the documents by their texts' hashes.
"""

from __future__ import annotations

import hashlib
import string
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, fresh, quoted, small, written

#: Words: runs of ASCII letters, digits and anything beyond ASCII, after A-Z became a-z.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
BLOCK_BYTES = 4 << 20
#: Words of texts that one suffix array holds, and hits that one step of a search gathers.
STEP_WORDS, STEP_HITS = 1 << 19, 1 << 20
#: Texts with hits, of several blocks, whose matches are broadcast at most; more are joined by shuffle.
MOST_HITS = 100_000
HIGH = np.iinfo(np.int32).max
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = "n_words long, n_hit long, item_ids array<string>, matches array<struct<item:string,start:long,item_start:long,words:long>>"


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Patterns:
    """The benchmark's suffixes, cut to ``window`` words, as sorted rows of word numbers."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window, self.vocabulary = window, {}
        rows, owner, offset, self.items = [], [], [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            for j in range(max(1, len(ids) - window + 1)):
                rows.append(ids[j : j + window])
                owner.append(len(self.items))
                offset.append(j)
            self.items.append(name)
        self.length = np.array([len(r) for r in rows], np.int64)
        self.owner, self.offset = np.array(owner, np.int64), np.array(offset, np.int64)
        self.low = np.full((len(rows), window), -1, np.int32)
        for i, r in enumerate(rows):
            self.low[i, : len(r)] = r
        self.high = np.where(self.low < 0, HIGH, self.low)
        self.shortest = int(self.length.min()) if rows else 0

    def number(self, text: str | None) -> np.ndarray:
        """The text's words as numbers, 0 for words that no item has; long texts are cut up between words."""
        data = b"" if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_BYTES)
        parts, at = [], 0
        while at < len(data):
            end = len(data) if len(data) - at <= STEP_BYTES else data.find(b" ", at + STEP_BYTES)
            end = len(data) if end < 0 else end
            words = data[at:end].split()
            parts.append(np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int32, len(words)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def suffix_array(self, tokens: np.ndarray) -> np.ndarray:
        """Sorted starts of the suffixes whose first ``shortest`` words all are benchmark words.

        ``tokens`` ends in ``window`` zeros.
        """
        zero = np.flatnonzero(tokens == 0)
        starts = np.flatnonzero(tokens)
        run = zero[np.searchsorted(zero, starts)] - starts
        starts = starts[run >= self.shortest]
        keys = self.rows(tokens, starts)
        return starts[np.lexsort(keys.T[::-1])]

    def rows(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return tokens[starts[:, None] + np.arange(self.window)]

    def search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the range of suffixes that begin with it, by binary search."""
        return self._bound(keys, self.low, False), self._bound(keys, self.high, True)

    def _bound(self, keys: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
        every = np.arange(len(wanted))
        while (low < high).any():
            middle = np.minimum((low + high) // 2, len(keys) - 1)
            at = keys[middle]
            first = (at != wanted).argmax(axis=1)
            ours, theirs = at[every, first], wanted[every, first]
            less = ((ours < theirs) | (after & (ours == theirs))) & (low < high)
            high = np.where((low < high) & ~less, middle, high)
            low = np.where(less, middle + 1, low)
        return low

    def places(self, pieces: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """Runs of hits in pieces of texts (text, offset, word numbers): rows of text, item, diagonal, first place, last place, end."""
        gap, none = np.zeros(self.window, np.int32), np.zeros((0, 6), np.int64)
        tokens = np.concatenate([x for _, _, n in pieces for x in (n, gap)])
        begins = np.cumsum([0, *[len(n) + self.window for _, _, n in pieces]])[:-1]
        suffixes = self.suffix_array(tokens)
        if not len(suffixes):
            return none
        lows, highs = self.search(self.rows(tokens, suffixes))
        counts, out, at = highs - lows, [none], 0
        total = np.cumsum(counts)
        while at < len(counts):  # some patterns at a time
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_HITS, side="right")))
            n = counts[at:end]
            pattern = np.repeat(np.arange(at, end), n)
            place = suffixes[np.repeat(lows[at:end] - (np.cumsum(n) - n), n) + np.arange(len(pattern))]
            piece = np.searchsorted(begins, place, side="right") - 1
            place = place - begins[piece] + np.array([o for _, o, _ in pieces], np.int64)[piece]
            text = np.array([t for t, _, _ in pieces], np.int64)[piece]
            out.append(runs(np.stack([text, self.owner[pattern], place - self.offset[pattern], place, place, place + self.length[pattern]], axis=1)))
            at = end
        return runs(np.concatenate(out))

    def scan(self, texts: list[str | None]) -> list[dict]:
        """Per text: number of words, covered word intervals, and the longest matches.

        Texts go in pieces of ``STEP_WORDS`` words at most, each with the next ``window`` - 1 words, so that
        memory doesn't grow with a text's length but for its word numbers.
        """
        numbers = [self.number(t) for t in texts]
        found = [{"n_words": len(x), "cover": np.zeros((0, 2), np.int64), "matches": []} for x in numbers]
        if not len(self.length):
            return found
        every, some, size = [np.zeros((0, 6), np.int64)], [], 0
        for t, own in enumerate(numbers):
            for at in range(0, len(own), STEP_WORDS):
                piece = own[at : at + STEP_WORDS + self.window - 1]
                if some and size + len(piece) > STEP_WORDS:
                    every.append(self.places(some))
                    some, size = [], 0
                some.append((t, at, piece))
                size += len(piece)
        if some:
            every.append(self.places(some))
        for t, item, diagonal, first, _, end in runs(np.concatenate(every)).tolist():
            found[t]["matches"].append((self.items[item], first, first - diagonal, end - first))
        for f in found:
            if f["matches"]:
                f["cover"] = np.array([(a, a + n) for _, a, _, n in f["matches"]], np.int64)
        return found


def runs(rows: np.ndarray) -> np.ndarray:
    """Rows of text, item, diagonal, first, last, end: those of one diagonal that touch or repeat become one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1) | (rows[1:, 3] > rows[:-1, 4] + 1)
    first = np.flatnonzero(new)
    return np.column_stack([rows[first, :4], np.maximum.reduceat(rows[:, 4:], first)])


def covered(parts: np.ndarray) -> int:
    """Number of words in a union of intervals."""
    if not len(parts):
        return 0
    parts = parts[np.argsort(parts[:, 0], kind="stable")]
    before = np.maximum.accumulate(np.concatenate([[0], parts[:-1, 1]]))
    return int(np.maximum(0, parts[:, 1] - np.maximum(parts[:, 0], before)).sum())


def shards(texts: pd.Series) -> Iterator[list[str | None]]:
    """The batch in lists of at most ``STEP_BYTES`` characters; a longer text is a list of its own."""
    some, size = [], 0
    for t in texts:
        n = 0 if t is None else len(t)
        if some and size + n > STEP_BYTES:
            yield some
            some, size = [], 0
        some.append(t)
        size += n
    if some:
        yield some


#: What this worker holds of the last block it met: its name and its patterns.
_held: tuple[str, Patterns] | None = None


def patterns_of(name: str, block, window: int) -> Patterns:
    """The patterns of a broadcast block, built once in a worker however many tasks it runs."""
    global _held
    if _held is None or _held[0] != name:
        _held = None  # the old ones go before the new ones come
        _held = (name, Patterns(block.value, window))
    return _held[1]


def match_benchmark(
    documents: DataFrame, benchmark: DataFrame, *, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = 13, into: str = "decontamination"
) -> DataFrame:
    """``documents`` with a struct column ``into`` (it must be a new name) of type ``RESULT``.

    ``n_words``; ``n_hit``, the words inside any occurrence of a window of ``window`` consecutive item
    words (a shorter item is one window); ``item_ids``, sorted distinct items that occur; ``matches``, the
    longest verbatim matches with their first word in the document and in the item.

    Null and empty texts have no words and no match; texts of any length are taken whole.  Null or wordless
    items never match; a null ``item_id`` counts as the name ``""``.  Equal items each count.  Every row
    stays, repeated ones too, and so does every other column; an empty benchmark matches nothing.
    """
    if into.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"{into} is a column already")
    spark, text = documents.sparkSession, quoted(text_column).cast("string")
    item = benchmark.select(F.coalesce(quoted(item_column).cast("string"), F.lit("")).alias("item"), quoted(item_text_column).cast("string").alias("text")).where(F.col("text").isNotNull())
    n = 1 + (item.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES

    def broadcast(i: int):
        return spark.sparkContext.broadcast([(r[0], r[1]) for r in item.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()])

    def scanner(block):
        name = uuid.uuid4().hex

        @F.pandas_udf(RESULT)
        def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            patterns = patterns_of(name, block, window)
            for batch in batches:
                rows = []
                for some in shards(batch):
                    for x in patterns.scan(some):
                        matches = sorted(x["matches"])
                        rows.append((x["n_words"], covered(x["cover"]), sorted({m[0] for m in matches}), [dict(zip(("item", "start", "item_start", "words"), m, strict=True)) for m in matches]))
                yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "matches"])

        return scan

    if n == 1:
        return documents.withColumn(into, scanner(broadcast(0))(text))
    passes = []
    for i in range(n):
        block = broadcast(i)
        hits = documents.select(F.xxhash64(text).alias("text_hash"), scanner(block)(text)["matches"].alias("matches")).where(F.size("matches") > 0)
        passes.append(written(hits.groupBy("text_hash").agg(F.first("matches").alias("matches")), "matches"))
        block.destroy()

    @F.pandas_udf("long")
    def hit_words(starts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([covered(np.column_stack([a, np.add(a, b)])) for a, b in zip(starts, lengths, strict=True)])

    names = fresh(documents, "hash", "matches", "hit")
    n_hash, n_matches, n_hit = names
    every = reduce(DataFrame.unionByName, passes).groupBy(F.col("text_hash").alias(n_hash)).agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias(n_matches))
    part = lambda c: F.transform(F.col(n_matches), lambda m: m[c])
    every = written(every.withColumn(n_hit, hit_words(part("start"), part("words"))), "all-matches")
    words = F.coalesce(F.regexp_count(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD)), F.lit(0)).cast("long")
    none = F.array().cast("array<struct<item:string,start:long,item_start:long,words:long>>")
    found = F.struct(
        words.alias("n_words"), F.coalesce(F.col(n_hit), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(part("item"))), F.array().cast("array<string>")).alias("item_ids"), F.coalesce(F.col(n_matches), none).alias("matches"),
    )
    joined = documents.withColumn(n_hash, F.xxhash64(text)).join(small(every, MOST_HITS), n_hash, "left")
    return joined.select(*map(quoted, documents.columns), found.alias(into))


def contaminated(n_hit, n_words, share: int = 20):
    """The rule: some word is hit, and at least one word in ``share`` is."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``documents`` without the contaminated ones, columns and other rows as they were."""
    (into,) = fresh(documents, "found")
    found = match_benchmark(documents, benchmark, into=into, **how)
    return found.where(~contaminated(F.col(f"{into}.n_hit"), F.col(f"{into}.n_words"))).drop(into)


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


#: The query's rows in DuckDB's SQL.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT row_number() OVER () AS row, doc_id, w FROM words),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS g FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT row, p, h.n, item_id FROM (SELECT row, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM places) h JOIN windows USING (n, g)),
covered AS (SELECT row, count(DISTINCT x) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS x FROM hits) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

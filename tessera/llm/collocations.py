"""Phrases whose words stand together more often than their parts alone would have it.

Every 1- to ``max_n``-gram of every piece becomes a row, rows are counted by language in one hash
aggregate, and what occurs often enough is written once; scores, extensions and ranks read only that table.
The rows are made in Arrow batches: the words of some megabytes of text become numbers of a dictionary,
n-grams numbers of pairs, and a row comes out for each distinct n-gram with its count there.

Defined results: a null or empty text, and one of separators only, has no words; a null language is
``und``; words keep every character but A-Z, which become small; repeated rows count as often as they
stand; equal scores rank by count, then by the phrase's UTF-8 bytes; an empty table gives no rows; other
columns, whatever their names, are not read.  A longer text than ``WINDOW`` bytes goes in slices.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written

PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \x09"

#: Bytes of text whose n-grams are counted together before they become rows.
WINDOW = 8 << 20

#: The row that counts all words of a language, a phrase no text has.
ALL = ""

#: Rows of an Arrow batch that goes back to Spark.
BATCH = 256

#: An odd number that spreads the checksums of words over 64 bits.
MIX = np.uint64(0x9E3779B97F4A7C15)

KIND = np.zeros(256, np.uint8)  # of a byte: 0 in a word, 1 blank, 2 end of a piece
KIND[list(BLANKS)], KIND[list(PIECE_ENDS)] = 1, 2


def words_of(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text, A-Z small, and the number of the piece that each stands in."""
    raw = np.frombuffer(data.lower(), np.uint8)
    kind = KIND[raw]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]), piece


def count_grams(data: bytes, max_n: int, context: int = 0) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(n-grams, their counts, their marks) for each n up to ``max_n``; those that end in the first ``context`` words don't count.

    The n-grams of three words and more that begin with the same n - 1 words have the same mark.
    """
    words, piece = words_of(data)
    if len(words) <= context:
        return
    coded = words.dictionary_encode()
    own, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    marks = np.fromiter(map(crc32, names.to_pylist()), np.uint64, len(names))
    base, codes, seen = len(names), own, {}
    for n in range(1, max_n + 1):
        if n > len(own):
            return
        if n > 1:
            if base ** min(n, 64) >= 1 << 62 and int(codes.max()) >= (1 << 62) // base:  # too many for the number: code what there is anew
                seen[n], codes = np.unique(codes, return_inverse=True)
            codes = codes[:-1] * base + own[n - 1 :]
        here = piece[: len(codes)] == piece[n - 1 :]
        here[: max(0, context - n + 1)] = False
        values, counts = np.unique(codes[here], return_counts=True)
        parts = []
        for m in range(n, 1, -1):
            values, last = np.divmod(values, base)
            parts.append(last)
            values = seen[m][values] if m in seen else values
        parts.append(values)
        mark = np.zeros(len(values), np.uint64)
        for part in parts[: 0 if n > 2 else None : -1]:
            mark = (mark ^ marks[part]) * MIX
        columns = [names.take(pa.array(part)) for part in parts[::-1]]
        yield pc.binary_join_element_wise(*columns, b" ") if n > 1 else columns[0], counts, mark


def slices(data: bytes, max_n: int) -> Iterator[tuple[bytes, int]]:
    """A long text in slices that end between words, each after the last words of the piece that the cut is in, and how many those are."""
    at, before = 0, b""
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            near = data[at:end].translate(SEPARATED)
            end = at + cut + 1 if (cut := near.rfind(b" ")) >= 0 else next((i for i in range(end, len(data)) if KIND[data[i]]), len(data))
        own = before + data[at:end]
        yield own, len(before.split())
        piece = own[max(own.rfind(e) for e in (PIECE_ENDS[i : i + 1] for i in range(len(PIECE_ENDS)))) + 1 :]
        before = b"".join(w + b" " for w in piece.rsplit(None, max_n - 1)[-(max_n - 1) :])
        at = end


SEPARATED = bytes(32 if k else b for b, k in enumerate(KIND))  # every separator a space


def counter(max_n: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(lang: str, data: bytes, context: int = 0) -> Iterator[pa.RecordBatch]:
        for n, (grams, counts, mark) in enumerate(count_grams(data, max_n, context), 1):
            if n == 1:
                yield pa.record_batch([[lang], pa.array([0], pa.int32()), [ALL.encode()], pa.array([[counts.sum()]], pa.list_(pa.int32()))], names)
            bucket = (mark >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            ends = np.append(first, len(order)).astype(np.int32)
            for at in range(0, len(found), BATCH):
                own = slice(ends[at], ends[min(at + BATCH, len(found))])
                cut = pa.array(ends[at : at + BATCH + 1] - ends[at], pa.int32())
                phrases = pc.binary_join(pa.ListArray.from_arrays(cut, grams.take(pa.array(order[own]))), b"\n")
                yield pa.record_batch([pa.repeat(pa.scalar(lang), len(phrases)), pa.array(found[at : at + BATCH].astype(np.int32)), phrases, pa.ListArray.from_arrays(cut, pa.array(counts[order[own]].astype(np.int32)))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, data = lang.as_py(), text.as_py()
                if data and len(data) > WINDOW:
                    for own, context in slices(data, max_n):
                        yield from rows(lang, own, context)
                elif data:
                    held[lang].append(data)
                    size += len(data)
                if size > WINDOW:
                    for k in list(held):
                        yield from rows(k, b"\n".join(held.pop(k)))
                    size = 0
        for k in list(held):
            yield from rows(k, b"\n".join(held.pop(k)))

    names = ["lang", "bucket", "phrases", "counts"]
    return run


def phrase_counts(documents: DataFrame, max_n: int = 3, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, f): occurrences of every 1- to ``max_n``-gram; phrase ``ALL`` has the number of all words."""
    rows = documents.select(F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("lang"), quoted(text).cast("string").cast("binary").alias("text"))
    buckets = max(1024, 16 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Windows have combined what they could.  Their n-grams go through the shuffle in buckets, a row each, and
    # those of three words and more lie beside the ones that begin alike, which takes half the room of a row each.
    packed = rows.mapInArrow(counter(max_n, buckets), "lang string, bucket int, phrases binary, counts array<int>").repartition("lang", "bucket")
    phrases = F.split(F.col("phrases").cast("string"), "\n", -1)
    each = packed.select("lang", "bucket", "counts", F.posexplode(phrases).alias("at", "phrase"))
    return each.groupBy("lang", "bucket", "phrase").agg(F.sum(F.get("counts", F.col("at"))).alias("f")).drop("bucket")


def scored(counts: DataFrame, max_n: int) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the phrases of two words or more in ``counts``: the cut that scores least.

    Both parts of a phrase occur at least as often as it does, so they are in the table too.  Products are
    decimals, the quotient is cut to a whole number.
    """
    words = F.split("phrase", " ", -1)
    sized = counts.withColumn("size", F.size(words)).where(F.col("size") <= max_n)
    candidates = sized.where("size > 1").withColumnRenamed("f", "a")
    cut = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("left"), F.array_join(F.slice(words, k + 1, F.col("size")), " ").alias("right")))
    parts = candidates.select("lang", "phrase", "size", "a", F.inline(cut))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    met = parts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    exact = lambda c: f"cast({c} as decimal(16, 0))"
    score = F.expr(f"cast(1000000 as decimal(7, 0)) * ({exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    best = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "size")).alias("m"))
    return best.select("lang", "phrase", "m.size", "m.a", "m.l", "m.r", "m.score")


def unextended(found: DataFrame, percent: int) -> DataFrame:
    """``found`` without phrases of which a longer one in it makes up ``percent`` per cent or more.

    A longer phrase occurs no more often than what it holds, so one-word extensions decide for all.
    """
    words = F.split("phrase", " ", -1)
    longer = found.where("size > 2").select("lang", F.col("a").alias("f"), F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size")), " "))).alias("phrase"))
    widest = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    extended = found.join(widest, ["lang", "phrase"]).where(100 * F.col("f") >= percent * F.col("a")).select("lang", "phrase")
    return found.join(extended, ["lang", "phrase"], "left_anti")


def collocations(documents: DataFrame, max_n: int = 3, least: int = 10, percent: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``max_n`` words.

    a: occurrences, ``least`` or more; l, r: those of the two parts at the lowest-scoring cut; n: all words
    of the language; score: a * a / (l * r) in millionths, cut.
    """
    if max_n < 2 or least < 1:
        raise ValueError("a phrase has two words or more and occurs")
    counts = written(phrase_counts(documents, max_n, text, lang).where((F.col("f") >= least) | (F.col("phrase") == ALL)), "phrase-counts")
    found = written(scored(counts.where(F.col("phrase") != ALL), max_n), "phrase-scores")
    totals = counts.where(F.col("phrase") == ALL).select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = unextended(found, percent).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, range(1, 4) t(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, j, array_to_string(string_split(c.phrase, ' ')[1:j], ' ') AS p, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') AS q
  FROM f c, range(1, 3) t(j) WHERE c.k > 1 AND j < c.k AND c.f >= 10
), met AS (
  SELECT cuts.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.p JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.q
), best AS (
  SELECT lang, k, phrase, a, l, r, score FROM met QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), wide AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[d:d + 1], ' ') AS phrase, max(a) AS f FROM best, range(1, 3) t(d) WHERE k = 3 GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN wide ON wide.lang = best.lang AND wide.phrase = best.phrase WHERE coalesce(100 * wide.f < 50 * a, true)
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

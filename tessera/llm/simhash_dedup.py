"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into segments of 32 bits.  Every fingerprint stands in one table row per segment
and asks each segment's table for the Hamming ball of radius ``ball`` (0 or 1) around its own value;
whatever is fetched is verified over all bits.  With ``m`` segments all pairs that differ in at most
``m (ball + 1) - 1`` bits meet.  Of a pair that differs in one bit of the segment only the side with
the 0 asks, which halves the balls and loses nothing.

Rows whose key no other row has leave before anything else is fetched.  The rest of a key's rows meet
in one task, sorted, and are compared in numpy in steps of bounded size.  A task hands on a spanning
star for each set of linked fingerprints, not their pairs.  Keys with more than ``BLOCK`` table rows
are dealt out as pairs of blocks over many tasks, so that none is cut or sampled.  Equal fingerprints
are one node from the start.

Where links are decided by the Jaccard similarity of shingle sets, a second table completes the first:
every set stands under its rarest shingles, so many that two sets of that similarity share one of them
(prefix filter).  Only keys that join different classes of the first table are compared.  Both tables
compare parities of the sets, and the sets themselves decide inside each class so connected.

Rows and nodes are told apart by 64-bit hashes: among 10^10 rows about two pairs share one by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_hubs, quoted, small, written

SEGMENT = 32
#: Table rows of one key that meet in one task; pairs that one numpy step compares.
BLOCK, STEP_PAIRS = 2048, 1 << 19
#: Shingle sets of one class that meet in one task, and bytes of theirs, in expectation at most.
SET_BLOCK, SET_BYTES = 512, 32 << 20
#: Rows of one or two longs that a join broadcasts at most (some 160 MB in memory); more are joined by shuffle.
SMALL = 4_000_000
#: Longs of a set's parity bits in one level; members of a level at most, in expectation; slack, in standard deviations.
PARITY, LEVEL, SLACK = 4, 128, 6.0
MARKS = 1 + 2 * PARITY
#: One in so many texts is counted to order the prefixes; counts that matter, and shingles that are kept.
#: The order decides the cost, never the result.
SAMPLE, LEAST_COUNT, COMMON = 16, 3, 100_000
#: Hashes whose bits are counted at once.
STEP_HASHES = 1 << 15
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SPACES = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words of the lower-cased (A-Z) text, repeats included.

    Words are runs of anything but space and U+0009-U+000D; a shingle is its words, space-joined.  A text
    of fewer words has the one shingle of all of them, a text without words none.
    """
    data = b"" if text is None else b" ".join(text.encode("utf-8", "surrogatepass").translate(SPACES).split())
    if not data:
        return np.zeros(0, np.uint64)
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
    starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])
    if len(starts) < words:
        return np.array([xxhash.xxh64_intdigest(data, seed)], np.uint64)
    starts, ends = starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(data[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash derived from each hash; the 0th is the hash itself."""
    for i in range(k):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(ODD[i % 3])
        hashes = hashes ^ (hashes >> np.uint64(32))
    return hashes


def simhash(hashes: np.ndarray, longs: int) -> list[int]:
    """Signed 64-bit parts: a bit is 1 if it is set in over half of the hashes."""
    out = []
    for k in range(longs):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), STEP_HASHES):
            part = mixed(hashes[at : at + STEP_HASHES], k)
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each distinct word of the lower-cased (A-Z) text."""
    words = set(() if text is None else text.encode("utf-8", "surrogatepass").translate(SPACES).split())
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def level_of(size: np.ndarray) -> np.ndarray:
    """The level at which about ``LEVEL`` members are left at most: level k keeps one hash in 2^k."""
    return np.ceil(np.log2(np.maximum(1, size / LEVEL))).astype(np.int64)


def set_marks(shingles: np.ndarray) -> list[int]:
    """Of a set: its size, ``PARITY`` signed longs of parities at its level, as many one level up, its hash.

    A level's parities tell of each slot whether it holds an odd number of the level's members, so two
    sets differ in at least as many of those as their parities differ in bits.
    """
    level, out = int(level_of(np.array([len(shingles)]))[0]), [len(shingles)]
    for k in (level, level + 1):
        own = shingles[(shingles >> np.uint64(64 - k)) == 0] if k else shingles
        odd = np.bincount((own % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
        out += np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()
    return [*out, int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))]


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The rarest members of a set, so many that any set of this similarity has one of them in its own prefix.

    Members go by their count (``times`` of the sorted ``common``, else 0), then by hash.  Similar sets
    share at least ``similarity`` of the larger one, so the first of what they share stands in both.
    """
    count = np.zeros(len(shingles), np.int64)
    if len(common):
        place = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        count = np.where(common[place] == shingles, times[place], 0)
    most = len(shingles) - math.ceil(similarity * len(shingles) - 1e-6) + 1
    return shingles[np.lexsort((shingles, count))[:most]]


def common_shingles(documents: DataFrame, text_column: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that stand in several texts of a sample by hash, and in how many."""

    @F.pandas_udf("array<long>")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts])

    text = quoted(text_column).cast("string")
    counts = documents.where(F.pmod(F.xxhash64(text, F.lit(7)), F.lit(SAMPLE)) == 0).select(F.explode(distinct(text)).alias("shingle")).groupBy("shingle").count()
    rows = counts.where(F.col("count") >= LEAST_COUNT).orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    found = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], rows.column("count").to_numpy()[order]


def fingerprint(
    text: Column, *, words: int, longs: int = 1, distinct_words: bool = False, similarity: float | None = None, common: tuple[np.ndarray, np.ndarray] | None = None
) -> Column:
    """Struct of ``bits`` (``longs`` parts), ``marks`` and ``prefix`` of a string column.

    Marks and prefix (in the order by ``common``) are of the set of shingles of ``words`` words; they are
    empty without ``similarity``.

    ``bits`` is over shingles of ``words`` words with their repeats, or with ``distinct_words`` over those.
    Null, empty and wordless texts have the bits zero.
    """

    @F.pandas_udf("bits array<long>, marks array<long>, prefix array<long>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                own = shingle_hashes(t, words)
                index = word_hashes(t) if distinct_words else own
                made = [simhash(index, longs), [], []]
                if similarity is not None:
                    own = np.unique(own)
                    made[1:] = set_marks(own), prefix(own, similarity, *common).view(np.int64)
                rows.append(made)
            yield pd.DataFrame(rows, columns=["bits", "marks", "prefix"])

    return parts(text.cast("string"))


def hex_of(parts: Column) -> Column:
    """The first part as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(parts[0]), 16, "0"))


def unpack(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), width).view(np.uint64)


def within(radius: int):
    """Compares rows of bits: at most ``radius`` differ."""

    def near(bits: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.bitwise_count(bits[left] ^ bits[right]).sum(1, dtype=np.int64) <= radius

    return near


def may_reach(similarity: float):
    """Compares marks of sets: false only where the sets can't have this Jaccard similarity.

    Up to ``LEVEL`` members that is certain.  Of larger sets a level is a random part, and the bound lies
    ``SLACK`` standard deviations above what similar sets may differ in: some 10^-9 of them fail it.
    """

    def near(marks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        size = marks[:, 0].astype(np.float64)
        level = level_of(size)
        a, b = size[left], size[right]
        out = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6
        left, right, some = left[out], right[out], np.flatnonzero(out)
        at = np.maximum(level[left], level[right])
        parity = marks[:, 1 : 1 + 2 * PARITY].reshape(-1, 2, PARITY)
        up = lambda side: np.minimum(at - level[side], 1)
        apart = np.bitwise_count(parity[left, up(left)] ^ parity[right, up(right)]).sum(1, dtype=np.int64)
        most = (1 - similarity) / (1 + similarity) * (a[out] + b[out]) / 2.0**at
        # Sets of one level share it; where the sizes are further apart they can't be similar at all.
        out[some] = apart <= most + (at > 0) * SLACK * (np.sqrt(most) + 1) + 1e-6
        return out

    return near


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the links reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        was = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == was).all():
            return root


def stars(table: pd.DataFrame, ball: pd.DataFrame, width: int, near_by, across: bool) -> Iterator[pd.DataFrame]:
    """Verified links of one run of whole keys: each node with the smallest of its set.

    ``across``: table rows are compared only if they are of different ``side``.  Rows of one ``root``, if
    they have that column, aren't compared.
    """
    both = pd.concat([table, ball], ignore_index=True)
    order = np.argsort(both["key"].to_numpy(), kind="stable")  # table rows first within a key
    key, node = both["key"].to_numpy()[order], both["node"].to_numpy()[order]
    bits = (unpack(both["bits"], width) if "bits" in both else both["node"].to_numpy().view(np.uint64)[:, None])[order]
    asked = np.concatenate([np.ones(len(table), bool), np.zeros(len(ball), bool)])[order]
    side = both["side"].to_numpy()[order] if across else None
    known = both["root"].to_numpy()[order] if "root" in both else None
    step = STEP_PAIRS * 8 // max(8, width)
    last = np.searchsorted(key, key, side="right")
    first = np.flatnonzero(asked)
    partners = last[first] - first - 1
    first, partners = first[partners > 0], partners[partners > 0]
    total, at = np.cumsum(partners), 0
    kept_left, kept_right = [], []
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, side="right")))
        count = partners[at:end]
        left = np.repeat(first[at:end], count)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        if known is not None:
            apart = known[left] != known[right]
            left, right = left[apart], right[apart]
        near = near_by(bits, left, right)
        if across:
            near &= ~asked[right] | (side[left] != side[right])
        left, right = left[near], right[near]
        if len(left):
            some, index = np.unique(np.concatenate([left, right]), return_inverse=True)
            root = roots(len(some), index[: len(left)], index[len(left) :])
            moved = np.flatnonzero(root != np.arange(len(some)))
            kept_left.append(some[root[moved]])
            kept_right.append(some[moved])
        at = end
    if kept_left:
        left, right = node[np.concatenate(kept_left)], node[np.concatenate(kept_right)]
        out = pd.DataFrame({"a": np.minimum(left, right), "b": np.maximum(left, right)})
        yield out[out["a"] != out["b"]].drop_duplicates()


def linker(width: int, near_by):
    """Turns rows sorted by (key, blocks, asks) into links; the rows of a key may run over several batches."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def done(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for across in (False, True):
                own = part[(part["i"] != part["j"]) == across]
                if len(own):
                    own = own.assign(key=np.unique(own[["key", "i", "j"]].astype("int64").to_numpy(), axis=0, return_inverse=True)[1].reshape(-1) if (own["j"] > 0).any() else own["key"])
                    yield from stars(own[~own["asks"]], own[own["asks"]], width, near_by, across)

        for batch in batches:
            held.append(batch)
            size += len(batch)
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
            name = rows[["key", "i", "j"]].to_numpy()
            same = (name == name[-1]).all(1)
            if same[0]:  # one key so far: balls go in steps, table rows (at most 2 BLOCK) stay
                if size > 8 * BLOCK:
                    fixed = rows[~rows["asks"]]
                    if len(fixed):
                        yield from done(rows)
                    held, size = [fixed], len(fixed)
                else:
                    held = [rows]
                continue
            cut = len(rows) - int(same[::-1].argmin())
            yield from done(rows.iloc[:cut])
            held, size = [rows.iloc[cut:]], len(rows) - cut
        if held and size:
            yield from done(pd.concat(held, ignore_index=True))

    return link


def dealt(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """``rows`` (key, node, asks ...) with side, i and j: (key, i, j) is what meets in one task.

    A key of over ``most`` table rows (``counts``: key, count) is cut into blocks by hash, and every pair
    of blocks is a meeting of its own, as is each block with all the balls.
    """
    hot = written(counts.where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("blocks")), "hot-keys")
    zero = F.lit(0)
    if hot.isEmpty():
        return rows.select("*", zero.alias("side"), zero.alias("i"), zero.alias("j"))
    side = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    every = F.sequence(zero, F.coalesce("blocks", F.lit(1)) - 1)
    place = F.when(F.col("asks"), F.transform(every, lambda x: F.struct(x.alias("i"), x.alias("j")))).otherwise(
        F.transform(every, lambda x: F.struct(F.least(x, F.col("side")).alias("i"), F.greatest(x, F.col("side")).alias("j")))
    )
    kept = [c for c in rows.columns if c != "key"]
    return rows.join(small(hot, SMALL), "key", "left").withColumn("side", side).select("key", *kept, "side", F.inline(place))


def links(nodes: DataFrame, *, longs: int, radius: int, ball: int = 1, similarity: float | None = None) -> DataFrame:
    """Links (a, b), a < b, that connect just what all pairs of near nodes connect.

    ``nodes``: node long (unique), bits array<long> of ``longs`` parts, with ``similarity`` also marks.
    Near: at most ``radius`` differing bits (a node of one part is its bits); with ``similarity`` instead
    whatever the marks can't exclude.  All pairs up to ``2 longs (ball + 1) - 1`` differing
    bits meet; farther ones if they come as close in one segment.
    """
    part = lambda k: (F.col("bits")[k].bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.col("bits")[k], SEGMENT))
    base = nodes.select("node", F.posexplode(F.array(*[x for k in range(longs) for x in part(k)])).alias("segment", "value"))
    key = (F.col("value") + F.shiftleft(F.col("segment").cast("long"), SEGMENT)).alias("key")
    table = base.select(key, "node")
    crowded = written(table.groupBy("key").count().where(F.col("count") > 1), "crowded-keys")
    asking, met = None, crowded.select("key")
    if ball:
        masks = F.explode(F.array(*[F.lit(1 << i).cast("long") for i in range(SEGMENT)])).alias("mask")
        flips = base.select("node", "segment", "value", masks).where(F.col("value").bitwiseAND(F.col("mask")) == 0)
        asking = flips.withColumn("value", F.col("value").bitwiseOR(F.col("mask"))).select(key, "node")
        asking = written(asking.join(table.select("key"), "key", "left_semi"), "asking")
        met = met.unionByName(asking.select("key"))
    rows = table.join(met, "key", "left_semi").withColumn("asks", F.lit(False))
    if asking is not None:
        rows = rows.unionByName(asking.withColumn("asks", F.lit(True)))
    width, near_by, column = (longs, within(radius), "bits") if similarity is None else (MARKS, may_reach(similarity), "marks")
    if width > 1:
        rows = rows.join(nodes.select("node", F.slice(column, 1, width).alias("bits")), "node")
    rows = dealt(rows, crowded, BLOCK)
    near = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "asks").mapInPandas(linker(width, near_by), "a long, b long")
    return near.distinct()


def prefix_links(nodes: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b), a < b, that with ``found`` connect all nodes whose sets have this Jaccard similarity.

    ``nodes``: node (unique), marks and prefix; ``found``: a written table (node, root) of what is connected
    already.  No pair is missed; what the marks can't exclude is linked without being similar.
    """
    placed = nodes.join(small(found, SMALL), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "prefix")
    rows = placed.select(F.explode("prefix").alias("key"), "node", "root")
    joins = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high"))
    joins = written(joins.select("key"), "joining-keys")
    rows = written(rows.join(small(joins, SMALL), "key", "left_semi"), "joining")
    counts = written(rows.groupBy("key").count(), "joining-counts")
    rows = rows.withColumn("asks", F.lit(False)).join(nodes.select("node", F.slice("marks", 1, MARKS).alias("bits")), "node")
    near = dealt(rows, counts, BLOCK).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return near.mapInPandas(linker(MARKS, may_reach(similarity)), "a long, b long").distinct()


def connect(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of sets (sorted distinct hashes) that, with equal ``label``, connect what all pairs of this Jaccard similarity connect.

    One set after another, the first one first, is compared with all of other labels, and whom it links
    it joins.  Once only members of the largest label are left, each other pair of labels was compared.
    """
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    values, row = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    label = np.unique(label, return_inverse=True)[1].reshape(-1)
    waits, left, right, x = np.ones(n, bool), [], [], 0 if n else -1
    while x >= 0:
        waits[x] = False
        low, high = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
        count = high - low
        found = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        common = np.bincount(row[found], minlength=n)
        near = np.flatnonzero((label != label[x]) & (common >= similarity * (size + size[x] - common) - 1e-6))
        if len(near):
            left.append(np.full(len(near), x))
            right.append(near)
            label[np.isin(label, label[near])] = label[x]
        rest = np.flatnonzero(waits & (label != np.bincount(label).argmax()))
        x = int(rest[0]) if len(rest) else -1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def set_linker(similarity: float):
    """Turns rows (key, i, j, later, node, label, shingles) sorted by (key, i, j, later) into links, one meeting at a time."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        left, right = connect([np.frombuffer(bytes(s), np.uint64) for s in rows["shingles"]], rows["label"].to_numpy(), similarity)
        node = rows["node"].to_numpy()
        a, b = node[left], node[right]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            name = batch[["key", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1
            for part in np.split(np.arange(len(batch)), cuts):
                rows = batch.iloc[part]
                if held and (held[-1][["key", "i", "j"]].iloc[0].to_numpy() != rows[["key", "i", "j"]].iloc[0].to_numpy()).any():
                    yield meet(pd.concat(held, ignore_index=True))
                    held = []
                held.append(rows)
        if held:
            yield meet(pd.concat(held, ignore_index=True))

    return link


def similar_links(documents: DataFrame, close: DataFrame, *, id_column: str, text_column: str, words: int, similarity: float) -> DataFrame:
    """A written table of links (a, b) that connect what the pairs of at least this Jaccard similarity inside the classes connect.

    ``documents`` has no (id, text) twice.  ``close``: a written table (node, root, doc, size), one document
    for each node; nodes of one root are a class.  First each class meets in blocks, the root in all of them.  What that leaves apart in a class
    of several blocks are few as a rule: those outside the class's largest part meet all its blocks.
    """

    @F.pandas_udf("binary")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(shingle_hashes(t, words)).tobytes() for t in batch])

    text = quoted(text_column).cast("string")
    texts = documents.select(F.xxhash64(quoted(id_column), text).alias("doc"), text.alias("text"))

    def met(rows: DataFrame) -> DataFrame:
        """``rows``: (key, i, j, later, node, label, doc)."""
        own = texts.join(small(written(rows, "meetings"), SMALL // 4), "doc").withColumn("shingles", shingles("text")).drop("doc", "text")
        return own.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "later").mapInPandas(set_linker(similarity), "a long, b long").distinct()

    parts = lambda n, size: F.greatest(F.ceil(n / SET_BLOCK), F.ceil(8 * size / SET_BYTES), F.lit(1)).cast("int")
    classes = written(close.groupBy(F.col("root").alias("key")).agg(parts(F.count("*"), F.sum("size")).alias("blocks")), "classes")
    rows = close.withColumnRenamed("root", "key").join(small(classes.where("blocks > 1"), SMALL), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    first, block = F.col("node") == F.col("key"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    inside = rows.select("key", F.explode(F.when(first, every(F.col("blocks"))).otherwise(F.array(block))).alias("i"), F.lit(0).alias("j"), (~first).alias("later"), "node", F.col("node").alias("label"), "doc")
    links = written(met(inside), "similar")
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return links
    part = components(links).withColumnRenamed("root", "label")
    large = written(large.withColumn("i", block).join(part, "node", "left").withColumn("label", F.coalesce("label", "node")), "large-classes")
    sizes = large.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    apart = written(large.join(small(written(most, "largest-parts"), SMALL), "key"), "apart")
    if apart.isEmpty():
        return links
    other = F.col("label") != F.col("most")
    counts = written(apart.groupBy("key").agg(parts(F.count_if(other), F.sum(F.when(other, F.col("size")).otherwise(0))).alias("others")), "others")
    apart = apart.join(small(counts, SMALL), "key").withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), F.col("others")).cast("int"))
    column = ["key", "i", "j", F.lit(True).alias("later"), "node", "label", "doc"]
    across = apart.drop("j").withColumn("j", F.explode(every(F.col("others")))).select(*column)
    asking = apart.where(other).drop("i").withColumn("i", F.explode(every(F.col("blocks")))).select(*column)
    return links.unionByName(written(met(across.unionByName(asking)), "similar"))


def with_low(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (a, b) with low: the smallest of the other column and ``key`` among the rows of one ``key``."""
    other = "b" if key == "a" else "a"
    low = rows.groupBy(key).agg(F.least(F.min(other), F.col(key)).alias("low"), F.count("*").alias("n"))
    return join_hubs(rows, written(low, "lows"), key, SMALL)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the smallest node it is connected with.

    Large-star and small-star steps in turn until all links are stars, whose centre is their smallest node; a
    few tables of the size of the links go to the shared folder.
    """
    edges = written(edges.select("a", "b"), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_low(both, "a").where((F.col("b") > F.col("a")) & (F.col("low") != F.col("b"))).select(F.col("low").alias("a"), "b").distinct()
        large = written(large, "links")
        star = with_low(large, "b").select(F.col("low").alias("a"), F.when(F.col("a") == F.col("low"), F.col("b")).otherwise(F.col("a")).alias("b"))
        edges = written(star.distinct(), "links")
        ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("low")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("low")))
        bent = ends.groupBy("node").agg(F.sum("low").alias("n"), F.min("low").alias("low")).where((F.col("n") > 1) | (F.col("n") == 1) & (F.col("low") == 0))
        if bent.isEmpty():  # nobody has two centres, no centre has one itself
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def once(documents: DataFrame, doc: Column, repeated: DataFrame) -> DataFrame:
    """``documents`` with one row of each value of ``doc``; ``repeated``: a written table of those that have several."""
    if repeated.isEmpty():
        return documents
    (own,) = fresh(documents, "own")
    repeated, tagged = small(repeated.toDF(own), SMALL), documents.withColumn(own, doc)
    kept = tagged.join(repeated, own, "left_anti").unionByName(tagged.join(repeated, own, "left_semi").dropDuplicates([own]))
    return kept.select(*map(quoted, documents.columns))


def near_duplicates(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 3, longs: int = 1, radius: int = 3, ball: int = 1, distinct_words: bool = False, similarity: float | None = None
) -> DataFrame:
    """One row per document: id, doc (a hash of id and text), bits, component, component_id (the smallest id in reach).

    Documents link at ``radius`` or fewer differing bits of their fingerprints over shingles of ``words``
    words.  With ``similarity`` equal sets of shingles are one node, and the links are just the pairs of at
    least that Jaccard similarity of the sets of shingles of ``words`` words: the fingerprints (with
    ``distinct_words`` over those) propose what meets in their tables, :func:`prefix_links` adds the pairs
    that don't, and inside each class so connected the sets decide.

    Null, empty and wordless texts have fingerprint zero and link like any other.  Rows with a null id
    take part; they get their component's smallest id, null if none has one.  Repeated rows stay, an
    empty table gives none.  Other columns aren't read, whatever their names.
    """
    text = quoted(text_column).cast("string")
    common = None if similarity is None else common_shingles(documents, text_column, words)
    made = fingerprint(text, words=words, longs=longs, distinct_words=distinct_words, similarity=similarity, common=common)
    slim = documents.select(quoted(id_column).alias("id"), F.xxhash64(quoted(id_column), text).alias("doc"), made.alias("made")).select("id", "doc", "made.*")
    slim = slim.withColumn("node", F.xxhash64("marks") if similarity is not None else F.col("bits")[0] if longs == 1 else F.xxhash64("bits"))
    slim = written(slim, "fingerprints")
    rank = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc")).alias("one")
    firsts = [F.first(c).alias(c) for c in ("bits", *(() if similarity is None else ("marks", "prefix")))]
    nodes = slim.groupBy("node").agg(F.min("id").alias("low_id"), rank, *firsts)
    nodes = written(nodes, "nodes")
    found = components(links(nodes, longs=longs, radius=radius, ball=ball, similarity=similarity))
    if similarity is not None:
        found = written(found, "found")
        stars = found.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        classes = components(stars.unionByName(prefix_links(nodes, found, similarity)))
        close = written(classes.join(nodes.select("node", "one", "marks"), "node").select("node", "root", "one.doc", F.col("marks")[0].alias("size")), "close")
        repeated = written(slim.groupBy("doc").count().where("count > 1").select("doc"), "repeated")
        slender = documents.select(quoted(id_column), quoted(text_column))
        slender = once(slender, F.xxhash64(quoted(id_column), text), repeated)
        found = components(similar_links(slender, close, id_column=id_column, text_column=text_column, words=words, similarity=similarity))
    ids = nodes.select("node", "low_id").join(found, "node", "left").withColumn("component", F.coalesce("root", "node"))
    ids = written(ids.select("node", "low_id", "component"), "components")
    lowest = written(ids.groupBy("component").agg(F.min("low_id").alias("component_id"), F.count("*").alias("n")), "lowest")
    labels = join_hubs(ids, lowest, "component", SMALL).select("node", "component", "component_id")
    return slim.join(labels, "node").select("id", "doc", "bits", "component", "component_id")


#: Parameters for shingles of five words and a similarity of 0.8.  Tables: 128 bits over the distinct
#: words in 4 segments, balls of radius 1, which join most near copies at little cost.  The prefixes, a
#: fifth of each set, bring together all other pairs.
FIVE_WORDS = {"words": 5, "longs": 2, "ball": 1, "distinct_words": True, "similarity": 0.8}


def keep_one(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """``documents`` with one row of each component: the one with the smallest id, columns as they were.

    Without parameters those of ``FIVE_WORDS`` hold.  Null ids come last, ties go by a hash of id and
    text, and of rows that repeat an (id, text) one stays.  An empty table stays empty; extra columns stay,
    whatever their names.
    """
    found = written(near_duplicates(documents, id_column=id_column, text_column=text_column, **(how or FIVE_WORDS)).select("id", "doc", "component"), "members")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc"))["doc"].alias("best"), F.count("*").alias("n"))
    best = written(best, "best")
    (own,) = fresh(documents, "own")
    doc = F.xxhash64(quoted(id_column), quoted(text_column).cast("string"))
    gone = written(join_hubs(found, best, "component", SMALL).where("doc != best").select(F.col("doc").alias(own)).distinct(), "gone")
    repeated = written(found.groupBy("doc").count().where("count > 1").select("doc"), "repeated")
    kept = documents.withColumn(own, doc).join(small(gone, SMALL), own, "left_anti")
    return once(kept.select(*map(quoted, documents.columns)), doc, repeated)

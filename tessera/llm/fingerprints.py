"""SimHash document fingerprints, as DataFrame operations only.

A text's terms are its pairs of neighbouring words.  Each occurrence of a term votes with its weight
on the signed bits of the term's hash; a bit is 1 if it has over half of all weight.  The votes are
counted four to a long, in lanes of 16 bits, per stretch of ``STRETCH`` terms, so that one pass of a
hash aggregate sums them and no lane runs over.

Near fingerprints are found with permuted block tables: cut into blocks, each block leads one table,
and two fingerprints with fewer differing bits than blocks agree in a whole block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hubs, lower_ascii, quoted, small, written

LONGS = 2
BITS = 64 * LONGS
LANES = 0x0001000100010001
#: Terms of one stretch, and the largest weight: their product stays below 2^15, so that a long never overflows.
STRETCH, HEAVIEST = 2048, 15
#: Rows of an order range, ranges at least and at most.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 2000, 64, 65536
#: Bits of a block; fingerprints of one block value from which another block is joined to the key, and such values
#: that are broadcast at most.
BLOCK_BITS, CROWD, MOST_CROWDED = 32, 1024, 1_000_000


def terms(text: Column) -> Column:
    """Array of structs of neighbouring words; a text of one word has it alone, an empty text the empty word."""
    words = F.split(F.trim(F.regexp_replace(lower_ascii(text), r"[\x20\x09-\x0D]+", " ")), " ")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"))


def votes() -> list[Column]:
    """Aggregates over columns h0, h1 ... and weight: lanes of votes, and all weight."""
    lanes = [F.sum(F.shiftrightunsigned(f"h{k}", s).bitwiseAND(LANES) * F.col("weight")).alias(f"v{k}_{s}") for k in range(LONGS) for s in range(16)]
    return [*lanes, F.sum("weight").alias("all")]


def fingerprints(texts: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """``keys`` and bits (array<long> of ``LONGS``) for each row; the keys must tell all rows apart.

    Null texts count as empty; equal texts have equal fingerprints.
    """
    text = F.coalesce(quoted(text_column).cast("string"), F.lit(""))
    each = texts.select(*keys, F.posexplode(terms(text)).alias("pos", "term")).select(*keys, F.floor(F.col("pos") / STRETCH).alias("stretch"), "term.*")
    weight = F.least(F.length("a") + F.coalesce(F.length("b"), F.lit(0)), F.lit(HEAVIEST)).cast("long")
    hashed = [F.xxhash64("a", "b").alias("h0")]
    hashed += [F.xxhash64(F.lit(k), F.col("a"), F.col("b")).alias(f"h{k}") for k in range(1, LONGS)]
    counted = each.select(*keys, "stretch", weight.alias("weight"), *hashed).groupBy(*keys, "stretch").agg(*votes())
    lane = lambda k, b: F.shiftrightunsigned(f"v{k}_{b % 16}", 16 * (b // 16)).bitwiseAND(0xFFFF)
    summed = counted.groupBy(*keys).agg(*[F.sum(lane(k, b)).alias(f"b{k}_{b}") for k in range(LONGS) for b in range(64)], F.sum("all").alias("all"))
    bit = lambda k, b: F.when(2 * F.col(f"b{k}_{b}") > F.col("all"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    return summed.select(*keys, F.array(*[reduce(lambda x, y: x.bitwiseOR(y), [bit(k, b) for b in range(64)]) for k in range(LONGS)]).alias("bits"))


def hex_of(bits: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(bits[k]), 16, "0") for k in range(LONGS)]))


def distance(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(LONGS)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def near_fingerprints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b, distance): each distinct fingerprint with each other one within ``radius`` bits, both ways, once.

    ``prints`` has distinct ``bits``; its other columns are taken along, of b.  Its blocks of ``BLOCK_BITS``
    must be more than ``radius``.  A block value that over ``CROWD`` fingerprints share is a key only
    together with one of the blocks of 16 bits of the rest, for which the same holds; so no key stays
    crowded just because one block is common.  A pair counts where it agrees first, in the first block
    and, if that is crowded, the first of the rest.
    """
    blocks = BITS // BLOCK_BITS
    if radius >= blocks:
        raise ValueError(f"{blocks} tables find at most {blocks - 1} differing bits")
    half = lambda bits, i: F.shiftrightunsigned(bits[i // 2], 32 * (i % 2)).bitwiseAND(0xFFFFFFFF)
    quarter = lambda bits, i: F.shiftrightunsigned(bits[i // 4], 16 * (i % 4)).bitwiseAND(0xFFFF)
    own, more = F.col("bits"), [c for c in prints.columns if c != "bits"]
    rest = F.array(*[F.array(*[F.named_struct(F.lit("more"), F.lit(j), F.lit("also"), quarter(own, j)) for j in range(2 * blocks) if j // 2 != i]) for i in range(blocks)])
    tables = prints.select("bits", *more, rest.alias("rest"), F.posexplode(F.array(*[half(own, i) for i in range(blocks)])).alias("block", "value"))
    counts = written(tables.groupBy("block", "value").count().where(F.col("count") > 1), "block-values")
    crowded = small(counts.where(F.col("count") > CROWD).select("block", "value", F.lit(True).alias("crowded")), MOST_CROWDED)
    shared = tables.join(counts.drop("count"), ["block", "value"], "left_semi").join(crowded, ["block", "value"], "left")
    nothing = F.array(F.named_struct(F.lit("more"), F.lit(-1), F.lit("also"), F.lit(0).cast("long")))
    keyed = shared.select("bits", *more, "block", "value", F.inline(F.when(F.col("crowded"), F.col("rest")[F.col("block")]).otherwise(nothing)))
    left = keyed.select(F.col("bits").alias("a"), "block", "value", "more", "also")
    right = keyed.withColumnRenamed("bits", "b")
    a, b = F.col("a"), F.col("b")
    apart = distance(a, b)
    at = F.coalesce(*[F.when(half(a, i) == half(b, i), F.lit(i)) for i in range(blocks)])
    then = F.coalesce(*[F.when((quarter(a, j) == quarter(b, j)) & (F.col("block") != j // 2), F.lit(j)) for j in range(2 * blocks)])
    first = (F.col("block") == at) & ((F.col("more") == -1) | (F.col("more") == then))
    return left.join(right, ["block", "value", "more", "also"]).where((a != b) & (apart <= radius) & first).select("a", "b", *more, apart.alias("distance"))


def with_near(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``prints`` (with a column bits) and n_near: how many other rows have a fingerprint within ``radius`` bits.

    Equal fingerprints are counted once and weighed by their rows, so copies make no pairs; pairs of
    different ones are summed where they are found and never written.
    """
    counts = written(prints.groupBy("bits").agg(F.count("*").alias("rows")), "distinct-fingerprints")
    others = near_fingerprints(counts, radius).groupBy(F.col("a").alias("bits")).agg(F.sum("rows").alias("near"))
    around = counts.join(others, "bits", "left").select("bits", (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), F.col("rows").alias("n"))
    return join_hubs(prints, written(around, "near-counts"), "bits")


def order_number(ident: Column, kind: T.DataType) -> Column:
    """A long that never falls where ids of this type rise; null for null."""
    if isinstance(kind, T.NumericType | T.BooleanType):
        value = ident.cast("double")
        return F.when(F.isnan(value), (1 << 63) - 1).otherwise(F.floor(value)) if isinstance(kind, T.FractionalType) else ident.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(ident).cast("long")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_seconds(ident.cast("timestamp"))
    beginning = F.rpad(F.substring(F.hex(F.encode(ident.cast("string"), "utf-8")), 1, 14), 14, "0")
    return F.conv(beginning, 16, 10).cast("long")


def order_ranges(documents: DataFrame, number: Column) -> Column:
    """The range of ids (int) in which a row's ``number`` lies; null is -1 and lies below all.

    The ranges' ends are quantiles, about one per ``RANGE_ROWS`` rows.
    """
    rows = documents.count()
    n = min(MOST_RANGES, max(LEAST_RANGES, rows // RANGE_ROWS))
    found = documents.agg(F.percentile_approx(number, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    ends = sorted(set(found))
    step = max(1, int(len(ends) ** 0.5))
    groups = [ends[i : i + step] for i in range(0, len(ends), step)]
    if not groups:
        return F.when(number.isNull(), -1).otherwise(0)
    below = lambda values: F.size(F.filter(values, lambda x: x <= number))
    longs = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    group = below(longs([g[0] for g in groups]))
    inside = below(F.element_at(F.array(*[longs(g) for g in groups]), F.greatest(group, F.lit(1))))
    return F.when(number.isNull(), -1).when(group == 0, 0).otherwise((group - 1) * step + inside)


def with_next(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(range, place, ghost, id, text, next_text): each document with the next one's text, ids descending.

    After the last comes the first; a lone document follows itself.  Ids may be numbers, dates, times or
    strings (by bytes).  Null ids come last, rows of one id are ordered by a hash of the text.  A range
    that holds one id only is cut by that hash, if its rows are many.  The first row of a range stands
    again as a ghost at the end of the range before it; so each range is a window of its own and no task
    sorts all.  Null texts are empty.
    """
    ident, kind = quoted(id_column), documents.select(quoted(id_column)).schema[0].dataType
    number = order_number(ident, kind)
    text, hashed = F.coalesce(quoted(text_column).cast("string"), F.lit("")), F.xxhash64(quoted(text_column).cast("string"))
    slim = documents.select(ident.alias("id"), text.alias("text"), hashed.alias("hashed"), order_ranges(documents, number).cast("long").alias("ids"))
    crowds = slim.groupBy("ids").agg(F.count("*").alias("n"), F.min("id").eqNullSafe(F.max("id")).alias("one")).where(F.col("one") & (F.col("n") > 4 * RANGE_ROWS)).collect()
    cuts = [F.lit(x).cast("long") for r in crowds for x in (r["ids"], min(MOST_RANGES, r["n"] // RANGE_ROWS))]  # few: of MOST_RANGES + 2 ranges
    tie = F.shiftrightunsigned("hashed", 33)
    part = F.shiftright(tie * F.coalesce(F.element_at(F.create_map(*cuts), F.col("ids")), F.lit(1)), 31) if cuts else F.lit(0)
    slim = slim.withColumn("tie", tie).withColumn("range", F.shiftleft(-F.col("ids"), 20) + part).drop("ids")  # rises as ids fall
    firsts = written(slim.groupBy("range").agg(F.max(F.struct("id", -F.col("tie"), "hashed")).alias("first")), "range-firsts")
    last = Window.orderBy("range")  # over at most some MOST_RANGES rows
    before = F.coalesce(F.lag("range").over(last), F.max("range").over(last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select("range", F.col("first.id").alias("first_id"), F.col("first.hashed").alias("first_hashed"), before.alias("before"))
    leads = slim.join(F.broadcast(firsts), "range").where(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hashed") == F.col("first_hashed"))).dropDuplicates(["range"])
    leads = leads.withColumn("range", F.col("before")).drop("first_id", "first_hashed", "before")
    both = slim.withColumn("ghost", F.lit(False)).unionByName(leads.withColumn("ghost", F.lit(True)))
    row = Window.partitionBy("range").orderBy("ghost", F.col("id").desc_nulls_last(), "tie", F.col("hashed").desc())
    return both.withColumn("place", F.row_number().over(row)).withColumn("next_text", F.lead("text").over(row)).drop("tie", "hashed")


def edited_fingerprints(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, bits, edited_bits, next_bits) of each document.

    Edited: the last half (rounded down) of the code points gives way to the first as many of the next
    document, ids descending.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    placed = with_next(documents, id_column=id_column, text_column=text_column).withColumn("edited", edited)
    keys = ["range", "place", "ghost", "id", "n_chars", "edited_sha256", "part"]
    variants = F.when(F.col("ghost"), F.array("text")).otherwise(F.array("text", "edited"))
    texts = placed.select("range", "place", "ghost", "id", n.alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), F.posexplode(variants).alias("part", "text"))
    prints = fingerprints(texts, keys)
    pick = lambda part: F.first(F.when(F.col("part") == part, F.col("bits")), ignorenulls=True)
    joined = prints.groupBy(*keys[:-1]).agg(pick(0).alias("bits"), pick(1).alias("edited_bits"))
    following = F.lead("bits").over(Window.partitionBy("range").orderBy("place"))
    return joined.withColumn("next_bits", following).where(~F.col("ghost")).select("id", "n_chars", "edited_sha256", "bits", "edited_bits", "next_bits")

"""Sharding by k-d tree partitioning, as DataFrame operations only.

A node is split at the weighted median of its widest dimension, all nodes of a level at once.  The
median is found by histograms: sums of the weights over at most ``BINS`` equal parts of the interval
that holds it, again and again until one part is light enough.  Nodes, intervals and cuts are tables,
and a window per node picks the part: the driver sees only whether nodes are left.  Where one value
weighs too much the next key decides: dimension, then text hash, then row hash, so that equal texts stay
together unless that would unbalance the halves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, written

BINS = 1024
#: Share of a node's weight that a cut may be off; the same where keeping equal texts together costs it.
SLACK, GROUP_SLACK = 0.0005, 0.005
#: Rows of a shard that one window orders; parts of a shard at least.
PART_ROWS, LEAST_PARTS = 100_000, 64
#: Nodes of a level, a few numbers each, that are broadcast at most; more are joined by shuffle.
MOST_NODES = 200_000


def log_size(size: Column) -> Column:
    return F.floor(F.log2(size + 1) * (1 << 20)).cast("long")


def letters(name: Column) -> Column:
    """A number that orders names by their first seven bytes; null is 0."""
    hexed = F.rpad(F.substring(F.hex(F.encode(F.coalesce(name.cast("string"), F.lit("")), "utf-8")), 1, 14), 14, "0")
    return F.conv(hexed, 16, 10).cast("long")


def chosen(names: list[str], which: str = "dimension") -> Column:
    """The column of that number."""
    return F.coalesce(*[F.when(F.col(which) == i, F.col(c)) for i, c in enumerate(names)])


def of_nodes(table: DataFrame, leaves: int) -> DataFrame:
    """``table``, one row for each of some nodes of a tree of so many leaves, marked for a broadcast if these are few.

    The nodes of a level are at most as many as the leaves, all of them less than twice as many: the bound
    is known without counting.
    """
    return F.broadcast(table) if 2 * leaves <= MOST_NODES else table


def first_state(placed: DataFrame, nodes: DataFrame, dimensions: list[str], spread: list[int], leaves: int) -> DataFrame:
    """One row for each of ``nodes`` (node, first, parts) with rows: its dimension and the interval of each key.

    wanted: the weight that goes left; step: the key that decides now, 0 the dimension, 1 the text hash, 2
    the row hash; low and high: that key's interval; key0 and key1: the values of the keys before it.
    """
    ends = [f(d).alias(f"{x}{i}") for i, d in enumerate([*dimensions, "text_hash", "row_hash"]) for x, f in (("min", F.min), ("max", F.max))]
    own = placed.join(of_nodes(nodes, leaves), "node").groupBy("node", "parts").agg(F.sum("size").alias("weight"), *ends)
    n = len(dimensions)
    widths = F.array(*[F.struct(((F.col(f"max{i}") - F.col(f"min{i}")) / max(1, spread[i])).alias("width"), F.lit(-i).alias("order")) for i in range(n)])
    own = own.withColumn("dimension", -F.array_max(widths)["order"])
    wanted = F.col("weight") * F.floor(F.col("parts") / 2) / F.col("parts")
    none, bound = F.lit(None).cast("long"), lambda x: chosen([f"{x}{i}" for i in range(n)])
    return own.select(
        "node", "dimension", "weight", wanted.alias("wanted"), F.lit(0).alias("step"), bound("min").alias("low"), bound("max").alias("high"), none.alias("key0"), none.alias("key1"),
        F.struct(F.col(f"min{n}").alias("low"), F.col(f"max{n}").alias("high")).alias("texts"), F.struct(F.col(f"min{n + 1}").alias("low"), F.col(f"max{n + 1}").alias("high")).alias("rows"),
        *[none.alias(f"cut{i}") for i in range(3)], F.lit(False).alias("done"),
    )


def next_state(placed: DataFrame, state: DataFrame, dimensions: list[str], leaves: int) -> DataFrame:
    """``state`` one histogram on: nodes whose part is light enough or a single row hash are done and have cuts."""
    at = placed.join(of_nodes(state.select("node", "dimension", "step", "low", "high", "key0", "key1"), leaves), "node")
    value = chosen(dimensions)
    key = F.when(F.col("step") == 0, value).when(F.col("step") == 1, F.col("text_hash")).otherwise(F.col("row_hash"))
    same = (F.col("key0").isNull() | (value == F.col("key0"))) & (F.col("key1").isNull() | (F.col("text_hash") == F.col("key1")))
    width = F.floor((F.col("high") - F.col("low")) / BINS) + 1
    counted = at.where(same).select("node", key.alias("key"), "low", "high", width.alias("width"), "size").where(F.col("key").between(F.col("low"), F.col("high")))
    bins = counted.groupBy("node", F.floor((F.col("key") - F.col("low")) / F.col("width")).cast("long").alias("bin")).agg(F.sum("size").alias("size"), F.min("key").alias("from"), F.max("key").alias("to"))
    upto = F.sum("size").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = bins.withColumn("upto", upto).join(of_nodes(state.select("node", "wanted"), leaves), "node").where(F.col("upto") >= F.col("wanted"))
    part = reached.groupBy("node").agg(F.min_by(F.struct("from", "to", "size", (F.col("upto") - F.col("size")).alias("before")), "bin").alias("part"))
    now, step = state.join(of_nodes(part, leaves), "node", "left"), F.col("step")
    low, high, size = F.col("part.from"), F.col("part.to"), F.col("part.size")
    rest = F.col("wanted") - F.col("part.before")
    single, last = low == high, step == 2
    light = size <= F.col("weight") * F.when(single & (step == 1), GROUP_SLACK).otherwise(SLACK)
    cut = F.when(F.col("part").isNull(), F.col("high") + 1).when(light | single & last, F.when(rest >= size / 2, high + 1).otherwise(low))
    after = F.when(step == 0, F.col("texts")).otherwise(F.col("rows"))
    deeper = single & cut.isNull()
    return now.select(
        "node", "dimension", "weight", F.coalesce(rest, F.col("wanted")).alias("wanted"), F.when(deeper, step + 1).otherwise(step).alias("step"),
        F.when(deeper, after["low"]).otherwise(F.coalesce(low, F.col("low"))).alias("low"), F.when(deeper, after["high"]).otherwise(F.coalesce(high, F.col("high"))).alias("high"),
        *[F.when(deeper & (step == i), low).otherwise(F.col(f"key{i}")).alias(f"key{i}") for i in range(2)], "texts", "rows",
        *[F.when(cut.isNotNull() & (step == i), cut).when(cut.isNotNull() & (step > i), F.col(f"key{i}") if i < 2 else F.lit(None)).cast("long").alias(f"cut{i}") for i in range(3)],
        cut.isNotNull().alias("done"),
    )


def split_level(placed: DataFrame, nodes: DataFrame, dimensions: list[str], spread: list[int], leaves: int) -> DataFrame:
    """(node, dimension, cut0, cut1, cut2) of the nodes that have rows: rows whose keys come from there on go right.

    ``placed`` has node, dimensions, text_hash, row_hash, size.
    """
    ready, state = [], written(first_state(placed, nodes, dimensions, spread, leaves), "intervals")
    while not state.isEmpty():
        now = written(next_state(placed, state, dimensions, leaves), "intervals")
        ready.append(now.where("done").select("node", "dimension", "cut0", "cut1", "cut2"))
        state = now.where("not done")
    return written(reduce(DataFrame.unionByName, ready), "cuts") if ready else state.select("node", "dimension", "cut0", "cut1", "cut2")


def place(placed: DataFrame, cuts: DataFrame, dimensions: list[str], leaves: int) -> DataFrame:
    """The rows one level down: node 2 n left of the cut, 2 n + 1 right of it; nodes without a cut stay."""
    at = placed.join(of_nodes(cuts, leaves), "node", "left")
    value = chosen(dimensions)
    right = (value > F.col("cut0")) | (value == F.col("cut0")) & (
        F.col("cut1").isNull() | (F.col("text_hash") > F.col("cut1")) | (F.col("text_hash") == F.col("cut1")) & (F.col("cut2").isNull() | (F.col("row_hash") >= F.col("cut2")))
    )
    node = F.when(F.col("cut0").isNull(), F.col("node")).otherwise(2 * F.col("node") + right.cast("long"))
    return at.withColumn("node", node).drop("dimension", "cut0", "cut1", "cut2")


def kd_shards(
    documents: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, id_column: str = "doc_id", text_column: str = "text", dimensions: tuple[Column, ...] = (), shard_column: str = "shard", slot_column: str = "slot"
) -> DataFrame:
    """``documents`` with shard (int) and slot (long, gapless from 0 in each shard).

    A document weighs the UTF-8 bytes of its text plus 1, a null text 1.  The number of leaves is
    ``shards``, or what brings each to ``target_bytes``; a node that will hold n leaves is split at n // 2
    of n of its weight, which is the median for even n.  ``dimensions`` are long columns; without any
    they are the logarithm of the size and, if there is one, the ``lang`` column's name.

    Shards differ by at most a percent or so of their weight, or by a document where tables are small;
    with fewer rows than shards some stay empty, and an empty table gives no rows.  Null ids and texts and
    repeated rows are rows like any other; rows that repeat id and text go to one shard.  Equal texts
    share a shard unless that costs over ``GROUP_SLACK`` of a node.  Dimensions lie between -2^61 and 2^61.
    Other columns stay, whatever their names, but for ones named like ``shard_column`` and ``slot_column``, which give way.
    """
    documents = documents.drop(*[quoted(c) for c in documents.columns if c.lower() in (shard_column.lower(), slot_column.lower())])
    names = fresh(documents, "size", "node", "text_hash", "row_hash", "part", "before", "s", "p")
    n_size, n_node, n_text, n_row, n_part, n_before, n_s, n_p = names
    text = quoted(text_column).cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    dims = list(dimensions) or [log_size(size), *([letters(quoted("lang"))] if "lang" in documents.columns else [])]
    hashed = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 2)
    text_hash, row_hash = hashed(text), hashed(quoted(id_column).cast("string"), text)
    d_names = [f"d{i}" for i in range(len(dims))]
    points = written(documents.select(*[F.coalesce(d.cast("long"), F.lit(0)).alias(a) for d, a in zip(dims, d_names, strict=True)], text_hash.alias("text_hash"), row_hash.alias("row_hash"), size.alias("size")), "points")
    whole = points.agg(F.sum("size").alias("size"), F.count("*").alias("rows"), *[(F.max(d) - F.min(d)).alias(d) for d in d_names]).first()
    leaves = shards or max(1, -(-(whole["size"] or 0) // target_bytes))
    spread, levels = [whole[d] or 0 for d in d_names], []
    nodes = written(documents.sparkSession.sql(f"SELECT 1L AS node, 0L AS first, {leaves}L AS parts"), "nodes")
    placed = points.withColumn("node", F.lit(1).cast("long"))
    while not (open_nodes := nodes.where("parts > 1")).isEmpty():
        cuts = split_level(placed, open_nodes.select("node", "parts"), d_names, spread, leaves)
        if cuts.isEmpty():
            break
        placed = written(place(placed, cuts, d_names, leaves), "placed")
        levels.append(cuts)
        both = nodes.join(of_nodes(cuts.select("node", F.lit(True).alias("cut")), leaves), "node", "left")
        half = F.floor(F.col("parts") / 2)
        left = F.struct((2 * F.col("node")).alias("node"), "first", half.alias("parts"))
        right = F.struct((2 * F.col("node") + 1).alias("node"), (F.col("first") + half).alias("first"), (F.col("parts") - half).alias("parts"))
        # A node without rows is a leaf, whatever it was meant to hold.
        nodes = written(both.select(F.inline(F.when(F.col("cut"), F.array(left, right)).otherwise(F.array(F.struct("node", "first", F.lit(1).cast("long").alias("parts")))))), "nodes")
    shard_of = of_nodes(nodes.select("node", F.col("first").cast("int").alias("shard")), leaves)
    parts = max(LEAST_PARTS, whole["rows"] // (leaves * PART_ROWS))
    part = F.pmod(F.xxhash64("row_hash"), F.lit(parts)).alias("part")
    counts = placed.join(shard_of, "node").groupBy("shard", part).count()
    order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias(n_s), F.col("part").alias(n_p), F.coalesce(F.sum("count").over(order), F.lit(0)).alias(n_before))
    # The same cuts on the documents themselves: their other columns never went through the tree.
    renamed = {"node": n_node, "text_hash": n_text, "row_hash": n_row, "size": n_size} | {d: fresh(documents, f"dim{i}")[0] for i, d in enumerate(d_names)}
    own = documents.select("*", *[F.coalesce(d.cast("long"), F.lit(0)).alias(renamed[a]) for d, a in zip(dims, d_names, strict=True)], text_hash.alias(n_text), row_hash.alias(n_row), F.lit(1).cast("long").alias(n_node))
    for level in levels:
        own = place_named(own, level, renamed, d_names, leaves)
    wide = nodes.select(F.col("node").alias(n_node), F.col("first").cast("int").alias(shard_column))
    own = own.join(of_nodes(wide, leaves), n_node)
    own = own.withColumn(n_part, F.pmod(F.xxhash64(n_row), F.lit(parts)))
    own = own.join(offsets, (F.col(shard_column) == F.col(n_s)) & (F.col(n_part) == F.col(n_p)))
    inside = Window.partitionBy(n_s, n_p).orderBy(n_row, n_text)
    slot = (F.col(n_before) + F.row_number().over(inside) - 1).cast("long").alias(slot_column)
    return own.select(*map(quoted, documents.columns), shard_column, slot)


def place_named(own: DataFrame, level: DataFrame, names: dict[str, str], dimensions: list[str], leaves: int) -> DataFrame:
    """:func:`place` under the helper names of a frame that may have columns of any name."""
    short = own.select(F.struct(*map(quoted, own.columns)).alias("all"), *[F.col(names[c]).alias(c) for c in ("node", "text_hash", "row_hash", *dimensions)])
    moved = place(short, level, dimensions, leaves)
    kept = [F.col("all").getField(c).alias(c) if c != names["node"] else F.col("node").alias(c) for c in own.columns]
    return moved.select(*kept)

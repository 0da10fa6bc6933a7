"""Sharding: a k-d tree over the documents' metadata with weighted medians for cuts.

DataFrame functions only.  Documents with equal texts are one group of their
summed size, and never part.  A node of k shards is cut along its widest
dimension where k // 2 of the k parts of its bytes lie on one side, all nodes of
a level at once: their weights are summed by ranges of the dimension, and the
range that holds the cut is looked at again until one group remains.  The
nodes of a level are a table that is joined to the groups; the driver sees a
row for each node and pass, never ranges, groups or documents.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import written

#: Ranges of a dimension that a pass tells apart, as a power of two.
BITS = 10
#: Bits of a group's place on a dimension, and of the hash that orders groups of one place.
VALUE_BITS, TIE_BITS = 30, 30
#: Nodes whose table is broadcast: under 16 MB.
BROADCAST_NODES = 300_000
#: Rows of a bucket in which slots are counted.
BUCKET_ROWS = 4_000


@dataclass
class Node:
    shards: tuple[int, int]  # first and end
    dim: int = -1
    cut: int = 0  # keys below it go to the first shards
    low: float = 0.0
    high: float = 0.0


def dimensions(lang: str, source: str) -> list[Column]:
    """A document's place, each from 0 to 1: length, language, source."""
    code = F.rpad(F.coalesce(F.lower(F.col(f"`{lang}`").cast("string")), F.lit("")), 2, " ")
    letters = F.ascii(F.substring(code, 1, 1)) * 256 + F.ascii(F.substring(code, 2, 1))
    return [
        F.least(F.lit(1.0), F.log2(F.col("size").cast("double") + 1) / 32),
        F.least(F.lit(1.0), letters / 65_536.0),
        F.crc32(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).cast("binary")) / 4_294_967_296.0,
    ]


def assign(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", target_bytes: int | None = None) -> DataFrame:
    """(key, size, text_crc32, group, shard, slot) of each row; target_bytes: as many shards as make leaves of about this size.

    size: UTF-8 bytes of the text (null: none) and 8.  Null texts are one
    group, apart from empty ones.  slot counts a shard's rows from 0 without a
    gap, by key within buckets; repeated rows have slots of their own.  A null
    language or source lies at 0.  An empty table has no rows.  Other columns
    are left to the caller.
    """
    value = F.col(f"`{text}`").cast("string")
    rows = docs.select(
        F.col(f"`{key}`").alias("id"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.substring(F.sha2(value.cast("binary"), 256), 1, 32)), F.lit("null").cast("binary")).alias("group"),
        *[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((lang, "lang"), (source, "source"))],
    )
    rows = written(rows)
    dims = [d.alias(f"d{i}") for i, d in enumerate(dimensions("lang", "source"))]
    placed = rows.select("group", "size", *dims)
    names = [f"d{i}" for i in range(len(dims))]
    groups = placed.groupBy("group").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *[F.min(d).alias(d) for d in names])
    groups = written(groups.withColumn("tie", F.pmod(F.xxhash64("group"), F.lit(1 << TIE_BITS))))
    if target_bytes:
        total = groups.agg(F.sum("w")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    return slotted(rows.join(grow(groups, names, shards), "group"), key)


def slotted(rows: DataFrame, key: str) -> DataFrame:
    n = rows.count()
    buckets = max(64, math.ceil(n / BUCKET_ROWS / 24))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets)).cast("int"))
    # bounded by shards x buckets
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("shard", "bucket", (F.sum("m").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("m")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size"))
    out = rows.withColumn("own", own).join(before, ["shard", "bucket"])
    return out.select(F.col("id").alias(key), "size", "text_crc32", "group", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"))


def _known(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's, as a literal; broadcast where it is under 16 MB."""
    fields = [f.split() for f in schema.split(", ")]
    listed = F.lit(json.dumps([dict(zip((n for n, _ in fields), r, strict=True)) for r in rows]))
    kind = "array<struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">>"
    table = spark.range(0, 1, 1, 1).select(F.explode(F.from_json(listed, kind)).alias("row")).select("row.*")
    return F.broadcast(table) if len(rows) <= BROADCAST_NODES else table


def grow(groups: DataFrame, names: list[str], shards: int) -> DataFrame:
    """(group, shard), by a tree over (w, tie, names) that is cut level by level."""
    spark, nodes = groups.sparkSession, [Node((0, shards))]
    placed = groups.withColumn("node", F.lit(0))
    level = [0]
    while level := [i for i in level if nodes[i].shards[1] - nodes[i].shards[0] > 1]:
        inside = placed.join(_known(spark, [(i,) for i in level], "node int"), "node", "left_semi")
        spans = inside.groupBy("node").agg(F.sum("w").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in names for f in (F.min, F.max)]).collect()
        need: dict[int, float] = {}
        for r in spans:
            node, widths = nodes[r["node"]], [r[f"max_{d}"] - r[f"min_{d}"] for d in names]
            node.dim = widths.index(max(widths))
            node.low, node.high = r[f"min_{names[node.dim]}"], r[f"max_{names[node.dim]}"]
            a, b = node.shards
            need[r["node"]] = r["w"] * ((b - a) // 2) / (b - a)
        boxes = _known(spark, [(i, nodes[i].dim, nodes[i].low, nodes[i].high) for i in need], "node int, dim int, low double, high double")
        keyed = written(placed.join(boxes, "node", "left").withColumn("key", place(names)).drop("dim", "low", "high"))
        _cut(keyed.where("key IS NOT NULL").select("node", "w", "key"), nodes, need)
        level, sides = [], []
        for i in need:
            a, b = nodes[i].shards
            half = a + (b - a) // 2
            sides.append((i, nodes[i].cut, len(nodes), len(nodes) + 1))
            level += [len(nodes), len(nodes) + 1]
            nodes += [Node((a, half)), Node((half, b))]
        cuts = _known(spark, sides, "node int, cut bigint, below int, above int")
        side = F.when(F.col("cut").isNull(), F.col("node")).when(F.col("key") < F.col("cut"), F.col("below")).otherwise(F.col("above"))
        placed = keyed.join(cuts, "node", "left").withColumn("node", side).drop("key", "cut", "below", "above")
    leaves = _known(spark, [(i, n.shards[0]) for i, n in enumerate(nodes)], "node int, shard int")
    return placed.join(leaves, "node").select("group", "shard")


def place(names: list[str]) -> Column:
    """A group's place on its node's dimension (dim, low, high; null without one): a whole number, different for different groups but for chance."""
    value, width = F.get(F.array(*[F.col(n) for n in names]), F.col("dim")), F.col("high") - F.col("low")
    scaled = F.when(width > 0, F.floor((value - F.col("low")) / width * ((1 << VALUE_BITS) - 1))).when(width.isNotNull(), F.lit(0))
    return scaled.cast("long") * (1 << TIE_BITS) + F.col("tie")


def _cut(keyed: DataFrame, nodes: list[Node], need: dict[int, float]) -> None:
    """Set each node's cut: below it lies the weight nearest to `need`."""
    total, width = VALUE_BITS + TIE_BITS, 1 << BITS
    ranges = {i: (0, total, 0.0) for i in need}  # start, bits left, weight below
    while ranges:
        rows = [(i, low, float(1 << max(0, bits - BITS)), below, need[i]) for i, (low, bits, below) in ranges.items()]
        known = _known(keyed.sparkSession, rows, "node int, start bigint, step double, below double, need double")
        bin_ = F.floor((F.col("key") - F.col("start")) / F.col("step")).cast("long")
        sums = keyed.join(known, "node").select("node", "w", "below", "need", bin_.alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < width))
        sums = sums.groupBy("node", "bin").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.first("below").alias("below"), F.first("need").alias("need"))
        # a node's bins are `width` at most
        so_far = F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        first = sums.withColumn("sum", so_far).where(F.col("sum") >= F.col("need")).groupBy("node").agg(F.min(F.struct("bin", "w", "n", "sum")).alias("hit"))
        hits = {r["node"]: r["hit"] for r in first.collect()}
        following = {}
        for i, (low, bits, _) in ranges.items():
            step = 1 << max(0, bits - BITS)
            if i not in hits:
                nodes[i].cut = low + width * step
                continue
            r = hits[i]
            at, under = low + r["bin"] * step, r["sum"] - r["w"]
            if r["n"] == 1 or step == 1:  # one group holds the cut: it goes where it fits better
                nodes[i].cut = at + step if need[i] - under > r["sum"] - need[i] else at
            else:
                following[i] = (at, max(0, bits - BITS), under)
        ranges = following

"""Rows in an order: what was stored before a row, and ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def stored_before(df: DataFrame, keys: list[str], stored: Column, seq: str | None) -> Column:
    """Whether a row of the same keys that counts as stored comes earlier by `seq` (None: by a digest of the row, for tables without an order)."""
    order = F.col(seq) if seq else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.count_if(stored).over(w), F.lit(0)) > 0


def neighbours(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, position: str | None = None) -> DataFrame:
    """`rows` with `name`, the `value` of the next row of the same keys in `order` (null for the last), and `position`, their rank among these from 1.

    Rows lie in ranges of (keys, order), so a key with a third of all rows is
    sorted by many tasks; only the first row of a key and range crosses a
    border. Null keys are equal. Rows that tie in `order` are in one range, and
    come in no defined order.
    """
    parts = written(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    firsts = parts.groupBy("__part", *keys).agg(F.min_by(value, F.struct(*order)).alias("__first"), F.count(F.lit(1)).alias("__rows"))
    # a row a key and range
    along = Window.partitionBy(*keys).orderBy("__part")
    named = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    borders = firsts.select(F.col("__part").alias("__range"), *named, "__rows", F.lead("__first").over(along).alias("__next"), (F.sum("__rows").over(along) - F.col("__rows")).alias("__before"))
    own = Window.partitionBy("__part", *keys).orderBy(*order)
    held = parts.withColumn("__at", F.row_number().over(own)).withColumn("__lead", F.lead(value).over(own))
    same = F.col("__part") == F.col("__range")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    out = held.join(borders, same).withColumn(name, F.when(F.col("__at") < F.col("__rows"), F.col("__lead")).otherwise(F.col("__next")))
    if position:
        out = out.withColumn(position, F.col("__before") + F.col("__at"))
    return out.select(*rows.columns, *[c for c in (name, position) if c and c not in rows.columns])


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """`rows` with k, their rank by `order` from 0: ranks within sorted partitions, and the sizes of those before."""
    parts = written(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # a row a partition
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return parts.withColumn("own", own).join(before, "__part").withColumn("k", F.col("before") + F.col("own") - 1)

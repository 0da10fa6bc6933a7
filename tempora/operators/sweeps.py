"""Reads at many instants: rows swept in the order of time over range partitions, and a join of windows with the instants that stab them.

A key with a third of all rows lies in many ranges. What a range knows of its
key is one row, and only that row crosses its border.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: How a running value goes on: its aggregate over the rows so far, and what joins that to what came before them.
RUNNING = {
    "sum": (F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "max": (F.max, F.greatest),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], totals: dict[str, str] | None = None) -> DataFrame:
    """`rows` with each of `values`, name: (how, what), over the rows of the same keys up to this one in `order`.

    how: sum (none: 0), max, or last, the latest that isn't null. `totals`
    names columns for a value over all rows of the keys. Null keys are equal.
    Rows that tie in `order` come in no defined order and aren't split, so an
    order that tells rows apart keeps ranges even.
    """
    named = {f"__v{i}": (how, what) for i, (how, what) in enumerate(values.values())}
    ranged = rows.withColumns({v: what for v, (_, what) in named.items()}).repartitionByRange(*keys, *order)
    parts = written(ranged.withColumn("__part", F.spark_partition_id()))
    at = F.struct(*order)
    of_range = {"sum": F.sum, "max": F.max, "last": lambda x: F.max_by(x, F.when(x.isNotNull(), at))}
    ends = parts.groupBy("__part", *keys).agg(*[of_range[how](F.col(v)).alias(v) for v, (how, _) in named.items()])
    # a row a key and range
    along = Window.partitionBy(*keys).orderBy("__part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = dict(zip(values, named, strict=True))
    carried = ends.select(
        F.col("__part").alias("__range"),
        *[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)],
        *[RUNNING[how][0](F.col(v)).over(before).alias(f"{v}_before") for v, (how, _) in named.items()],
        *[RUNNING[named[place[name]][0]][0](F.col(place[name])).over(whole).alias(column) for name, column in (totals or {}).items()],
    )
    own = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = parts.select(*rows.columns, "__part", *[RUNNING[how][0](F.col(v)).over(own).alias(v) for v, (how, _) in named.items()])
    same = functools.reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)), F.col("__part") == F.col("__range"))
    joined = {name: RUNNING[named[v][0]][1](F.col(f"{v}_before"), F.col(v)).alias(name) for name, v in place.items()}
    kept = [c for c in rows.columns if c not in joined]
    return held.join(carried, same).select(*kept, *joined.values(), *(totals or {}).values())


def stabbed(windows: DataFrame, moments: DataFrame, key: str, start: str, end: str, at: str, closed: bool) -> DataFrame:
    """Each moment (`key`, `at`, and what else it has) with each window of its key that holds it; a null end is open.

    The bounds of a key's windows and its moments are put in one order, in which
    a window is a range of places and a moment one place. A range is cut into
    its dyadic slabs, two a level at most; a moment asks for the one slab of
    each level that it lies in. So windows and moments meet on equal (key,
    level, slab), and nothing that meets is thrown away: the join has as many
    rows as the result. Columns of the moments, then those of the windows but
    the key; names must differ. Null keys, starts and moments meet nothing, nor
    do windows that end before they start. Repeated rows stay.
    """
    own = written(windows.where(F.col(key).isNotNull() & F.col(start).isNotNull()).withColumn("__id", F.monotonically_increasing_id()))
    asked = written(moments.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__id", F.monotonically_increasing_id()))
    # at one instant: a start before the moments; an end after them where the window is closed, else before
    ending = 3 if closed else 0

    def bound(df: DataFrame, time: str, kind: int) -> DataFrame:
        return df.select(F.col(key).alias("__k"), F.col(time).isNull().alias("__late"), F.col(time).alias("__t"), F.lit(kind).alias("__kind"), "__id")

    sound = own.where(F.col(end).isNull() | ((F.col(start) <= F.col(end)) if closed else (F.col(start) < F.col(end))))
    line = bound(sound, start, 1).unionByName(bound(sound, end, ending)).unionByName(bound(asked, at, 2))
    # the end of an open window lies behind all others of its key
    placed = running(line.withColumn("__role", F.when(F.col("__late"), F.lit(ending)).otherwise(F.col("__kind"))), ["__k"], ["__late", "__t", "__role", "__id"], {"__place": ("sum", (F.col("__kind") != 2).cast("long"))}, {"__place": "__bounds"})
    placed = written(placed)
    ranges = placed.where("__kind <> 2").groupBy("__k", "__id").agg(F.min(F.when(F.col("__kind") == 1, F.col("__place"))).alias("a"), F.max(F.when(F.col("__kind") == ending, F.col("__place"))).alias("b"), F.first("__bounds").alias("n"))
    levels = F.sequence(F.lit(0), F.floor(F.log2((F.col("n") + 1).cast("double"))).cast("int"))

    def slabs(k: Column) -> Column:
        """Those of level k: [a, b) without what whole slabs of the level above hold."""
        size = F.expr("bigint(1)") * F.pow(F.lit(2.0), k).cast("long")
        low, high = F.floor((F.col("a") + size - 1) / size), F.floor(F.col("b") / size)
        first = F.when((low < high) & (low % 2 == 1), low)
        last = F.when((low < high) & (high % 2 == 1), high - 1)
        both = F.array_compact(F.array(first, last))
        return F.transform(both, lambda x: F.struct(k.alias("level"), x.alias("slab")))

    cut = ranges.select("__k", F.col("__id").alias("__w"), F.explode(F.flatten(F.transform(levels, slabs))).alias("s")).select("__k", "__w", "s.level", "s.slab")
    asks = placed.where("__kind = 2").select("__k", F.col("__id").alias("__m"), F.col("__place").alias("q"), F.explode(F.sequence(F.lit(0), F.floor(F.log2((F.col("__bounds") + 1).cast("double"))).cast("int"))).alias("level"))
    asks = asks.select("__k", "__m", "level", F.floor(F.col("q") / F.pow(F.lit(2.0), F.col("level"))).alias("slab"))
    met = cut.join(asks, ["__k", "level", "slab"]).select("__w", "__m")
    rest = [c for c in windows.columns if c != key]
    return met.join(asked.withColumnRenamed("__id", "__m"), "__m").join(own.select(F.col("__id").alias("__w"), *rest), "__w").select(*moments.columns, *rest)

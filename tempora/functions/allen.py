"""Allen's thirteen relations between proper intervals, as columns and as sets in a SMALLINT mask."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .guards import code, first_code

#: The relations in their order, which is that of a mask's bits, and their converses.
RELATIONS = ("before", "after", "meets", "met_by", "overlaps", "overlapped_by", "starts", "started_by", "during", "contains", "finishes", "finished_by", "equals")
CONVERSE = {"before": "after", "meets": "met_by", "overlaps": "overlapped_by", "starts": "started_by", "during": "contains", "finishes": "finished_by", "equals": "equals"}
CONVERSE |= {v: k for k, v in CONVERSE.items()}
BIT = {name: 1 << i for i, name in enumerate(RELATIONS)}
ALL = (1 << len(RELATIONS)) - 1


def classify(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """The relation of [ls, le] to [rs, re]; NULL where an end is NULL or an interval isn't proper."""
    proper = (ls < le) & (rs < re)
    name = (
        F.when(le < rs, "before")
        .when(re < ls, "after")
        .when(le == rs, "meets")
        .when(re == ls, "met_by")
        .when(ls == rs, F.when(le == re, "equals").when(le < re, "starts").otherwise("started_by"))
        .when(le == re, F.when(ls > rs, "finishes").otherwise("finished_by"))
        .when(ls < rs, F.when(le < re, "overlaps").otherwise("contains"))
        .otherwise(F.when(le < re, "during").otherwise("overlapped_by"))
    )
    return F.when(proper, name)


def classify_error(left: Column, right: Column) -> Column:
    """Only bounded intervals with both ends included have a relation."""
    bad = [(i["certainty"] != "bounded") | (i["lower_kind"] != "included") | (i["upper_kind"] != "included") for i in (left, right)]
    return first_code(code(bad[0] | bad[1], "UncertainRelation"))


def classify_intervals(left: Column, right: Column) -> Column:
    return F.when(classify_error(left, right).isNull(), classify(left["lower"], left["upper"], right["lower"], right["upper"]))


def converse(relation: Column) -> Column:
    out = None
    for a, b in CONVERSE.items():
        out = F.when(relation == a, b) if out is None else out.when(relation == a, b)
    return out  # type: ignore[return-value]


# sets


def mask_of(*names: str) -> int:
    return sum({BIT[n] for n in names})


def singleton(relation: Column) -> Column:
    """The mask of one name, NULL for none of them; names the relation once, as it may be a long expression."""
    place = F.array_position(F.array(*[F.lit(n) for n in BIT]), relation)
    return F.call_function("shiftleft", F.lit(1), F.nullif(place, F.lit(0)).cast("int") - 1)


def contains_relation(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(BIT[name])) != 0


def size(mask: Column) -> Column:
    return F.bit_count(mask).cast("int")


def is_empty(mask: Column) -> Column:
    return mask == 0


def members(mask: Column) -> Column:
    """The names of a set, in the relations' order."""
    names = F.array(*[F.lit(n) for n in RELATIONS])
    return F.filter(names, lambda n, i: F.getbit(mask.cast("long"), i) == 1)


def intersection(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def union(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def converse_mask(mask: Column) -> Column:
    """Each relation of the set by its converse, which is one bit up or down, or itself; the empty set for NULL."""
    up = mask_of(*[a for a, b in itertools.pairwise(RELATIONS) if CONVERSE[a] == b])
    down, same = up << 1, mask_of(*[n for n in RELATIONS if CONVERSE[n] == n])
    moved = F.shiftleft(mask.bitwiseAND(F.lit(up)), 1).bitwiseOR(F.shiftright(mask.bitwiseAND(F.lit(down)), 1))
    return F.coalesce(moved.bitwiseOR(mask.bitwiseAND(F.lit(same))), F.lit(0))


# composition


def relation_of(ls: int, le: int, rs: int, re: int) -> str:
    """classify() for four numbers."""
    sign = lambda a, b: (a > b) - (a < b)
    if le <= rs:
        return "before" if le < rs else "meets"
    if re <= ls:
        return "after" if re < ls else "met_by"
    return {
        (-1, -1): "overlaps", (-1, 0): "finished_by", (-1, 1): "contains",
        (0, -1): "starts", (0, 0): "equals", (0, 1): "started_by",
        (1, -1): "during", (1, 0): "finishes", (1, 1): "overlapped_by",
    }[sign(ls, rs), sign(le, re)]


@functools.lru_cache(maxsize=4)
def composition(ranks: int = 6) -> dict[tuple[str, str], int]:
    """The table of masks, from all triples of proper intervals over `ranks` ranks (6 are enough)."""
    spans = list(itertools.combinations(range(ranks), 2))
    out: dict[tuple[str, str], int] = {}
    for a, b, c in itertools.product(spans, repeat=3):
        pair = (relation_of(*a, *b), relation_of(*b, *c))
        out[pair] = out.get(pair, 0) | BIT[relation_of(*a, *c)]
    return out


def composition_table(spark: SparkSession, ranks: int = 6) -> DataFrame:
    """(left, right, mask), built by joins over all proper intervals on `ranks` ranks: a fixed 169 rows."""
    n = F.lit(ranks)
    spans = spark.range(1).select(F.explode(F.sequence(F.lit(0), n - 2)).alias("s")).select("s", F.explode(F.sequence(F.col("s") + 1, n - 1)).alias("e"))
    every = spans.agg(F.collect_list(F.struct("s", "e")).alias("x"))
    triples = every.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b"), "x").select("a", "b", F.explode("x").alias("c"))
    rel = lambda p, q: classify(F.col(p)["s"], F.col(p)["e"], F.col(q)["s"], F.col(q)["e"])
    cells = triples.select(rel("a", "b").alias("left"), rel("b", "c").alias("right"), singleton(rel("a", "c")).alias("bit"))
    return cells.groupBy("left", "right").agg(F.bit_or("bit").alias("mask"))


def compose(df: DataFrame, a: str, b: str, to: str = "composed") -> DataFrame:
    """`df` with the composition of the sets in columns a and b: the union over their members of the table's cells.

    The table is a literal of 169 masks, so no join and no shuffle is needed.
    """
    table = composition()
    cells = F.array(*[F.lit(table[x, y]) for x in RELATIONS for y in RELATIONS])
    bits = lambda m: F.filter(F.sequence(F.lit(0), F.lit(len(RELATIONS) - 1)), lambda i: F.getbit(F.col(m).cast("long"), i) == 1)
    own = F.flatten(F.transform(bits(a), lambda x: F.transform(bits(b), lambda y: F.get(cells, x * len(RELATIONS) + y))))
    return df.withColumn(to, F.aggregate(own, F.lit(0), lambda m, x: m.bitwiseOR(x)))

"""Path consistency over interval networks.

A network's cells are masks of possible relations. What they narrow to doesn't
depend on an order: closed_masks() closes many small networks at once in a task,
and joins the cells of large ones until none changes. `revisions`, `steps` and supports do depend on the order of the
loops, so close_networks() closes each network by the same triple loop; only
networks run beside each other.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.allen import ALL, BIT, CONVERSE, RELATIONS, compose, composition, converse_mask
from ..tables import drop_written, written


class Contradiction(ValueError):
    pass


class BudgetExceeded(ValueError):
    pass


@functools.lru_cache(maxsize=None)
def compose_masks(a: int, b: int) -> int:
    out = 0
    for x in RELATIONS:
        if a & BIT[x]:
            for y in RELATIONS:
                if b & BIT[y]:
                    out |= composition()[x, y]
    return out


@functools.lru_cache(maxsize=None)
def converse_of(mask: int) -> int:
    return sum(BIT[CONVERSE[n]] for n in RELATIONS if mask & BIT[n])


class Network:
    """Variables 0, 1, .. and what is known of each pair."""

    def __init__(self, max_variables: int = 256, max_steps: int = 1_000_000):
        if max_variables < 1 or max_steps < 1:
            raise ValueError("limits must be over 0")
        self.max_variables, self.max_steps = max_variables, max_steps
        self.masks: list[list[int]] = []
        self.observed: list[list[bool]] = []
        self.support: list[list[frozenset[int]]] = []
        self.constraints = 0

    def add_variable(self) -> int:
        n = len(self.masks)
        if n >= self.max_variables:
            raise BudgetExceeded("variables")
        for rows, value in ((self.masks, ALL), (self.observed, False), (self.support, frozenset())):
            for row in rows:
                row.append(value)  # type: ignore[arg-type]
            rows.append([value] * (n + 1))  # type: ignore[list-item]
        self.masks[n][n] = BIT["equals"]
        return n

    def assert_relation(self, i: int, j: int, mask: int) -> int:
        """The constraint's number; a contradiction uses none and changes nothing."""
        narrowed = self.masks[i][j] & mask
        if not narrowed:
            raise Contradiction(f"{i} {j}")
        number = self.constraints
        self.constraints += 1
        own = self.support[i][j] | {number}
        self.masks[i][j], self.masks[j][i] = narrowed, converse_of(narrowed)
        self.support[i][j] = self.support[j][i] = own
        self.observed[i][j] = True
        return number

    def close(self) -> tuple[int, int]:
        """(steps, revisions) until nothing changes; a contradiction or a spent budget leaves the network as it was."""
        before = [row[:] for row in self.masks], [row[:] for row in self.support]
        try:
            return self._close()
        except (Contradiction, BudgetExceeded):
            self.masks, self.support = before
            raise

    def _close(self) -> tuple[int, int]:
        n, steps, revisions, changed = len(self.masks), 0, 0, True
        while changed:
            changed = False
            for k in range(n):
                for i in range(n):
                    for j in range(n):
                        if i == k or j == k:
                            continue
                        steps += 1
                        if steps > self.max_steps:
                            raise BudgetExceeded("steps")
                        narrowed = self.masks[i][j] & compose_masks(self.masks[i][k], self.masks[k][j])
                        if narrowed == self.masks[i][j]:
                            continue
                        if not narrowed:
                            raise Contradiction(f"{i} {j}")
                        self.masks[i][j], self.masks[j][i] = narrowed, converse_of(narrowed)
                        own = self.support[i][j] | self.support[i][k] | self.support[k][j]
                        self.support[i][j] = self.support[j][i] = own
                        revisions += 1
                        changed = True
        return steps, revisions


_CELLS = "network {kind}, i int, j int, mask int, observed boolean, support array<int>, error_code string"
_NAMES = ("network", "i", "j", "mask", "observed", "support", "error_code")


def _closed(name, rows: list[tuple[int, int, int, int]], max_variables: int, max_steps: int) -> list[tuple]:
    """The cells of one network from its assertions (step, i, j, mask)."""
    net, error = Network(max_variables, max_steps), None
    try:
        for _ in range(max(max(i, j) for _, i, j, _ in rows) + 1):
            net.add_variable()
        for _, i, j, mask in sorted(rows, key=lambda r: r[0]):
            net.assert_relation(i, j, mask)
        net.close()
    except Contradiction:
        error = "Contradiction"
    except BudgetExceeded:
        error = "BudgetExceeded"
    n = len(net.masks)
    return [(name, i, j, net.masks[i][j], net.observed[i][j], sorted(net.support[i][j]), error) for i in range(n) for j in range(n)]


def close_networks(assertions: DataFrame, max_variables: int = 256, max_steps: int = 1_000_000) -> DataFrame:
    """Cells (network, i, j, mask, observed, support, error_code) of networks given as (network, step, i, j, mask) rows.

    Networks stand one after the other in sorted partitions, so a task holds
    one network at a time and starts no group for each of many small ones.
    """
    rows = assertions.select("network", *[F.col(c).cast("int") for c in ("step", "i", "j", "mask")])

    def run(batches):
        schema, name, own = None, None, []
        for batch in batches:
            schema = batch.schema.field("network").type
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and row[0] != name:
                    out += _closed(name, own, max_variables, max_steps)
                    own = []
                name = row[0]
                own.append(row[1:])
            yield _cells(out, schema)
        if own:
            yield _cells(_closed(name, own, max_variables, max_steps), schema)

    ordered = rows.repartition("network").sortWithinPartitions("network", "step")
    return ordered.mapInArrow(run, _CELLS.replace("{kind}", rows.schema["network"].dataType.simpleString()))


def _cells(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.string())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(_NAMES))


#: Networks of so many asserted pairs at most (so 65 variables, if they hang together) are closed beside each other in tasks.
IN_TASK = 64
#: Rows of whole networks that a task closes at a time, and cells that it composes at a time.
ROWS, CELLS = 1 << 16, 1 << 17
_MASKS = "network {kind}, i int, j int, mask int, error_code string"


def closed_masks(assertions: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(network, i, j, mask, error_code): the path-consistent closure of networks given as (network, i, j, mask) rows, without limits.

    Only cells that tell something have a row: a pair without one may be in any
    relation, as composing with all relations gives all. Networks of `in_task`
    asserted pairs at most stand in sorted partitions, and a task closes many of
    them at once; larger ones, found by a count, are closed by joins.

    Of a network with a Contradiction the rows are its pairs as asserted, mask 0
    where the assertions themselves contradict; the network takes no more part.
    Rows with a null are left out; a variable's relation to itself can only be
    `equals`, and contradicts where it can't.
    """
    rows = assertions.select("network", *[F.col(c).cast("int").alias(c) for c in ("i", "j", "mask")]).dropna()
    own = F.when(F.col("i") == F.col("j"), F.col("mask").bitwiseAND(F.lit(BIT["equals"]))).when(F.col("i") > F.col("j"), converse_mask(F.col("mask"))).otherwise(F.col("mask"))
    upward = rows.where(f"mask < {ALL} OR i = j").select("network", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), own.alias("mask"))
    asserted = written(upward.groupBy("network", "i", "j").agg(F.bit_and("mask").alias("mask")))
    large = written(asserted.groupBy("network").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > in_task).select("network"))
    if large.isEmpty():
        drop_written(large)
        return _closed_in_tasks(asserted)
    return _closed_in_tasks(asserted.join(large, "network", "left_anti")).union(_closed_by_joins(asserted.join(large, "network", "left_semi")))


def _closed_in_tasks(asserted: DataFrame) -> DataFrame:
    """The closure of networks given by a row a pair, each of which a task can hold."""
    n = int(asserted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = asserted.select("network", "i", "j", "mask").repartition(n, "network").sortWithinPartitions("network")
    return ordered.mapInArrow(_closed_batches, _MASKS.replace("{kind}", asserted.schema["network"].dataType.simpleString()))


def _closed_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The closure of networks (network, i, j, mask) that lie one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            codes = _codes(rows)
            last = int(np.argmax(codes == codes[-1]))  # the last network may go on in the next batch
            yield from _closed_rows(rows.slice(0, last))
            held = rows.slice(last).to_batches()
    if sum(x.num_rows for x in held):
        yield from _closed_rows(pa.Table.from_batches(held).combine_chunks())


def _codes(rows: pa.Table) -> np.ndarray:
    """A number for each row's network, from 0 in the order they appear."""
    return rows["network"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)


def _closed_rows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The closure of whole networks. Those of as many variables are closed together, as arrays of cells by network."""
    if not rows.num_rows:
        return
    nets, names = _codes(rows), rows["network"].combine_chunks()
    i, j, mask = (rows[c].to_numpy().astype(np.int64) for c in ("i", "j", "mask"))
    first = np.unique(nets, return_index=True)[1]
    # variables by network, numbered from 0 in their order
    known, at = np.unique(np.concatenate([nets, nets]) << 32 | np.concatenate([i, j]) + (1 << 31), return_inverse=True)
    start = np.searchsorted(known >> 32, np.arange(len(first) + 1))
    at = at - start[np.concatenate([nets, nets])]
    a, b, variables, sizes = at[: len(i)], at[len(i) :], (known & (1 << 32) - 1) - (1 << 31), np.diff(start)
    refused = np.zeros(len(first), bool)
    for n in np.unique(sizes):
        alike = np.flatnonzero(sizes == n)
        for part in np.array_split(alike, -(-len(alike) * int(n) ** 2 // CELLS)):
            place = np.full(len(first), -1)
            place[part] = np.arange(len(part))
            own = np.flatnonzero(place[nets] >= 0)
            cells = np.full((n, n, len(part)), ALL, np.int16)
            cells[np.arange(n), np.arange(n)] = BIT["equals"]
            cells[a[own], b[own], place[nets[own]]] &= mask[own].astype(np.int16)
            cells[b[own], a[own], place[nets[own]]] = _converses()[cells[a[own], b[own], place[nets[own]]]]
            _close_cells(cells)
            refused[part] = bad = (cells == 0).any((0, 1))
            told = (cells < ALL) & ~bad & ~np.eye(n, dtype=bool)[:, :, None]
            net, x, y = np.nonzero(told.transpose(2, 0, 1))
            of = part[net]
            yield _mask_rows(names.take(pa.array(first[of])), variables[start[of] + x], variables[start[of] + y], cells[x, y, net], None)
    lost = np.flatnonzero(refused[nets] & ((i != j) | (mask == 0)))
    if len(lost):
        turned = lost[i[lost] != j[lost]]
        both = names.take(pa.array(np.concatenate([lost, turned])))
        yield _mask_rows(both, np.concatenate([i[lost], j[turned]]), np.concatenate([j[lost], i[turned]]), np.concatenate([mask[lost], _converses()[mask[turned]]]), "Contradiction")


def _mask_rows(network: pa.Array, i: np.ndarray, j: np.ndarray, mask: np.ndarray, error: str | None) -> pa.RecordBatch:
    columns = [network, *[pa.array(x.astype(np.int32)) for x in (i, j, mask)], pa.repeat(pa.scalar(error, pa.string()), len(network))]
    return pa.record_batch(columns, names=["network", "i", "j", "mask", "error_code"])


def _close_cells(cells: np.ndarray) -> None:
    """Narrows cells (variable, variable, network) by all paths over a third variable until none changes; networks that no longer change are left."""
    composed, open_ = _compositions(), np.arange(cells.shape[2])
    while len(open_):
        now = cells[:, :, open_]
        for k in range(len(now)):
            now &= composed(now[:, k], now[k])
        changed = (now != cells[:, :, open_]).any((0, 1))
        cells[:, :, open_] = now
        open_ = open_[changed & (now != 0).all((0, 1))]


class Compositions:
    """Compositions of arrays of masks, by tables.

    Masks that networks come to are few, so each gets a number when it is first
    seen and a pair of them is looked up at once; beyond `most` masks, a
    composition is made of those of the lower seven and upper six bits.
    """

    def __init__(self, most: int = 512):
        self.most, self.seen = most, np.zeros(0, np.intp)
        self.number = np.full(ALL + 1, -1, np.intp)
        self.pairs = np.zeros(most * most, np.int16)
        x, y, self.parts = np.arange(128)[:, None], np.arange(128)[None, :], {}
        for p, q in itertools.product((0, 1), repeat=2):
            part = np.zeros((128, 128), np.int16)
            for (s, r), (t, u) in itertools.product(enumerate(RELATIONS[7 * p : 7 * p + 7]), enumerate(RELATIONS[7 * q : 7 * q + 7])):
                part |= np.where((x >> s) & (y >> t) & 1, composition()[r, u], 0).astype(np.int16)
            self.parts[p, q] = part.ravel()

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """(x, y, network): the composition of left (x, network) and right (y, network)."""
        a, b = self.number[left], self.number[right]
        if min(a.min(), b.min()) < 0:
            self._see(np.concatenate([left[a < 0], right[b < 0]]))
            a, b = self.number[left], self.number[right]
            if min(a.min(), b.min()) < 0:
                return self.by_parts(left[:, None], right[None])
        return self.pairs.take((a * self.most)[:, None] + b[None])

    def by_parts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right = left.astype(np.intp), right.astype(np.intp)
        met = [one.take(((left >> 7 * p & 127) << 7) + (right >> 7 * q & 127)) for (p, q), one in self.parts.items()]
        return functools.reduce(np.bitwise_or, met)

    def _see(self, masks: np.ndarray) -> None:
        new = np.unique(masks)[: self.most - len(self.seen)].astype(np.intp)
        self.number[new] = np.arange(len(self.seen), len(self.seen) + len(new))
        self.seen = np.concatenate([self.seen, new])
        n, pairs = len(self.seen), self.pairs.reshape(self.most, self.most)
        pairs[n - len(new) : n, :n] = self.by_parts(new[:, None], self.seen[None])
        pairs[:n, n - len(new) : n] = self.by_parts(self.seen[:, None], new[None])


@functools.lru_cache(maxsize=1)
def _compositions() -> Compositions:
    return Compositions()


@functools.lru_cache(maxsize=1)
def _converses() -> np.ndarray:
    return np.array([converse_of(m) for m in range(ALL + 1)], np.int16)


def _closed_by_joins(asserted: DataFrame) -> DataFrame:
    """The closure of networks of any size, given by a row a pair.

    Each round composes the cells that the last one changed with those beside
    them, so a chain of n links takes about log n rounds. Cells are joined by
    (network, variable) and met by bit_and before they are shuffled.
    """
    asserted = written(asserted.where("i = j").select("network", "i", "j", "mask").union(_both_ways(asserted.where("i <> j"))))
    wrong = written(asserted.where("mask = 0").select("network").distinct())
    cells = written(asserted.where("i <> j").join(wrong, "network", "left_anti").withColumn("changed", F.lit(True)))
    while not cells.where("changed").isEmpty():
        changed = cells.where("changed").select(F.col("network").alias("of"), F.col("i").alias("start"), F.col("j").alias("over"), F.col("mask").alias("first"))
        beside = cells.select(F.col("network"), F.col("i").alias("middle"), F.col("j").alias("end"), F.col("mask").alias("second"))
        paths = changed.join(beside, (F.col("of") == F.col("network")) & (F.col("over") == F.col("middle")) & (F.col("start") != F.col("end")))
        met = compose(paths.select("network", F.col("start").alias("i"), F.col("end").alias("j"), "first", "second"), "first", "second", "mask")
        found = _both_ways(met.where(f"mask < {ALL}")).groupBy("network", "i", "j").agg(F.bit_and("mask").alias("found"))
        before, after = F.coalesce("mask", F.lit(ALL)), F.coalesce("mask", F.lit(ALL)).bitwiseAND(F.coalesce("found", F.lit(ALL)))
        joined = cells.drop("changed").join(found, ["network", "i", "j"], "full").select("network", "i", "j", after.alias("mask"), (after != before).alias("changed"))
        met_cells = written(joined)
        more = written(wrong.union(met_cells.where("mask = 0").select("network")).distinct())
        following = written(met_cells.join(more, "network", "left_anti"))
        drop_written(cells, met_cells, wrong)
        cells, wrong = following, more
    refused = asserted.where("i <> j OR mask = 0").join(wrong, "network", "left_semi").select("network", "i", "j", "mask", F.lit("Contradiction").alias("error_code"))
    return cells.select("network", "i", "j", "mask", F.lit(None).cast("string").alias("error_code")).union(refused)


def _both_ways(cells: DataFrame) -> DataFrame:
    """Each cell, and its converse for the pair the other way round."""
    turned = cells.select("network", F.col("j").alias("i"), F.col("i").alias("j"), converse_mask(F.col("mask")).alias("mask"))
    return cells.select("network", "i", "j", "mask").union(turned)

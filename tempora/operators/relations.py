"""Typed relations: vocabulary, forward order of transitions, and a graph that stays acyclic."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.allen import classify
from ..functions.guards import code, first_code, one_of
from ..tables import drop_written, written
from .components import connected_components

#: Kinds that lead to a later event, and kinds of provenance.
TRANSITIONS = ("causes", "enables", "intervenes_on", "leads_to", "produces", "transitions_to", "input_to", "process_to")
PROVENANCE = ("references", "summarizes", "revises", "translates", "retrospectively_reports", "supports", "contradicts", "outcome_of")
KINDS = TRANSITIONS + PROVENANCE
EVIDENCE = ("observed", "inferred")


def is_transition(kind: Column) -> Column:
    return one_of(kind, TRANSITIONS)


def forward_order_error(sf: Column, st: Column, tf: Column, tt: Column) -> Column:
    """UncertainRelation without two proper intervals; ReverseTransition where the source is after or met by the target."""
    relation = classify(sf, st, tf, tt)
    return first_code(code(relation.isNull(), "UncertainRelation"), code(relation.isin("after", "met_by"), "ReverseTransition"))


def edge_error(source: Column, target: Column, kind: Column, sf: Column, st: Column, tf: Column, tt: Column) -> Column:
    """An unknown kind; for transitions a self-loop first, then the order. Provenance may point anywhere."""
    step = is_transition(kind)
    return first_code(code(~one_of(kind, KINDS), "UnknownRelationKind"), code(step & source.eqNullSafe(target), "TransitionSelfLoop"), F.when(step, forward_order_error(sf, st, tf, tt)))


def stored_error() -> Column:
    kind, flag = F.col("kind"), F.col("is_transition")
    return first_code(
        code(~one_of(kind, KINDS), "UnknownRelationKind"),
        code(flag != is_transition(kind), "TransitionFlagMismatch"),
        code(is_transition(kind) & (F.col("source") == F.col("target")), "TransitionSelfLoop"),
    )


class Forward:
    """An acyclic graph that keeps a topological order of its nodes: an edge along the order costs nothing, another a search between its two ranks."""

    def __init__(self) -> None:
        self.rank: dict[str, int] = {}
        self.after: dict[str, set[str]] = {}
        self.before: dict[str, set[str]] = {}

    def add(self, source: str, target: str) -> bool:
        """Whether the edge was added: not where it closes a cycle."""
        for x in (source, target):
            if x not in self.rank:
                self.rank[x], self.after[x], self.before[x] = len(self.rank), set(), set()
        low, high = self.rank[target], self.rank[source]
        if source == target:
            return False
        if low < high:
            ahead = self._reach(target, self.after, lambda r: r <= high)
            if source in ahead:
                return False
            behind = self._reach(source, self.before, lambda r: r >= low)
            nodes = sorted(behind, key=self.rank.__getitem__) + sorted(ahead, key=self.rank.__getitem__)
            for x, r in zip(nodes, sorted(self.rank[x] for x in nodes), strict=True):
                self.rank[x] = r
        self.after[source].add(target)
        self.before[target].add(source)
        return True

    def _reach(self, node: str, links: dict[str, set[str]], within: Callable[[int], bool]) -> set[str]:
        seen, todo = {node}, [node]
        while todo:
            for x in links[todo.pop()]:
                if x not in seen and within(self.rank[x]):
                    seen.add(x)
                    todo.append(x)
        return seen


#: Edges that a task links, or folds if they are whole components, at a time.
ROWS = 1 << 18
#: Components of more transitions lose those that can't lie on a cycle before they are folded.
LARGE = 1 << 20
_CODES = pa.array([None, "DuplicateRelationEdge", "TransitionCycle"], pa.string())


def _chunks(batches: Iterable[pa.RecordBatch], rows: int, key: str | None = None) -> Iterator[pa.Table]:
    """Batches put together to `rows` rows or more; with a key, by which they lie in order, none of its groups is cut."""
    held: list[pa.RecordBatch] = []
    n, most = 0, rows
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        chunk, cut = pa.Table.from_batches(held).combine_chunks(), n
        if key is not None:
            of = chunk[key].to_numpy()
            cut = int(np.searchsorted(of, of[-1]))
        if cut:
            yield chunk.slice(0, cut)
        held = chunk.slice(cut).to_batches()
        n -= cut
        most = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _leads(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each edge (a, b) the least `order` of those that hang together with it, in whatever direction."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] < root).any():
            root = root[root]
        x, y = x[apart], y[apart]
    own = root[at[: len(a)]]
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, own, order)
    return least[own]


def _led(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with `lead`: of transitions (those with ends a and b) that hang together among the rows at hand, the least `order`."""
    for chunk in _chunks(batches, ROWS):
        inner = np.flatnonzero(chunk["a"].is_valid().to_numpy())
        lead = np.zeros(chunk.num_rows, np.int64)
        lead[inner] = _leads(*(chunk[c].take(pa.array(inner)).to_numpy() for c in ("a", "b", "order")))
        none = np.ones(chunk.num_rows, bool)
        none[inner] = False
        yield from chunk.drop_columns(["a", "b", "order"]).append_column("lead", pa.array(lead, mask=none)).to_batches()


def _on_cycles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) may lie on a cycle.

    Nodes are ranked as they first appear. A cycle comes down again, by edges to
    a rank that is no higher, over each step between two ranks that it goes up;
    so it keeps to a stretch of ranks that such edges cover without a gap.
    """
    _, first, at = np.unique(np.stack([a, b], 1).ravel(), return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.intp)
    rank[np.argsort(first)] = np.arange(len(first))
    source, target = rank[at].reshape(-1, 2).T
    down = source >= target
    covered = np.cumsum(np.bincount(target[down], minlength=len(first)) - np.bincount(source[down], minlength=len(first)))
    stretch = np.concatenate([[0], np.cumsum(covered[:-1] == 0)])
    return stretch[source] == stretch[target]


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transitions with error_code, from transitions sorted by component and seq: one whose id is stored, or that would close a cycle of those stored, is refused."""
    for chunk in _chunks(batches, ROWS, "component"):
        closing = _on_cycles(chunk["a"].to_numpy(), chunk["b"].to_numpy())
        asked = np.flatnonzero(closing | chunk["again"].to_numpy())
        found = np.zeros(chunk.num_rows, np.int8)
        component, graph, stored = None, Forward(), set()
        rows = zip(asked, closing[asked], *(chunk.column(c).take(pa.array(asked)).to_pylist() for c in ("component", "again", "edge_id", "source", "target")), strict=True)
        for k, may_close, part, again, edge, source, target in rows:
            if part != component:
                component, graph, stored = part, Forward(), set()
            if again and edge in stored:
                found[k] = 1
            elif may_close and not graph.add(source, target):
                found[k] = 2
            elif again:
                stored.add(edge)
        out = chunk.select(["seq", "edge_id", "kind", "source", "target"])
        yield from out.append_column("error_code", _CODES.take(pa.array(found))).to_batches()


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _node(x: str) -> Column:
    """A node by 64 bits. Two that agree in them are taken for one, which only puts more edges into a component."""
    return F.xxhash64(x)


def _linked(rows: DataFrame, inner: Column) -> DataFrame:
    """Edges with `lead`: one for those of `inner` that lay together and share nodes, null for the others.

    Leads are as the edges' order, so where edges come in the order of a chain,
    labels that fall along it are few rounds from its first.
    """
    order = F.col("seq").cast("long") if isinstance(rows.schema["seq"].dataType, IntegralType) else F.xxhash64("seq")
    hashed = rows.select("*", order.alias("order"), *[F.when(inner, _node(x)).alias(c) for x, c in (("source", "a"), ("target", "b"))])
    out = rows.drop("lead")
    return written(hashed.drop("lead").mapInArrow(_led, f"{_kinds(out)}, lead long"))


def _repeated(every: DataFrame) -> DataFrame:
    """(edge_id, stored): ids of several edges. From the first edge outside the fold on, an id is stored: by that edge or before it."""
    seen = every.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("lead").isNull(), F.col("seq"))).alias("stored"))
    return written(seen.where("n > 1 AND edge_id IS NOT NULL").select("edge_id", "stored"))


def _placed(every: DataFrame, repeated: DataFrame) -> DataFrame:
    """Transitions to fold with their component, and whether their id comes `again`; those whose id is stored outside by then are left out.

    What hangs together among the rows that lay together has one lead by now, so
    only leads that share a node, or an id, remain to be joined.
    """
    columns = ["seq", "edge_id", "kind", "source", "target", "lead"]
    open_ = every.where("lead IS NOT NULL").select(*columns, F.lit(False).alias("again"))
    ids = None
    if not repeated.isEmpty():
        marked = every.where("lead IS NOT NULL").join(repeated.withColumn("again", F.lit(True)), "edge_id", "left").where("stored IS NULL OR seq < stored")
        open_ = marked.select(*columns, F.coalesce("again", F.lit(False)).alias("again"))
        ids = open_.where("again").select("lead", F.xxhash64(F.lit("id"), "edge_id").alias("first"))
    ends = open_.select(F.explode(F.array(_node("source"), _node("target"))).alias("node"), "lead")
    shared = written(ends.groupBy("node").agg(F.min("lead").alias("first"), F.max("lead").alias("last")).where("first < last").select("node", "first"))
    if ids is None and shared.isEmpty():
        drop_written(shared)
        return open_.withColumnRenamed("lead", "component")
    links = ends.join(shared, "node").where("lead > first").select("lead", "first").distinct()
    links = written(links if ids is None else links.union(ids))
    parts = connected_components(links, "lead", "first")
    drop_written(shared, links)
    return open_.join(parts, F.col("lead") == parts["node"], "left").withColumn("component", F.coalesce("component", "lead")).drop("lead", "node")


def insert_edges(edges: DataFrame, large: int = LARGE) -> DataFrame:
    """(seq, edge_id, kind, source, target, error_code) of edges inserted one after the other by `seq`.

    An edge_id that is stored by then is DuplicateRelationEdge, a transition
    that closes a cycle of stored ones TransitionCycle; neither is stored, so a
    refused edge's id is free for the next. What is refused depends on the
    order, so transitions are folded in it, by weak components (joined where an
    id repeats) that lie one after the other in sorted partitions; only those
    that may lie on a cycle are looked at one by one. All others close no cycle:
    only ids matter there. A component of more than `large` transitions first
    loses sources and sinks. Two rounds of that are made: more would only make
    what is folded smaller.
    """
    rows = edges.select("seq", "edge_id", "kind", "source", "target")
    inner = is_transition(F.col("kind")) & F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("seq").isNotNull()
    every = _linked(rows, inner)
    repeated = _repeated(every)
    placed = _placed(every, repeated)
    crowded = written(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("component"))
    if not crowded.isEmpty():
        held = written(placed.join(crowded, "component", "left_semi").select("seq", "source", "target"))
        core = cyclic_core(held, 2)
        off = held.join(core, "seq", "left_anti").select("seq", F.lit(True).alias("off"))
        # leads were found over the edges taken off, too: once more without them
        every = _linked(every.join(off, "seq", "left").select(*every.columns, "off"), F.col("lead").isNotNull() & F.col("off").isNull()).drop("off")
        repeated = _repeated(every)
        placed = _placed(every, repeated)
    n = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(n, "component").sortWithinPartitions("component", "seq")
    folded = ordered.select("*", _node("source").alias("a"), _node("target").alias("b")).mapInArrow(_folded, f"{_kinds(rows)}, error_code string")
    none = F.lit(None).cast("string").alias("error_code")
    if repeated.isEmpty():
        return folded.union(every.where("lead IS NULL").select(*rows.columns, none))
    folded = written(folded)
    taken = folded.where("error_code IS NULL").join(repeated, "edge_id", "left_semi").groupBy("edge_id").agg(F.min("seq").alias("taken"))
    rest = every.join(repeated.select(F.col("edge_id").alias("id"), "stored"), F.col("edge_id") == F.col("id"), "left").where("lead IS NULL OR seq >= stored")
    twice = code((F.col("seq") > F.col("stored")) | F.coalesce(F.col("seq") > F.col("taken"), F.lit(False)), "DuplicateRelationEdge")
    return folded.union(rest.join(taken, "edge_id", "left").select(*rows.columns, twice.alias("error_code")))


def cyclic_core(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges left when edges from nodes nothing leads to, and to nodes that lead nowhere, are taken off, `rounds` times or until none is: empty then for an acyclic graph."""
    now = written(edges)
    n = now.count()
    while n and rounds != 0:
        rounds = rounds if rounds is None else rounds - 1
        sources, targets = now.select(F.col("source").alias("x")).distinct(), now.select(F.col("target").alias("x")).distinct()
        both = sources.join(targets, "x")
        left = now.join(both, now["source"] == both["x"], "left_semi").join(both.withColumnRenamed("x", "y"), F.col("target") == F.col("y"), "left_semi")
        following = written(left)
        m = following.count()
        drop_written(now)
        now = following
        if m == n:
            break
        n = m
    return now


def counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(is_transition(F.col("kind"))).alias("transitions"))


def by_evidence(edges: DataFrame, status: str = "evidence_status") -> DataFrame:
    """Observed and inferred edges, counted apart."""
    return edges.groupBy(status).agg(F.count(F.lit(1)).alias("n"))

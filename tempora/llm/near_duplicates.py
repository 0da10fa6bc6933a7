"""Near duplicates: b-bit minhash signatures in a multi-index Hamming join, links confirmed on full shingle sets.

A signature has K symbols, each the low bits of one minhash.  Documents at the
similarity threshold differ in about (1 - similarity) * K symbols; `radius` is
the count that they exceed with a chance of under MISS.  The signature is cut
into more than radius / 2 chunks, so by the pigeonhole principle two signatures
within the radius have a chunk with one wrong symbol at most, and they share
the chunk's key with that symbol left out: every such pair meets in a bucket.

Equal shingle sets are one class from the start.  In a bucket each class is
first held against one leader, so a group of near copies falls together in as
many comparisons as it has members; then signatures of classes that are still apart
are compared within the buckets, a large one block by block, and where some lie
within the radius, the full sets of their rows meet in the same blocks.  A task
gives each of its linked rows once, with one of those that it reaches, so a
group makes no more rows than it has members.  No pair is left out and no bucket is cut off.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..tables import drop_written, written
from . import words as W
from .frames import if_small, map_texts, releasing

#: Symbols of a signature that are indexed, of 32 bits, and those of 8 bits that only measure.
K, FINE = 48, 464
#: Rows of a bucket that meet in one task: a larger bucket is compared block by block.
BLOCK = 512
#: Members of sets that a task counts at a time.
MEMBERS = 2_048
#: Chance that a pair at the threshold differs in more than `radius` symbols.
MISS = 1e-6
#: Times that classes are held against their buckets' leaders.
ROUNDS = 3
_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(0, 1 << 64, K + FINE, dtype=np.uint64) | np.uint64(1)


def radius(similarity: float, k: int = K, miss: float = MISS) -> int:
    """The smallest r for which P(Binomial(k, 1 - similarity) > r) < miss."""
    p, r, left = 1 - similarity, 0, 1.0
    while r < k:
        left -= math.comb(k, r) * p**r * (1 - p) ** (k - r)
        if left < miss:
            break
        r += 1
    return r


def chunks(r: int, k: int = K) -> list[range]:
    """More than r / 2 chunks of the k symbols, of nearly equal sizes and two symbols at least."""
    m = r // 2 + 1
    if k < 2 * m:
        raise ValueError(f"{k} symbols are too few for a radius of {r}")
    edges = [k * i // m for i in range(m + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's shingles and where each text's start.

    A text with fewer words than `size` has its whole sequence as one shingle, a text without words has none.
    """
    w = W.words(texts, W.SPACED, True)
    h, inside = w.windows(size)
    owner = w.owner
    at = np.flatnonzero(inside)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    own = [W.rolling(w.hash[w.first[i] : w.first[i + 1]], int(w.counts[i]))[0] for i in short]
    h = np.concatenate([h[at], np.array(own, np.uint64)])
    owner = np.concatenate([owner[at], short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bytes of K 32-bit and FINE 8-bit symbols for each set that isn't empty."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), K), np.uint32)
    fine = np.empty((len(starts), FINE), np.uint8)
    if len(starts):
        order = np.empty_like(h)
        for k in range(K + FINE):
            np.multiply(h, _A[k], out=order)
            low = W.mixed(np.minimum.reduceat(order, starts))
            if k < K:
                out[:, k] = low & np.uint64(0xFFFFFFFF)
            else:
                fine[:, k - K] = low & np.uint64(0xFF)
    return np.concatenate([out.view(np.uint8).reshape(len(starts), -1), fine], axis=1)


def parts_of(signature: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The indexed and the measuring symbols of signatures."""
    raw = np.frombuffer(b"".join(signature), np.uint8).reshape(len(signature), -1)
    return np.ascontiguousarray(raw[:, : 4 * K]).view(np.uint32), raw[:, 4 * K :]


def digests(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """A digest of each set, null for an empty one."""
    n = np.diff(first)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(W.mixed(h), dtype=np.uint64)])
    digest = W.mixed(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return pa.array(digest.astype(np.int64), pa.int64(), mask=n == 0)


def _describe(size: int):
    def fn(texts: pa.Array) -> dict[str, pa.Array]:
        h, first = shingles(texts, size)
        n = np.diff(first)
        rows = iter(signatures(h, first))
        return {
            "n_shingles": pa.array(n, pa.int64()),
            "class": digests(h, first),
            "signature": pa.array([next(rows).tobytes() if x else None for x in n > 0], pa.binary()),
        }

    return fn


def index_keys(signature: np.ndarray, r: int) -> np.ndarray:
    """Each signature's keys: for every chunk and each symbol left out of it, the hash of the others."""
    out, k = np.empty(signature.shape, np.uint64), 0
    mixed = W.mixed(signature.astype(np.uint64) + np.arange(1, signature.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for chunk in chunks(r, signature.shape[1]):
        total = mixed[:, chunk].sum(axis=1, dtype=np.uint64)
        for j in chunk:
            out[:, k] = W.mixed(total - mixed[:, j] + np.uint64(j + 1))
            k += 1
    return out


def _bucketed(classes: DataFrame, r: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig, _ = parts_of(part["signature"].to_pylist())
                keys = index_keys(sig, r).astype(np.int64)
                yield pa.record_batch({"key": pa.array(keys.ravel()), "class": pa.array(np.repeat(part["class"].to_numpy(), K))})

    return classes.select("class", "signature").mapInArrow(run, "key bigint, class bigint")


def _within(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Of distinct pairs (a, b) of classes those within the radius of both kinds of symbols."""
    r, far = radius(similarity), radius(similarity, K + FINE)
    sig = classes.select("class", "signature")
    both = pairs.join(sig.select(F.col("class").alias("a"), F.col("signature").alias("x")), "a").join(sig.select(F.col("class").alias("b"), F.col("signature").alias("y")), "b")

    def run(batches):
        for batch in batches:
            (x, p), (y, q) = (parts_of(batch[c].to_pylist()) for c in ("x", "y"))
            d = (x != y).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array((d <= r) & (d + (p != q).sum(axis=1) <= far)))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _apart(members: DataFrame, classes: DataFrame, components: DataFrame, similarity: float) -> DataFrame:
    """(key, i, j, block, class): rows of blocks i and j of a bucket that have one of another component within the radius there.

    Buckets of one component are done with. The others' rows go to tasks by
    pairs of blocks of BLOCK rows; a task compares signatures, and a pair counts
    in the first bucket that it shares.
    """
    r, far = radius(similarity), radius(similarity, K + FINE)
    placed = members.select("key", "class").join(components.select(F.col("node").alias("class"), "component"), "class", "left").select("key", "class", F.coalesce("component", "class").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("class", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "class", "c", "block", other).select("key", "class", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(classes.select("class", "signature"), "class")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        own, c, block = (group[x].to_numpy() for x in ("class", "c", "block"))
        (x, p), key = parts_of(group["signature"].to_pylist()), np.uint64(group["key"][0].as_py() & 0xFFFFFFFFFFFFFFFF)
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        near, keys = np.zeros(len(own), bool), None
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for row in left:
            with_ = right[(c[right] != c[row]) & ((own[right] > own[row]) if i == j else True)]
            if not len(with_):
                continue
            d = (x[with_] != x[row]).sum(axis=1)
            with_, d = with_[d <= r], d[d <= r]
            with_ = with_[d + (p[with_] != p[row]).sum(axis=1) <= far]
            if len(with_):
                keys = index_keys(x, r) if keys is None else keys
                first = (keys[with_] == keys[row]).argmax(axis=1)
                with_ = with_[keys[row][first] == key]
                near[with_] = True
                near[row] |= len(with_) > 0
        return group.select(["key", "i", "j", "block", "class"]).filter(pa.array(near))

    return rows.groupBy("key", "i", "j").applyInArrow(run, "key bigint, i int, j int, block int, class bigint")


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many members the sets at places `left` share with those at places `right`: a product of their incidence matrices, MEMBERS members at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    member = np.unique(np.concatenate(sets), return_inverse=True)[1]
    shared = np.bincount(member)[member] > 1
    owner, member = owner[shared], np.unique(member[shared], return_inverse=True)[1]
    order = np.argsort(member, kind="stable")
    owner, member = owner[order], member[order]
    for at in range(0, int(member[-1]) + 1 if len(member) else 0, MEMBERS):
        a, b = np.searchsorted(member, (at, at + MEMBERS))
        x = np.zeros((len(sets), MEMBERS), np.float32)
        x[owner[a:b], member[a:b] - at] = 1
        out += x[left] @ x[right].T
    return out.astype(np.int64)


def _linked(links: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Of n rows the smallest row that each reaches over links from `left` to `right`."""
    least, before = np.arange(n), None
    while before is None or (least != before).any():
        before = least.copy()
        if len(right):
            np.minimum.at(least, left, np.where(links, least[right][None, :], n).min(axis=1))
        if len(left):
            np.minimum.at(least, right, np.where(links, least[left][:, None], n).min(axis=0))
    return least


def _links(near: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): rows of a block pair with the smallest row that they reach there, by den * |intersection| >= num * |union| of full sets."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        own, block = (group[x].to_numpy() for x in ("class", "block"))
        rows = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
        left, right = (np.flatnonzero(block == group[x][0].as_py()) for x in ("i", "j"))
        size = np.array([len(x) for x in rows])
        both = common(rows, left, right)
        links = den * both >= num * (size[left][:, None] + size[right][None, :] - both)
        least = _linked(links, left, right, len(own))
        other = least != np.arange(len(own))
        return pa.table({"a": own[least[other]], "b": own[other]})

    return near.join(sets, "class").groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets have den * |intersection| >= num * |union|."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("a", "b").join(sets.select(F.col("class").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("hashes").alias("y")), "b")
    return both.mapInArrow(releasing(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, class, component, component_id, kept) of each row: components of documents linked at den * |intersection| >= num * |union|.

    A-Z are lower-cased, words are separated by white space, a shingle is
    `size` words (the whole text, where it has fewer).  Texts without words,
    empty or null, have no shingles, no class and no link, and are their own
    components.  Repeated rows are copies of each other.  component names a
    component (null: without a class), component_id is the smallest key
    reachable, a null key counting only where no other is; kept: it is the
    row's own, so repeated rows are both kept (keep_one() keeps one row).
    An empty table gives none.  Other columns are left to the caller.
    """
    similarity = num / den
    r = radius(similarity)
    base = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    described = written(map_texts(base, "text", _describe(size), {"n_shingles": "bigint", "class": "bigint", "signature": "binary"}, keep=["id"]))
    classes = written(described.where("class IS NOT NULL").groupBy("class", "signature").agg(F.min("id").alias("id")))

    keys = _bucketed(classes, r)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("lead")).where("n > 1")
    members = written(keys.join(shared, "key").select("key", "class", "lead"))

    # each class against that of its buckets' leaders with which it shares most buckets, ROUNDS times
    sets = written(_sets_of(base, classes, members, size))
    led = written(members.where("class <> lead").groupBy("class", "lead").agg(F.count(F.lit(1)).alias("n")))
    links, known = None, None
    for _ in range(ROUNDS):
        open_ = led
        if known is not None:
            near, far = (known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_at")) for c in ("class", "lead"))
            open_ = led.join(near, "class", "left").join(far, "lead", "left").where("coalesce(class_at, class) <> coalesce(lead_at, lead)")
        nearest = open_.groupBy(F.col("class").alias("b")).agg(F.max(F.struct("n", "lead"))["lead"].alias("a")).select("a", "b")
        found = written(_confirmed(_within(nearest, classes, similarity), sets, num, den))
        links = found if links is None else links.union(found)
        before, known = known, written(connected_components(links, "a", "b"))
        drop_written(*([before] if before is not None else []))
    drop_written(led)

    # what is still apart
    near = written(_apart(members, classes, known, similarity))
    drop_written(members)
    more = written(_links(near, sets, num, den))
    drop_written(near, sets)
    components = connected_components(links.union(more), "a", "b")
    of_class = classes.select("class", "id").join(components.select(F.col("node").alias("class"), "component"), "class", "left").select("class", "id", F.coalesce("component", "class").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("id").alias("component_id"))
    named = of_class.join(smallest, "component").select("class", "component", "component_id")
    out = described.select("id", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(key), "n_shingles", "class", "component", component.alias("component_id"))
    result = written(out.withColumn("kept", F.col(f"`{key}`").eqNullSafe(F.col("component_id"))))
    drop_written(described, classes, known)
    return result


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` of which one of each component stays, as near_duplicates() finds them: that of the smallest key, a null key last.

    Rows count, not keys: of rows that repeat a key and text one stays, and a
    key that stands on other texts too loses only the rows that are copies.
    Rows of one key and one set of shingles go by their text.  Texts without
    words stay.  Columns named __class, __k and __c must not be in `docs`.
    """
    found = written(near_duplicates(docs.select(key, text), key, text, size, num, den).where("class IS NOT NULL").groupBy("component", F.col(key).alias("k"), "class").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("k").isNull().alias("none"), "k", "class")
    best = found.groupBy("component").agg(F.min(order).alias("best"))
    judged = written(found.join(best, "component").select(F.col("k").alias("__k"), F.col("class").alias("__c"), (order.eqNullSafe(F.col("best"))).alias("stays"), "n"))
    placed = map_texts(docs, text, _digest_of(size), {"__class": "bigint"})
    same = lambda t: (F.col(f"`{key}`").eqNullSafe(t["__k"])) & (F.col("__class") == t["__c"])
    gone, often = (if_small(written(judged.where(x).select("__k", "__c"))) for x in ("NOT stays", "stays AND n > 1"))
    drop_written(found, judged)
    left = placed.join(gone, same(gone), "left_anti")
    single = left.join(often, same(often), "left_anti").select(*docs.columns)
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = left.join(often, same(often), "left_semi").groupBy(F.col(f"`{key}`").alias("__k"), "__class").agg(F.min_by(rows, F.col(f"`{text}`")).alias("row"))
    return single.union(first.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def _digest_of(size: int):
    return lambda texts: {"__class": digests(*shingles(texts, size))}


def _sets_of(base: DataFrame, classes: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(class, hashes): the full set of each class of a shared bucket, as sorted 64-bit hashes of its shingles."""
    wanted = written(classes.join(members.select("class").distinct(), "class", "left_semi").select(F.col("class").alias("wanted"), "id"))
    wanted = if_small(wanted)
    fields = {"class": "bigint", "hashes": "binary"}
    # an id may stand on rows of several classes
    named = map_texts(base.join(wanted, "id").select("wanted", "text"), "text", _set_of(size), fields, keep=["wanted"]).where("class = wanted").select("class", "hashes")
    nameless = map_texts(base.where("id IS NULL"), "text", _set_of(size), fields, keep=[]).where("class IS NOT NULL")
    every = named.union(nameless.join(wanted.where("id IS NULL"), nameless["class"] == wanted["wanted"]).select("class", "hashes"))
    return every.groupBy("class").agg(F.first("hashes").alias("hashes"))


def _set_of(size: int):
    def fn(texts: pa.Array) -> dict[str, pa.Array]:
        h, first = shingles(texts, size)
        rows = [h[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
        return {"class": digests(h, first), "hashes": pa.array(rows, pa.binary())}

    return fn

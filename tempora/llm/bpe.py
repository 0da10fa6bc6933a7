"""Byte-level BPE in Spark: ranked merges folded by higher-order functions.

A text is split as by the tokenizer's pattern.  Each task keeps the distinct
words it has met (a bounded dictionary, started anew when full), so a word is
folded once a task and not once an occurrence; the fold is a Spark
``aggregate`` over the word's bytes, which looks pairs up in a rank map.
No step shuffles, so cost is linear in the text and a lost executor costs only
its own splits.  The ids are written to the shared folder as they are made: the
one plan that reads the map is gone before anything reads them.

Spark's own map lookup walks the map from its start, so the map is held as
arrays, the rows of its table of pairs laid over each other: three array reads
find a pair.  A task lays them out as a table of one row, which the plan reads by
a scalar subquery: as a literal of millions of characters, the map took the
driver hundreds of MB, a copy for each time that the plan is rewritten or sent.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written
from .dictionary import CODED, LONG, Dictionary, assembled, with_codes
from .frames import releasing

#: Words of more bytes than this are merged with a heap in a Python worker: a
#: fold costs the square of the word's length, a heap n log n.
MAX_FOLD_BYTES = LONG
#: The least rank of a pair that no merge joins.
NONE = 1 << 20
#: How often 64 places are drawn for a row of the rank map before it goes behind all others.
TRIES = 200
#: Documents decoded at a time in a worker.
ROWS = 500


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: a line has a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def pair_map(path: str) -> dict[int, int]:
    """(left id, right id), packed as left << 20 | right, to the merged id."""
    return _pairs(path)


def _pairs(path: str) -> dict[int, int]:
    ranks = load_ranks(path)
    if max(ranks.values()) >= 1 << 20:
        raise ValueError("ranks of 2**20 or more aren't supported")
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks the bytes {missing}")
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                out[a << 20 | b] = rank
    return out


def displaced_rows(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """The sparse table left x right -> merged, its rows laid over each other in one array: where each row starts, and the cells.

    The pair (a, b) is in cell ``start[a] + b``, which holds a << 20 | merged;
    another's cell, or a free one, differs above the lower 20 bits.
    Large rows are laid first, each where all its cells are free: at the first
    such place of a fixed series of random ones, or, if many of them are taken,
    behind all others; rows of one cell at the first free one.
    """
    rows: dict[int, list[int]] = {}
    for key in pairs:
        rows.setdefault(key >> 20, []).append(key & 0xFFFFF)
    n = 1 + max(max(rows), max(map(max, rows.values())))
    room = 2 * len(pairs) + 16
    taken, start = np.zeros(n + room, bool), [0] * n
    cells = np.full(n + room, n << 20, np.int64)
    places = np.random.Generator(np.random.PCG64(5))
    free = None
    for left in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        own = np.array(rows[left])
        if len(own) > 1:
            at = room + n
            for _ in range(TRIES):
                some = places.integers(room, size=64)
                fits = ~taken[some[:, None] + own].any(axis=1)
                if fits.any():
                    at = int(some[fits.argmax()])
                    break
            else:
                taken, cells = np.append(taken, np.zeros(n, bool)), np.append(cells, np.full(n, n << 20))
                room += n
        else:
            free = iter(np.flatnonzero(~taken).tolist()) if free is None else free
            at = next(free) - int(own[0])
        start[left], taken[own + at] = at, True
        cells[own + at] = [left << 20 | pairs[left << 20 | int(b)] for b in own]
    return start, cells.tolist()


def _tables(path: str) -> dict[str, list[int]]:
    ranks, (start, cells) = load_ranks(path), displaced_rows(_pairs(path))
    return {"bytes": [ranks[bytes([b])] for b in range(256)], "start": start, "cells": cells}


def rank_map(spark: SparkSession, path: str) -> DataFrame:
    """The rank map, a written table of one row with a struct of arrays, laid out by a task. Its size is the vocabulary's."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({k: pa.array([v], pa.list_(pa.int64())) for k, v in _tables(path).items()})

    arrays = spark.range(0, 1, 1, 1).mapInArrow(releasing(run), "bytes array<bigint>, start array<bigint>, cells array<bigint>")
    return written(arrays.select(F.struct("bytes", "start", "cells").alias("ranks")))


def with_ids(df: DataFrame, words: str, ids: str, path: str) -> DataFrame:
    """`df` with the ids of each word of an array; null for words over MAX_FOLD_BYTES.

    An array of one names the rank map, so that the plan reads it once; a subquery may
    stand beside a higher-order function, not in it, and Spark then puts both in one step.
    """
    fold = lambda ranks: F.transform(F.col(words), lambda w: F.when(F.octet_length(w) <= MAX_FOLD_BYTES, fold_word(w, ranks)))
    named = df.withColumn("__ranks", rank_map(df.sparkSession, path).scalar())
    return named.select(*[F.col(f"`{c}`") for c in df.columns], F.get(F.transform(F.array("__ranks"), fold), 0).alias(ids))


def fold_word(word: Column, ranks: Column) -> Column:
    """The ids of a word of text (empty: none): its bytes' ids, of which the lowest-ranked pair is merged, the leftmost first, until none is left.

    A place of the fold's array holds the rank of the pair that starts there
    (NONE or more without a merge) over 20 bits of its own id, so a step looks
    up only the two pairs it makes, and the array's least value is the next pair.
    """
    n = F.octet_length(word)

    def place(left: Column, right: Column) -> Column:
        found = F.get(ranks["cells"], (F.get(ranks["start"], left.cast("int")) + right).cast("int"))
        rank = F.coalesce(found.bitwiseXOR(F.shiftleft(left, 20)), F.lit(NONE))
        return F.shiftleft(rank, 20).bitwiseOR(left)

    def own(at: Column) -> Column:
        return at.bitwiseAND(F.lit(0xFFFFF))

    def step(state: Column, _: Column) -> Column:
        places, at, best = state["places"], state["at"], state["best"]

        def merged(x: Column, i: Column) -> Column:
            after = F.when(i == at, place(best, own(F.get(places, at + 2)))).when(i == at + 1, F.lit(-1).cast("bigint")).otherwise(place(own(x), best))
            return F.when(F.abs(i - at) > 1, x).otherwise(after)

        return F.when(best >= NONE, state).otherwise(_state(F.array_remove(F.transform(places, merged), F.lit(-1).cast("bigint"))))

    bytes_ = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    ids = F.transform(F.sequence(F.lit(1), n), lambda at: F.get(ranks["bytes"], F.ascii(F.substring(bytes_, at, F.lit(1)))))
    first = F.get(F.transform(F.array(ids), lambda ids: _state(F.transform(ids, lambda left, i: place(left, F.get(ids, i + 1))))), 0)
    none = F.array().cast("array<int>")
    return F.when(n == 0, none).otherwise(F.aggregate(F.sequence(F.lit(1), n), first, step, lambda s: F.transform(s["places"], lambda x: own(x).cast("int"))))


def _state(places: Column) -> Column:
    """The places, where the next pair to merge stands (from 0) and its rank."""
    least = lambda p: F.array_min(p)
    return F.get(F.transform(F.array(places), lambda p: F.struct(p.alias("places"), (F.array_position(p, least(p)) - 1).cast("int").alias("at"), F.shiftright(least(p), 20).alias("best"))), 0)


def heap_merge(word: bytes, path: str) -> list[int]:
    """The ids of a word, as fold_word's, in n log n."""
    pairs, ranks = pair_map(path), load_ranks(path)
    ids = [ranks[bytes([b])] for b in word]
    n = len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else -1
        if j < 0 or ids[j] != b:
            continue  # merged meanwhile
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (r := pairs.get(ids[left] << 20 | ids[right])) is not None:
                heapq.heappush(heap, (r, left, ids[left], ids[right]))
    return [x for x in ids if x >= 0]


def _folded(docs: DataFrame, path: str, text: str, keep: list[str] | None, *replaced: str):
    """`docs` with words' numbers and the ids of new words; a function from its batches to those of `kept` and ids; kept."""
    coded = with_codes(docs, text, keep, *replaced)
    folded = with_ids(coded, "__new", "__new_ids", path).drop("__new")
    kept = [c for c in folded.columns if c not in (*CODED, "__new_ids")]

    def run(batches):
        known = Dictionary()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cut = [0, *(i for i, x in enumerate(table["__anew"].to_pylist()) if x and i), table.num_rows]
            for a, b in zip(cut, cut[1:], strict=False):
                part = table.slice(a, b - a).combine_chunks()
                if part["__anew"][0].as_py():
                    known = Dictionary()
                new, long = part["__new_ids"].chunk(0).flatten(), part["__long"].chunk(0).flatten().to_pylist()
                if new.null_count:
                    rest = iter(long)
                    new = pa.array([x if x is not None else heap_merge(next(rest).encode(), path) for x in new.to_pylist()], pa.list_(pa.int32()))
                known.add(new.flatten().to_numpy(zero_copy_only=False).astype(np.int32), pc.list_value_length(new).to_numpy(zero_copy_only=False).astype(np.int64))
                codes = part["__codes"].chunk(0)
                values = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), codes), b"")[0].as_buffer(), np.int32)
                for at, ids in assembled(values, pc.binary_length(codes).to_numpy() // 4, known):
                    yield pa.record_batch([*(part[c].chunk(0).slice(at, len(ids)) for c in kept), ids], names=[*kept, "ids"])

    return folded, run, kept


def _fields(df: DataFrame, kept: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (None: all) and `ids`, those of the whole text by the rank file at `path` (on every node).

    Null or empty texts have no ids.  Special tokens' strings are ordinary
    text.  Repeated rows are encoded each; a column named ids is replaced.
    """
    folded, run, kept = _folded(docs, path, text, keep, "ids")
    return written(folded.mapInArrow(releasing(run), ", ".join([*_fields(folded, kept), "ids array<int>"])))


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As encode(), and `decoded`, the bytes that decode() gives for the ids, in the worker that has put them together."""
    folded, run, kept = _folded(docs, path, text, keep, "ids", "decoded")
    both = lambda batches: decoded_batches(run(batches), path, [*kept, "ids"])
    return written(folded.mapInArrow(releasing(both), ", ".join([*_fields(folded, kept), "ids array<int>, decoded binary"])))


def decoded_batches(batches: Iterable[pa.RecordBatch], path: str, kept: list[str], ids: str = "ids", to: str = "decoded") -> Iterator[pa.RecordBatch]:
    """`kept` of each batch and the bytes of its ids, a few rows at a time."""
    ranks = load_ranks(path)
    pieces = [b""] * (max(ranks.values()) + 2)
    for token, rank in ranks.items():
        pieces[rank] = token
    pieces = pa.array(pieces, pa.binary())
    none = len(pieces) - 1
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            lists = part[ids]
            own = lists.flatten().fill_null(none).to_numpy(zero_copy_only=False)
            own = np.where((own < 0) | (own > none), none, own)
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, pieces.take(pa.array(own))), b"")
            yield pa.record_batch([*(part[c] for c in kept), joined], names=[*kept, to])


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its ids: the vocabulary's pieces, one after the other.

    No ids, or null, are no bytes; an id that is null or outside the vocabulary adds none.
    """
    kept = [c for c in encoded.columns if c != to]
    source = encoded.select(*[F.col(f"`{c}`") for c in kept])
    return source.mapInArrow(releasing(lambda batches: decoded_batches(batches, path, kept, ids, to)), ", ".join([*_fields(source, kept), f"`{to}` binary"]))


def digests(docs: DataFrame, path: str, key: str, text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row: digests of the decimal ids of its text, joined by commas, and of the bytes that the ids decode to.

    Null or empty texts have no ids; repeated rows and null keys stay as they are.
    """
    folded, run, kept = _folded(docs, path, text, [key])

    def digest(batches):
        numbers = pa.array([str(i) for i in range(max(load_ranks(path).values()) + 1)])
        for part in decoded_batches(run(batches), path, [key, "ids"]):
            lists = part["ids"]
            offsets = pc.cast(lists.offsets, pa.int64()).to_numpy() - lists.offsets[0].as_py()
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), numbers.take(lists.flatten())), ",")
            sha = [[hashlib.sha256(x.as_buffer()).hexdigest() for x in column] for column in (texts, part["decoded"])]
            yield pa.record_batch([part[key], pa.array(np.diff(offsets)), *map(pa.array, sha)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return written(folded.mapInArrow(releasing(digest), ", ".join([*_fields(folded, kept), "n_tokens bigint, ids_sha256 string, decoded_sha256 string"])))

"""Substring dedup: every word inside a run of SPAN words that starts anywhere else goes.

Anchors are hashes of runs of SPAN - PERIOD + 1 words at the positions that a
difference cover modulo PERIOD selects: two equal runs of SPAN words, wherever
they stand, have a shift under PERIOD at which both have an anchor, and these
anchors are equal.  So only runs that contain a repeated anchor are extended
to SPAN words and compared.

Documents are dealt to blocks of bounded size.  A block sends each hash once
(sorted, by ranges of hash values), the ranges' tasks answer a bit for each,
and so neither a passage in a third of all documents nor a group of copies
makes more rows than there are blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .frames import n_blocks

SPAN = 35
PERIOD = 21
#: A perfect difference set modulo 21: every difference is one of two members.
COVER = (3, 6, 7, 12, 14)
#: Words put together at a time.
WORDS = 100_000
#: Blocks of documents for a range of hash values.
BLOCKS_A_RANGE = 6
_ASK = "block int, part int, kind string, hashes binary, twice binary"
_ANSWER = "block int, part int, kind string, n int, bits binary"


class _Block:
    """A block's words, anchors and candidate runs."""

    def __init__(self, texts: pa.ChunkedArray, span: int):
        self.span = span
        self.words = w = W.words_of(texts)
        n = len(w)
        size = span - PERIOD + 1
        self.runs, self.whole = w.windows(span)
        anchors, inside = w.windows(size)
        place = np.arange(len(anchors)) - np.repeat(w.first[:-1], w.counts)[: len(anchors)]
        chosen = np.zeros(PERIOD, bool)
        chosen[list(COVER)] = True
        # a text without a whole run has no use for anchors
        long = np.repeat(w.counts >= span, w.counts)[: len(anchors)]
        self.at = np.flatnonzero(chosen[place % PERIOD] & inside & long) if len(anchors) else np.zeros(0, np.int64)
        self.anchors, self.n = anchors[self.at], n

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Places of whole runs with a repeated anchor; repeated: of each anchor."""
        mark = np.zeros(self.n + 1, np.int64)
        mark[self.at[repeated] + 1] = 1
        mark = np.cumsum(mark)
        i = np.flatnonzero(self.whole)
        return i[mark[i + PERIOD] > mark[i]]

    def covered(self, starts: np.ndarray) -> np.ndarray:
        mark = np.zeros(self.n + 1, np.int64)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + self.span, -1)
        return np.cumsum(mark[:-1]) > 0


def _ask(block: int, kind: str, hashes: np.ndarray, parts: int) -> pa.Table:
    own, counts = np.unique(hashes, return_counts=True)
    edges = np.searchsorted(own, _bounds(parts))
    rows = [(p, a, b) for p, (a, b) in enumerate(zip(edges, [*edges[1:], len(own)], strict=True)) if b > a]
    return pa.table(
        {
            "block": pa.array([block] * len(rows), pa.int32()),
            "part": pa.array([p for p, _, _ in rows], pa.int32()),
            "kind": pa.array([kind] * len(rows), pa.string()),
            "hashes": pa.array([own[a:b].tobytes() for _, a, b in rows], pa.binary()),
            "twice": pa.array([np.packbits(counts[a:b] > 1).tobytes() for _, a, b in rows], pa.binary()),
        }
    )


def _bounds(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)


def answer(table: pa.Table) -> pa.Table:
    """For each block's hashes of a range: whether they stand in another block too, or twice in this one."""
    own = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(table["twice"].to_pylist(), own, strict=True)]
    every = np.sort(np.concatenate(own))
    repeated = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[h[t] for h, t in zip(own, twice, strict=True)]]))
    bits = [np.packbits(_in(h, repeated)).tobytes() for h in own]
    return table.select(["block", "part", "kind"]).append_column("n", pa.array([len(h) for h in own], pa.int32())).append_column("bits", pa.array(bits, pa.binary()))


def _in(h: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(among, h), len(among) - 1)
    return among[at] == h


def _told(table: pa.Table, kind: str, hashes: np.ndarray) -> np.ndarray:
    """The answers for the hashes, each of which the block had asked for."""
    own = np.unique(hashes)
    rows = sorted((p, n, b) for p, k, n, b in zip(*(table[c].to_pylist() for c in ("part", "kind", "n", "bits")), strict=True) if k == kind)
    bits = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for _, n, b in rows]])
    if len(bits) != len(own):
        raise ValueError(f"a block asked for {len(own)} hashes and got {len(bits)} answers")
    return bits[np.searchsorted(own, hashes)]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, blocks: int | None = None) -> DataFrame:
    """`docs` with n_words, n_removed and kept_text: the words that no repeated run of `span` words covers, joined by a space.

    Words are as they stand, case included.  Null or empty texts have no words
    and the kept text ''.  Repeated rows are documents of their own and repeat
    each other.  `key` only deals rows to blocks; it may repeat or be null.
    Columns of the result's names are replaced, others stay.
    """
    if span < PERIOD + 4:
        raise ValueError(f"span must be {PERIOD + 4} or more")
    blocks = blocks or n_blocks(docs, text)
    parts = -(-blocks // BLOCKS_A_RANGE)
    new = ("n_words", "n_removed", "kept_text", "block")
    kept = [c for c in docs.columns if c not in new]
    source = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("string")), F.lit(blocks)).cast("int").alias("block"),  # a key may stand on many texts
        *[F.col(f"`{c}`") for c in kept],
        F.col(f"`{text}`").cast("string").alias("__text"),
    )
    dealt = source.groupBy("block")

    def anchors(group: pa.Table) -> pa.Table:
        return _ask(group["block"][0].as_py(), "anchor", _Block(group["__text"], span).anchors, parts)

    first = dealt.applyInArrow(anchors, _ASK).groupBy("part").applyInArrow(answer, _ANSWER)

    def runs(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            raise ValueError("answers without a block")
        b = _Block(group["__text"], span)
        return _ask(group["block"][0].as_py(), "run", b.runs[b.candidates(_told(told, "anchor", b.anchors))], parts)

    second = dealt.cogroup(first.groupBy("block")).applyInArrow(runs, _ASK).groupBy("part").applyInArrow(answer, _ANSWER)

    def result(group: pa.Table, told: pa.Table) -> pa.Table:
        b = _Block(group["__text"], span)
        at = b.candidates(_told(told, "anchor", b.anchors))
        gone = b.covered(at[_told(told, "run", b.runs[at])])
        w = b.words
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
        out = group.select(kept).append_column("n_words", pa.array(w.counts, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
        return out.append_column("kept_text", kept_texts(w, ~gone))

    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept), "n_words bigint", "n_removed bigint", "kept_text string"])
    return dealt.cogroup(first.union(second).groupBy("block")).applyInArrow(result, schema)


def kept_texts(w: W.Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by a space."""
    out, at, n = [pa.array([], pa.string())], 0, len(w.counts)
    while at < n:
        end = max(at + 1, int(np.searchsorted(w.first, w.first[at] + WORDS, side="right")) - 1)
        out.append(_joined(w, keep, at, end))
        at = end
    return pa.concat_arrays(out)


def _joined(w: W.Words, keep: np.ndarray, at: int, end: int) -> pa.Array:
    i = w.first[at] + np.flatnonzero(keep[w.first[at] : w.first[end]])
    length = w.end[i] - w.start[i]
    text = np.searchsorted(w.first[at : end + 1], i, side="right") - 1
    last = np.ones(len(i), bool)
    last[:-1] = text[1:] != text[:-1]
    data = np.full(int(length.sum()) + len(i), 0x20, np.uint8)
    to = np.cumsum(length + 1) - (length + 1)
    data[W.ragged(to, length)] = w.data[W.ragged(w.start[i], length)]
    data = np.delete(data, (to + length)[last])  # no space after a text's last word
    size = np.bincount(text, weights=length + 1 - last, minlength=end - at).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), end - at, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

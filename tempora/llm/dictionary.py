"""Texts as sequences of distinct words, for encoders whose result for a word doesn't depend on its neighbours."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .frames import releasing
from .pieces import Kinds, split, tiktoken_kinds

#: Distinct words, and their characters, that a task or worker remembers before it starts its dictionary anew.
MAX_WORDS, MAX_CHARACTERS = 600_000, 30_000_000
#: Bytes of text handled at a time, and ids put together at a time.
TEXT_BYTES, IDS = 2_000_000, 500_000
#: The columns that with_codes() adds.
CODED = ("__codes", "__new", "__long", "__anew")
#: Words of more bytes also go into __long.
LONG = 512


class Coder:
    """Numbers words as they first come."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.characters = 0

    def code(self, words: pa.Array) -> tuple[np.ndarray, list[str], bool]:
        """The words' numbers, the words that are new, and whether the numbers begin anew."""
        coded = words.dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        anew = len(self.known) > MAX_WORDS or self.characters > MAX_CHARACTERS
        if anew:
            self.known, self.characters = {}, 0
        known, n = self.known, len(self.known)
        number = np.fromiter(map(known.get, own, itertools.repeat(-1)), np.int32, len(own))
        fresh = np.flatnonzero(number < 0)
        new = [own[i] for i in fresh.tolist()]
        number[fresh] = np.arange(n, n + len(new))
        known.update(zip(new, range(n, n + len(new)), strict=True))
        self.characters += sum(map(len, new))
        return number[coded.indices.to_numpy(zero_copy_only=False)], new, anew


def coded_batches(batches: Iterable[pa.RecordBatch], text: str, kinds: Kinds, added: Sequence[str] = (), coder: Coder | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[str], bool]]:
    """Of a few rows at a time: the rows, the numbers of their words, how many words each has, the words first met here, and whether the numbers begin anew.

    A number is a word's place in the list of all new words up to and with
    these, since the numbers began anew.  coder: one that knows words already.
    """
    coder = coder or Coder()
    for batch in batches:
        for at, texts in W.pieces(batch[text], TEXT_BYTES):
            words, counts = split(texts, kinds, added)
            codes, new, anew = coder.code(words)
            yield batch.slice(at, len(texts)), codes, counts, new, anew


def with_codes(docs: DataFrame, text: str, keep: list[str] | None, *replaced: str) -> DataFrame:
    """The columns `keep` (None: all, but `replaced`), the text's words, as tiktoken cuts them, as __codes (32-bit numbers), and on some rows the words first met there.

    A row's numbers are places in the list of all __new words of its task up to
    and with its own, since the last row with __anew.  A null text has no words.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in replaced]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for part, codes, counts, new, anew in coded_batches(batches, "__text", tiktoken_kinds()):
            n = part.num_rows
            ends = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(codes)])
            long = [w for w in new if len(w) * 4 > LONG and len(w.encode()) > LONG]
            lists = (pa.array([x, *[[]] * (n - 1)], pa.list_(pa.string())) for x in (new, long))
            yield pa.record_batch([*(part[c] for c in kept), binary, *lists, pa.array([anew, *[False] * (n - 1)])], names=[*kept, *CODED])

    fields = [*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept), "__codes binary, __new array<string>, __long array<string>, __anew boolean"]
    return source.mapInArrow(releasing(run), ", ".join(fields))


class Dictionary:
    """The ids of numbered words."""

    def __init__(self):
        self.ids, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, length: np.ndarray) -> None:
        """The ids of the next words, one after the other, and how many each has."""
        if not len(length):
            return
        first = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, ids])
        self.start, self.length = np.concatenate([self.start, first]), np.concatenate([self.length, length])


def assembled(codes: np.ndarray, counts: np.ndarray, known: Dictionary, end: int | None = None) -> Iterator[tuple[int, pa.ListArray]]:
    """From which row on, and the ids of that and the following rows: those of their words (counts: how many) by `codes`; end: an id to put after each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + IDS // 3, side="right")) - 1)
        own = codes[offsets[at] : offsets[stop]]
        length = known.length[own]
        ids = known.ids[W.ragged(known.start[own], length)]
        ends = np.concatenate([[0], np.cumsum(length)])[offsets[at : stop + 1] - offsets[at]]
        if end is not None:
            ids = np.insert(ids, ends[1:], end)
            ends = ends + np.arange(len(ends))
        yield at, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
        at = stop

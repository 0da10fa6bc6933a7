"""Benchmark decontamination: Wu-Manber search for runs of benchmark words.

A pattern is a window of WINDOW consecutive words of an item (an item of fewer
words is one pattern).  Words, not bytes, are the search's symbols: a block is
two words, the shift table says for a block how far a pattern may still be, a
bucket of patterns is found by its last block, and the words themselves are
compared before an occurrence counts.

Patterns go to the workers in blocks of a bounded number of words, of which
the driver holds one at a time; documents pass one block after the other, and
between two blocks they are written with what was found so far. So nothing is
shuffled, and of the benchmark no more than a block is anywhere at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from . import words as W
from .frames import map_texts

WINDOW = 13
#: Words of the patterns of a block: the bound on what a task gets at once (about 100 MB).
BLOCK_WORDS = 2_600_000


class WuManber:
    """Patterns of one length over word hashes: shift table, suffix buckets, direct comparison."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        """patterns: words to the items that have them there."""
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[tuple[bytes, ...], list[str]]]] = {}
        flat = W.words(pa.array([" ".join(x.decode("utf-8", "surrogateescape") for x in p) for p in patterns], pa.string()), W.ALNUM)
        blocks = W.rolling(flat.hash, self.block) if len(flat) >= self.block else np.zeros(0, np.uint64)
        for k, (pattern, items) in enumerate(patterns.items()):
            first = int(flat.first[k])
            for j in range(self.far):
                h = int(blocks[first + j])
                self.shift[h] = min(self.shift.get(h, self.far), self.far - 1 - j)
            self.buckets.setdefault(int(blocks[first + self.far - 1]), []).append((pattern, items))

    def find(self, w: W.Words) -> Iterator[tuple[int, int, list[str]]]:
        """(text, first word's place, items) of each occurrence."""
        if len(w) < self.length:
            return
        blocks, shift, far, last = W.rolling(w.hash, self.block).tolist(), self.shift, self.far, self.length - self.block
        first = w.first.tolist()
        for text in range(len(first) - 1):
            at, end = first[text] + last, first[text + 1] - self.block
            while at <= end:  # at: the last block of the window
                skip = shift.get(blocks[at], far)
                if skip:
                    at += skip
                    continue
                start = at - last
                found = None
                for pattern, items in self.buckets[blocks[at]]:
                    if all(w.word(start + j) == x for j, x in enumerate(pattern)):
                        found = items if found is None else found + items
                if found is not None:
                    yield text, start, found
                at += 1


def patterns_of(item: str, text: str, window: int) -> Iterator[tuple[tuple[bytes, ...], str]]:
    w = W.words(pa.array([text], pa.string()), W.ALNUM, True)
    own = [w.word(i) for i in range(len(w))]
    size = min(window, len(own))
    if size:
        for i in range(len(own) - size + 1):
            yield tuple(own[i : i + size]), item


def pattern_blocks(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> Iterator[list[WuManber]]:
    """The benchmark's patterns by blocks of at most `most` words (one pattern at least), read one partition at a time."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("t IS NOT NULL")
    groups: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    n = 0
    for row in rows.toLocalIterator():
        for pattern, name in patterns_of(row.i, row.t, window):
            groups.setdefault(len(pattern), {}).setdefault(pattern, []).append(name)
            n += len(pattern)
            if n >= most:
                yield [WuManber(k, v) for k, v in sorted(groups.items())]
                groups, n = {}, 0
    if groups:
        yield [WuManber(k, v) for k, v in sorted(groups.items())]


def find_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """`docs` with n_words, n_hit, hit_starts and hit_ends (runs of hit words, the end excluded) and items (sorted ids).

    Null or empty texts have no words and no hits; items without words have no
    windows; an item id that is null counts as the id ''; equal items both
    count.  Columns of those names in `docs` are replaced, others stay.  A
    benchmark without rows leaves every document without hits.
    """
    names = ("hit_starts", "hit_ends", "items")
    fields = {"n_words": "bigint", "hit_starts": "array<int>", "hit_ends": "array<int>", "items": "array<string>"}
    extra = [c for c in docs.columns if c not in fields and c != "n_hit"]
    blocks = pattern_blocks(benchmark, item, item_text, window, block_words)
    out = map_texts(docs, text, _finder(next(blocks, [])), fields, keep=extra)
    for block in blocks:
        before = [F.col(c).alias(f"__{c}") for c in names]
        now = map_texts(written(out).select(*[F.col(f"`{c}`") for c in extra], *before), text, _finder(block), fields)
        out = now.select(*[F.col(f"`{c}`") for c in extra], "n_words", *_merged())
    covered = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_hit", covered)


def _merged() -> list[Column]:
    """What was found before (names with __) and now; runs may overlap."""
    pairs = [F.arrays_zip(F.col(f"{p}hit_starts").alias("s"), F.col(f"{p}hit_ends").alias("e")) for p in ("__", "")]
    runs = F.aggregate(F.array_sort(F.concat(*pairs)), F.array().cast("array<struct<s:int,e:int>>"), _join_run)
    items = F.array_sort(F.array_distinct(F.concat("__items", "items")))
    return [F.transform(runs, lambda r: r["s"]).alias("hit_starts"), F.transform(runs, lambda r: r["e"]).alias("hit_ends"), items.alias("items")]


def _join_run(runs: Column, r: Column) -> Column:
    last = F.try_element_at(runs, F.lit(-1))
    longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], r["e"]).alias("e"))
    apart = F.concat(runs, F.array(F.struct(r["s"].alias("s"), r["e"].alias("e"))))
    return F.when((F.size(runs) > 0) & (last["e"] >= r["s"]), F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer))).otherwise(apart)


def _finder(machines: list[WuManber]):
    def fn(texts: pa.Array) -> dict[str, pa.Array]:
        w = W.words(texts, W.ALNUM, True)
        cover = np.zeros(len(w) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for m in machines:
            for text, start, names in m.find(w):
                cover[start] += 1
                cover[start + m.length] -= 1
                items.setdefault(text, set()).update(names)
        hit = np.zeros(len(w) + 2, bool)
        hit[1:-1] = np.cumsum(cover[:-1]) > 0
        edge = hit[1:] != hit[:-1]
        edge[w.first] |= hit[1:][w.first] & hit[:-1][w.first]  # a run ends where its text does
        at = np.flatnonzero(edge)
        double = at[hit[1:][at] & hit[:-1][at]]
        at = np.sort(np.concatenate([at, double]))
        starts, ends = at[::2], at[1::2]
        text = np.searchsorted(w.first, starts, side="right") - 1
        offsets = np.searchsorted(text, np.arange(len(w.first))).astype(np.int32)
        base = w.first[text]
        lists = [sorted(items.get(i, ())) for i in range(len(texts))]
        return {
            "n_words": pa.array(w.counts, pa.int64()),
            "hit_starts": pa.ListArray.from_arrays(offsets, pa.array((starts - base).astype(np.int32))),
            "hit_ends": pa.ListArray.from_arrays(offsets, pa.array((ends - base).astype(np.int32))),
            "items": pa.array(lists, pa.list_(pa.string())),
        }

    return fn


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """A document with hits in a twentieth of its words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)

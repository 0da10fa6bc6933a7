"""Interpolated modified Kneser-Ney model of any order, counted in Spark and scored where its parts lie.

Documents are packed into blocks as numbered words; a block sends its distinct
words, and then its distinct n-grams of the highest order, once each to the
parts of the model that own them.  A part adds the blocks' counts to sorted
arrays in files that it memory-maps, answers every block from them, and is
gone; so neither the driver nor any worker ever holds the model, whose size
follows the corpus, and a word in a third of all places is a row of each block.

Rounds: words -> counts and global numbers, small for frequent words; n-grams,
from the highest order down to 3 -> counts and statistics of their contexts.
Three words belong to the part of the middle one, so that round knows how many
words stand before each two and answers these too.  Of a hot word (HOT times or
more) no part has everything: its threes are dealt by their first two words,
and its twos, of which the threes' parts send on what they have counted, in a
round of their own.  Last, words -> how many first words they follow, and the
statistics of the twos that they begin; scores.  Below the highest order a
count is that of different words in front (continuation); an n-gram at a
document's beginning has none in front and keeps its own count.
"""

from __future__ import annotations

import functools
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written
from . import words as W
from .frames import n_blocks, releasing

#: Bytes of text of a block.
BLOCK_TEXT = 10_000_000
#: Occurrences from which the n-grams around a word are dealt to several parts: about what a part has of other words together.
HOT = 2_000_000
#: The bit that marks a hot word's number.
_HOT = np.uint32(1 << 31)
#: The end of a document and what stands before its first word, as hashes of no word.
END = np.uint64(0xE7D0E7D0E7D0E7D0)
BEGIN = 0  # the number of the beginning; words' numbers start at 1
_MESSAGE = "block bigint, part int, kind string, data array<binary>"
_U = np.uint64


def is_held_out(key: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the key as text falls into the fold that isn't learnt from (a null key as '')."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def pack(a: np.ndarray) -> bytes:
    """An array's bytes, those of one weight together, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T))


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _messages(rows: list[tuple[int, int, str, list[bytes]]]) -> pa.Table:
    names, kinds = ("block", "part", "kind", "data"), (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.binary()))
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _of(table: pa.Table, kind: str) -> list[tuple[int, int, list[bytes]]]:
    own = table.filter(pc.equal(table["kind"], kind))
    return sorted(zip(*(own[c].to_pylist() for c in ("block", "part", "data")), strict=True), key=lambda r: r[:2])


class MappedArrays:
    """Sorted keys and their values in a file of this worker that is mapped and already unlinked."""

    def __init__(self, keys: np.ndarray, **values: np.ndarray):
        with tempfile.TemporaryFile() as f:
            parts, at = {"keys": keys, **values}, {}
            for name, a in parts.items():
                at[name] = (f.tell(), a.dtype, len(a))
                f.write(np.ascontiguousarray(a).data)
            f.flush()
            size = f.tell()
            view = mmap.mmap(f.fileno(), size, access=mmap.ACCESS_READ) if size else b""
        self.arrays = {name: np.frombuffer(view, dtype, n, offset) if n else np.zeros(0, dtype) for name, (offset, dtype, n) in at.items()}

    def get(self, keys: np.ndarray, *names: str) -> list[np.ndarray]:
        """The values of keys, 0 for those that aren't there."""
        own = self.arrays["keys"]
        if not len(own):
            return [np.zeros(len(keys), self.arrays[n].dtype) for n in names]
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        there = own[at] == keys
        return [np.where(there, self.arrays[n][at], 0).astype(self.arrays[n].dtype) for n in names]


def _bounds(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(parts)], dtype=_U)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and their counts added up, in whole numbers."""
    every = np.concatenate([np.zeros(0, keys[0].dtype if keys else _U), *keys])
    order = np.argsort(every)
    every, total = every[order], np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for x in counts)])[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    return every[first], np.add.reduceat(total, first) if len(first) else total


def _histogram(counts: np.ndarray) -> bytes:
    """How many are 1, 2, 3, 4; how many there are; their sum."""
    return np.array([*[(counts == k).sum() for k in (1, 2, 3, 4)], (counts > 0).sum(), counts.sum()], np.int64).tobytes()


# round 1


def _packed(parts: int, want: str):
    """Blocks of documents: want 'docs', their numbered words; or 'words', the distinct words for each part."""

    def block(number: int, texts: list[pa.Array], ids: list[pa.Array], held: list[pa.Array]):
        w = W.words_of(pa.chunked_array(texts), W.SPACED, True)
        stream = np.insert(w.hash, w.first[1:], END)
        length = w.counts + 1
        out = np.concatenate([x.to_numpy(zero_copy_only=False) for x in held])
        if want == "docs":
            at, inverse = _distinct(stream)
            every = pa.concat_arrays(ids)
            lists = {"ids": every, "held": pa.array(out), "length": pa.array(length, pa.int64())}
            cells = {k: pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), v) for k, v in lists.items()}
            frequent = np.argsort(-np.bincount(inverse, minlength=len(at)), kind="stable").astype(np.uint32)  # small codes for frequent words
            code = np.empty(len(at), np.uint32)
            code[frequent] = np.arange(len(at), dtype=np.uint32)
            packed = {k: pa.array([pack(v)], pa.binary()) for k, v in (("stream", code[inverse]), ("codes", frequent))}
            return pa.record_batch({"block": pa.array([number], pa.int64()), **cells, **packed})
        learnt = np.sort(stream[np.repeat(~out, length)])  # values alone are sorted much faster than places
        own = np.sort(stream)
        own = own[_run_starts([own])]
        counts = (np.searchsorted(learnt, own, side="right") - np.searchsorted(learnt, own)).astype(np.uint32)
        edges = np.append(np.searchsorted(own, _bounds(parts)), len(own))
        rows = [(number, p, "ask", [own[a:b].tobytes(), pack(counts[a:b])]) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return _messages(rows).combine_chunks().to_batches()[0]

    def run(batches):
        from pyspark import TaskContext

        number, size, texts, ids, held = TaskContext.get().partitionId() << 32, 0, [], [], []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for at, piece in W.pieces(table["text"], 1_000_000):
                part = batch.slice(at, len(piece))
                texts.append(piece)
                ids.append(part["id"])
                held.append(part["held"])
                size += piece.nbytes
                if size >= BLOCK_TEXT:
                    yield block(number, texts, ids, held)
                    number, size, texts, ids, held = number + 1, 0, [], [], []
        if texts:
            yield block(number, texts, ids, held)

    return run


def _answer_words(group: pa.Table, parts: int, hot: int) -> pa.Table:
    """A part of the vocabulary: each asked word's number and count."""
    asked = _of(group, "ask")
    hashes = [np.frombuffer(d[0], _U) for _, _, d in asked]
    part = asked[0][1]
    every, counts = _summed(hashes, [unpack(d[1], np.uint32) for _, _, d in asked])
    numbers = np.empty(len(every), np.int64)
    numbers[np.argsort(-counts, kind="stable")] = np.arange(len(every), dtype=np.int64) * parts + part + 1
    if len(numbers) and numbers.max() >= 1 << 31:
        raise ValueError("over 2**31 word numbers: more than the packed columns hold")
    numbers = numbers.astype(np.uint32) | np.where(counts >= hot, _HOT, np.uint32(0))
    model = MappedArrays(every, number=numbers, count=counts)
    rows = [(b, part, "word", [pack(x) for x in model.get(h, "number", "count")]) for (b, _, _), h in zip(asked, hashes, strict=True)]
    return _messages([*rows, (-1, part, "words", [_histogram(counts)])])


# round 2


def word_part(number: np.ndarray, parts: int) -> np.ndarray:
    """The part that a word belongs to."""
    return np.where(number > 0, ((number & ~_HOT).astype(np.int64) - 1) % parts, 0)


def _part(columns: list[np.ndarray], parts: int) -> np.ndarray:
    h = columns[0].astype(_U)
    for c in columns[1:]:
        h = W.mixed(h) + c.astype(_U)
    return (W.mixed(h) % _U(parts)).astype(np.int64)


def owner(columns: list[np.ndarray], parts: int) -> np.ndarray:
    """The part that n-grams belong to: of four words and more by the context, of three by the middle word and of two by the first, unless that is hot: then by the first two."""
    if len(columns) > 3:
        return _part(columns[:-1], parts)
    return np.where(columns[-2] >= _HOT, _part(columns[:2], parts), _part(columns[-2:-1], parts))


def _key(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    return node.astype(_U) << _U(32) | word.astype(_U)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in ascending order; and which of them each key is."""
    order = np.argsort(keys)
    new = _run_starts([keys[order]])
    ids = np.empty(len(keys), np.int64)
    ids[order] = np.cumsum(new) - 1
    return order[new], ids


def _dense(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct row, in the order of the rows' words; and which of them each row is."""
    ids = columns[0]
    if len(columns) == 1:
        return _distinct(ids)
    for c in columns[1:]:
        at, ids = _distinct(_key(ids, c))
    return at, ids


def _by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """The order by part, which keeps that of rows of one part; 16-bit numbers are sorted by their digits."""
    return np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")


def _run_starts(context: list[np.ndarray]) -> np.ndarray:
    """Whether a row, of rows whose equal contexts stand together, is the first of its context."""
    new = np.ones(len(context[0]), bool)
    new[1:] = context[0][1:] != context[0][:-1]
    for c in context[1:]:
        new[1:] |= c[1:] != c[:-1]
    return new


class _Block:
    """A block with its words' global numbers: its tokens, and its distinct n-grams of each order in the order of the parts."""

    def __init__(self, docs: pa.Table, told: pa.Table, parts: int, order: int):
        self.docs, self.parts = docs, parts
        self.stream = unpack(docs["codes"][0].as_py(), np.uint32)[unpack(docs["stream"][0].as_py(), np.uint32)]
        words = _of(told, "word")
        self.number = np.concatenate([np.zeros(0, np.uint32), *(unpack(d[0], np.uint32) for _, _, d in words)])
        self.count = np.concatenate([np.zeros(0, np.int64), *(unpack(d[1], np.int64) for _, _, d in words)])
        if len(self.stream) and int(self.stream.max()) >= len(self.number):
            raise ValueError("a block got fewer answers than it has words")
        self.length = docs["length"].chunk(0).flatten().to_numpy()
        self.held = docs["held"].chunk(0).flatten().to_numpy(zero_copy_only=False)
        self.first = np.cumsum(self.length) - self.length
        by_number = np.argsort(self.number)
        #: Numbers in ascending order, the beginning's first, and the places of the words they stand for.
        self.named = named = np.concatenate([np.full(1, BEGIN, np.uint32), self.number[by_number]])
        self.by_number = by_number
        rank = np.empty(len(by_number), np.uint32)
        rank[by_number] = np.arange(1, len(by_number) + 1)
        w = rank[self.stream]
        before = np.arange(len(w)) - np.repeat(self.first, self.length)
        #: Of each order: columns of word numbers, the n-gram that ends at each token, where each part's start.
        self.grams: dict[int, tuple[list[np.ndarray], np.ndarray, np.ndarray]] = {}
        node = w
        for n in range(2, order + 1):
            context = np.concatenate([np.zeros(1, node.dtype), node[:-1]])
            context[self.first] = BEGIN
            at, inverse = _dense([context, w])
            inside = before[at]
            columns = [named[np.where(inside >= j, w[np.maximum(at - j, 0)], BEGIN)] for j in range(n - 1, 0, -1)] + [named[w[at]]]
            part = owner(columns, parts)
            ordered = _by_part(part, parts)
            place = np.empty(len(ordered), np.int64)
            place[ordered] = np.arange(len(ordered))
            self.grams[n] = [c[ordered] for c in columns], place[inverse], np.searchsorted(part[ordered], np.arange(parts + 1))
            node = inverse + 1


def _ask_grams(docs: pa.Table, told: pa.Table, parts: int, order: int) -> pa.Table:
    b = _Block(docs, told, parts, order)
    number, rows = docs["block"][0].as_py(), []
    for n, (columns, gram, edges) in b.grams.items():
        if n == 2 < order:  # these follow from three words
            continue
        sent = list(columns)
        if n == order:  # the counts of lower orders follow from these
            sent.append(np.bincount(gram[np.repeat(~b.held, b.length)], minlength=len(columns[0])).astype(np.uint32))
        rows += [(number, p, f"ask{n}", [pack(c[x:y]) for c in sent]) for p, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
    return _messages(rows)


class _Grams:
    """A part's n-grams, distinct and in the order of their words: a chain of sorted arrays from word to word, the last with counts; and statistics of the contexts."""

    def __init__(self, columns: list[np.ndarray], counts: np.ndarray):
        node, self.steps = columns[0], []
        for c in columns[1:-1]:
            keys = _key(node, c)
            new = _run_starts([keys])
            keys = keys[new]
            self.steps.append(MappedArrays(keys, node=np.arange(1, len(keys) + 1, dtype=_U)))
            node = np.cumsum(new)
        keys = _key(node, columns[-1])
        if not (keys[1:] > keys[:-1]).all():
            raise ValueError("n-grams must stand in the order of their words")
        start = np.flatnonzero(_run_starts([keys >> _U(32)]))
        first = keys[start] >> _U(32)
        sums = lambda x: np.add.reduceat(x.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        self.counts = MappedArrays(keys, count=counts)
        self.heads = MappedArrays(first, total=sums(counts), n1=sums(counts == 1), n2=sums(counts == 2), n3=sums(counts > 2))

    def get(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Counts of n-grams whose equal contexts stand together; total, n1, n2, n3 of each context."""
        node = columns[0].astype(_U)
        for step, c in zip(self.steps, columns[1:-1], strict=True):
            (node,) = step.get(_key(node, c), "node")
        return [*self.counts.get(_key(node, columns[-1]), "count"), *self.heads.get(node[_run_starts(columns[:-1])], "total", "n1", "n2", "n3")]


def _added(sources: list[tuple[list[np.ndarray], np.ndarray]], n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct n-grams of all sources in the order of their words, with their counts added up; and which of them each row of the sources is."""
    columns = [np.concatenate([np.zeros(0, np.uint32), *(c[j] for c, _ in sources)]) for j in range(n)]
    at, ids = _dense(columns)
    # sums below 2**53 are whole numbers in doubles too
    counts = np.bincount(ids, weights=np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for _, x in sources)]), minlength=len(at)).astype(np.int64)
    return [c[at] for c in columns], counts, ids.astype(np.int32)


def _counted(sources: list[tuple[list[np.ndarray], np.ndarray]], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct n-grams of all sources with their counts added up, those that were counted at all."""
    columns, counts, _ = _added(sources, n)
    return [c[counts > 0] for c in columns], counts[counts > 0]


def _at_places(columns: list[np.ndarray], counts: np.ndarray, ids: np.ndarray, keys: list[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """What _Grams.get() says of each of `keys`, whose rows, one after the other, are the n-grams `ids` of `columns`."""
    context = np.cumsum(_run_starts(columns[:-1])) - 1
    n = int(context[-1]) + 1 if len(context) else 0
    heads = [np.bincount(context, weights=x, minlength=n).astype(np.int64) for x in (counts, counts == 1, counts == 2, counts > 2)]
    edges = np.cumsum([0, *(len(k[0]) for k in keys)])
    for k, a, b in zip(keys, edges, edges[1:], strict=False):
        own = ids[a:b]
        of = context[own[_run_starts(k[:-1])]]
        yield [counts[own], *(h[of] for h in heads)]


def _unpacked(data: list[bytes], n: int) -> list[np.ndarray]:
    return [unpack(c, np.uint32) for c in data[:n]]


def _ends(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """What stands behind the first words, and the weights added up over these."""
    at, ids = _dense(columns[1:])
    return [c[at] for c in columns[1:]], np.bincount(ids, weights=weights, minlength=len(at)).astype(np.int64)


def _dealt(block: int, kind: str, to: np.ndarray, columns: list[np.ndarray], parts: int) -> list[tuple[int, int, str, list[bytes]]]:
    """A message to each part in `to` with its rows of the columns."""
    ordered = _by_part(to, parts)
    edges = np.searchsorted(to[ordered], np.arange(parts + 1))
    return [(block, p, kind, [pack(c[ordered[x:y]]) for c in columns]) for p, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]


def _answer_grams(group: pa.Table, n: int, order: int, parts: int) -> pa.Table:
    """A part of the n-grams, three words or more: counts, contexts' statistics; for the order below, how many n-grams end there (of three words: see _answer_twos); and what else is asked."""
    part = group["part"][0].as_py()
    asked, told = _of(group, f"ask{n}"), _of(group, f"ends{n}")
    later = group.filter(pc.is_in(group["kind"], pa.array([f"ask{k}" for k in range(3, n)], pa.string())))
    keys = [_unpacked(d, n) for _, _, d in asked]
    # with two words before the beginning it is none, but the n-gram without the first keeps its count
    if n == order:  # what is asked for is what is counted: no need to look it up
        columns, counts, ids = _added([(k, unpack(d[n], np.uint32)) for k, (_, _, d) in zip(keys, asked, strict=True)], n)
        none = (columns[0] == BEGIN) & (columns[1] == BEGIN)
        answers = _at_places(columns, np.where(none, 0, counts), ids, keys)
        columns, counts, none = [c[counts > 0] for c in columns], counts[counts > 0], none[counts > 0]
    else:
        columns, counts = _counted([(_unpacked(d, n), unpack(d[n], np.int64)) for _, _, d in told], n)
        none = (columns[0] == BEGIN) & (columns[1] == BEGIN)
        model = _Grams([c[~none] for c in columns], counts[~none])
        answers = map(model.get, keys)
    rows = [(b, part, f"gram{n}", [pack(x) for x in own]) for (b, _, _), own in zip(asked, answers, strict=True)]
    rows.append((-1, part, f"grams{n}", [_histogram(counts[~none])]))
    second, ends = _ends(columns, np.where(none, counts, 1))
    if n > 3:
        rows += _dealt(-1, f"ends{n - 1}", owner(second, parts), [*second, ends], parts)
    else:
        rows += _answer_twos(part, second, ends, [(b, k[1:]) for (b, _, _), k in zip(asked, keys, strict=True)], parts)
    return pa.concat_tables([_messages(rows), later.cast(_messages([]).schema)])


def _answer_twos(part: int, columns: list[np.ndarray], counts: np.ndarray, asked: list[tuple[int, list[np.ndarray]]], parts: int) -> list[tuple[int, int, str, list[bytes]]]:
    """Of two words that stand behind a first: the counts where the first of them isn't hot; what a hot one has so far, and who asks for it, goes on to its parts."""
    hot = columns[0] >= _HOT
    rows = _summary(part, [c[~hot] for c in columns], counts[~hot], parts)
    own = [c[hot] for c in columns]
    rows += _dealt(-1, "ends2", owner(own, parts), [*own, counts[hot]], parts)
    model = _arrays([c[~hot] for c in columns], counts[~hot])
    for block, k in asked:
        keys = np.sort(_key(*k))
        keys = keys[_run_starts([keys])]
        k = [(keys >> _U(32)).astype(np.uint32), keys.astype(np.uint32)]
        hot = k[0] >= _HOT
        rows.append((block, part, "gram2", [pack(x) for x in model.get(_key(*(c[~hot] for c in k)), "count")]))
        own = [c[hot] for c in k]
        rows += _dealt(block, "ask2", owner(own, parts), own, parts)
    return rows


def _arrays(columns: list[np.ndarray], counts: np.ndarray) -> MappedArrays:
    keys = _key(*columns)
    order = np.argsort(keys)
    return MappedArrays(keys[order], count=counts[order])


def _summary(part: int, columns: list[np.ndarray], counts: np.ndarray, parts: int) -> list[tuple[int, int, str, list[bytes]]]:
    """Of two words with their final counts: the histogram; each first word's statistics and each second one's number of first words, for the words' parts."""
    last, types = _ends(columns, np.ones(len(counts)))
    first, start = np.unique(columns[0], return_inverse=True)
    sums = lambda x: np.bincount(start, weights=x, minlength=len(first)).astype(np.int64)
    heads = [sums(counts), sums(counts == 1), sums(counts == 2), sums(counts > 2)]
    begins = first == BEGIN
    rows = [(-1, part, "grams2", [_histogram(counts)]), (-1, part, "begin", [np.array([*(int(h[begins].sum()) for h in heads), 0, 0], np.int64).tobytes()])]
    rows += _dealt(-1, "ends1", word_part(last[0], parts), [last[0], types], parts)
    return rows + _dealt(-1, "heads", word_part(first[~begins], parts), [first[~begins], *(h[~begins] for h in heads)], parts)


def _answer_hot(group: pa.Table, order: int, parts: int) -> pa.Table:
    """A part of the two words that threes' parts have sent on (order 2: of all two words): their counts for each block that asks, in the order of the words."""
    part = group["part"][0].as_py()
    asked: dict[int, list[list[np.ndarray]]] = {}
    sources = [(_unpacked(d, 2), unpack(d[2], np.int64)) for _, _, d in _of(group, "ends2")]
    for block, _, d in _of(group, "ask2"):
        asked.setdefault(block, []).append(_unpacked(d, 2))
        if order == 2:
            sources.append((asked[block][-1], unpack(d[2], np.uint32)))
    columns, counts = _counted(sources, 2)
    rows = _summary(part, columns, counts, parts)
    model = _arrays(columns, counts)
    for block, lists in asked.items():
        keys = np.unique(np.concatenate([_key(*k) for k in lists]))
        rows.append((block, part, "hot2", [pack(x) for x in model.get(keys, "count")]))
    return _messages(rows)


# round 3


def _answer_ends(words: pa.Table, told: pa.Table) -> pa.Table:
    """How many first words each asked word follows, and the statistics of the two words that it begins."""
    asked = _of(words, "word")
    if not asked:
        return _messages([])
    sent = [(unpack(d[0], np.uint32), unpack(d[1], np.int64)) for _, _, d in _of(told, "ends1")]
    every, types = _summed([k for k, _ in sent], [x for _, x in sent])
    model, part = MappedArrays(every, types=types), asked[0][1]
    heads = [[unpack(d[0], np.uint32), *(unpack(x, np.int64) for x in d[1:])] for _, _, d in _of(told, "heads")]
    of = [_summed([h[0] for h in heads], [h[i] for h in heads]) for i in range(1, 5)]
    firsts = MappedArrays(of[0][0], **{f"h{i}": x for i, (_, x) in enumerate(of)})
    rows = []
    for block, _, d in asked:
        numbers = unpack(d[0], np.uint32)
        rows.append((block, part, "end", [pack(x) for x in (*model.get(numbers, "types"), *firsts.get(numbers, "h0", "h1", "h2", "h3"))]))
    return _messages([*rows, (-1, part, "types", [_histogram(types)])])


# scores


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2 and more, from how many counts are 1, 2, 3, 4; halves where the counts don't tell."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3) <= 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))  # type: ignore[return-value]


def _taken(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts == 0, 0.0, np.where(counts == 1, d[0], np.where(counts == 2, d[1], d[2])))


def _scores(docs: pa.Table, told: pa.Table, parts: int, words: np.ndarray, grams: list[np.ndarray], types: np.ndarray, begin: np.ndarray, key: str) -> pa.Table:
    """grams: the histograms of the orders from 2 up; begin: the statistics of the two words that begin with a beginning."""
    b = _Block(docs, told, parts, len(grams) + 1)
    n, v = int(words[5]), int(words[4])
    ends = _of(told, "end")
    end, *heads = (np.concatenate([np.zeros(0, np.int64), *(unpack(d[i], np.int64) for _, _, d in ends)]) for i in range(5))
    if len(end) != len(b.number):
        raise ValueError("a block's answers are incomplete")
    # words
    low = discounts(types)
    all_types = max(1, int(types[5]))
    spare = (low[0] * types[0] + low[1] * types[1] + low[2] * (types[4] - types[0] - types[1])) / all_types if types[5] else 1.0
    p = (np.maximum(end - _taken(end, low), 0) / all_types + spare / (v + 1))[b.stream]
    # n-grams, each with a share of the order below
    for k, histogram in enumerate(grams, 2):
        columns, gram, _ = b.grams[k]
        if k == 2:
            context = np.searchsorted(b.named, columns[0])
            total, n1, n2, n3 = (np.append(x, h[b.by_number]) for x, h in zip(begin, heads, strict=False))
            of_part = sorted((q, i, d[0]) for i, kind in enumerate(("gram2", "hot2")) for _, q, d in _of(told, kind))  # in a part hot words' come last
            count = np.concatenate([np.zeros(0, np.int64), *(unpack(d, np.int64) for _, _, d in of_part)])
        else:
            context = np.cumsum(_run_starts(columns[:-1])) - 1
            answers = _of(told, f"gram{k}")
            count, total, n1, n2, n3 = (np.concatenate([np.zeros(0, np.int64), *(unpack(d[i], np.int64) for _, _, d in answers)]) for i in range(5))
            if len(total) != (context[-1] + 1 if len(context) else 0):
                raise ValueError("a block's answers are incomplete")
        if len(count) != len(columns[0]):
            raise ValueError("a block's answers are incomplete")
        d = discounts(histogram)
        whole = np.maximum(total, 1)
        rest = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / whole, 1.0)
        p = (np.maximum(count - _taken(count, d), 0) / whole[context])[gram] + rest[context][gram] * p
    tokens = np.log10(p)
    base = np.log10((b.count + 1) / (n + v + 1))[b.stream]
    sums = lambda x: np.add.reduceat(x, b.first) if len(b.first) else np.zeros(0)
    return pa.table(
        {
            key: docs["ids"].chunk(0).flatten(),
            "held_out": pa.array(b.held),
            "n_tokens": pa.array(b.length, pa.int64()),
            "n_known": pa.array(sums((b.count > 0)[b.stream].astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(b.length), n), pa.int64()),
            "base_score": pa.array(sums(base), pa.float64()),
            "score": pa.array(sums(tokens), pa.float64()),
        }
    )


def _sum_of(answers: DataFrame, kind: str) -> np.ndarray:
    """The parts' histograms added up: six numbers a part."""
    rows = answers.where(F.col("kind") == kind).select("data").toLocalIterator()
    return sum((np.frombuffer(r.data[0], np.int64) for r in rows), np.zeros(6, np.int64))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None, order: int = 2, hot: int = HOT) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, by the model of the rows that aren't held out.

    A-Z are lower-cased; tokens are the words and one end.  base_score: the
    log10 probability under add-one unigrams; score: under the model of n-grams
    up to `order` (2 at least), which for a word never learnt still has a share,
    as one more word.  Null or empty texts are an end alone.  A null key is
    held out as '' would be, a null `held_out` is not.  Repeated rows are
    learnt from as often, and scored each; an empty table gives none.  hot: as
    HOT, which changes no score.  `docs` is read three times and must give the
    same rows in the same partitions each time, as a stored table does.  Other
    columns are left to the caller.
    """
    if order < 2:
        raise ValueError("the order must be 2 at least")
    held = is_held_out(F.col(f"`{key}`")) if held_out is None else F.coalesce(held_out, F.lit(False))
    source = docs.select(F.col(f"`{key}`").alias("id"), held.alias("held"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    parts = max(2, n_blocks(docs, text, BLOCK_TEXT) // 2)
    kind = source.schema["id"].dataType.simpleString()
    blocks = source.mapInArrow(releasing(_packed(parts, "docs")), f"block bigint, ids array<{kind}>, held array<boolean>, length array<bigint>, stream binary, codes binary").groupBy("block")
    asked = source.mapInArrow(releasing(_packed(parts, "words")), _MESSAGE)
    words = written(asked.groupBy("part").applyInArrow(lambda t: _answer_words(t, parts, hot), _MESSAGE))
    of_block = words.where("kind = 'word'").groupBy("block")
    sent = blocks.cogroup(of_block).applyInArrow(lambda x, y: _ask_grams(x, y, parts, order), _MESSAGE)
    grams: dict[int, DataFrame] = {}
    answer = lambda n: lambda t: _answer_grams(t, n, order, parts)
    for n in range(order, 2, -1):
        grams[n] = written(sent.groupBy("part").applyInArrow(answer(n), _MESSAGE))
        sent = grams[n].where(F.col("kind").isin(f"ends{n - 1}", *(f"ask{k}" for k in range(2, n))))
    twos = written(sent.groupBy("part").applyInArrow(lambda t: _answer_hot(t, order, parts), _MESSAGE))
    rounds = [twos, *([grams[3]] if order > 2 else [])]
    every = functools.reduce(DataFrame.union, rounds)
    to_words = every.where("kind IN ('ends1', 'heads')").groupBy("part")
    ends = written(words.where("kind = 'word'").groupBy("part").cogroup(to_words).applyInArrow(_answer_ends, _MESSAGE))
    sums = _sum_of(words, "words"), [_sum_of(every, "grams2"), *(_sum_of(grams[n], f"grams{n}") for n in sorted(grams))], _sum_of(ends, "types"), _sum_of(every, "begin")
    told = words.where("kind = 'word'").union(ends.where("kind = 'end'")).union(every.where("kind IN ('gram2', 'hot2')"))
    for n, answers in grams.items():
        told = told.union(answers.where(F.col("kind") == f"gram{n}"))
    schema = f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.cogroup(told.groupBy("block")).applyInArrow(lambda x, y: _scores(x, y, parts, *sums, key), schema)

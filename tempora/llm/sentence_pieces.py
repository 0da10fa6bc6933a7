"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled
character map knows; each normalised byte remembers the byte of the source that
it comes from.  So every piece of the result is projected to a span of source
bytes.  All of that, and putting the rows together, is done on whole Arrow
buffers.  Normalised texts are cut where no piece of the vocabulary spans two
neighbouring characters; a task merges each distinct stretch between such cuts
once.  No step shuffles, and a lost executor costs only its own splits.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .dictionary import Coder, Dictionary
from .frames import releasing

#: What a blank is in pieces, and what a byte that isn't UTF-8 becomes (fixed values).
BLANK, REPLACEMENT = "▁", "�"
_BLANK = np.frombuffer(BLANK.encode(), np.uint8)
#: Bytes of text, and ids, handled at a time.
TEXT_BYTES, IDS = 1_000_000, 200_000
#: Stretches of more characters are merged with a heap.
SHORT = 48
#: Cells of the table of neighbouring characters that a piece holds; two pairs in one cell only make stretches longer.
_CELLS = 1 << 20


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes whose values are places in a list of replacements, each ended by a zero."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).astype(np.int64)
        self.texts = np.frombuffer(compiled, np.uint8, offset=4 + size)
        self.zeros = np.flatnonzero(self.texts == 0)

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place: how many bytes the longest key has that starts there and ends by `end` (0: none is known), and where its replacement is."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        going = np.arange(len(at))
        node = np.full(len(at), self._offset(self.units[:1])[0])
        for depth in itertools.count():
            own = at[going] + depth < end[going]
            going, node = going[own], node[own]
            if not len(going):
                return length, value
            byte = data[at[going] + depth].astype(np.int64)
            node ^= byte
            own = node < len(self.units)
            own[own] = self.units[node[own]] & 0x800000FF == byte[own]
            going, node = going[own], node[own]
            unit = self.units[node]
            node = node ^ self._offset(unit)
            leaf = (unit >> 8) & 1 == 1
            length[going[leaf]] = depth + 1
            value[going[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF


class Model:
    """What encoding needs of a SentencePiece model of the kind BPE."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only BPE models without user-defined and unused pieces are supported")
        if model.trainer_spec.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("blanks as suffixes, and denormalisation, aren't supported")
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefixed, self.trimmed, self.escaped = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.end = next((i for i, p in enumerate(model.pieces) if p.piece == model.trainer_spec.eos_piece), -1)
        #: What decoding makes of each id, whether it is a byte, and whether it is nothing (control pieces).
        surface = model.trainer_spec.unk_surface.encode()
        blank = lambda p: p.piece.replace(BLANK, " ").encode()
        self.surfaces = [
            b"" if p.type == kinds.CONTROL else surface if p.type == kinds.UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else blank(p) for p in model.pieces
        ]
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.silent = np.array([p.type == kinds.CONTROL for p in model.pieces])
        self.blank_first = np.array([p.type == kinds.NORMAL and p.piece.startswith(BLANK) for p in model.pieces])
        self.strips_all = self.trimmed
        self.strips = self.prefixed or self.trimmed
        self.joined = np.zeros(_CELLS, bool)
        pairs = {p for piece in self.ids for p in zip(piece, piece[1:], strict=False)}
        if pairs:
            a, b = (np.array([ord(p[k]) for p in pairs], np.int64) for k in (0, 1))
            self.joined[_cell(a, b)] = True

    def merge(self, text: str) -> list[str]:
        """The pieces of a stretch: of neighbours that make a piece the best-scored are joined, the leftmost first, until none are left."""
        parts, scores = list(text), self.scores
        if len(parts) > SHORT:
            return self._merge_long(parts)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _merge_long(self, parts: list[str]) -> list[str]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-s, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (s := self.scores.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or parts[i] + parts[j] != whole:
                continue  # merged meanwhile
            parts[i], parts[j] = whole, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (s := self.scores.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def encoded(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of a stretch and how many of its bytes each stands for: of a character in bytes, the last for all of them."""
        ids, sizes = [], []
        for p in self.merge(text):
            own, n = self.ids.get(p), len(p.encode())
            if own is None and self.bytes:
                ids += [self.bytes[b] for b in p.encode()]
                sizes += [*[0] * (n - 1), n]
            else:
                ids.append(self.unknown if own is None else own)
                sizes.append(n)
        return ids, sizes


def _cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 8191 + b * 31) & (_CELLS - 1)


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, where each text starts; bytes that aren't UTF-8 become REPLACEMENT."""
    data, offsets = W.texts_bytes(texts)
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        plain = [data[a:b].tobytes().decode(errors="replace") for a, b in itertools.pairwise(offsets)]
        return W.texts_bytes(pa.array(plain, pa.string()))
    return data, offsets


def normalised(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of one buffer normalised: their bytes, where each text starts in them, of each byte the byte of the source that it comes from, and where each text's source ends."""
    n = len(offsets) - 1
    at = np.flatnonzero((data & 0xC0) != 0x80)  # characters
    size = np.diff(np.append(at, len(data)))
    row = np.searchsorted(offsets, at, side="right") - 1
    own_start, own_size, pool = at, size, data  # what each unit becomes: a place in the pool
    if model.map is not None and len(at):
        length, value = model.map.longest(data, at, offsets[row + 1])
        reached = np.ones(len(at), bool)
        until = 0
        for k in np.flatnonzero(length > size).tolist():  # keys of several characters take those behind with them
            if at[k] >= until:
                until = at[k] + length[k]
                reached[k + 1 : np.searchsorted(at, until)] = False
        pool = np.concatenate([data, model.map.texts])
        known = length > 0
        ends = model.map.zeros[np.minimum(np.searchsorted(model.map.zeros, value), len(model.map.zeros) - 1)]
        own_start, own_size = np.where(known, len(data) + value, at), np.where(known, ends - value, size)
        at, row, own_start, own_size = at[reached], row[reached], own_start[reached], own_size[reached]
    stop = offsets[1:].copy()
    first = offsets[:-1].copy()  # the source's place of the blank put before a text
    if model.trimmed and len(at):
        heading = (own_size == 1) & (pool[own_start] == 0x20)
        filled = np.flatnonzero(own_size > 0)
        ends = pool[own_start[filled] + own_size[filled] - 1] == 0x20
        before = np.ones(len(filled), bool)  # what stands before ends in a blank, or a text begins
        before[1:] = (row[filled[1:]] != row[filled[:-1]]) | ends[:-1]
        for k in filled[before & (pool[own_start[filled]] == 0x20)].tolist():
            while own_size[k] and pool[own_start[k]] == 0x20:
                own_start[k] += 1
                own_size[k] -= 1
        # blanks that head a text stand before the one that is put there
        begin, past = (np.searchsorted(row, np.arange(n), side=s) for s in ("left", "right"))
        others = np.append(np.flatnonzero(~heading), len(at))
        content = others[np.searchsorted(others, begin)]
        first = np.where(content < past, np.append(at, len(data))[content], stop)
    some = first < stop  # texts with anything in them
    out = pool[W.ragged(own_start, own_size)]
    source = np.repeat(at, own_size)
    owner = np.repeat(row, own_size)
    wide = np.where(out == 0x20, 3, 1) if model.escaped else np.ones(len(out), np.int64)
    place = np.cumsum(wide) - wide
    blank = np.flatnonzero(wide == 3)
    own = np.repeat(out, wide)
    if len(blank):
        own[(place[blank, None] + np.arange(3)).ravel()] = np.tile(_BLANK, len(blank))
    source, owner = np.repeat(source, wide), np.repeat(owner, wide)
    lengths = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    if model.prefixed:
        mark = _BLANK if model.escaped else np.frombuffer(b" ", np.uint8)
        where = np.repeat((np.cumsum(lengths) - lengths)[some], len(mark))
        own = np.insert(own, where, np.tile(mark, int(some.sum())))
        source = np.insert(source, where, np.repeat(first[some], len(mark)))
        lengths = lengths + len(mark) * some
    begin = np.concatenate([[0], np.cumsum(lengths)])
    if model.trimmed and len(own):
        own, source, begin, stop = _without_tails(own, source, begin, stop, _BLANK if model.escaped else np.frombuffer(b" ", np.uint8))
    return own, begin, source, stop


def _without_tails(own: np.ndarray, source: np.ndarray, begin: np.ndarray, stop: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The normalised texts without the blanks at their ends."""
    keep, stop = np.ones(len(own), bool), stop.copy()
    w = len(mark)
    for i, (a, b) in enumerate(itertools.pairwise(begin.tolist())):
        end = b
        while end - w >= a and (own[end - w : end] == mark).all():
            end -= w
            stop[i] = source[end]
        keep[end:b] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return own[keep], source[keep], kept[begin], stop


def stretches(own: np.ndarray, begin: np.ndarray, model: Model) -> tuple[pa.StringArray, np.ndarray]:
    """The normalised texts cut where no piece can span, one after the other, and where each text's first stands."""
    at = np.flatnonzero((own & 0xC0) != 0x80)
    codes = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    cut = np.ones(len(at), bool)
    cut[1:] = ~model.joined[_cell(codes[:-1], codes[1:])]
    cut[np.searchsorted(at, begin[:-1][begin[:-1] < len(own)])] = True
    start = at[cut]
    ends = np.append(start, len(own)).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(own))), np.searchsorted(start, begin)


def encoded_batches(batches: Iterable[pa.RecordBatch], path: str, text: str, end: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a few rows at a time: the rows, their ids, the source bytes where each id's span begins and ends, and where each row's ids start."""
    model, coder, known, sizes = load(path), Coder(), Dictionary(), Dictionary()
    for batch in batches:
        for at, texts in W.pieces(batch[text], TEXT_BYTES):
            data, offsets = _utf8(texts)
            own, begin, source, stop = normalised(data, offsets, model)
            words, first = stretches(own, begin, model)
            codes, new, anew = coder.code(words)
            if anew:
                known, sizes = Dictionary(), Dictionary()
            each = [model.encoded(w) for w in new]
            n_ids = np.fromiter((len(i) for i, _ in each), np.int64, len(each))
            known.add(np.fromiter(itertools.chain.from_iterable(i for i, _ in each), np.int32), n_ids)
            sizes.add(np.fromiter(itertools.chain.from_iterable(s for _, s in each), np.int32), n_ids)
            length = known.length[codes]
            index = W.ragged(known.start[codes], length)
            ids, size = known.ids[index], sizes.ids[index].astype(np.int64)
            row_start = np.concatenate([[0], np.cumsum(length)])[first]
            after = np.cumsum(size)
            row = np.repeat(np.arange(len(texts)), np.diff(row_start))
            base = offsets[:-1][row]
            spans = np.append(source, 0)
            span_begin = spans[after - size] - base
            span_end = np.where(after == begin[1:][row], stop[row], spans[after]) - base
            if end:
                last = (stop - offsets[:-1]).astype(np.int64)
                ids = np.insert(ids, row_start[1:], model.end)
                span_begin, span_end = (np.insert(x, row_start[1:], last) for x in (span_begin, span_end))
                row_start = row_start + np.arange(len(row_start))
            yield batch.slice(at, len(texts)), ids, span_begin, span_end, row_start


def decoded(ids: np.ndarray, starts: np.ndarray, model: Model) -> pa.BinaryArray:
    """The UTF-8 bytes of rows of ids: pieces with blanks for their marks, runs of bytes that are no UTF-8 as REPLACEMENT, the blank put before a text taken off."""
    known = (ids >= 0) & (ids < len(model.surfaces))
    surfaces, none = pa.array([*model.surfaces, b""], pa.binary()), len(model.surfaces)
    own = np.where(known, ids, none)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), surfaces.take(pa.array(own))), b"")
    # of each row the first id that isn't a control piece
    loud = np.flatnonzero(~np.append(model.silent, True)[own])
    head = np.searchsorted(loud, starts[:-1])
    has = (head < len(loud)) & (np.append(loud, len(own))[np.minimum(head, len(loud))] < starts[1:])
    lead = np.zeros(len(starts) - 1, bool)
    lead[has] = np.append(model.blank_first, False)[own[loud[head[has]]]]
    odd = np.zeros(len(starts) - 1, bool)
    where = np.flatnonzero(np.append(model.is_byte, False)[own])
    odd[np.searchsorted(starts, where, side="right") - 1] = True
    out = joined.to_pylist()
    for i in np.flatnonzero((lead & model.strips) | odd).tolist():
        text = out[i]
        if odd[i]:
            try:
                text.decode()
            except UnicodeDecodeError:
                text = _lossy(own[starts[i] : starts[i + 1]].tolist(), model)
        if lead[i] and model.strips:
            text = text.lstrip(b" ") if model.strips_all else text[1:]
        out[i] = text
    return pa.array(out, pa.binary())


def _lossy(ids: list[int], model: Model) -> bytes:
    """The bytes of ids among which byte pieces are no UTF-8: each byte that starts no character is REPLACEMENT."""
    out = b""
    for is_byte, run in itertools.groupby((i for i in ids if i < len(model.surfaces) and not model.silent[i]), lambda i: bool(model.is_byte[i])):
        own = b"".join(model.surfaces[i] for i in run)
        while is_byte and own:
            size = next((n for n in (1, 2, 3, 4) if n <= len(own) and _is_character(own[:n])), 0)
            out += own[:size] if size else REPLACEMENT.encode()
            own = own[max(size, 1) :]
        out += own
    return out


def _is_character(some: bytes) -> bool:
    try:
        return len(some.decode()) == 1
    except UnicodeDecodeError:
        return False


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int32)))


def _source(docs: DataFrame, text: str, keep: list[str]) -> tuple[DataFrame, str]:
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    return own, "".join(f"`{c}` {own.schema[c].dataType.simpleString()}, " for c in keep)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, end: bool = True) -> DataFrame:
    """`keep` (None: all columns) and of each whole text its `ids` by the model at `path` (on every node), and `begins` and `ends`: the span of UTF-8 bytes of the text that each id stands for.

    end: the end id comes last, with an empty span.  Of a character that is
    spelled in bytes the last one has the span, those before empty ones.  Null
    or empty texts have no ids but the end.  Repeated rows are encoded each;
    columns named as the new ones are replaced.
    """
    new = ("ids", "begins", "ends")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source, fields = _source(docs, text, kept)

    def run(batches):
        for part, ids, a, b, starts in encoded_batches(batches, path, "__text", end):
            yield pa.record_batch([*(part[c] for c in kept), *(_lists(x, starts) for x in (ids, a, b))], names=[*kept, *new])

    return source.mapInArrow(releasing(run), fields + "ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """`encoded` with the text of its ids as string; ids that are null or outside the vocabulary add nothing, no ids (or null) are an empty text."""
    kept = [c for c in encoded.columns if c != to]
    source = encoded.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept), f"`{to}` string"])

    def run(batches):
        for batch in batches:
            lists = batch[ids]
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            own = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            for at, stop in _runs(starts):
                text = decoded(own[starts[at] : starts[stop]], starts[at : stop + 1] - starts[at], load(path))
                yield pa.record_batch([*(batch[c].slice(at, stop - at) for c in kept), text.cast(pa.string())], names=[*kept, to])

    return source.mapInArrow(releasing(run), schema)


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows, from and to, that have IDS ids or one row."""
    at, n = 0, len(starts) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + IDS, side="right")) - 1)
        yield at, stop
        at = stop


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, spans_crc32) of each row: encode() with an end id and decode() of these ids in one worker.

    The digests are of the decimal ids joined by a blank and of the decoded
    text; the checksum is that of each span's two ends as little-endian 32-bit
    integers.  Null keys and repeated rows stay as they are.
    """
    source, fields = _source(docs, text, [key])

    def run(batches):
        model = load(path)
        numbers = pa.array([str(i) for i in range(len(model.surfaces))])
        for part, ids, a, b, starts in encoded_batches(batches, path, "__text", True):
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), numbers.take(pa.array(ids))), " ")
            spans = np.stack([a, b], axis=1).astype("<i4")
            crc = [zlib.crc32(spans[x:y].tobytes()) for x, y in itertools.pairwise(starts.tolist())]
            sha = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column]) for column in (joined, decoded(ids, starts, model))]
            yield pa.record_batch([part[key], pa.array(np.diff(starts)), *sha, pa.array(crc, pa.int64())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return source.mapInArrow(releasing(run), fields + "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint")

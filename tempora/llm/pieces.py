"""The matches of the public byte-level tokenizers' pattern in whole texts, a batch at a time, without a Python loop over them.

The pattern: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its matches cover a text without gaps, so their starts tell all: where the kind
of character changes, one space earlier where a space stands before, at the
last of several white-space characters, and around a contraction.  What is a
letter, a number or white space is asked of the library itself, since each
knows another Unicode.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words as W

LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
#: What makes a match of its own after an apostrophe (fixed values).
CONTRACTIONS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


#: The kind of a code point that no text has had yet.
UNSEEN = 0xFF
_PROBES = {LETTER: r"\p{L}", NUMBER: r"\p{N}", SPACE: r"\s"}


class Kinds:
    """The kinds of code points, by a library's own classes: asked once a worker for each code point that comes up."""

    def __init__(self, found: Callable[[str, str], str]):
        """found: (pattern, text) to the characters of the text that match."""
        self.found = found
        self.known = np.full(0x110000, UNSEEN, np.uint8)
        self.known[0xD800:0xE000] = OTHER  # in no text

    def of(self, codes: np.ndarray) -> np.ndarray:
        out = self.known[codes]
        if (out == UNSEEN).any():
            new = np.unique(codes[out == UNSEEN]).tolist()
            text = "".join(map(chr, new))
            self.known[new] = OTHER
            for kind, pattern in _PROBES.items():
                own = [ord(c) for c in self.found(pattern, text)]
                self.known[own] = kind
            out = self.known[codes]
        return out


@functools.lru_cache(maxsize=1)
def tiktoken_kinds() -> Kinds:
    import tiktoken

    probes = {p: tiktoken.Encoding("probe", pat_str=p, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}) for p in _PROBES.values()}
    return Kinds(lambda pattern, text: bytes(probes[pattern].encode_ordinary(text)).decode())


@functools.lru_cache(maxsize=1)
def tokenizers_kinds() -> Kinds:
    from tokenizers import Regex, pre_tokenizers

    probes = {p: pre_tokenizers.Split(Regex(p), "isolated") for p in _PROBES.values()}

    def found(pattern: str, text: str) -> str:
        return "".join(c for c in text if _splits(probes[pattern], c))

    return Kinds(found)


def _splits(probe, c: str) -> bool:
    """Whether a probe cuts the character off between two that it doesn't match."""
    return len(probe.pre_tokenize_str(f"\0{c}\0")) == 3


def _characters(data: np.ndarray, kinds: Kinds) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes starts, and its kind."""
    if not len(data) or data.max() < 0x80:
        return np.arange(len(data)), kinds.of(data)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    out = kinds.of(lead & 0x7F)
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
        own = np.flatnonzero((lead >= low) & (lead < high))
        code = lead[own].astype(np.int64) & (0x3F >> more)
        for k in range(1, more + 1):
            code = code << 6 | data[np.minimum(at[own] + k, len(data) - 1)] & 0x3F
        out[own] = kinds.of(np.minimum(code, 0x10FFFF))
    return at, out


def starts(data: np.ndarray, offsets: np.ndarray, kinds: Kinds) -> np.ndarray:
    """Where the matches start in texts' bytes, of which text i has those from offsets[i] up to offsets[i + 1]."""
    at, kind = _characters(data, kinds)
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)  # starts a text
    first[np.searchsorted(at, offsets)] = True
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[0], before[1:] = EDGE, np.where(first[1:n], EDGE, kind[:-1])
    after[-1], after[:-1] = EDGE, np.where(first[1:n], EDGE, kind[1:])
    white = kind == SPACE
    blank = data[at] == 0x20
    behind = np.zeros(n, bool)  # a blank stands right before, in the same text
    behind[1:] = blank[:-1] & ~first[1:n]
    new = kind != before
    start = np.where(white, new | ((after != SPACE) & (after != EDGE)), new & ~behind)
    quote = np.flatnonzero(start & (data[at] == 0x27))  # a blank before an apostrophe starts that match
    if len(quote):
        stop = offsets[np.searchsorted(offsets, at[quote], side="right")]
        for tail in CONTRACTIONS:
            place = at[quote]
            own = place + len(tail) < stop
            for k, c in enumerate(tail, 1):
                own &= data[np.minimum(place + k, len(data) - 1)] == c
            found = quote[own]
            start[found + 1] = False
            past = found + 1 + len(tail)
            past = past[past < n]
            start[past[(kind[past] == LETTER) & ~first[past]]] = True
    return at[start]


def split(texts: pa.Array, kinds: Kinds, added: Sequence[str] = ()) -> tuple[pa.Array, np.ndarray]:
    """All matches in the texts (null: none), one after the other, and how many each text has.

    added: tokens that are matches of their own wherever they stand; the pattern sees what lies between them.
    """
    if added and pc.any(functools.reduce(pc.or_kleene, (pc.match_substring(texts, t) for t in added))).as_py():
        cut = [_segments(t or "", added) for t in texts.to_pylist()]
        own = pa.array([s for row in cut for s in row], pa.string())
        data, offsets = W.texts_bytes(own)
        whole = pc.is_in(own, pa.array(list(added))).to_numpy(zero_copy_only=False)
        begin = starts(data, offsets, kinds)
        inner = whole[np.searchsorted(offsets, begin, side="right") - 1] & ~np.isin(begin, offsets)
        begin, offsets = begin[~inner], offsets[np.cumsum([0, *map(len, cut)])]
    else:
        data, offsets = W.texts_bytes(texts)
        begin = starts(data, offsets, kinds)
    ends = np.append(begin, len(data)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return pieces, np.diff(np.searchsorted(begin, offsets))


def _segments(text: str, added: Sequence[str]) -> list[str]:
    """The text cut around the added tokens in it, the leftmost first and of those that start together the longest."""
    out, at = [], 0
    while at < len(text):
        found = [(p, -len(t), t) for t in added if (p := text.find(t, at)) >= 0]
        if not found:
            out.append(text[at:])
            break
        place, _, token = min(found)
        out += [text[at:place], token] if place > at else [token]
        at = place + len(token)
    return out

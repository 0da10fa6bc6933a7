"""Words of whole texts as 64-bit hashes, a batch at a time, without a Python loop over words.

Two kinds of word: ``[^\\x20\\x09-\\x0D]+`` (SPACED) and runs of ASCII letters,
digits and non-ASCII characters (ALNUM).  A word's hash is a polynomial over
random 64-bit values of its bytes, so equal words have equal hashes everywhere;
two different ones agree by a chance of about 2**-64 unless they are built to
(a polynomial modulo 2**64 has such pairs among words of a thousand bytes).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time (a longer text is handled alone).
CHUNK_BYTES = 500_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=_U)
        out[0] = 1
        have = np.cumprod(out, dtype=_U)
        if n <= 2 * CHUNK_BYTES:  # those of a longer text aren't kept
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser (that of MurmurHash3): every bit of the result depends on every bit of h."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


@dataclass
class Words:
    """Words of some texts, one after the other: text i has those from first[i] up to first[i + 1]."""

    data: np.ndarray  # bytes of the texts, lower-cased where asked for
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each run of `size` words that starts at a word, and whether one text holds it all."""
        n = len(self)
        if n < size:
            return np.zeros(0, _U), np.zeros(0, bool)
        inside = np.repeat(self.first[1:], self.counts)[: n - size + 1] - np.arange(n - size + 1) >= size
        return rolling(self.hash, size), inside


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` hashes; equal runs have equal hashes wherever they stand."""
    n = len(h)
    sums = np.zeros(n + 1, _U)
    np.cumsum(h * powers(_BASE, n), dtype=_U, out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * powers(_INVERSE, n - size + 1))


def texts_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts (null: none), one after the other, and where each starts (and the last ends)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(texts: pa.Array, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    """The words of the texts; lower: A-Z are lower-cased first, other letters aren't."""
    data, offsets = texts_bytes(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, _U))
    inside = kind[data]
    edge = np.empty(n + 1, bool)  # where a word starts or ends, or a text starts inside one
    edge[0], edge[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    joined = np.unique(cut[inside[cut - 1] & inside[cut]]) if len(cut) else cut  # one word ends and another starts there
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]))
    start, end = at[::2], at[1::2]
    sums = np.zeros(n + 1, _U)
    np.cumsum(_MIX[data] * powers(_BASE, n), dtype=_U, out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * powers(_INVERSE, n)[start])
    return Words(data, start, end, np.searchsorted(start, offsets), hashes)


def words_of(texts: pa.Array | pa.ChunkedArray, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    """words() of many texts, with the working memory of a few."""
    parts = [words(piece, kind, lower) for _, piece in pieces(texts, CHUNK_BYTES // 2)]
    if len(parts) == 1:
        return parts[0]
    data = np.concatenate([np.zeros(0, np.uint8), *(w.data for w in parts)])
    byte = np.cumsum([0, *(len(w.data) for w in parts)])
    place = np.cumsum([0, *(len(w) for w in parts)])
    join = lambda arrays: np.concatenate([np.zeros(0, np.int64), *arrays])
    return Words(
        data,
        join(w.start + b for w, b in zip(parts, byte, strict=False)),
        join(w.end + b for w, b in zip(parts, byte, strict=False)),
        np.append(join(w.first[:-1] + k for w, k in zip(parts, place, strict=False)), place[-1]),
        np.concatenate([np.zeros(0, _U), *(w.hash for w in parts)]),
    )


def pieces(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """The texts cut into runs of about `most` bytes: the first one's place and the run."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. (length[0] of them), start[1], .. and so on."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)

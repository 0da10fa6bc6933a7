"""Simple-8b: a 64-bit word holds a selector in its top 4 bits and as many ids as fit, all of one width.

Selectors 0 to 13 stand for COUNTS ids of WIDTHS bits.  Selector 14 is an
escape: the next word is one id of 64 bits.  Ids are unsigned.
"""

from __future__ import annotations

import numpy as np

#: Ids in a word, by selector, and their widths in bits (fixed values).
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 14
#: Words that blocks go on before they are asked whether they have ended.
STRIDE = 64
_U = np.uint64
_LIMITS = np.array([1 << w for w in WIDTHS], np.uint64)


def _fit(need: np.ndarray, n: int) -> np.ndarray:
    """For each of the first n places of every row the selector of a word that starts there.

    need: of each id the first selector wide enough for it alone; places beyond a row's ids have more than any.
    """
    best = np.where(need[:, :n] < len(WIDTHS), len(WIDTHS) - 1, ESCAPE).astype(np.uint8)
    most = need[:, :n].copy()  # of as many ids as a narrower word holds
    k = 1
    for s in range(len(WIDTHS) - 2, -1, -1):
        for k in range(k, COUNTS[s]):
            np.maximum(most, need[:, k : k + n], out=most)
        k = COUNTS[s]
        fits = most <= s
        if not fits.any():  # a narrower word holds more ids
            break
        best[fits] = s
    return best


def encode_blocks(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of unsigned ids, `block` ids at a time, and where the words of each block start (and the last ones end)."""
    ids = np.asarray(ids, _U)
    n, rows = len(ids), -(-len(ids) // block)
    if not n:
        return np.zeros(0, _U), np.zeros(1, np.int64)
    need = np.full(rows * block, 255, np.uint8)
    need[:n] = np.searchsorted(_LIMITS, ids, side="right")
    need = np.concatenate([need.reshape(rows, block), np.full((rows, COUNTS[0]), 255, np.uint8)], axis=1)
    best = _fit(need, block)
    # all blocks go from word to word side by side; one that has ended stays behind its last id
    wide = block + 1
    jump = np.zeros((rows, wide), np.int64)
    jump[:, :block] = np.array([*COUNTS, 1])[best]
    jump.ravel()[(rows - 1) * wide + n - (rows - 1) * block :] = 0
    jump, at, found = jump.ravel(), np.arange(rows) * wide, []
    while jump[at].any():
        for _ in range(STRIDE):
            found.append(at)
            at = at + jump[at]
    at = np.concatenate(found)
    row, column = np.divmod(np.sort(at[jump[at] > 0]), wide)
    at = row * block + column
    selector = best.ravel()[at]
    size = 1 + (selector == ESCAPE)
    place = np.cumsum(size) - size
    starts = np.append(place[np.searchsorted(at, np.arange(rows) * block)], size.sum())
    out = np.zeros(int(size.sum()), _U)
    for s, (c, w) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = selector == s
        if own.any():
            word = np.full(int(own.sum()), s << 60, _U)
            first = at[own]
            for k in range(c):
                word |= ids[first + k] << _U(k * w)
            out[place[own]] = word
    own = selector == ESCAPE
    out[place[own]] = _U(ESCAPE << 60)
    out[place[own] + 1] = ids[at[own]]
    return out, starts


def encode(ids: np.ndarray) -> np.ndarray:
    """The words of unsigned ids."""
    return encode_blocks(ids, max(1, len(ids)))[0]


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of whole words that encode() made."""
    words = np.asarray(words, _U)
    selector = (words >> _U(60)).astype(np.int8)
    if (selector == ESCAPE).any():  # an escaped id isn't a word
        raw, i = np.zeros(len(words), bool), 0
        for i in np.flatnonzero(selector == ESCAPE):
            raw[i + 1] |= not raw[i]
        head = ~raw
    else:
        head, raw = np.ones(len(words), bool), None
    counts = np.where(head, np.array([*COUNTS, 1, 0])[selector], 0)
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), _U)
    for s, (c, w) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = np.flatnonzero(head & (selector == s))
        if len(own):
            mask = _U((1 << w) - 1)
            for k in range(c):
                out[start[own] + k] = (words[own] >> _U(k * w)) & mask
    if raw is not None:
        own = np.flatnonzero(head & (selector == ESCAPE))
        out[start[own]] = words[own + 1]
    return out

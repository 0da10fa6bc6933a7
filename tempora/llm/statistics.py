"""Statistics of whole texts, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import words as W

#: Words of a window that counts as repeated when it is found twice in a text.
REPEAT_WINDOW = 8
#: The characters counted as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
FIELDS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_lines": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "n_distinct": "bigint"}


def _at_symbols() -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(SYMBOLS)] = True
    return out


def _repeated(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (owner, hash), and which places of that order equal the one before."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    same = np.zeros(len(h), bool)
    same[1:] = (o[1:] == o[:-1]) & (x[1:] == x[:-1])
    return order, same


def describe(texts: pa.Array) -> dict[str, pa.Array]:
    """FIELDS of each text (null: as empty).

    word_chars: code points in words.  n_lines: \\n-split lines with a word;
    n_dup_lines: those of them equal to an earlier line.  n_repeat_words: words
    in windows of REPEAT_WINDOW words that stand twice or more in the text, the
    first included.  n_distinct: different words.
    """
    n = len(texts)
    data, offsets = W.texts_bytes(texts)
    w = W.words(texts, W.SPACED)

    def per_text(mark: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mark)])[offsets])

    inside = W.SPACED[data]
    # lines: a text's first starts with it, the others after a \n
    cut = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data[:-1] == 0x0A) + 1]))
    ends = np.append(cut[1:], len(data)) if len(cut) else cut
    stop = ends - ((ends > cut) & (data[np.maximum(ends - 1, 0)] == 0x0A)) if len(cut) else ends
    filled = np.concatenate([[0], np.cumsum(inside)])
    wordy = filled[stop] > filled[cut]
    cut, stop = cut[wordy], stop[wordy]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W._MIX[data] * W.powers(W._BASE, len(data)), dtype=np.uint64)])
    lines = W.mixed((sums[stop] - sums[cut]) * W.powers(W._INVERSE, len(data))[cut]) if len(cut) else np.zeros(0, np.uint64)
    line_owner = np.searchsorted(offsets, cut, side="right") - 1
    order, same = _repeated(line_owner, lines)
    n_dup = np.bincount(line_owner[order][same], minlength=n)

    owner = w.owner
    order, same = _repeated(owner, w.hash)
    n_distinct = w.counts - np.bincount(owner[order][same], minlength=n)

    h, whole = w.windows(REPEAT_WINDOW)
    at = np.flatnonzero(whole)
    order, same = _repeated(owner[at], h[at])
    twice = same.copy()
    twice[:-1] |= same[1:]
    starts = at[order[twice]]
    mark = np.zeros(len(w) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + REPEAT_WINDOW, -1)
    covered = np.cumsum(mark[:-1]) > 0
    n_repeat = np.diff(np.concatenate([[0], np.cumsum(covered)])[w.first])
    out = {
        "n_words": w.counts,
        "word_chars": per_text(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_at_symbols()[data]),
        "n_lines": np.bincount(line_owner, minlength=n),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "n_distinct": n_distinct,
    }
    return {k: pa.array(v.astype(np.int64)) for k, v in out.items()}

"""Fill-in-the-middle rows: each text cut in two places and its parts put in another order, a whole Arrow batch at a time.

A unit is a run of ASCII letters or any other single code point.  One kernel
works on the UTF-8 buffer of many texts together: a table gives the class of
each byte, adjacent bytes tell where a unit starts, sums that begin anew with
each text number the units, and a binary search in them finds both cuts of
every row.  No step shuffles or loops over characters or rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .frames import releasing

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts so many are rearranged, and of 100 rearranged ones so many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
#: The digest that cuts a text is that of this number, a colon and the row's key.
SEED = 1
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Classes of bytes: ASCII letters, bytes that go on a code point, and all others.
_LETTER, _OTHER, _FOLLOWING = 0, 1, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x80:0xC0] = _FOLLOWING


def numbers(key: Column, seed: int = SEED) -> Column:
    """Four numbers under 2**32 of a row: the first groups of 8 digits of the SHA-256 of `seed:key` (a null key: of `seed:`)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)])


def _counted(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and in all."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks stand inside texts, and in which text each does."""
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) & np.isin(data[1:-1], [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])) if len(data) > 2 else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 2 < offsets[row + 1]
    return at[inside], row[inside]


def cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one buffer: the units of each, and the bytes at which its prefix and its middle end; after the lesser and the greater of two numbers modulo units + 1."""
    kind = _CLASS[data]
    new = kind != _FOLLOWING
    new[1:] &= (kind[1:] != _LETTER) | (kind[:-1] != _LETTER)
    new[offsets[:-1][offsets[:-1] < len(data)]] = True  # counting begins anew with each text
    before = _counted(new)
    base = before[offsets[:-1]]
    n = before[offsets[1:]] - base
    a, b = first % (n + 1), second % (n + 1)
    place = lambda k: np.where(k == n, offsets[1:], np.searchsorted(before, base + k + 1) - 1)
    return n, place(np.minimum(a, b)), place(np.maximum(a, b))


def _gathered(data: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.StringArray:
    """A string a row: the bytes of `data` between the two ends of each part, one part after the other."""
    start, length = (np.stack(x, axis=1) for x in ([p[0] for p in parts], [p[1] - p[0] for p in parts]))
    out = data[W.ragged(start.ravel(), length.ravel())]
    ends = np.concatenate([[0], np.cumsum(length.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out)))


def rearranged(texts: pa.Array, h: np.ndarray, share: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> dict[str, pa.Array]:
    """Of each text (null: empty), with its four numbers as a row of `h`: n, form, output, prefix_chars and middle_chars."""
    data, offsets = W.texts_bytes(texts)
    n, low, high = cuts(data, offsets, h[:, 0], h[:, 1])
    begin, end = offsets[:-1], offsets[1:]
    plain = (begin == end) | (h[:, 2] % 100 >= share)
    plain[_marks(data, offsets)[1]] = True
    spm = ~plain & (h[:, 3] % 100 < suffix_first)
    chars = _counted(_CLASS[data] != _FOLLOWING)

    marked = np.concatenate([data, np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8)])
    mark = lambda k: (np.where(plain, 0, len(data) + 3 * k), np.where(plain, 0, len(data) + 3 * k + 3))
    either = lambda a, b: tuple(np.where(spm, x, y) for x, y in zip(a, b, strict=True))
    prefix, suffix, middle = (begin, low), (high, end), (low, high)
    none = np.zeros(len(n), np.int64)
    first = tuple(np.where(plain, x, y) for x, y in zip((begin, end), either(suffix, prefix), strict=True))
    rest = [tuple(np.where(plain, none, x) for x in part) for part in (either(prefix, suffix), middle)]
    output = _gathered(marked, [either(mark(1), mark(0)), first, either(mark(0), mark(1)), rest[0], mark(2), rest[1]])
    counted = lambda a, b: pa.array(chars[b] - chars[a], mask=plain)
    form = pa.array(np.where(plain, PLAIN, np.where(spm, SPM, PSM)).astype(object), pa.string())
    return {"n": pa.array(n), "form": form, "output": output, "prefix_chars": counted(*prefix), "middle_chars": counted(*middle)}


def restored(outputs: pa.Array, forms: pa.Array) -> pa.StringArray:
    """The texts again, from outputs and forms alone: no text that holds a mark is rearranged, so each mark stands once where it was put."""
    data, offsets = W.texts_bytes(outputs)
    form = forms.to_numpy(zero_copy_only=False)
    moved = (form == PSM) | (form == SPM)
    at, row = _marks(data, offsets)
    own = moved[row]
    at, row = at[own], row[own]
    place = np.zeros((3, len(form)), np.int64)
    for k, mark in enumerate((PREFIX, SUFFIX, MIDDLE)):
        of = data[at + 1] == mark[1]
        place[k, row[of]] = at[of]
    p, s, m = place
    spm, end = form == SPM, offsets[1:]
    prefix = (np.where(moved, p + 3, offsets[:-1]), np.where(moved, np.where(spm, m, s), end))
    middle = (np.where(moved, m + 3, 0), np.where(moved, end, 0))
    suffix = (np.where(moved, s + 3, 0), np.where(moved, np.where(spm, p, m), 0))
    return _gathered(data, [prefix, middle, suffix])


def _mapped(df: DataFrame, run: Callable[[pa.RecordBatch], Iterator[list[pa.Array]]], kept: list[str], fields: str) -> DataFrame:
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), fields])
    names = [*kept, *(f.split()[0].strip("`") for f in fields.split(", "))]
    return df.mapInArrow(releasing(lambda batches: (pa.record_batch(x, names=names) for b in batches for x in run(b))), schema)


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, share: int = REARRANGED, suffix_first: int = SUFFIX_FIRST, keep: list[str] | None = None
) -> DataFrame:
    """The columns `keep` (None: all) with n (units), form, output, prefix_chars and middle_chars (code points; null for plain rows).

    A null text is empty. Rows that are empty, hold a mark, or by their numbers
    are left as they are, are plain. Rows of one key are cut by the same
    numbers; repeated rows stay, and columns named as the new ones are replaced.
    """
    new = ("n", "form", "output", "prefix_chars", "middle_chars")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"), numbers(F.col(f"`{key}`"), seed).alias("__h"))

    def run(batch):
        h = batch["__h"].flatten().to_numpy().reshape(-1, 4)
        for at, texts in W.pieces(batch["__text"]):
            out = rearranged(texts, h[at : at + len(texts)], share, suffix_first)
            yield [*(batch[c].slice(at, len(texts)) for c in kept), *(out[c] for c in new)]

    return _mapped(own, run, kept, "n bigint, form string, output string, prefix_chars bigint, middle_chars bigint")


def restore(rows: DataFrame, output: str = "output", form: str = "form", to: str = "restored", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (None: all) with the text that transform() has rearranged, made from the columns output and form (null: an empty text, and plain)."""
    kept = [c for c in (rows.columns if keep is None else keep) if c != to]
    own = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{output}`").alias("__output"), F.col(f"`{form}`").alias("__form"))

    def run(batch):
        for at, outputs in W.pieces(batch["__output"]):
            yield [*(batch[c].slice(at, len(outputs)) for c in kept), restored(outputs, batch["__form"].slice(at, len(outputs)))]

    return _mapped(own, run, kept, f"`{to}` string")

"""What the operators share: text columns mapped in Arrow batches, and sizes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Bytes of text of a block of documents: what one group of rows holds in a worker.
BLOCK_BYTES = 7_000_000
#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 16_000_000
_TEXT = "__text"


def releasing(run: Callable) -> Callable:
    """`run`, a function over Arrow batches, which at a task's end gives memory that is free back to the system: Spark keeps its workers for other tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def map_texts(
    df: DataFrame, text: str, fn: Callable[[pa.Array], dict[str, pa.Array]], fields: dict[str, str], keep: list[str] | None = None, most: int = W.CHUNK_BYTES
) -> DataFrame:
    """Each row with what `fn` makes of its text, over Arrow batches and without a shuffle.

    keep: the columns that stay (None: all); a column named as one of `fields`
    is replaced.  A null text reaches `fn` as it is.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in fields]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(_TEXT))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), *(f"`{k}` {v}" for k, v in fields.items())])

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for at, texts in W.pieces(table[_TEXT], most):
                out = fn(texts)
                part = table.slice(at, len(texts)).select(kept)
                for name in fields:
                    part = part.append_column(name, out[name])
                yield from part.combine_chunks().to_batches()

    return source.mapInArrow(releasing(run), schema)


def if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, a written table, to be broadcast where its values have `most` bytes as text at most."""
    size = functools.reduce(Column.__add__, (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def n_blocks(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Into how many blocks of documents to deal `df`, from the bytes of its texts: one scan of that column."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))

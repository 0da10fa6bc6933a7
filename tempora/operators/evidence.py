"""Evidence: digests, limits and spans of texts by bytes and characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.guards import code, finite, first_code, is_sha256

#: Bytes that an artifact and a document may have.
MAX_ARTIFACT, MAX_DOCUMENT = 64 << 20, 16 << 20


def digest(content: Column) -> Column:
    """SHA-256 in lowercase hex."""
    return F.sha2(content.cast("binary"), 256)


def artifact_error(content: Column, claimed: Column, most: int = MAX_ARTIFACT) -> Column:
    n = F.octet_length(content)
    return first_code(
        code(content.isNull() | (n == 0), "EmptyEvidence"), code(n > most, "EvidenceTooLarge"), code(~is_sha256(claimed, False), "InvalidContentDigest"), code(F.lower(claimed) != digest(content), "DigestMismatch")
    )


def document_error(text: Column, claimed: Column, scalars: Column, most: int = MAX_DOCUMENT) -> Column:
    return first_code(artifact_error(text, claimed, most), code(scalars != F.char_length(text), "CharacterRangeMismatch"))


def _prefix(text: Column, n: Column) -> Column:
    return F.substring(F.encode(text, "UTF-8"), F.lit(1), n.cast("int"))


def span_error(text: Column, byte_start: Column, byte_end: Column, scalar_start: Column, scalar_end: Column) -> Column:
    """Half-open ranges of bytes and of characters must be the same span, on whole characters."""
    size, chars = F.octet_length(text), F.char_length(text)
    starts, ends = _prefix(text, byte_start), _prefix(text, byte_end)
    boundary = F.is_valid_utf8(starts.cast("string")) & F.is_valid_utf8(ends.cast("string"))
    agree = (F.char_length(starts.cast("string")) == scalar_start) & (F.char_length(ends.cast("string")) == scalar_end)
    return first_code(
        code((byte_start > byte_end) | (scalar_start > scalar_end), "InvalidSourceSpanOrder"),
        code((byte_start == byte_end) | (scalar_start == scalar_end), "EmptySourceSpan"),
        code((byte_start < 0) | (byte_end > size) | (scalar_start < 0) | (scalar_end > chars), "ByteRangeOutOfBounds"),
        code(~boundary, "InvalidUtf8Boundary"),
        code(~agree, "CharacterRangeMismatch"),
    )


def span_text(text: Column, byte_start: Column, byte_end: Column) -> Column:
    return F.substring(F.encode(text, "UTF-8"), (byte_start + 1).cast("int"), (byte_end - byte_start).cast("int")).cast("string")


def page_error(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column, page: Column) -> Column:
    """A box on a page: finite, of some size, and inside."""
    numbers = [width, height, x, y, w, h]
    bad = ~finite(numbers[0])
    for n in numbers[1:]:
        bad = bad | ~finite(n)
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (width > 0) & (height > 0) & (x + w <= width) & (y + h <= height)
    return first_code(code(page.isNull() | (page < 1), "InvalidPageLocation"), code(bad | ~inside, "InvalidPageLocation"))

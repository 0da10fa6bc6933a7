"""Strict versioned JSON: unknown, missing and repeated keys are rejected, which from_json alone doesn't do."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import evidence
from . import intervals
from .clocks import CLOCKS, parse_rfc3339, to_rfc3339
from .guards import code, first_code

SCHEMA_VERSION = 1
#: The fields of an end, of a page's box and of a span's ranges.
_BOUNDARY = "struct<kind:string,timestamp:string>"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out a single time however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)


def keys(payload: Column) -> Column:
    """The object's keys in order; a key given twice is there twice."""
    return F.array_sort(F.json_object_keys(payload))


def keys_error(own: Column, *names: str) -> Column:
    """InvalidWirePayload unless keys() gave exactly these."""
    return code(~F.coalesce(own == F.array(*[F.lit(k) for k in sorted(names)]), F.lit(False)), "InvalidWirePayload")


def _read(payload: Column, kind: str, judge: Callable[[Column, Column], tuple[Column, Column]]) -> tuple[Column, Column]:
    """(value, error code) by judge(fields, keys) of an object that is parsed once; the value is null where there is an error."""

    def judged(w: Column) -> Column:
        value, error = judge(w["wire"], w["keys"])
        return F.struct(value.alias("value"), error.alias("error"))

    out = once(F.struct(F.from_json(payload, kind).alias("wire"), keys(payload).alias("keys")), judged)
    kept = once(out, lambda r: F.when(r["error"].isNull(), r["value"]))
    return kept, out["error"]


def encode_clock(at: Column, clock: str) -> Column:
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(clock).alias("clock_type"), to_rfc3339(at).alias("timestamp")))


def _header_error(wire: Column, clock: str) -> Column:
    return first_code(code(~F.coalesce(wire["schema_version"] == SCHEMA_VERSION, F.lit(False)), "UnsupportedSchemaVersion"), code(~F.coalesce(wire["clock_type"] == clock, F.lit(False)), "ClockTypeMismatch"))


def decode_clock(payload: Column, clock: str) -> tuple[Column, Column]:
    """(instant, error code)."""

    def judge(wire: Column, own: Column) -> tuple[Column, Column]:
        both = once(parse_rfc3339(wire["timestamp"]), lambda at: F.struct(at.alias("at"), code(at.isNull(), "InvalidTimestamp").alias("error")))
        return both["at"], first_code(keys_error(own, "schema_version", "clock_type", "timestamp"), _header_error(wire, clock), both["error"])

    return _read(payload, "schema_version int, clock_type string, timestamp string", judge)


def encode_interval(interval: Column, clock: str) -> Column:
    end = lambda kind, at: F.struct(kind.alias("kind"), F.when(kind != intervals.UNBOUNDED, to_rfc3339(at)).alias("timestamp"))
    fields = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "clock_type": F.lit(clock),
        "certainty": interval["certainty"],
        "precision": interval["precision"],
        "lower": end(interval["lower_kind"], interval["lower"]),
        "upper": end(interval["upper_kind"], interval["upper"]),
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _boundary_error(payload: Column, side: str, kind: Column) -> Column:
    """An unbounded end has its kind alone, the others a timestamp too; anything else is InvalidWirePayload."""

    def judged(end: Column) -> Column:
        own, stamp = end["keys"], end["stamp"]
        return (
            F.when(kind == intervals.UNBOUNDED, keys_error(own, "kind"))
            .when(kind.isin(intervals.INCLUDED, intervals.EXCLUDED), first_code(keys_error(own, "kind", "timestamp"), code(stamp.isNull(), "InvalidWirePayload")))
            .otherwise(F.lit("InvalidWirePayload"))
        )

    parsed = once(F.get_json_object(payload, f"$.{side}"), lambda end: F.struct(keys(end).alias("keys"), F.get_json_object(end, "$.timestamp").alias("stamp")))
    return once(parsed, judged)


def decode_interval(payload: Column, clock: str) -> tuple[Column, Column]:
    """(interval, error code): keys of the object and of both ends are strict, and what it claims to be is validated again."""
    own = ("schema_version", "clock_type", "certainty", "precision", "lower", "upper")

    def judge(wire: Column, names: Column) -> tuple[Column, Column]:
        lower, upper = wire["lower"], wire["upper"]
        times = F.struct(*[parse_rfc3339(end["timestamp"]).alias(n) for n, end in (("lo", lower), ("hi", upper))])

        def timed(at: Column) -> Column:
            lk, uk, lo, hi, certainty, precision = lower["kind"], upper["kind"], at["lo"], at["hi"], wire["certainty"], wire["precision"]
            ends = code(((lk != intervals.UNBOUNDED) & lo.isNull()) | ((uk != intervals.UNBOUNDED) & hi.isNull()), "InvalidTimestamp")
            open_ = (lk == intervals.UNBOUNDED) & (uk == intervals.UNBOUNDED)
            exact = (lk == intervals.INCLUDED) & (uk == intervals.INCLUDED) & lo.eqNullSafe(hi)
            kind = (
                F.when(certainty == "bounded", intervals.bounded_error(lk, lo, uk, hi, precision))
                .when(certainty == "exact", code(~exact | (precision == "unknown"), "InvalidIntervalCertainty"))
                .when(certainty == "unknown", code(~open_ | (precision != "unknown"), "InvalidIntervalCertainty"))
                .otherwise(F.lit("InvalidIntervalCertainty"))
            )
            value = F.struct(lk.alias("lower_kind"), lo.alias("lower"), uk.alias("upper_kind"), hi.alias("upper"), precision.alias("precision"), certainty.alias("certainty"))
            return F.struct(value.alias("value"), first_code(ends, kind).alias("error"))

        shape = first_code(_boundary_error(payload, "lower", lower["kind"]), _boundary_error(payload, "upper", upper["kind"]))
        found = once(times, timed)
        return found["value"], first_code(keys_error(names, *own), shape, _header_error(wire, clock), found["error"])

    return _read(payload, f"schema_version int, clock_type string, certainty string, precision string, lower {_BOUNDARY}, upper {_BOUNDARY}", judge)


def clock_schema(clock: str) -> dict:
    """JSON Schema (2020-12) of a clock's wire form."""
    if clock not in CLOCKS:
        raise ValueError(f"unknown clock {clock}")
    return _schema({"schema_version": {"const": SCHEMA_VERSION}, "clock_type": {"const": clock}, "timestamp": {"type": "string", "format": "date-time"}})


def interval_schema(clock: str) -> dict:
    bound = {"oneOf": [_object({"kind": {"const": "unbounded"}}), _object({"kind": {"enum": ["included", "excluded"]}, "timestamp": {"type": "string", "format": "date-time"}})]}
    own = {"certainty": {"enum": list(intervals.CERTAINTIES)}, "precision": {"enum": list(intervals.PRECISIONS)}, "lower": bound, "upper": bound}
    return _schema({"schema_version": {"const": SCHEMA_VERSION}, "clock_type": {"const": clock}, **own})


def _object(properties: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": properties, "required": list(properties)}


def _schema(properties: dict) -> dict:
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **_object(properties)}


def encode_artifact(id: Column, content: Column) -> Column:
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), id.alias("artifact_id"), F.base64(content.cast("binary")).alias("content"), F.sha2(content.cast("binary"), 256).alias("content_digest")))


def decode_artifact(payload: Column) -> tuple[Column, Column]:
    """(struct of id and content, error code); the content is hashed again."""

    def judge(wire: Column, own: Column) -> tuple[Column, Column]:
        def hashed(content: Column) -> Column:
            differs = code(~F.coalesce(F.sha2(content, 256) == wire["content_digest"], F.lit(False)), "DigestMismatch")
            return F.struct(F.struct(wire["artifact_id"].alias("artifact_id"), content.alias("content")).alias("value"), differs.alias("error"))

        found = once(F.unbase64(wire["content"]), hashed)
        return found["value"], first_code(keys_error(own, "schema_version", "artifact_id", "content", "content_digest"), _version_error(wire), found["error"])

    return _read(payload, "schema_version int, artifact_id string, content string, content_digest string", judge)


def encode_document(id: Column, artifact_id: Column, text: Column) -> Column:
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), id.alias("document_id"), artifact_id.alias("source_artifact_id"), F.sha2(text.cast("binary"), 256).alias("content_sha256"), text.alias("text")))


def _version_error(wire: Column) -> Column:
    return code(~F.coalesce(wire["schema_version"] == SCHEMA_VERSION, F.lit(False)), "UnsupportedSchemaVersion")


def decode_document(payload: Column) -> tuple[Column, Column]:
    """(struct of document_id, source_artifact_id, text; error code); the text is hashed again."""

    def judge(wire: Column, own: Column) -> tuple[Column, Column]:
        error = first_code(
            keys_error(own, "schema_version", "document_id", "source_artifact_id", "content_sha256", "text"),
            _version_error(wire),
            evidence.document_error(wire["text"], wire["content_sha256"], F.char_length(wire["text"])),
        )
        return F.struct(*[wire[c].alias(c) for c in ("document_id", "source_artifact_id", "text")]), error

    return _read(payload, "schema_version int, document_id string, source_artifact_id string, content_sha256 string, text string", judge)


_PAGE = ("page_number", "page_width", "page_height", "x", "y", "width", "height")
_RANGE = ("byte_start", "byte_end", "scalar_start", "scalar_end")


def encode_span(document_id: Column, ranges: list[Column], page: list[Column] | None = None) -> Column:
    """ranges: bytes' start and end, characters' start and end; page: number, width and height, and a box of x, y, width, height."""
    own = F.struct(*[c.alias(n) for n, c in zip(_PAGE, page, strict=True)]) if page else F.lit(None).cast("struct<page_number:int>")
    fields = [F.lit(SCHEMA_VERSION).alias("schema_version"), document_id.alias("document_id"), *[c.cast("long").alias(n) for n, c in zip(_RANGE, ranges, strict=True)], own.alias("page_location")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def decode_span(payload: Column, document_id: Column, text: Column) -> tuple[Column, Column]:
    """(struct of the ranges and the page; error code) of a span of the document `document_id` with `text`; both are validated again."""
    kinds = ", ".join([*(f"{n} bigint" for n in _RANGE), f"page_location struct<page_number:int,{','.join(f'{n}:double' for n in _PAGE[1:])}>"])

    def judge(wire: Column, own: Column) -> tuple[Column, Column]:
        page = wire["page_location"]
        there = once(F.get_json_object(payload, "$.page_location"), lambda p: F.struct(p.isNotNull().alias("given"), F.when(p.isNotNull(), keys_error(keys(p), *_PAGE)).alias("error")))

        def placed(p: Column) -> Column:
            strict = first_code(keys_error(own, "schema_version", "document_id", *_RANGE, "page_location"), p["error"])
            box = F.when(p["given"], evidence.page_error(*[page[n] for n in _PAGE[1:]], page["page_number"]))
            missing = code(functools.reduce(Column.__or__, (wire[n].isNull() for n in _RANGE)), "InvalidWirePayload")
            return first_code(strict, missing, _version_error(wire), code(~wire["document_id"].eqNullSafe(document_id), "SpanDocumentMismatch"), box, evidence.span_error(text, *[wire[n] for n in _RANGE]))

        return F.struct(*[wire[n].alias(n) for n in _RANGE], page.alias("page_location")), once(there, placed)

    return _read(payload, f"schema_version int, document_id string, {kinds}", judge)

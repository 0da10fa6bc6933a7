"""Uncertain intervals: STRUCT<lower_kind, lower, upper_kind, upper, precision, certainty>, ends as instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clocks import as_nanosecond
from .guards import code, first_code, one_of

UNBOUNDED, INCLUDED, EXCLUDED = "unbounded", "included", "excluded"
BOUNDARIES = (UNBOUNDED, INCLUDED, EXCLUDED)
#: Names of precision and certainty.
PRECISIONS = ("nanosecond", "microsecond", "millisecond", "second", "minute", "hour", "day", "month", "quarter", "year", "unknown")
CERTAINTIES = ("exact", "bounded", "unknown")


def _interval(lk: Column, lo: Column, uk: Column, hi: Column, precision: Column, certainty: Column) -> Column:
    return F.struct(lk.alias("lower_kind"), lo.alias("lower"), uk.alias("upper_kind"), hi.alias("upper"), precision.alias("precision"), certainty.alias("certainty"))


def exact(at: Column, precision: Column) -> Column:
    return _interval(F.lit(INCLUDED), at, F.lit(INCLUDED), at, precision, F.lit("exact"))


def bounded(lower_kind: Column, lower: Column, upper_kind: Column, upper: Column, precision: Column) -> Column:
    return _interval(lower_kind, lower, upper_kind, upper, precision, F.lit("bounded"))


def unknown() -> Column:
    none = F.lit(None).cast("struct<sec:bigint,nano:int>")
    return _interval(F.lit(UNBOUNDED), none, F.lit(UNBOUNDED), none, F.lit("unknown"), F.lit("unknown"))


def bounded_error(lower_kind: Column, lower: Column, upper_kind: Column, upper: Column, precision: Column) -> Column:
    """Both ends open: InvalidIntervalCertainty; reversed: InvalidIntervalOrder; a point, or the open gap of one nanosecond: EmptyInterval."""
    both = (lower_kind != UNBOUNDED) & (upper_kind != UNBOUNDED)
    a, b = as_nanosecond(lower), as_nanosecond(upper)
    return first_code(
        code(~one_of(precision, PRECISIONS) | (precision == "unknown"), "InvalidTemporalPrecision"),
        code(~one_of(lower_kind, BOUNDARIES) | ~one_of(upper_kind, BOUNDARIES), "InvalidWirePayload"),
        code((lower_kind == UNBOUNDED) & (upper_kind == UNBOUNDED), "InvalidIntervalCertainty"),
        code(both & (a > b), "InvalidIntervalOrder"),
        code(both & (a == b), "EmptyInterval"),
        code(both & (lower_kind == EXCLUDED) & (upper_kind == EXCLUDED) & (b - a <= 1), "EmptyInterval"),
    )


def contains(interval: Column, at: Column) -> Column:
    """Whether an instant lies inside; an unknown interval contains none."""
    lk, uk = interval["lower_kind"], interval["upper_kind"]
    low = (lk == UNBOUNDED) | ((lk == INCLUDED) & (interval["lower"] <= at)) | ((lk == EXCLUDED) & (interval["lower"] < at))
    high = (uk == UNBOUNDED) | ((uk == INCLUDED) & (at <= interval["upper"])) | ((uk == EXCLUDED) & (at < interval["upper"]))
    return F.coalesce((interval["certainty"] != "unknown") & low & high, F.lit(False))


def closed(low: Column, high: Column, at: Column) -> Column:
    """low <= at <= high: the window of memberships and event instances."""
    return (low <= at) & (at <= high)


def half_open(low: Column, high: Column, at: Column) -> Column:
    """low <= at < high, a NULL high being open: the window of bitemporal rows."""
    return (low <= at) & (high.isNull() | (at < high))

"""Instants and the six clocks.

An instant is a STRUCT<sec BIGINT, nano INT>, which orders as it should and
keeps nanoseconds; TIMESTAMP serves where the source has microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The clocks.
CLOCKS = ("event_time", "assertion_time", "document_time", "system_time", "available_time", "knowledge_cutoff")
#: The strict profile: T and seconds required, 1 to 9 fraction digits, Z or an offset.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:[0-5]\d(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"


def is_strict_rfc3339(text: Column) -> Column:
    """The lexical test alone: no -00:00, no second 60, no lower-case letters."""
    return F.coalesce(text.rlike(RFC3339) & ~text.rlike(r"-00:00$"), F.lit(False))


def parse_rfc3339(text: Column) -> Column:
    """The instant, or NULL where the text isn't one (a date that doesn't exist, an hour 24 or an offset beyond 23:59 included)."""
    head = F.substring(text, 1, 19)
    zone = F.regexp_extract(text, r"(Z|[+-]\d{2}:\d{2})$", 1)
    sound_zone = (zone == "Z") | zone.rlike(r"^[+-]([01]\d|2[0-3]):[0-5]\d$")
    local = F.try_to_timestamp(F.concat(head, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    hours, minutes = (F.coalesce(F.substring(zone, a, 2).try_cast("int"), F.lit(0)) for a in (2, 5))
    offset = F.when(zone == "Z", 0).otherwise(sign * (hours * 3600 + minutes * 60))
    digits = F.regexp_extract(text, r"\.(\d{1,9})", 1)
    nano = F.when(digits == "", 0).otherwise(F.rpad(digits, 9, "0").try_cast("int"))
    ok = is_strict_rfc3339(text) & sound_zone & local.isNotNull()
    return F.when(ok, F.struct((F.unix_seconds(local) - offset).cast("long").alias("sec"), nano.alias("nano")))


def as_nanosecond(instant: Column) -> Column:
    """Nanoseconds since the epoch as DECIMAL(38, 0)."""
    return (instant["sec"].cast("decimal(28,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + instant["nano"].cast("decimal(10,0)")).cast("decimal(38,0)")


def to_rfc3339(instant: Column) -> Column:
    """Canonical UTC text: a fraction only where there is one, without trailing zeros."""
    # whole days and the rest, so that the session's time zone has no say
    days, rest = F.floor(instant["sec"] / 86_400).cast("int"), F.pmod(instant["sec"], F.lit(86_400))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    clock_ = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(rest / 60) % 60), two(rest % 60))
    base = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), F.lit("T"), clock_)
    fraction = F.rtrim(F.lpad(instant["nano"].cast("string"), 9, "0"), F.lit("0"))
    return F.concat(base, F.when(instant["nano"] > 0, F.concat(F.lit("."), fraction)).otherwise(F.lit("")), F.lit("Z"))


def from_timestamp(ts: Column) -> Column:
    """The instant of a timestamp; one without a zone, or a date, is read as UTC whatever the session's zone."""
    at = ts.cast("timestamp")
    zoneless = F.typeof(ts).isin("timestamp_ntz", "date")
    micros = F.unix_micros(F.when(zoneless, F.from_utc_timestamp(at, F.current_timezone())).otherwise(at))
    return F.when(ts.isNotNull(), F.struct(F.floor(micros / 1_000_000).cast("long").alias("sec"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int").alias("nano")))


def clock(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Mark a column as one of the six clocks."""
    if kind not in CLOCKS:
        raise ValueError(f"unknown clock {kind}")
    return df.withMetadata(column, {"clock_type": kind})


def same_clock(df: DataFrame, *columns: str) -> str:
    """The clock of the columns; mixing clocks raises."""
    kinds = {df.schema[c].metadata.get("clock_type") for c in columns}
    if len(kinds) != 1 or None in kinds:
        raise TypeError(f"clocks differ: {sorted(map(str, kinds))}")
    return kinds.pop()

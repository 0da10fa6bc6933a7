"""Streams of versions, as an extension: the reference semantics are batch ones.

A cutoff is a rule about what was available, not a watermark: late evidence is
withheld by its available_time, however late it arrives. The watermark here
only bounds the state that duplicate ids need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bitemporal import is_eligible


def eligible_stream(versions: DataFrame, cutoff: Column, available: str = "available_time", id: str = "document_record_id", keep: str = "1 day") -> DataFrame:
    """Rows that the cutoff admits, each id once within `keep` of available time."""
    admitted = versions.where(is_eligible(F.col(available), cutoff))
    return admitted.withWatermark(available, keep).dropDuplicatesWithinWatermark([id])


def counted_by_window(versions: DataFrame, width: str, keep: str, available: str = "available_time") -> DataFrame:
    """How many versions became available in each window."""
    return versions.withWatermark(available, keep).groupBy(F.window(available, width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")

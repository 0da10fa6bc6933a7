"""Event mentions and the instances they are promoted to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import blank, code, finite, first_code, one_of
from ..functions.intervals import closed
from .sequence import stored_before

#: What an argument is to an event.
ROLES = ("agent", "patient", "factor", "product", "place", "instrument", "beneficiary")


def mention_error(surface: str = "surface_form", confidence: str = "confidence") -> Column:
    c = F.col(confidence)
    return first_code(code(blank(F.col(surface)), "InvalidWirePayload"), code(~finite(c) | (c < 0) | (c > 1), "InvalidConfidence"))


def promote(mentions: DataFrame, instance: str = "instance_id") -> DataFrame:
    """An instance of the mentions that name it: sorted mention ids, first and last time, mean confidence, and a code where the window isn't proper.

    An instance's mentions are its own content and go into one row.
    """
    g = mentions.where(F.col(instance).isNotNull()).groupBy(instance).agg(
        F.sort_array(F.collect_set("mention_id")).alias("supporting_mentions"), F.min("at").alias("valid_from"), F.max("at").alias("valid_to"), F.avg("confidence").alias("confidence")
    )
    return g.withColumn("error_code", first_code(code(F.size("supporting_mentions") == 0, "InvalidWirePayload"), code(F.col("valid_from") >= F.col("valid_to"), "EmptyInterval")))


def mention_as_instance(*_: object) -> None:
    """A mention is never an instance."""
    raise TypeError("MentionIsNotInstance")


def registry_error(instances: DataFrame, mentions: DataFrame, id: str = "instance_id", seq: str | None = None) -> DataFrame:
    """Instances with DuplicateEventInstance where an earlier one (by `seq`) was registered under the id, or UnknownEventInstance where a supporting mention isn't registered."""
    wanted = instances.select(id, _digest().alias("__row"), F.explode("supporting_mentions").alias("mention_id"))
    missing = wanted.join(mentions.select("mention_id").distinct(), "mention_id", "left_anti").select(F.col(id).alias("__id"), "__row").distinct()
    out = instances.join(missing, [F.col(id) == F.col("__id"), _digest() == F.col("__row")], "left").withColumn("__missing", F.col("__id").isNotNull()).drop("__id", "__row")
    again = stored_before(instances, [id], ~F.col("__missing"), seq)
    return out.withColumn("error_code", first_code(code(again, "DuplicateEventInstance"), code(F.col("__missing"), "UnknownEventInstance"))).drop("__missing")


def _digest() -> Column:
    """Tells rows of one id apart by their mentions."""
    return F.xxhash64("supporting_mentions")


def assign_roles(instances: DataFrame, roles: DataFrame, id: str = "instance_id") -> DataFrame:
    """Instances with their roles ARRAY<STRUCT<role, argument>> in the order of `seq`; unknown roles are left out (role_error tells them)."""
    own = roles.where(one_of(F.col("role"), ROLES)).groupBy(id).agg(F.sort_array(F.collect_list(F.struct("seq", "role", "argument"))).alias("r"))
    listed = F.transform("r", lambda x: F.struct(x["role"].alias("role"), x["argument"].alias("argument")))
    return instances.join(own, id, "left").withColumn("roles", F.coalesce(listed, F.array().cast("array<struct<role:string,argument:string>>"))).drop("r")


def role_error(role: str = "role") -> Column:
    return code(~one_of(F.col(role), ROLES), "UnknownEventRole")


def active_at(instances: DataFrame, at: Column) -> DataFrame:
    return instances.where(closed(F.col("valid_from"), F.col("valid_to"), at))

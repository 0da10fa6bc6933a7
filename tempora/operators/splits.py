"""Leakage-safe corpus splits: cutoff snapshots, connected groups, rolling origins, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import code, first_code
from .bitemporal import is_eligible
from .components import connected_components
from .sequence import stored_before

#: The kinds of link that must not cross a split.
LINK_KINDS = ("revision", "translation", "copied_variant", "same_episode")


def snapshot(documents: DataFrame, cutoff: Column, id: str = "document_id", available: str = "available_time", seq: str | None = None) -> DataFrame:
    """Documents with error_code: UnavailableAtCutoff for late ones, DuplicateDocument for an id that an earlier row (by `seq`) has taken."""
    late = ~is_eligible(F.col(available), cutoff)
    again = stored_before(documents, [id], ~late, seq)
    return documents.withColumn("error_code", first_code(code(late, "UnavailableAtCutoff"), code(again, "DuplicateDocument")))


def connected_groups(universe: DataFrame, links: DataFrame, id: str = "document_id", left: str = "left", right: str = "right") -> DataFrame:
    """(id, group): the smallest id that a document's links reach; self-links and links out of the universe don't count, lonely documents are their own group."""
    ids = universe.select(F.col(id).alias("id")).where("id IS NOT NULL").distinct()
    inside = links.where(F.col(left) != F.col(right)).select(F.col(left).alias("left"), F.col(right).alias("right"))
    for side in ("left", "right"):
        inside = inside.join(ids.withColumnRenamed("id", side), side, "left_semi")
    found = connected_components(inside)
    return ids.join(found, ids["id"] == found["node"], "left").select(F.col("id").alias(id), F.coalesce("component", "id").alias("group"))


def group_leakage(groups: DataFrame, assignment: DataFrame, id: str = "document_id", partition: str = "partition") -> DataFrame:
    """Groups whose assigned members lie in more than one partition; unassigned members don't count."""
    both = groups.join(assignment.where(F.col(partition).isNotNull()).select(id, partition), id)
    return both.groupBy("group").agg(F.min(partition).alias("low"), F.max(partition).alias("high")).where("low <> high").select("group")


def rolling_origin(cutoffs: DataFrame, cutoff: str = "cutoff") -> DataFrame:
    """(train_cutoff, test_cutoff) of neighbouring cutoffs. The list of cutoffs is a calendar: one small window."""
    w = Window.orderBy(cutoff)
    return cutoffs.select(F.col(cutoff).alias("train_cutoff"), F.lead(cutoff).over(w).alias("test_cutoff")).where("test_cutoff IS NOT NULL")


def cutoffs_error(cutoffs: DataFrame, cutoff: str = "cutoff") -> DataFrame:
    """One row: InvalidRollingOrigin for fewer than two cutoffs or equal ones."""
    s = cutoffs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(cutoff).alias("d"))
    return s.select(code((F.col("n") < 2) | (F.col("d") < F.col("n")), "InvalidRollingOrigin").alias("error_code"))


def effective_sample_size(weight: str = "weight") -> Column:
    """Kish's (sum w)^2 / sum w^2; 0 where there is no weight."""
    w = F.col(weight)
    return F.coalesce(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)), F.lit(0).cast("double"))


def group_normalized(rows: DataFrame, group: str = "group", weight: str = "weight", to: str = "normalized") -> DataFrame:
    """Weights as shares of their group; rows of weight 0 or less go, and so do groups without any."""
    positive = rows.where(F.col(weight) > 0)
    sums = positive.groupBy(group).agg(F.sum(weight).alias("__sum"))
    return positive.join(sums, group).withColumn(to, F.col(weight) / F.col("__sum")).drop("__sum")

"""Retention, legal holds, tombstones, tenants and checks of a restored snapshot.

Plain Spark has no row security and no triggers: these are rules that a writer
or reader applies, not a boundary that holds against one who doesn't.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import code, first_code, is_sha256, one_of
from .sequence import neighbours

#: Vocabularies.
DELETION_KINDS = ("expiry", "revocation", "identity")
BLOCKING_KINDS = ("revocation", "identity")
HOLD_SCOPES = ("tenant", "document")
HOLD_STATES = ("active", "released")
POLICY_STATES = ("active", "superseded")
AVAILABILITIES = ("available", "restricted", "unavailable")


def active_documents(documents: DataFrame, tombstones: DataFrame, deletions: DataFrame, id: str = "document_record_id") -> DataFrame:
    """Open documents without a tombstone and without a completed deletion by revocation or of an identity."""
    done = deletions.where((F.col("status") == "completed") & F.col("kind").isin(*BLOCKING_KINDS))
    return documents.where(F.col("system_to").isNull()).join(tombstones.select(id), id, "left_anti").join(done.select(id), id, "left_anti")


def blocked_deletions(requests: DataFrame, holds: DataFrame, id: str = "document_record_id") -> DataFrame:
    """Requests that an active, open hold of their tenant blocks: of the whole tenant, or of the document.

    Two equi joins instead of one with an OR: the first against one row for each
    tenant with a hold of its own, which adaptive execution broadcasts or splits
    where a tenant has most of the requests.
    """
    active = holds.where((F.col("status") == "active") & F.col("system_to").isNull())
    tenants = active.where(F.col("scope") == "tenant").select("tenant_record_id").distinct()
    documents = active.where(F.col("scope") == "document").select("tenant_record_id", id).distinct()
    tenant_wide = tenants.withColumn("__t", F.lit(True))
    single = documents.withColumn("__d", F.lit(True))
    out = requests.join(tenant_wide, "tenant_record_id", "left").join(single, ["tenant_record_id", id], "left")
    return out.where("__t OR __d").select(*requests.columns)


def policy_error() -> Column:
    f, t = F.col("system_from"), F.col("system_to")
    return first_code(
        code(~one_of(F.col("status"), POLICY_STATES), "InvalidVocabulary"),
        code((F.col("status") == "active") != t.isNull(), "StatusWindowMismatch"),
        code(t.isNotNull() & (t <= f), "InvalidIntervalOrder"),
        code(F.col("retention_days").isNull() | (F.col("retention_days") <= 0), "InvalidRetention"),
    )


def hold_error(id: str = "document_record_id") -> Column:
    f, t = F.col("system_from"), F.col("system_to")
    return first_code(
        code(~one_of(F.col("scope"), HOLD_SCOPES) | ~one_of(F.col("status"), HOLD_STATES), "InvalidVocabulary"),
        code((F.col("scope") == "document") != F.col(id).isNotNull(), "ScopeDocumentMismatch"),
        code((F.col("status") == "active") != t.isNull(), "StatusWindowMismatch"),
        code(t.isNotNull() & (t <= f), "InvalidIntervalOrder"),
    )


_BINDING = ["tenant_record_id", "retention_policy_id", "record_class", "purpose"]


def unbound_deletions(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Requests whose cited policy isn't there with the same tenant, class and purpose."""
    return requests.join(policies.select(*_BINDING).distinct(), _BINDING, "left_anti")


def tombstone_error() -> Column:
    strict = (F.col("evidence_layer") == "raw_source") & F.col("kind").isin(*BLOCKING_KINDS)
    return first_code(code(~one_of(F.col("availability"), AVAILABILITIES), "InvalidVocabulary"), code(strict & (F.col("availability") != "unavailable"), "TombstoneAvailability"))


_MATCH = ["tenant_record_id", "deletion_request_id", "document_record_id", "kind", "evidence_layer"]


def unmatched_tombstones(tombstones: DataFrame, requests: DataFrame) -> DataFrame:
    """Tombstones without a completed request of the same five columns."""
    return tombstones.join(requests.where(F.col("status") == "completed").select(*_MATCH).distinct(), _MATCH, "left_anti")


def refused_restores(documents: DataFrame, tombstones: DataFrame, id: str = "document_record_id") -> DataFrame:
    return documents.join(tombstones.select(id).distinct(), id, "left_semi")


_SERIES = ["tenant_record_id", "record_class", "purpose"]


def policy_succession(policies: DataFrame) -> DataFrame:
    """Policies with system_to as their successors close them, and PolicyConflict where two of a series start at once."""
    start = [*_SERIES, "system_from"]
    twice = policies.groupBy(*[F.col(c).alias(f"__{c}") for c in start]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    chained = neighbours(policies, _SERIES, ["system_from"], "system_from", "system_to")
    same = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in start))
    out = chained.join(twice, same, "left").withColumn("error_code", code(F.col("__n").isNotNull(), "PolicyConflict"))
    return out.drop("__n", *[f"__{c}" for c in start])


def hold_insert_error(holds: DataFrame, deletions: DataFrame, id: str = "document_record_id", at: str = "system_time") -> DataFrame:
    """New holds must be open, and no deletion of their document (of a tenant's hold: of any of the tenant's) may have been completed at their time or since."""
    done = deletions.where(F.col("status") == "completed").groupBy("tenant_record_id", id).agg(F.max("system_time").alias("__done"))
    of_tenant = done.groupBy("tenant_record_id").agg(F.max("__done").alias("__any"))
    out = holds.join(done, ["tenant_record_id", id], "left").join(of_tenant, "tenant_record_id", "left")
    last = F.when(F.col("scope") == "tenant", F.col("__any")).otherwise(F.col("__done"))
    codes = first_code(code(F.col("system_to").isNotNull(), "HoldNotOpen"), code(last >= F.col(at), "AlreadyDeleted"))
    return out.withColumn("error_code", codes).select(*holds.columns, "error_code")


def release_holds(holds: DataFrame, at: Column, ids: list[str]) -> DataFrame:
    hit = F.col("legal_hold_id").isin(ids) & F.col("system_to").isNull()
    return holds.withColumn("status", F.when(hit, "released").otherwise(F.col("status"))).withColumn("system_to", F.when(hit, at).otherwise(F.col("system_to")))


def of_tenant(df: DataFrame, tenant: str | None) -> DataFrame:
    """The rows of the session's tenant; without one, none."""
    return df.where(F.lit(False)) if tenant is None else df.where(F.col("tenant_record_id") == tenant)


class AppendOnly:
    """A Parquet table that is only ever added to."""

    def __init__(self, path: str):
        self.path = path

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)


# a restored snapshot


def bad_digests(documents: DataFrame, digest: str = "content_digest") -> DataFrame:
    return documents.where(~is_sha256(F.col(digest), False))


def bad_windows(rows: DataFrame, start: str = "system_from", end: str = "system_to") -> DataFrame:
    return rows.where(F.col(end).isNotNull() & (F.col(end) <= F.col(start)))


def missing_manifests(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    return runs.join(manifests.select("manifest_id").distinct(), "manifest_id", "left_anti")


def past_cutoff(artifacts: DataFrame, manifests: DataFrame, available: str = "available_time") -> DataFrame:
    """Artifacts that became available after the last knowledge cutoff of their tenant."""
    last = manifests.groupBy("tenant_record_id").agg(F.max("knowledge_cutoff").alias("__cutoff"))
    return artifacts.join(last, "tenant_record_id").where(F.col(available) > F.col("__cutoff")).drop("__cutoff")


def snapshot_usable(*violations: DataFrame) -> DataFrame:
    """One row: `usable`, whether none of the probes found a row."""
    counts = None
    for i, v in enumerate(violations):
        n = v.agg(F.count(F.lit(1)).alias("n")).withColumn("probe", F.lit(i))
        counts = n if counts is None else counts.union(n)
    return counts.agg((F.sum("n") == 0).alias("usable"))  # type: ignore[union-attr]

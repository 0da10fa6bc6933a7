"""Bitemporal versions: what was known at a time, what was valid at it, and what a cutoff admits.

Rows are versions (id, valid_from, valid_to, system_from, system_to, revision);
windows are half-open and a NULL end is open. Reads are a filter and an
aggregation of one struct a row, so nothing is sorted and hot ids are
pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.guards import blank, code, first_code, is_sha256
from ..functions.intervals import half_open
from ..tables import written
from .sequence import neighbours, stored_before
from .sweeps import running, stabbed


def is_eligible(available: Column, cutoff: Column) -> Column:
    """available_time <= knowledge_cutoff, the cutoff included."""
    return F.coalesce(available <= cutoff, F.lit(False))


def insert_error(versions: DataFrame, new: DataFrame, id: str = "document_record_id", digest: str = "content_digest", seq: str | None = None) -> DataFrame:
    """`new` with the code that refuses each row: a bad digest, then an id that exists or that an earlier row (by `seq`) has taken."""
    known = versions.select(F.col(id).alias("__known")).distinct()
    sound = is_sha256(F.col(digest), False)
    out = new.withColumn("__again", stored_before(new, [id], sound, seq)).join(known, new[id] == F.col("__known"), "left")
    return out.withColumn("error_code", first_code(code(~sound, "InvalidContentDigest"), code(F.col("__known").isNotNull() | F.col("__again"), "DuplicateDocumentRecord"))).drop("__known", "__again")


def insert(versions: DataFrame, new: DataFrame, id: str = "document_record_id", seq: str | None = None) -> DataFrame:
    return versions.unionByName(insert_error(versions, new, id, seq=seq).where("error_code IS NULL").drop("error_code").select(*versions.columns))


def _revisions(versions: DataFrame, new: DataFrame, id: str, start: str, end: str, digest: str | None, seq: str | None) -> DataFrame:
    """`new` with the code that refuses each row."""
    order = F.col(seq or start)
    sound = is_sha256(F.col(digest), False) if digest else F.lit(True)
    open_ids = versions.where(F.col(end).isNull()).select(F.col(id).alias("__open")).distinct()
    until = new.where(sound & F.col(end).isNotNull()).groupBy(F.col(id).alias("__id")).agg(F.min(order).alias("__until"))
    out = new.join(open_ids, new[id] == F.col("__open"), "left").join(until, new[id] == F.col("__id"), "left")
    gone = F.col("__open").isNull() | (order > F.col("__until"))
    return out.withColumn("error_code", first_code(code(~sound, "InvalidContentDigest"), code(gone, "HistoricalVersionNotFound"))).drop("__open", "__id", "__until")


def revise(versions: DataFrame, new: DataFrame, id: str = "document_record_id", start: str = "system_from", end: str = "system_to", digest: str | None = "content_digest", seq: str | None = None) -> DataFrame:
    """Append the rows of `new` one after the other, each closing what is open of its id at its own `start`.

    Their order is `seq`, or `start` where no column says what came first. A row
    that is closed itself leaves nothing open, so what follows it is refused, as
    are rows of ids without an open row and malformed digests (`digest` None:
    the table has none); revise_error tells them.
    """
    order = seq or start
    own = _revisions(versions, new, id, start, end, digest, seq).where("error_code IS NULL").drop("error_code")
    first = own.groupBy(F.col(id).alias("__id")).agg(F.min_by(start, order).alias("__at"))
    closed = versions.join(first, versions[id] == F.col("__id"), "left").withColumn(end, F.coalesce(end, "__at")).drop("__id", "__at")
    chained = neighbours(own, [id], [order], start, "__following").withColumn(end, F.coalesce(end, "__following"))
    return closed.unionByName(chained.select(*versions.columns))


def revise_error(versions: DataFrame, new: DataFrame, id: str = "document_record_id", start: str = "system_from", end: str = "system_to", digest: str | None = "content_digest", seq: str | None = None) -> DataFrame:
    """The rows that revise() refuses, with their code: a malformed digest first, then no row of the id that is open by then."""
    return _revisions(versions, new, id, start, end, digest, seq).where("error_code IS NOT NULL")


def replay(changes: DataFrame, id: str, start: str, revision: str | None = None, end: str = "system_to") -> DataFrame:
    """Versions from a log of changes: each is closed by the next of its id (in the order of `start`, then `revision`)."""
    order = [start] + ([revision] if revision else [])
    return neighbours(changes, [id], order, start, end, None if revision else "revision")


def _latest(rows: DataFrame, id: str, by: str) -> DataFrame:
    rest = [c for c in rows.columns if c != id]
    best = F.max_by(F.struct(*rest), F.col(by))
    return rows.groupBy(id).agg(best.alias("__row")).select(id, *[F.col("__row")[c].alias(c) for c in rest]).select(*rows.columns)


def as_known_at(versions: DataFrame, known: Column, id: str = "document_record_id", revision: str = "revision_number") -> DataFrame:
    """Of each id the row with the highest revision among those the system held at `known`."""
    return _latest(versions.where(half_open(F.col("system_from"), F.col("system_to"), known)), id, revision)


def as_valid_at(versions: DataFrame, valid: Column, known: Column, id: str = "document_record_id", revision: str = "revision_number") -> DataFrame:
    """As as_known_at, among rows that are valid at `valid` too."""
    held = half_open(F.col("system_from"), F.col("system_to"), known) & half_open(F.col("valid_from"), F.col("valid_to"), valid)
    return _latest(versions.where(held), id, revision)


def _held_at(versions: DataFrame, probes: DataFrame, id: str, known: str) -> DataFrame:
    """`probes` with each version (as __version) of their id that the system held at `known`; a probe that met none has no row.

    Versions and probes are swept in one order of time: a probe that lies in
    one window only, the one that began last, has its answer from the sweep.
    Windows that overlap leave others open, which a stabbing join answers.
    """
    window = [F.col("system_from").alias("__from"), F.col("system_to").alias("__to")]
    held = versions.where(F.col("system_to").isNull() | (F.col("system_from") < F.col("system_to"))).select(id, *window, F.struct(*versions.columns).alias("__version"))
    none = F.lit(None).cast(held.schema["__version"].dataType)
    no_probe = F.lit(None).cast(probes.select(F.struct(*probes.columns).alias("p")).schema["p"].dataType)
    # at one instant: ends, starts, probes
    starts = held.select(id, F.col("__from").alias("__t"), F.lit(1).alias("__kind"), F.lit(1).alias("__step"), "__to", "__version", no_probe.alias("__probe"))
    ends = held.where("__to IS NOT NULL").select(id, F.col("__to").alias("__t"), F.lit(0).alias("__kind"), F.lit(-1).alias("__step"), F.lit(None).cast(held.schema["__to"].dataType).alias("__to"), none.alias("__version"), no_probe.alias("__probe"))
    asked = probes.where(F.col(id).isNotNull() & F.col(known).isNotNull()).select(
        id, F.col(known).alias("__t"), F.lit(2).alias("__kind"), F.lit(0).alias("__step"), F.lit(None).cast(held.schema["__to"].dataType).alias("__to"), none.alias("__version"), F.struct(*probes.columns).alias("__probe")
    )
    line = starts.unionByName(ends).unionByName(asked).withColumn("__id", F.monotonically_increasing_id())
    began = F.when(F.col("__kind") == 1, F.struct("__to", "__version"))
    swept = written(running(line, [id], ["__t", "__kind", "__id"], {"__depth": ("sum", F.col("__step").cast("long")), "__last": ("last", began)}).where("__kind = 2 AND __depth > 0").select("__probe", "__t", "__depth", "__last"))
    to = F.col("__last")["__to"]
    sure = (F.col("__depth") == 1) & (to.isNull() | (F.col("__t") < to))
    told = swept.where(sure).select("__probe.*", F.col("__last")["__version"].alias("__version"))
    open_ = swept.where(~sure).select("__probe.*")
    return told.unionByName(stabbed(held, open_, id, "__from", "__to", known, closed=False).select(*probes.columns, "__version"))


def _best(held: DataFrame, probes: list[str], id: str, revision: str) -> DataFrame:
    best = held.groupBy(*probes).agg(F.max_by("__version", F.col("__version")[revision]).alias("__version"))
    names = [c for c in held.schema["__version"].dataType.names if c not in probes]
    return best.select(*probes, *[F.col("__version")[c].alias(c) for c in names])


def as_known_at_each(versions: DataFrame, probes: DataFrame, id: str = "document_record_id", known: str = "known", revision: str = "revision_number") -> DataFrame:
    """as_known_at for each probe (id, known): its row with the highest revision among those held then. Repeated probes are answered once; one that met none, or has a null, has no row."""
    asked = probes.select(id, known).distinct()
    return _best(_held_at(versions, asked, id, known), asked.columns, id, revision)


def as_valid_at_each(versions: DataFrame, probes: DataFrame, id: str = "document_record_id", known: str = "known", valid: str = "valid", revision: str = "revision_number") -> DataFrame:
    """as_valid_at for each probe (id, known, valid), likewise: among the rows held at `known` those valid at `valid`."""
    asked = probes.select(id, known, valid).distinct()
    held = _held_at(versions, asked, id, known)
    v = F.col("__version")
    return _best(held.where(half_open(v["valid_from"], v["valid_to"], F.col(valid))), asked.columns, id, revision)


def eligible_at_cutoff(versions: DataFrame, cutoff: Column, id: str = "document_record_id", available: str = "available_time", order: str = "system_from") -> DataFrame:
    """Open rows that the cutoff admits, one an id: the one that was inserted last (by `order`)."""
    return _latest(versions.where(F.col("system_to").isNull() & is_eligible(F.col(available), cutoff)), id, order)


def instance_as_known_at(instances: DataFrame, known: Column, id: str = "event_instance_id") -> DataFrame:
    """As as_known_at, the latest system_from deciding."""
    return _latest(instances.where(half_open(F.col("system_from"), F.col("system_to"), known)), id, "system_from")


def append_audit(audit: DataFrame, new: DataFrame, id: str = "audit_event_id", seq: str | None = None) -> DataFrame:
    """`new` with ImmutableAuditViolation where the id was there before, in `audit` or in an earlier row (by `seq`)."""
    known = audit.select(F.col(id).alias("__known")).distinct()
    out = new.withColumn("__again", stored_before(new, [id], F.lit(True), seq)).join(known, new[id] == F.col("__known"), "left")
    return out.withColumn("error_code", code(F.col("__known").isNotNull() | F.col("__again"), "ImmutableAuditViolation")).drop("__known", "__again")


# guards of rows to be stored


def mention_error(mention: str = "event_mention_id", instance: str = "event_instance_id", confidence: str = "confidence") -> Column:
    c = F.col(confidence)
    return first_code(code(F.col(mention) == F.col(instance), "MentionIsInstance"), code(c.isNull() | F.isnan(c) | (c <= 0) | (c > 1), "InvalidConfidence"))


def artifact_error(new: DataFrame, stored: DataFrame, id: str = "source_artifact_id", seq: str | None = None) -> DataFrame:
    """Idempotent insert of a batch: of an id the stored row holds, or else the first of the batch; one equal to it is sound but not new, one that differs an ArtifactConflict.

    The first is told by `seq`; without it by a digest of the row, and equal rows then all are the first. A null id meets no other.
    """
    rest = [c for c in new.columns if c not in (id, seq)]
    row, order = F.struct(*rest), F.col(seq) if seq else F.xxhash64(*new.columns)
    old = stored.select(F.col(id).alias("__id"), F.struct(*rest).alias("__old"))
    first = new.groupBy(F.col(id).alias("__own")).agg(F.min_by(row, order).alias("__first"), F.min(order).alias("__least"))
    out = new.join(old, new[id] == F.col("__id"), "left").join(first, new[id] == F.col("__own"), "left")
    held = F.when(F.col("__id").isNotNull(), F.col("__old")).otherwise(F.coalesce("__first", row))
    is_new = F.col("__id").isNull() & F.coalesce(order == F.col("__least"), F.lit(True))
    return out.withColumn("error_code", code(~row.eqNullSafe(held), "ArtifactConflict")).withColumn("is_new", is_new).drop("__id", "__old", "__own", "__first", "__least")


def manifest_error(input_digest: str = "input_digest", output_digest: str = "output_digest", commit: str = "code_commit") -> Column:
    from ..functions.guards import COMMIT

    bad = ~is_sha256(F.col(input_digest)) | ~is_sha256(F.col(output_digest)) | ~F.coalesce(F.col(commit).rlike(COMMIT), F.lit(False))
    return code(bad, "InvalidManifestDigest")


def manifests_by_digests(manifests: DataFrame, input_digest: str, output_digest: str) -> DataFrame:
    return manifests.where((F.col("input_digest") == input_digest) & (F.col("output_digest") == output_digest)).limit(1)


def model_run_error(runs: DataFrame, manifests: DataFrame, splits: DataFrame) -> DataFrame:
    """A run cites a manifest, and a split if any; each must exist."""
    m = manifests.select(F.col("manifest_id").alias("__m")).distinct()
    s = splits.select(F.col("split_id").alias("__s")).distinct()
    out = runs.join(m, runs["manifest_id"] == F.col("__m"), "left").join(s, runs["split_id"] == F.col("__s"), "left")
    codes = first_code(code(F.col("__m").isNull(), "UnknownManifest"), code(F.col("split_id").isNotNull() & F.col("__s").isNull(), "UnknownSplit"))
    return out.withColumn("error_code", codes).drop("__m", "__s")


def artifacts_of_run(artifacts: DataFrame, run: str) -> DataFrame:
    return artifacts.where(F.col("model_run_id") == run).orderBy("system_time", "model_artifact_id")


#: What a database's code says about a conflict of writers.
CONFLICTS = {"40001": "SerializationFailure", "40P01": "Deadlock", "55P03": "LockNotAvailable", "23505": "UniqueViolation"}


def conflict(sqlstate: Column) -> Column:
    out = None
    for k, v in CONFLICTS.items():
        out = F.when(sqlstate == k, v) if out is None else out.when(sqlstate == k, v)
    return out.otherwise("Other")  # type: ignore[union-attr]


def is_named(x: Column) -> Column:
    return ~blank(x)


def schema_error(df: DataFrame, contract: StructType) -> list[tuple[str, str]]:
    """How a table departs from its contract, as (column, code): MissingColumn, TypeMismatch, UnexpectedNull where a column may hold nulls against it, UnknownColumn, DuplicateColumn.

    A catalog check: only the schema is looked at, no row is read.
    """
    own: dict[str, list] = {}
    for f in df.schema.fields:
        own.setdefault(f.name, []).append(f)
    out = [(name, "DuplicateColumn") for name, fields in own.items() if len(fields) > 1]
    for want in contract.fields:
        if want.name not in own:
            out.append((want.name, "MissingColumn"))
        elif own[want.name][0].dataType != want.dataType:
            out.append((want.name, "TypeMismatch"))
        elif own[want.name][0].nullable and not want.nullable:
            out.append((want.name, "UnexpectedNull"))
    return sorted(out + [(name, "UnknownColumn") for name in own if name not in contract.names])

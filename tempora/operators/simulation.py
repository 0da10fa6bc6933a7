"""Simulation of a corpus with a known truth.

The draws are one sequence, so the generator runs on the driver and its size is
the configuration's; what it makes are DataFrames.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import code, first_code

_MASK = (1 << 64) - 1
#: Hours of the synthetic calendar: 12 months of 28 days.
YEAR_HOURS = 12 * 28 * 24
#: Roles of memberships, in turn, and effects of documents with the relation that each has to its parent.
ROLES = ("author", "department", "organization", "project", "template", "episode")
VARIANTS = {"revision": "revises", "translation": "references", "template_copy": "template_copy_of"}


class SimulationError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    seed: int
    event_count: int = 4
    documents_per_event: int = 1
    membership_targets: int = 3
    max_report_delay_hours: int = 48
    max_availability_delay_hours: int = 24
    missingness_rate_bps: int = 2_500
    relation_false_negative_bps: int = 1_000
    relation_false_positive_bps: int = 500
    revision_rate_bps: int = 5_000
    translation_rate_bps: int = 5_000
    template_copy_rate_bps: int = 5_000

    def __post_init__(self):
        if min(self.event_count, self.documents_per_event, self.membership_targets) < 1:
            raise SimulationError("counts must be over 0")
        if any(f.name.endswith("_bps") and not 0 <= getattr(self, f.name) <= 10_000 for f in fields(self)):
            raise SimulationError("rates are basis points from 0 to 10000")


class SplitMix64:
    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _MASK
        z = self.state
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = ((z ^ z >> shift) * factor) & _MASK
        return z ^ z >> 31

    def below(self, n: int) -> int:
        return self.next() % n if n else 0

    def happens(self, bps: int) -> bool:
        """A rate of 0, or of 10000 and more, draws nothing."""
        return bps >= 10_000 or (bps > 0 and self.below(10_000) < bps)

    def uuid(self) -> uuid.UUID:
        raw = bytearray(self.next().to_bytes(8, "little") + self.next().to_bytes(8, "little"))
        raw[6], raw[8] = raw[6] & 0x0F | 0x40, raw[8] & 0x3F | 0x80
        return uuid.UUID(bytes=bytes(raw))


def hour_stamp(hour: int) -> str:
    if not 0 <= hour < YEAR_HOURS:
        raise SimulationError("the schedule leaves the synthetic year")
    day, month = hour // 24 % 28 + 1, hour // 24 // 28 + 1
    return f"2026-{month:02}-{day:02}T{hour % 24:02}:00:00Z"


class Truth:
    """What a run made, in its order, and the digest of it all."""

    def __init__(self, config: Config):
        self.config = config
        self.config_digest = hashlib.sha256(b"".join((v & _MASK).to_bytes(8, "little") for v in astuple(config))).hexdigest()
        self.events: list[tuple] = []  # id, time, ordinal, state
        self.documents: list[tuple] = []  # id, event, document time, available time, effect, parent, observed time, memberships
        self.relations: list[tuple] = []  # id, kind, source, target
        self.observed: list[tuple] = []  # and whether it is true

    @property
    def digest(self) -> str:
        h = hashlib.sha256()
        for part in self._parts():
            h.update(part)
        return h.hexdigest()

    def _parts(self) -> Iterator[bytes]:
        yield (self.config.seed & _MASK).to_bytes(8, "little")
        yield self.config_digest.encode()
        for id_, time, ordinal, state in self.events:
            yield id_.bytes + ordinal.to_bytes(4, "little") + (time + state).encode()
        for id_, event, written, available, effect, parent, seen, memberships in self.documents:
            yield id_.bytes + event.bytes + (written + available + effect).encode()
            yield (parent.bytes if parent else b"") + (seen or "missing").encode()
            for group, role, weight in memberships:
                yield group.bytes + role.encode() + weight.to_bytes(4, "little")
        for id_, kind, source, target in self.relations:
            yield id_.bytes + kind.encode() + source.bytes + target.bytes
        for id_, kind, source, target, true in self.observed:
            yield id_.bytes + kind.encode() + source.bytes + target.bytes + bytes([true])

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        text = lambda x: str(x) if x is not None else None
        docs = [(text(d[0]), text(d[1]), *d[2:5], text(d[5]), d[6], [(text(g), r, w) for g, r, w in d[7]]) for d in self.documents]
        return {
            "events": spark.createDataFrame([(text(i), *rest) for i, *rest in self.events], "event_id string, event_time string, ordinal int, state string"),
            "documents": spark.createDataFrame(
                docs,
                "document_id string, event_id string, document_time string, available_time string, method_effect string, parent_document_id string, observed_event_time string, memberships array<struct<group_id:string,role:string,weight_bps:int>>",
            ),
            "true_relations": spark.createDataFrame([(text(i), k, text(s), text(t)) for i, k, s, t in self.relations], "relation_id string, kind string, source_id string, target_id string"),
            "observed_relations": spark.createDataFrame([(text(i), k, text(s), text(t), p) for i, k, s, t, p in self.observed], "relation_id string, kind string, source_id string, target_id string, is_true_positive boolean"),
            "manifest": spark.createDataFrame([(self.config.seed, self.config_digest, self.digest)], "seed long, config_digest string, content_digest string"),
        }


def generate(config: Config) -> Truth:
    """The truth of a configuration; equal configurations give equal ones."""
    truth, draw = Truth(config), SplitMix64(config.seed)
    spacing = max(1, config.max_report_delay_hours + config.max_availability_delay_hours + 24)

    def delay(most: int) -> int:
        return draw.below(most + 1) if most else 0

    def document(event: uuid.UUID, hours: tuple[int, int, int], effect: str, parent: uuid.UUID | None) -> uuid.UUID:
        n = config.membership_targets
        memberships = [(draw.uuid(), ROLES[i % len(ROLES)], 10_000 // n) for i in range(n)]
        seen = None if draw.happens(config.missingness_rate_bps) else stamp
        id_ = draw.uuid()
        written, available = hour_stamp(sum(hours[:2])), hour_stamp(sum(hours))
        truth.documents.append((id_, event, written, available, effect, parent, seen, memberships))
        return id_

    for ordinal in range(config.event_count):
        hour = ordinal * spacing
        report, availability = delay(config.max_report_delay_hours), delay(config.max_availability_delay_hours)
        hour_stamp(hour + report + availability)
        stamp = hour_stamp(hour)
        event = draw.uuid()
        truth.events.append((event, stamp, ordinal, "planned" if draw.happens(1_000) else "occurred"))
        for _ in range(config.documents_per_event):
            original = document(event, (hour, report, availability), "original", None)
            truth.relations.append((draw.uuid(), "retrospectively_reports", original, event))
            for effect, kind in VARIANTS.items():
                if draw.happens(getattr(config, f"{effect}_rate_bps")):
                    hour_stamp(hour + 1 + report + 1 + availability)
                    variant = document(event, (hour + 1, report + 1, availability), effect, original)
                    truth.relations.append((draw.uuid(), kind, variant, original))
    for a, b in zip(truth.events, truth.events[1:], strict=False):
        truth.relations.append((draw.uuid(), "transitions_to", a[0], b[0]))
    truth.observed = [(*r, True) for r in truth.relations if not draw.happens(config.relation_false_negative_bps)]
    n = len(truth.documents)
    if n >= 2 and draw.happens(config.relation_false_positive_bps):
        left = draw.below(n)
        truth.observed.append((draw.uuid(), "references", truth.documents[left][0], truth.documents[(left + 1) % n][0], False))
    return truth


def mask_time(at: Column, missing: Column) -> Column:
    return F.when(~missing, at)


def document_error() -> Column:
    derived = F.col("method_effect") != "original"
    return code((F.col("available_time") < F.col("document_time")) | (derived != F.col("parent_document_id").isNotNull()), "TemporalInvariantViolation")


def manifest_errors(frames: dict[str, DataFrame]) -> DataFrame:
    """(what, error_code) for everything that breaks the manifest's rules."""
    events, docs = frames["events"], frames["documents"]
    bad = docs.select(F.col("document_id").alias("what"), first_code(document_error(), code(F.size("memberships") == 0, "NoMembership"), code(F.size(F.array_distinct(F.transform("memberships", lambda m: m["role"]))) < F.size("memberships"), "RepeatedRole")).alias("error_code"))
    lost = docs.join(events, "event_id", "left_anti").select(F.col("document_id").alias("what"), F.lit("UnknownEvent").alias("error_code"))
    parents = docs.select(F.col("document_id").alias("__p")).distinct()
    orphan = docs.where("parent_document_id IS NOT NULL").join(parents, docs["parent_document_id"] == F.col("__p"), "left_anti").select(F.col("document_id").alias("what"), F.lit("UnknownParent").alias("error_code"))
    twice = docs.groupBy("document_id").count().where("count > 1").select(F.col("document_id").alias("what"), F.lit("DuplicateDocument").alias("error_code"))
    # an event's predecessor by ordinal: an equi join instead of a window over all events
    later = events.select((F.col("ordinal") - 1).alias("ordinal"), F.col("event_time").alias("following"))
    order = events.join(later, "ordinal").where("following < event_time").select(F.col("event_id").alias("what"), F.lit("EventOrder").alias("error_code"))
    return bad.where("error_code IS NOT NULL").union(lost).union(orphan).union(twice).union(order)

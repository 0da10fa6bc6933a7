"""Contracts with other services: requests, exports, purpose-bound disclosure, routing of interpretation tasks."""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import blank, code, finite, first_code, is_sha256, one_of
from .sequence import ranked

VERSION = 1
MAX_REQUEST_BYTES = 64 << 10


class ContractError(ValueError):
    """A stable code and no content."""


#: Codes of the error envelope and their HTTP statuses.
ERRORS = {"InvalidWirePayload": 400, "AuthorizationDenied": 403, "LimitExceeded": 413, "UnsupportedContractVersion": 422, "IdempotencyConflict": 409}


def error_envelope(name: str, request_id: str) -> dict:
    return {"contract_version": VERSION, "error_code": name, "status": ERRORS[name], "request_id": request_id}


@dataclass(frozen=True)
class AnalysisRunRequest:
    contract_version: int
    idempotency_key: str
    tenant_workspace_id: str
    snapshot_id: str
    knowledge_cutoff: str
    model_contract_version: str
    output_profile: str

    @classmethod
    def from_json(cls, payload: str, now: datetime.datetime | None = None, most: int = MAX_REQUEST_BYTES) -> AnalysisRunRequest:
        """Strict: the size first, then each key exactly once, then the values; a cutoff in the future is refused."""
        if len(payload.encode()) > most:
            raise ContractError("LimitExceeded")
        try:
            pairs = json.loads(payload, object_pairs_hook=list)
            given = dict(pairs)
        except (ValueError, TypeError):
            raise ContractError("InvalidWirePayload") from None
        if len(given) != len(pairs) or set(given) != {f.name for f in fields(cls)}:
            raise ContractError("InvalidWirePayload")
        if given["contract_version"] != VERSION:
            raise ContractError("UnsupportedContractVersion")
        rest = {k: v for k, v in given.items() if k != "contract_version"}
        if any(not isinstance(v, str) or not v.strip() for v in rest.values()):
            raise ContractError("InvalidWirePayload")
        if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:[0-5]\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)", given["knowledge_cutoff"]) or given["knowledge_cutoff"].endswith("-00:00"):
            raise ContractError("InvalidWirePayload")
        try:
            at = datetime.datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", given["knowledge_cutoff"]))
        except ValueError:
            raise ContractError("InvalidWirePayload") from None
        if at > (now or datetime.datetime.now(datetime.UTC)):
            raise ContractError("InvalidWirePayload")
        return cls(**given)

    def to_json(self) -> str:
        return json.dumps(asdict(self), separators=(",", ":"))


def accept(request: AnalysisRunRequest, seen: dict[tuple[str, str], tuple[AnalysisRunRequest, str]], run_id: str) -> dict:
    """The acceptance; the same request again gives the same run, another under its key a conflict."""
    key = (request.tenant_workspace_id, request.idempotency_key)
    before, own = seen.setdefault(key, (request, run_id))
    if before != request:
        raise ContractError("IdempotencyConflict")
    return {"contract_version": VERSION, "run_id": own, "run_state": "accepted", "idempotency_key": request.idempotency_key}


# exports


def manifest_json() -> Column:
    names = ("artifact_id", "snapshot_id", "knowledge_cutoff", "model_contract_version", "engine_version", "artifact_digest_sha256")
    return F.to_json(F.struct(F.lit(VERSION).alias("contract_version"), *names))


def json_ld() -> Column:
    return F.to_json(F.struct(F.lit(VERSION).alias("contract_version"), "context", "id", "type_name", "artifact_digest_sha256"))


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def graphml_lines(edges: DataFrame, graph: str, most: int, order: str = "seq", source: str = "source", target: str = "target") -> DataFrame:
    """(part, at, line) of a GraphML file: sort by (part, at) and write the lines as text.

    Nodes are sorted and each once, edges keep their order as e0, e1, ...; the
    lines stay distributed. No edge, a blank end or more than `most` edges raise.
    """
    s = edges.agg(F.count(F.lit(1)).alias("n"), F.count_if(blank(F.col(source)) | blank(F.col(target))).alias("bad")).first()
    if not s["n"] or s["bad"] or not graph.strip():
        raise ContractError("InvalidWirePayload")
    if s["n"] > most:
        raise ContractError("LimitExceeded")
    spark = edges.sparkSession
    name = graph.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    frame = [
        (0, "", '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + f'<graph id="{name}" edgedefault="directed">'),
        (3, "", "</graph>\n</graphml>"),
    ]
    nodes = edges.select(F.col(source).alias("x")).union(edges.select(target)).distinct()
    node_lines = nodes.select(F.lit(1).alias("part"), F.col("x").alias("at"), F.concat(F.lit('  <node id="'), xml_escape(F.col("x")), F.lit('"/>')).alias("line"))
    numbered = ranked(edges.select(F.col(order).alias("__order"), source, target), "__order")
    line = F.concat(F.lit('  <edge id="e'), F.col("k").cast("string"), F.lit('" source="'), xml_escape(F.col(source)), F.lit('" target="'), xml_escape(F.col(target)), F.lit('"/>'))
    edge_lines = numbered.select(F.lit(2).alias("part"), F.lpad(F.col("k").cast("string"), 20, "0").alias("at"), line.alias("line"))
    return spark.createDataFrame(frame, "part int, at string, line string").union(node_lines).union(edge_lines)


#: Purposes of a grant.
PURPOSES = ("scientific_validation", "operational_monitoring", "partner_disclosure", "modular_service_consumer")


def export_decision(purpose: Column, includes_source_text: Column) -> Column:
    """The decision code; an unknown purpose is denied."""
    return (
        F.when(~one_of(purpose, PURPOSES), "unknown_purpose_denied")
        .when((purpose == "operational_monitoring") & includes_source_text, "source_text_denied_for_purpose")
        .when((purpose == "partner_disclosure") & includes_source_text, "partner_source_text_requires_elevated_grant")
        .otherwise("purpose_bound_export_allowed")
    )


def is_allowed(decision: Column) -> Column:
    return decision == "purpose_bound_export_allowed"


def is_stamp(x: Column) -> Column:
    """Twenty characters of UTC, of a date and time that exist."""
    shape = x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:[0-5]\dZ$")
    return F.coalesce(shape & F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ssX")).isNotNull(), F.lit(False))


def grant_covers(at: Column, valid_from: Column, valid_to: Column) -> Column:
    """Both ends count; stamps of one form compare as strings."""
    return (valid_from <= at) & (valid_to.isNull() | (at <= valid_to))


def minimize_payloads(offers: DataFrame, grants: DataFrame, at: str = "decision_time") -> DataFrame:
    """Offers joined to their grants: only the columns that may leave, and the code of what may not."""
    both = offers.join(grants.withColumnRenamed("tenant_workspace_id", "grant_tenant"), "grant_id")
    stamp = F.col(at)
    text = F.col("source_text").isNotNull()
    malformed = blank(F.col("artifact_id")) | blank(F.col("opaque_analytical_id")) | ~is_stamp(stamp) | ~is_stamp(F.col("valid_from"))
    denied = first_code(
        code(malformed, "InvalidWirePayload"),
        code(~grant_covers(stamp, F.col("valid_from"), F.col("valid_to")) | (F.col("tenant_workspace_id") != F.col("grant_tenant")), "AuthorizationDenied"),
        code(F.col("identity_mapping").isNotNull(), "AuthorizationDenied"),
        code(~is_allowed(export_decision(F.col("purpose"), text)), "AuthorizationDenied"),
    )
    both = both.withColumn("error_code", denied)
    own = lambda c: F.when(F.col("error_code").isNull(), F.col(c)).alias(c)
    return both.select("grant_id", own("artifact_id"), own("opaque_analytical_id"), own("source_text"), own("membership_role"), "purpose", (F.col("error_code").isNull() & text).alias("included_source_text"), "error_code")


def audit_digest(*values: Column) -> Column:
    """SHA-256 over the values' UTF-8, each after its length as eight bytes, big end first."""
    parts = []
    for v in values:
        raw = F.encode(v, "UTF-8")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*parts), 256))


def disclosures(requests: DataFrame, domain: str) -> tuple[DataFrame, DataFrame]:
    """(audit records of all requests, identities of the allowed ones): the audit comes first, whatever the outcome.

    domain: names the digest's version.
    """
    allowed = (
        grant_covers(F.col("decision_time"), F.col("valid_from"), F.col("valid_to"))
        & (F.col("tenant_workspace_id") == F.col("mapping_tenant_workspace_id"))
        & F.col("reidentification_authorized")
        & (F.col("purpose") == "scientific_validation")
    )
    rows = requests.withColumn("outcome", F.when(F.coalesce(allowed, F.lit(False)), "allowed").otherwise("denied"))
    flag = lambda c: F.when(c, "1").otherwise("0")
    c = F.col
    digest = audit_digest(
        F.lit(domain), F.lit("reidentify_identity_mapping"), c("tenant_workspace_id"), c("principal_id"), c("purpose"), c("valid_from"), flag(c("valid_to").isNotNull()), F.coalesce(c("valid_to"), F.lit("")),
        flag(c("reidentification_authorized")), c("mapping_tenant_workspace_id"), c("opaque_analytical_id"), c("direct_identity"), c("decision_time"), c("outcome"),
    )
    audit = rows.select("tenant_workspace_id", "principal_id", "purpose", F.lit("reidentify_identity_mapping").alias("action_code"), "opaque_analytical_id", "decision_time", "outcome", digest.alias("decision_digest"))
    return audit, rows.where("outcome = 'allowed'").select("opaque_analytical_id", "direct_identity")


# routing

#: Modes from the dearest to the cheapest, with least budget, stages, depth and how each divides the work.
MODES = {
    "conductor": (24_000, 4, 2, "adaptive_roles_under_budget"),
    "committee": (16_000, 3, 0, "blinded_parallel_then_adjudicate"),
    "verify": (8_000, 2, 0, "producer_then_verifier"),
    "direct": (4_000, 1, 0, "single_call"),
    "abstain": (0, 0, 0, "no_forced_answer"),
}
#: Tasks and their default effort.
TASKS = {"span_classification": "low", "concept_alignment": "medium", "blinded_model_review": "high", "narrative_synthesis": "medium", "adversarial_verification": "high", "schema_conversion": "minimal"}
EVIDENCE_FLOOR, LOW, HIGH = 0.35, 0.35, 0.50
MAX_BUDGET, MAX_ACCESS, MAX_ACCESS_BYTES = 1_000_000, 64, 128


#: The routing policy's version, and what a request may attempt with its document; only the first is allowed.
POLICY_VERSION = "orchestration-policy.v1"
DOCUMENT_CONTROLS = ("none", "instruction", "tool_call")


def routing_error(policy_version: Column | None = None, document_control: Column | None = None) -> Column:
    """The first broken rule: another policy's version, a document that tries to control, limits, scores, access lists."""
    version, control = policy_version if policy_version is not None else F.lit(POLICY_VERSION), document_control if document_control is not None else F.lit("none")
    scores = [F.col(c) for c in ("risk", "ambiguity", "evidence")]
    bad = ~one_of(F.col("task"), tuple(TASKS))
    for s in scores:
        bad = bad | ~finite(s) | (s < 0) | (s > 1)
    access = F.coalesce(F.col("access_list"), F.array().cast("array<string>"))
    return first_code(
        code(~version.eqNullSafe(F.lit(POLICY_VERSION)), "UnsupportedContractVersion"),
        code(~control.eqNullSafe(F.lit("none")), "AuthorizationDenied"),
        code((F.col("budget") > MAX_BUDGET) | (F.size(access) > MAX_ACCESS), "LimitExceeded"),
        code(bad, "InvalidWirePayload"),
        code(F.exists(access, lambda a: F.length(F.trim(a)) == 0), "InvalidWirePayload"),
        code(F.exists(access, lambda a: F.octet_length(a) > MAX_ACCESS_BYTES), "LimitExceeded"),
        code(F.size(F.array_distinct(access)) < F.size(access), "InvalidWirePayload"),
    )


def preferred_mode(task: Column, risk: Column, ambiguity: Column, evidence: Column, gate_passed: Column) -> Column:
    return (
        F.when((evidence < EVIDENCE_FLOOR) | ((task == "blinded_model_review") & ~gate_passed), "abstain")
        .when(task == "schema_conversion", "direct")
        .when(task == "blinded_model_review", "committee")
        .when(task == "adversarial_verification", "verify")
        .when(task == "span_classification", F.when((risk < LOW) & (ambiguity < LOW), "direct").otherwise("verify"))
        .when(task == "concept_alignment", F.when(ambiguity >= HIGH, "committee").otherwise("verify"))
        .otherwise(F.when((risk >= HIGH) | (ambiguity >= HIGH), "conductor").otherwise("verify"))
    )


def fitted_mode(preferred: Column, budget: Column, task: Column) -> Column:
    """The dearest mode from the preferred one down that the budget pays; a blinded review steps down to none."""
    names = list(MODES)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), preferred)
    out = None
    for i, n in enumerate(names, 1):
        hit = (rank <= i) & (budget >= MODES[n][0])
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return F.when((task == "blinded_model_review") & (budget < MODES["committee"][0]), "abstain").otherwise(out)  # type: ignore[arg-type]


def _lookup(key: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out  # type: ignore[return-value]


def assigned_roles(mode: Column, task: Column) -> Column:
    """ARRAY<STRUCT<role, effort>>."""
    effort = _lookup(task, TASKS)
    role = lambda r, e: F.struct(F.lit(r).alias("role"), (e if isinstance(e, Column) else F.lit(e)).alias("effort"))
    worker = role("worker", effort)
    return (
        F.when(mode == "direct", F.array(worker))
        .when(mode == "verify", F.array(worker, role("verifier", "high")))
        .when(mode == "committee", F.array(worker, worker, role("adjudicator", "high")))
        .when(mode == "conductor", F.array(role("conductor", "high"), role("thinker", effort), worker, role("verifier", "high")))
        .otherwise(F.array().cast("array<struct<role:string,effort:string>>"))
    )


def route(requests: DataFrame) -> DataFrame:
    """Requests (task, risk, ambiguity, evidence, budget, gate_passed, access_list, and policy_version and document_control where given) with their plans, or an error code and no plan."""
    mode = fitted_mode(preferred_mode(*[F.col(c) for c in ("task", "risk", "ambiguity", "evidence", "gate_passed")]), F.col("budget"), F.col("task"))
    out = requests.withColumn("error_code", routing_error(*[F.col(c) if c in requests.columns else None for c in ("policy_version", "document_control")])).withColumn("mode", F.when(F.col("error_code").isNull(), mode))
    m = F.col("mode")
    return out.withColumns(
        {
            "stages": _lookup(m, {k: F.lit(v[1]) for k, v in MODES.items()}),
            "recursion_depth": _lookup(m, {k: F.lit(v[2]) for k, v in MODES.items()}),
            "decomposition": _lookup(m, {k: F.lit(v[3]) for k, v in MODES.items()}),
            "fallback_mode": _lookup(m, dict(zip(MODES, [*list(MODES)[1:], "abstain"], strict=True))),
            "token_budget": F.when(m == "abstain", F.lit(0).cast("long")).when(m.isNotNull(), F.col("budget").cast("long")),
            "roles": F.when(m.isNotNull(), assigned_roles(m, F.col("task"))),
        }
    )


def budgets_comparable(left: Column, right: Column) -> Column:
    """Both over 0, and apart by a tenth of the larger at most."""
    return (left > 0) & (right > 0) & (F.abs(left - right) * 10 <= F.greatest(left, right))


def ablation(plans: DataFrame) -> DataFrame:
    """Rows (baseline_*, compared_* of mode, task, access_list, budget) with `comparable`, or the code of an unfit pair."""
    bad = (F.col("baseline_mode") != "direct") | (F.col("baseline_task") != F.col("compared_task")) | ~F.col("baseline_access_list").eqNullSafe(F.col("compared_access_list"))
    ok = budgets_comparable(F.col("baseline_budget"), F.col("compared_budget"))
    return plans.withColumn("error_code", code(bad, "InvalidWirePayload")).withColumn("comparable", F.when(~bad, ok))


def binding_error(mode: Column, manifest_hash: Column) -> Column:
    sound = manifest_hash.startswith("sha256:") & is_sha256(F.substring(manifest_hash, 8, 1000))
    return first_code(code(~F.coalesce(sound, F.lit(False)), "InvalidWirePayload"), code(mode == "abstain", "AuthorizationDenied"))

"""Queries of the rules that refuse rows: sound rows from the driver's tables, and some that break each rule, with their SQL.

Which rows break a rule follows from their keys, so the SQL says independently
what has to come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import allen, clocks, intervals, wire
from ..functions.allen import CONVERSE, RELATIONS
from ..operators import bitemporal, contracts, events, evidence, governance, membership, metrics, reasoner, relations
from ..sources.tables import table
from .oracle import _CLASS, _MID, _ORDERS, _PAIRS, _VERSIONS
from .queries import _at_middle, _chains, _orders, _pairs, _r, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _tally(df: DataFrame, error: Column | str = "error_code") -> DataFrame:
    e = F.col(error) if isinstance(error, str) else error
    return df.groupBy(F.coalesce(e, F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _every(n: int, key: str = "event_id") -> Column:
    return F.col(key) % n == 0


def _digest(x: Column) -> Column:
    return F.sha2(x.cast("string"), 256)


_TALLY = "SELECT {case} AS outcome, count(*) AS n FROM {rows} GROUP BY 1"


# versions


@_query(
    "version_insert",
    """WITH new AS (SELECT event_id AS seq, event_id // 3 AS id, event_id % 7 = 0 AS bad FROM events),
      s AS (SELECT *, coalesce(sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM new)
      SELECT CASE WHEN bad THEN 'InvalidContentDigest' WHEN id % 5 = 0 OR before > 0 THEN 'DuplicateDocumentRecord' ELSE 'ok' END AS outcome, count(*) AS n, sum(seq)::BIGINT AS seqs FROM s GROUP BY 1""",
)
def version_insert(spark: SparkSession, d: str) -> DataFrame:
    """Three events a record; every fifth record is there already, every seventh digest is malformed."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 3).alias("document_record_id"))
    e = e.withColumn("content_digest", F.when(_every(7, "seq"), F.lit("short")).otherwise(_digest(F.col("seq"))))
    there = e.where(_every(5, "document_record_id")).dropDuplicates(["document_record_id"])
    out = bitemporal.insert_error(there, e, seq="seq")
    return out.groupBy(F.coalesce("error_code", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


@_query("version_revise", f"WITH {_VERSIONS} SELECT user_id, event_id, strftime(system_to, '%Y-%m-%d %H:%M:%S.%f') AS closed FROM versions")
def version_revise(spark: SparkSession, d: str) -> DataFrame:
    """A user's first event is there; all others come as one batch of revisions, with some of users that aren't."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("system_from"), F.lit(None).cast("timestamp_ntz").alias("system_to"))
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("system_from"))
    numbered = e.withColumn("n", at)
    later = numbered.where("n > 1").drop("n")
    unknown = later.withColumn("user_id", -F.col("user_id") - 1)
    out = bitemporal.revise(numbered.where("n = 1").drop("n"), later.union(unknown), "user_id", digest=None)
    return out.select("user_id", "event_id", F.date_format("system_to", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("closed"))


_LOG = """log AS (SELECT user_id AS id, event_id AS seq, ts, event_id % 13 = 0 AS bad, event_id % 11 = 0 AS ends FROM events),
  firsts AS (SELECT id, min(seq) AS f FROM log GROUP BY id),
  batch AS (SELECT log.*, f, id % 5 = 0 AS closed FROM log JOIN firsts USING (id) WHERE seq > f),
  judged AS (SELECT *, CASE WHEN bad THEN 'InvalidContentDigest' WHEN closed OR seq > (min(CASE WHEN ends AND NOT bad THEN seq END) OVER (PARTITION BY id)) THEN 'HistoricalVersionNotFound' END AS code FROM batch)"""


def _revision_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A user's first event as its version, closed for every fifth user; the others as revisions in the order of their ids, which isn't that of their times: every thirteenth has a malformed digest, every eleventh is closed."""
    at, k = F.col("ts"), F.col("event_id")
    e = table(spark, d, "events").select("user_id", k.alias("seq"), at.alias("system_from"), F.when(k % 11 == 0, at).alias("system_to"), F.when(k % 13 == 0, F.lit("short")).otherwise(_digest(k)).alias("content_digest"))
    marked = e.join(e.groupBy(F.col("user_id").alias("u")).agg(F.min("seq").alias("f")), F.col("user_id") == F.col("u"))
    there = marked.where("seq = f").withColumn("system_to", F.when(F.col("user_id") % 5 == 0, F.col("system_from")))
    return there.select(*e.columns), marked.where("seq > f").select(*e.columns)


@_query(
    "revisions_in_order",
    f"""WITH {_LOG}, kept AS (SELECT id, seq, ts, CASE WHEN ends THEN ts END AS own FROM judged WHERE code IS NULL
        UNION ALL SELECT id, seq, ts, CASE WHEN id % 5 = 0 THEN ts END FROM log JOIN firsts USING (id) WHERE seq = f)
      SELECT id, seq, strftime(coalesce(own, lead(ts) OVER (PARTITION BY id ORDER BY seq)), '%Y-%m-%d %H:%M:%S.%f') AS closed FROM kept""",
)
def revisions_in_order(spark: SparkSession, d: str) -> DataFrame:
    there, batch = _revision_log(spark, d)
    out = bitemporal.revise(there, batch, "user_id", seq="seq")
    return out.select(F.col("user_id").alias("id"), "seq", F.date_format("system_to", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("closed"))


@_query("revisions_refused", f"WITH {_LOG} SELECT code AS error_code, count(*) AS n, sum(seq)::BIGINT AS seqs FROM judged WHERE code IS NOT NULL GROUP BY 1")
def revisions_refused(spark: SparkSession, d: str) -> DataFrame:
    there, batch = _revision_log(spark, d)
    return bitemporal.revise_error(there, batch, "user_id", seq="seq").groupBy("error_code").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


@_query(
    "revision_errors",
    """SELECT user_id AS id, 'HistoricalVersionNotFound' AS error_code, count(*) AS n FROM events WHERE user_id % 4 = 1 GROUP BY 1""",
)
def revision_errors(spark: SparkSession, d: str) -> DataFrame:
    """Of every fourth user no version is open."""
    v = versions(spark, d).withColumn("system_to", F.when(F.col("user_id") % 4 == 1, F.col("system_from")).otherwise(F.col("system_to")))
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("system_from"), F.lit(None).cast("timestamp_ntz").alias("system_to"))
    return bitemporal.revise_error(v, e, "user_id", digest=None).groupBy(F.col("user_id").alias("id"), "error_code").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "audit_append",
    """SELECT CASE WHEN id % 6 = 0 OR k > 1 THEN 'ImmutableAuditViolation' ELSE 'ok' END AS outcome, count(*) AS n, sum(event_id)::BIGINT AS ids
      FROM (SELECT event_id, event_id // 2 AS id, row_number() OVER (PARTITION BY event_id // 2 ORDER BY event_id) AS k FROM events) GROUP BY 1""",
)
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """Two events name each audit event; every sixth is there already."""
    e = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 2).alias("audit_event_id"))
    out = bitemporal.append_audit(e.where(_every(6, "audit_event_id")).select("audit_event_id"), e, seq="event_id")
    return out.groupBy(F.coalesce("error_code", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@_query(
    "instances_as_known_at",
    f"WITH {_VERSIONS} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY system_from DESC) AS rn FROM versions WHERE system_from <= {_MID} AND (system_to IS NULL OR {_MID} < system_to)) WHERE rn = 1",
)
def instances_as_known_at(spark: SparkSession, d: str) -> DataFrame:
    return bitemporal.instance_as_known_at(versions(spark, d), _at_middle(spark, d), "user_id").select("user_id", "event_id")


@_query(
    "mention_guard",
    _TALLY.format(case="CASE WHEN event_id % 10 = 0 THEN 'MentionIsInstance' WHEN event_id % 7 = 0 OR NOT (value / 100 > 0 AND value / 100 <= 1) THEN 'InvalidConfidence' ELSE 'ok' END", rows="events"),
)
def mention_guard(spark: SparkSession, d: str) -> DataFrame:
    instance = F.when(_every(10), F.col("event_id")).otherwise(-F.col("event_id") - 1)
    c = F.when(_every(7), F.lit(float("nan"))).otherwise(F.col("value") / 100)
    e = table(spark, d, "events").select(F.col("event_id").alias("event_mention_id"), instance.alias("event_instance_id"), c.alias("confidence"))
    return _tally(e, bitemporal.mention_error())


@_query(
    "artifact_conflicts",
    "SELECT CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'ArtifactConflict' ELSE 'ok' END AS outcome, doc_id % 3 <> 0 AS is_new, count(*) AS n FROM documents GROUP BY 1, 2",
)
def artifact_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Every third document is stored, half of these with another digest."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_artifact_id"), F.sha2("text", 256).alias("content_digest"), "lang")
    changed = F.when(_every(2, "source_artifact_id"), F.lit("other")).otherwise(F.col("content_digest"))
    stored = docs.where(_every(3, "source_artifact_id")).withColumn("content_digest", changed)
    out = bitemporal.artifact_error(docs, stored)
    return out.groupBy(F.coalesce("error_code", F.lit("ok")).alias("outcome"), "is_new").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "artifact_batch",
    """WITH b AS (SELECT event_id AS seq, event_id // 4 AS id, CASE WHEN event_id % 4 = 2 THEN 'other' ELSE 'own' END AS digest FROM events),
      s AS (SELECT *, id % 3 = 0 AS there, CASE WHEN id % 3 = 0 THEN 'other' ELSE first_value(digest) OVER (PARTITION BY id ORDER BY seq) END AS held, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM b)
      SELECT CASE WHEN digest <> held THEN 'ArtifactConflict' ELSE 'ok' END AS outcome, NOT there AND k = 1 AS is_new, count(*) AS n, sum(seq)::BIGINT AS seqs FROM s GROUP BY 1, 2""",
)
def artifact_batch(spark: SparkSession, d: str) -> DataFrame:
    """Four events insert each artifact, the third with another digest; every third artifact is stored, with that digest."""
    k = F.col("event_id")
    e = table(spark, d, "events").select(k.alias("seq"), F.floor(k / 4).alias("source_artifact_id"), F.when(k % 4 == 2, F.lit("other")).otherwise(F.lit("own")).alias("content_digest"))
    stored = e.where(_every(3, "source_artifact_id")).select("source_artifact_id", F.lit("other").alias("content_digest")).distinct()
    out = bitemporal.artifact_error(e, stored, seq="seq")
    return out.groupBy(F.coalesce("error_code", F.lit("ok")).alias("outcome"), "is_new").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


_COMMITS = "CASE WHEN doc_id % 11 = 0 THEN 'HEAD' ELSE substring(sha256(doc_id::VARCHAR), 1, 40) END"


@_query("manifest_digests", _TALLY.format(case="CASE WHEN doc_id % 11 = 0 OR doc_id % 5 = 0 THEN 'InvalidManifestDigest' ELSE 'ok' END", rows="documents"))
def manifest_digests(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth output digest is in upper case, every eleventh commit is a name."""
    h = _digest(F.col("doc_id"))
    out = F.when(_every(5, "doc_id"), F.concat(F.lit("A"), F.substring(F.upper(h), 2, 63))).otherwise(h)
    m = table(spark, d, "documents").select("doc_id", h.alias("input_digest"), out.alias("output_digest"), F.when(_every(11, "doc_id"), F.lit("HEAD")).otherwise(F.substring(h, 1, 40)).alias("code_commit"))
    return _tally(m, bitemporal.manifest_error())


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as runs that cite customers as manifests and clerks' splits, some of which don't exist."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("manifest_id"), F.when(_every(3, "o_orderkey"), F.lit(None)).otherwise(F.col("o_orderkey") % 10).alias("split_id"))
    m = table(spark, d, "customer").where(~_every(4, "c_custkey")).select(F.col("c_custkey").alias("manifest_id"))
    s = spark.range(7).select(F.col("id").alias("split_id"))
    return o, m, s


@_query(
    "model_run_guard",
    """SELECT CASE WHEN o_custkey % 4 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'UnknownManifest' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 10 > 6 THEN 'UnknownSplit' ELSE 'ok' END AS outcome, count(*) AS n
      FROM orders GROUP BY 1""",
)
def model_run_guard(spark: SparkSession, d: str) -> DataFrame:
    return _tally(bitemporal.model_run_error(*_runs(spark, d)))


@_query("missing_manifests", "SELECT o_orderkey AS run FROM orders WHERE o_custkey % 4 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def missing_manifests(spark: SparkSession, d: str) -> DataFrame:
    o, m, _ = _runs(spark, d)
    return governance.missing_manifests(o, m).select("run")


@_query(
    "write_conflicts",
    """SELECT CASE event_id % 5 WHEN 0 THEN 'SerializationFailure' WHEN 1 THEN 'Deadlock' WHEN 2 THEN 'LockNotAvailable' WHEN 3 THEN 'UniqueViolation' ELSE 'Other' END AS conflict, count(*) AS n FROM events GROUP BY 1""",
)
def write_conflicts(spark: SparkSession, d: str) -> DataFrame:
    states = F.element_at(F.array(*[F.lit(x) for x in ("40001", "40P01", "55P03", "23505", "08006")]), (F.col("event_id") % 5).cast("int") + 1)
    return table(spark, d, "events").groupBy(bitemporal.conflict(states).alias("conflict")).agg(F.count(F.lit(1)).alias("n"))


# retention


@_query(
    "policy_guard",
    _TALLY.format(
        case="CASE WHEN event_id % 13 = 0 THEN 'InvalidVocabulary' WHEN event_id % 11 = 0 THEN 'StatusWindowMismatch' WHEN event_id % 2 = 1 AND event_id % 7 = 0 THEN 'InvalidIntervalOrder' WHEN event_id % 5 = 0 THEN 'InvalidRetention' ELSE 'ok' END",
        rows="events",
    ),
)
def policy_guard(spark: SparkSession, d: str) -> DataFrame:
    """Odd events are superseded policies; the remainders by 13, 11, 7 and 5 break a rule each."""
    superseded = F.col("event_id") % 2 == 1
    status = F.when(_every(13), F.lit("paused")).when(superseded, F.lit("superseded")).otherwise(F.lit("active"))
    shown = F.when(_every(11), ~superseded).otherwise(superseded)
    end = F.when(shown, F.when(_every(7), F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 1 DAY")))
    e = table(spark, d, "events").select("event_id", status.alias("status"), F.col("ts").alias("system_from"), end.alias("system_to"), F.when(_every(5), F.lit(0)).otherwise(F.lit(30)).alias("retention_days"))
    return _tally(e, governance.policy_error())


@_query(
    "hold_guard",
    _TALLY.format(
        case="CASE WHEN event_id % 13 = 0 THEN 'InvalidVocabulary' WHEN event_id % 11 = 0 THEN 'ScopeDocumentMismatch' WHEN event_id % 7 = 0 THEN 'StatusWindowMismatch' WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'InvalidIntervalOrder' ELSE 'ok' END",
        rows="events",
    ),
)
def hold_guard(spark: SparkSession, d: str) -> DataFrame:
    """Even events are holds of a document, every third is released."""
    of_document, released = _every(2), _every(3)
    scope = F.when(_every(13), F.lit("planet")).when(of_document, F.lit("document")).otherwise(F.lit("tenant"))
    document = F.when(F.when(_every(11), ~of_document).otherwise(of_document), F.col("event_id"))
    end = F.when(F.when(_every(7), ~released).otherwise(released), F.when(_every(5), F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 1 DAY")))
    e = table(spark, d, "events").select(scope.alias("scope"), F.when(released, F.lit("released")).otherwise(F.lit("active")).alias("status"), document.alias("document_record_id"), F.col("ts").alias("system_from"), end.alias("system_to"))
    return _tally(e, governance.hold_error())


@_query(
    "hold_insert",
    """WITH done AS (SELECT source, doc_id % 50 AS document, max(doc_id) AS t FROM documents WHERE doc_id % 4 = 0 GROUP BY 1, 2),
      holds AS (SELECT doc_id, source, doc_id % 50 AS document, doc_id % 3 = 0 AS tenant, doc_id % 9 = 1 AS closed, doc_id * 2 AS t FROM documents)
      SELECT CASE WHEN closed THEN 'HoldNotOpen' WHEN (SELECT max(d.t) FROM done d WHERE d.source = h.source AND (h.tenant OR d.document = h.document)) >= h.t THEN 'AlreadyDeleted' ELSE 'ok' END AS outcome, count(*) AS n, sum(doc_id)::BIGINT AS ids
      FROM holds h GROUP BY 1""",
)
def hold_insert(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth document's deletion is complete at the time of its number; holds come at twice their number, every third of a whole source."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("tenant_record_id"), (F.col("doc_id") % 50).alias("document"))
    at = lambda x: F.timestamp_seconds(x)
    done = docs.where(_every(4, "doc_id")).select("tenant_record_id", F.col("document").alias("document_record_id"), F.lit("completed").alias("status"), at(F.col("doc_id")).alias("system_time"))
    tenant = _every(3, "doc_id")
    holds = docs.select(
        "doc_id", "tenant_record_id", F.when(~tenant, F.col("document")).alias("document_record_id"), F.when(tenant, F.lit("tenant")).otherwise(F.lit("document")).alias("scope"),
        at(F.col("doc_id") * 2).alias("system_time"), F.when(F.col("doc_id") % 9 == 1, at(F.col("doc_id") * 3)).alias("system_to"),
    )
    out = governance.hold_insert_error(holds, done)
    return out.groupBy(F.coalesce("error_code", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@_query("holds_released", "SELECT status, open, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 OR doc_id = 1 OR doc_id = 2 THEN 'released' ELSE 'active' END AS status, doc_id % 5 <> 0 AND doc_id NOT IN (1, 2) AS open FROM documents) GROUP BY 1, 2")
def holds_released(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth hold is released already; two more are released, and one of the first again."""
    closed = _every(5, "doc_id")
    h = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("legal_hold_id"), F.when(closed, "released").otherwise("active").alias("status"), F.when(closed, F.timestamp_seconds(F.col("doc_id"))).alias("system_to"))
    out = governance.release_holds(h, F.timestamp_seconds(F.lit(99)), ["1", "2", "5"])
    return out.groupBy("status", F.col("system_to").isNull().alias("open")).agg(F.count(F.lit(1)).alias("n"))


@_query("deletions_unbound", "SELECT doc_id FROM documents WHERE doc_id % 6 = 0 OR doc_id % 7 = 0 OR lang IS NULL OR source IS NULL")
def deletions_unbound(spark: SparkSession, d: str) -> DataFrame:
    """Requests cite their language's policy: every sixth with another purpose, every seventh with a policy that isn't there."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("tenant_record_id"), F.col("lang").alias("record_class"))
    policies = docs.select("tenant_record_id", "record_class", F.col("record_class").alias("retention_policy_id"), F.lit("research").alias("purpose"))
    requests = docs.select("doc_id", "tenant_record_id", "record_class", F.when(_every(7, "doc_id"), F.lit("none")).otherwise(F.col("record_class")).alias("retention_policy_id"), F.when(_every(6, "doc_id"), F.lit("sale")).otherwise(F.lit("research")).alias("purpose"))
    return governance.unbound_deletions(requests, policies).select("doc_id")


_KINDS = "['expiry', 'revocation', 'identity'][doc_id % 3 + 1]"


def _deletions(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % k).cast("int") + 1)
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("document_record_id"), F.col("source").alias("tenant_record_id"), F.col("doc_id").alias("deletion_request_id"), pick(governance.DELETION_KINDS, 3).alias("kind"),
        pick(("raw_source", "derived"), 2).alias("evidence_layer"), pick(("available", "restricted", "unavailable", "unavailable", "gone"), 5).alias("availability"), pick(("completed", "requested", "completed", "refused"), 4).alias("status"), "doc_id",
    )


@_query(
    "tombstone_guard",
    _TALLY.format(case="CASE WHEN doc_id % 5 = 4 THEN 'InvalidVocabulary' WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 < 2 THEN 'TombstoneAvailability' ELSE 'ok' END", rows="documents"),
)
def tombstone_guard(spark: SparkSession, d: str) -> DataFrame:
    return _tally(_deletions(spark, d), governance.tombstone_error())


@_query("tombstones_unmatched", "SELECT doc_id FROM documents WHERE doc_id % 4 IN (1, 3) OR doc_id % 7 = 0 OR source IS NULL")
def tombstones_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh tombstone says another layer than its request."""
    q = _deletions(spark, d)
    stones = q.withColumn("evidence_layer", F.when(_every(7, "doc_id"), F.lit("shadow")).otherwise(F.col("evidence_layer")))
    return governance.unmatched_tombstones(stones, q.drop("doc_id")).select("doc_id")


@_query("restores_refused", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def restores_refused(spark: SparkSession, d: str) -> DataFrame:
    stones = table(spark, d, "labels").where("quality = 0").select("doc_id")
    return governance.refused_restores(table(spark, d, "documents").select("doc_id"), stones, "doc_id")


@_query(
    "restore_usable",
    """SELECT 'digests' AS probe, NOT EXISTS (SELECT 1 FROM documents WHERE doc_id % 97 = 5) AS usable UNION ALL
      SELECT 'windows', NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate) UNION ALL SELECT 'none', true""",
)
def restore_usable(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot with some broken digests, one of the lines' windows, and one without a fault."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 97 == 5, F.lit("x")).otherwise(F.sha2("text", 256)).alias("content_digest"))
    line = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderdate").alias("system_from"), F.col("l_shipdate").alias("system_to"))
    faults = {"digests": governance.bad_digests(docs), "windows": governance.bad_windows(line), "none": governance.bad_digests(docs.where("doc_id % 97 <> 5"))}
    out = [governance.snapshot_usable(v, faults["none"]).select(F.lit(k).alias("probe"), "usable") for k, v in faults.items()]
    return out[0].union(out[1]).union(out[2])


# relations and intervals


@_query(
    "interval_relations",
    f"""WITH {_ORDERS}, pairs AS (SELECT a.k AS ak, b.k AS bk, {_CLASS} AS r FROM ords a JOIN ords b ON a.customer = b.customer AND a.k < b.k)
      SELECT CASE WHEN ak % 7 = 0 OR bk % 11 = 0 THEN 'UncertainRelation' ELSE coalesce(r, 'none') END AS relation, count(*) AS n FROM pairs GROUP BY 1""",
)
def interval_relations(spark: SparkSession, d: str) -> DataFrame:
    """Orders' intervals; every seventh left one excludes its start, every eleventh right one is unknown."""
    p = _pairs(spark, d)
    at = clocks.from_timestamp
    edge = F.when(F.col("a_order") % 7 == 0, F.lit("excluded")).otherwise(F.lit("included"))
    left = intervals.bounded(edge, at(F.col("a_start")), F.lit("included"), at(F.col("a_end")), F.lit("day"))
    whole = intervals.bounded(F.lit("included"), at(F.col("b_start")), F.lit("included"), at(F.col("b_end")), F.lit("day"))
    right = F.when(F.col("b_order") % 11 == 0, intervals.unknown()).otherwise(whole)
    p = p.select(left.alias("l"), right.alias("r"))
    name = F.coalesce(allen.classify_error(F.col("l"), F.col("r")), allen.classify_intervals(F.col("l"), F.col("r")), F.lit("none"))
    return p.groupBy(name.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = "[" + ", ".join(f"'{r}'" for r in RELATIONS) + "]"
_CONVERSES = "[" + ", ".join(f"'{CONVERSE[r]}'" for r in RELATIONS) + "]"


@_query("relation_converses", f"WITH {_PAIRS} SELECT r AS relation, {_CONVERSES}[list_position({_NAMES}, r)] AS converse, count(*) AS n FROM pairs WHERE r IS NOT NULL GROUP BY 1, 2")
def relation_converses(spark: SparkSession, d: str) -> DataFrame:
    r = allen.classify(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    return _pairs(spark, d).select(r.alias("relation")).where("relation IS NOT NULL").groupBy("relation", allen.converse(F.col("relation")).alias("converse")).agg(F.count(F.lit(1)).alias("n"))


_TRIPLES = f"""{_ORDERS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY k) AS n FROM ords WHERE s < e),
  triples AS (SELECT a.customer, a.n, {_CLASS} AS ab, {_CLASS.replace("b.", "c.").replace("a.", "b.")} AS bc, {_CLASS.replace("b.", "c.")} AS ac
    FROM numbered a JOIN numbered b ON a.customer = b.customer AND b.n = a.n + 1 JOIN numbered c ON a.customer = c.customer AND c.n = a.n + 2)"""
_RANKS = "(SELECT s, e FROM range(6) a(s), range(6) b(e) WHERE s < e)"
_TABLE = f"""cells AS (SELECT l, r, bit_or((1 << (list_position({_NAMES}, t)::INT - 1))::INT)::INT AS mask
  FROM (SELECT {_CLASS} AS l, {_CLASS.replace("b.", "c.").replace("a.", "b.")} AS r, {_CLASS.replace("b.", "c.")} AS t FROM {_RANKS} a, {_RANKS} b, {_RANKS} c) GROUP BY l, r)"""


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Each three successive orders of a customer: their masks (ab, bc) and the relation of the outer two."""
    w = Window.partitionBy("customer").orderBy("order")
    o = _orders(spark, d).where("start < end").select("customer", F.row_number().over(w).alias("n"), "start", "end", *[F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in ("start", "end")])
    rel = lambda *x: allen.classify(*[F.col(c) for c in x])
    o = o.where("start2 IS NOT NULL").select("customer", "n", rel("start", "end", "start1", "end1").alias("ab"), rel("start1", "end1", "start2", "end2").alias("bc"), rel("start", "end", "start2", "end2").alias("ac"))
    return o.select("customer", "n", "ac", *[allen.singleton(F.col(c)).alias(c) for c in ("ab", "bc")])


@_query(
    "relation_composition",
    f"""WITH {_TRIPLES}, {_TABLE} SELECT count(*) AS n, count(*) FILTER ((mask >> (list_position({_NAMES}, ac)::INT - 1)) & 1 = 1) AS held, sum(bit_count(mask))::BIGINT AS sizes
      FROM triples JOIN cells ON l = ab AND r = bc""",
)
def relation_composition(spark: SparkSession, d: str) -> DataFrame:
    """The composition of two relations always holds the relation of the outer intervals."""
    t = allen.compose(_triples(spark, d), "ab", "bc")
    held = F.col("composed").bitwiseAND(allen.singleton(F.col("ac"))) != 0
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(held).alias("held"), F.sum(allen.size(F.col("composed"))).alias("sizes"))


@_query(
    "reasoner_triples",
    f"WITH {_TRIPLES}, {_TABLE} SELECT mask, count(*) AS n FROM triples JOIN cells ON l = ab AND r = bc GROUP BY 1",
)
def reasoner_triples(spark: SparkSession, d: str) -> DataFrame:
    """Networks of three successive orders with two relations asserted; what is derived for the third is their composition."""
    t = _triples(spark, d).select(F.concat_ws("/", F.col("customer").cast("string"), F.col("n").cast("string")).alias("network"), "ab", "bc")
    rows = t.select("network", F.lit(1).alias("step"), F.lit(0).alias("i"), F.lit(1).alias("j"), F.col("ab").alias("mask")).union(t.select("network", F.lit(2), F.lit(1), F.lit(2), "bc"))
    return reasoner.close_networks(rows).where("i = 0 AND j = 2").groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "closure_of_chains",
    f"""WITH RECURSIVE {_ORDERS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY k) AS n FROM ords WHERE s < e), {_TABLE},
      links AS (SELECT a.customer, a.n AS i, {_CLASS} AS r FROM numbered a JOIN numbered b ON a.customer = b.customer AND b.n = a.n + 1),
      steps AS (SELECT m, r, bit_or(mask)::INT AS mask FROM (SELECT range::INT AS m FROM range(1, 8192)) JOIN cells ON (m >> (list_position({_NAMES}, l)::INT - 1)) & 1 = 1 GROUP BY m, r),
      walk AS (SELECT customer, i, i + 1 AS j, (1 << (list_position({_NAMES}, r)::INT - 1))::INT AS mask FROM links
        UNION ALL SELECT w.customer, w.i, w.j + 1, s.mask FROM walk w JOIN links l ON l.customer = w.customer AND l.i = w.j JOIN steps s ON s.m = w.mask AND s.r = l.r)
      SELECT customer AS network, i - 1 AS i, j - 1 AS j, mask FROM walk WHERE mask < 8191""",
)
def closure_of_chains(spark: SparkSession, d: str) -> DataFrame:
    """A network for each customer, of each order's relation to the next: in a chain, what is known of two orders is what the links between them compose to."""
    cells = reasoner.closed_masks(_chains(spark, d))
    return cells.where("i < j").select("network", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "mask")


_KIND16 = "[" + ", ".join(f"'{k}'" for k in relations.KINDS) + "]"
_STEP = ", ".join(f"'{k}'" for k in relations.TRANSITIONS)


@_query(
    "edge_guard",
    f"""WITH {_PAIRS.replace("SELECT a.customer AS a_customer", "SELECT a.k AS ak, b.k AS bk")}, e AS (SELECT r, ak % 9 = 0 AS self, CASE WHEN bk % 17 = 0 THEN 'rumours' ELSE {_KIND16}[ak % 16 + 1] END AS kind FROM pairs)
      SELECT CASE WHEN kind = 'rumours' THEN 'UnknownRelationKind' WHEN kind NOT IN ({_STEP}) THEN 'ok' WHEN self THEN 'TransitionSelfLoop' WHEN r IS NULL THEN 'UncertainRelation' WHEN r IN ('after', 'met_by') THEN 'ReverseTransition' ELSE 'ok' END AS outcome, count(*) AS n
      FROM e GROUP BY 1""",
)
def edge_guard(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("b_order") % 17 == 0, F.lit("rumours")).otherwise(F.element_at(F.array(*[F.lit(k) for k in relations.KINDS]), (F.col("a_order") % 16).cast("int") + 1))
    p = _pairs(spark, d).withColumn("kind", kind).withColumn("target", F.when(F.col("a_order") % 9 == 0, F.col("a_order")).otherwise(F.col("b_order")))
    return _tally(p, relations.edge_error(F.col("a_order"), F.col("target"), F.col("kind"), *[F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")]))


@_query(
    "stored_edge_guard",
    f"""WITH e AS (SELECT event_id, {_KIND16}[event_id % 16 + 1] AS kind, event_id % 5 = 0 AS flipped, event_id % 7 = 0 AS self, event_id % 19 = 0 AS odd FROM events)
      SELECT CASE WHEN odd THEN 'UnknownRelationKind' WHEN flipped THEN 'TransitionFlagMismatch' WHEN self AND kind IN ({_STEP}) THEN 'TransitionSelfLoop' ELSE 'ok' END AS outcome, count(*) AS n FROM e GROUP BY 1""",
)
def stored_edge_guard(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in relations.KINDS]), (F.col("event_id") % 16).cast("int") + 1)
    e = table(spark, d, "events").select("event_id", F.when(_every(19), F.lit("rumours")).otherwise(kind).alias("kind"), F.col("event_id").alias("source"), F.when(_every(7), F.col("event_id")).otherwise(F.col("event_id") + 1).alias("target"))
    e = e.withColumn("is_transition", F.when(_every(5), ~relations.is_transition(F.col("kind"))).otherwise(relations.is_transition(F.col("kind"))))
    return _tally(e, relations.stored_error())


@_query(
    "edge_insert_repeats",
    f"""WITH RECURSIVE e AS (SELECT event_id AS seq, event_id // 2 AS id, event_id % 4 AS m FROM events),
      x AS (SELECT seq, id, m, CASE m WHEN 1 THEN 'TransitionCycle' WHEN 3 THEN 'DuplicateRelationEdge' ELSE 'ok' END AS outcome FROM e)
      SELECT outcome, count(*) AS n, sum(seq)::BIGINT AS seqs FROM x GROUP BY 1""",
)
def edge_insert_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Four events make four edges: a->b; then b->a under an id of its own, refused for the cycle; p->q; and q->r under p->q's id, a duplicate.

    The first two have different ids, the last two share one.
    """
    q, m = F.floor(F.col("event_id") / 4), F.col("event_id") % 4
    node = lambda x: F.concat(F.lit(x), q.cast("string"))
    source = F.when(m == 0, node("a")).when(m == 1, node("b")).when(m == 2, node("p")).otherwise(node("q"))
    target = F.when(m == 0, node("b")).when(m == 1, node("a")).when(m == 2, node("q")).otherwise(node("r"))
    id_ = F.when(m < 2, F.concat_ws("/", F.col("event_id").cast("string"), F.lit("own"))).otherwise(F.concat_ws("/", q.cast("string"), F.lit("pair")))
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), id_.alias("edge_id"), F.lit("causes").alias("kind"), source.alias("source"), target.alias("target"))
    return relations.insert_edges(e).groupBy(F.coalesce("error_code", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


@_query(
    "policy_conflicts",
    """WITH p AS (SELECT user_id, event_type, ts::DATE AS day FROM events),
      c AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, day) > 1 AS clash, lead(day) OVER (PARTITION BY user_id, event_type ORDER BY day) AS following FROM p)
      SELECT event_type AS record_class, CASE WHEN clash THEN 'PolicyConflict' ELSE 'ok' END AS outcome, count(*) AS n, count(following) AS closed FROM c GROUP BY 1, 2""",
)
def policy_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """A user's events of a type are policies from their day on; those of one day conflict."""
    start = F.col("ts").cast("date").cast("timestamp_ntz").alias("system_from")
    e = table(spark, d, "events").select(F.col("user_id").alias("tenant_record_id"), F.col("event_type").alias("record_class"), F.lit("p").alias("purpose"), start)
    out = governance.policy_succession(e)
    return out.groupBy("record_class", F.coalesce("error_code", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count("system_to").alias("closed"))


@_query("edges_by_evidence", "SELECT CASE WHEN event_id % 3 = 0 THEN 'inferred' ELSE 'observed' END AS evidence_status, count(*) AS n FROM events GROUP BY 1")
def edges_by_evidence(spark: SparkSession, d: str) -> DataFrame:
    return relations.by_evidence(table(spark, d, "events").select(F.when(_every(3), F.lit("inferred")).otherwise(F.lit("observed")).alias("evidence_status")))


@_query(
    "stored_memberships",
    _TALLY.format(case="CASE WHEN event_id % 5 = 0 THEN 'AmbiguousMember' WHEN event_id % 7 = 0 THEN 'AmbiguousGroup' WHEN event_id % 3 = 0 THEN 'InvalidMembershipWeight' ELSE 'ok' END", rows="events"),
)
def stored_memberships(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth names a document and a segment, every seventh no group, every third has no weight."""
    e = F.col("event_id")
    m = table(spark, d, "events").select(
        e.alias("document_id"), F.when(_every(5), e).alias("segment_id"), F.lit(None).cast("long").alias("mention_id"), F.when(~_every(7), e).alias("entity_id"), F.lit(None).cast("long").alias("project_id"),
        F.when(_every(3), F.lit(0.0)).otherwise(F.lit(0.5)).alias("weight"),
    )
    return _tally(m, membership.stored_error())


# events


@_query(
    "instance_registry",
    """WITH m AS (SELECT event_id, event_id % 10 <> 3 AS known FROM events), i AS (SELECT event_id // 6 AS id, event_id // 3 AS seq, bool_and(known) AS sound FROM m GROUP BY 1, 2),
      s AS (SELECT *, coalesce(sum(sound::INT) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i)
      SELECT CASE WHEN before > 0 THEN 'DuplicateEventInstance' WHEN NOT sound THEN 'UnknownEventInstance' ELSE 'ok' END AS outcome, count(*) AS n, sum(seq)::BIGINT AS seqs FROM s GROUP BY 1""",
)
def instance_registry(spark: SparkSession, d: str) -> DataFrame:
    """Three events support an instance, two instances share an id; a tenth of the mentions isn't registered."""
    e = table(spark, d, "events").select(F.col("event_id").alias("mention_id"))
    i = e.groupBy(F.floor(F.col("mention_id") / 6).alias("instance_id"), F.floor(F.col("mention_id") / 3).alias("seq")).agg(F.sort_array(F.collect_set("mention_id")).alias("supporting_mentions"))
    out = events.registry_error(i, e.where("mention_id % 10 <> 3"), seq="seq")
    return out.groupBy(F.coalesce("error_code", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


_EVENT_ROLES = "[" + ", ".join(f"'{r}'" for r in events.ROLES) + ", 'bystander']"


@_query(
    "event_roles",
    f"""WITH r AS (SELECT user_id, event_id, {_EVENT_ROLES}[event_id % 8 + 1] AS role, event_type FROM events)
      SELECT user_id, coalesce(string_agg(role || '=' || event_type, ',' ORDER BY event_id) FILTER (role <> 'bystander'), '') AS roles, count(*) FILTER (role = 'bystander') AS refused FROM r GROUP BY 1""",
)
def event_roles(spark: SparkSession, d: str) -> DataFrame:
    """A user's events are roles of one instance; every eighth has a role that isn't known."""
    role = F.element_at(F.array(*[F.lit(x) for x in (*events.ROLES, "bystander")]), (F.col("event_id") % 8).cast("int") + 1)
    r = table(spark, d, "events").select(F.col("user_id").alias("instance_id"), F.col("event_id").alias("seq"), role.alias("role"), F.col("event_type").alias("argument"))
    refused = r.groupBy("instance_id").agg(F.count(events.role_error()).alias("refused"))
    out = events.assign_roles(refused, r)
    return out.select(F.col("instance_id").alias("user_id"), F.array_join(F.transform("roles", lambda x: F.concat(x["role"], F.lit("="), x["argument"])), ",").alias("roles"), "refused")


@_query(
    "instances_active",
    f"WITH i AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id) SELECT user_id FROM i WHERE lo <= {_MID} AND {_MID} <= hi",
)
def instances_active(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select(F.col("user_id").alias("instance_id"), F.col("event_id").alias("mention_id"), F.col("ts").alias("at"), F.lit(0.5).alias("confidence"))
    return events.active_at(events.promote(m), _at_middle(spark, d)).select(F.col("instance_id").alias("user_id"))


# metrics


@_query(
    "absolute_residuals",
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 9 <> 0 THEN round(abs(p_retailprice - p_size * 100), 6) END AS residual, CASE WHEN p_partkey % 9 = 0 THEN 'InvalidInput' ELSE 'ok' END AS outcome FROM part""",
)
def absolute_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth part's recovered value isn't a number."""
    recovered = F.when(_every(9, "k"), F.lit(float("nan"))).otherwise((F.col("size") * 100).cast("double"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("truth"), F.col("p_size").alias("size")).withColumn("recovered", recovered)
    out = metrics.absolute_residuals(p)
    return out.select("k", _r(F.when(F.col("error_code").isNull(), F.col("residual")), "residual"), F.coalesce("error_code", F.lit("ok")).alias("outcome"))


@_query(
    "validation_reports",
    """SELECT k, CASE WHEN k % 10 = 0 THEN 'InvalidInput' ELSE 'ok' END AS outcome, CASE WHEN k % 10 <> 0 THEN printf('rmse=%.6f bias=%.6f coverage=%.6f', k / 4.0::DOUBLE, k / -8.0::DOUBLE, 0.5::DOUBLE) END AS summary FROM (SELECT p_partkey AS k FROM part)""",
)
def validation_reports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    m = table(spark, d, "part").select(k.alias("k"), F.when(k % 10 == 0, F.lit(float("inf"))).otherwise(k / 4).alias("rmse"), (k / -8).alias("mean_bias"), F.lit(0.5).alias("coverage"))
    out = metrics.report(m)
    return out.select("k", F.coalesce("error_code", F.lit("ok")).alias("outcome"), F.when(F.col("error_code").isNull(), F.col("summary")).alias("summary"))


@_query(
    "monte_carlo_overall",
    """WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events)
      SELECT any_value(n) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(max(value) FILTER (k = greatest(ceil(0.07::DOUBLE * n), 1)), 6) AS low, round(max(value) FILTER (k = greatest(ceil(0.93::DOUBLE * n), 1)), 6) AS high FROM r""",
)
def monte_carlo_overall(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all events as one series."""
    m = metrics.summarize_replications(table(spark, d, "events").select("value"), 0.07, 0.93)
    return m.select("n", *[_r(F.col(c), c) for c in ("mean", "sd", "low", "high")])


# evidence and wire


@_query(
    "page_boxes",
    _TALLY.format(case="CASE WHEN page_id % 8 = 0 OR page_id % 5 = 0 OR page_id % 7 = 0 THEN 'InvalidPageLocation' ELSE 'ok' END", rows="pages"),
)
def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page: every fifth is wider than it, every seventh isn't a number, every eighth is on page 0."""
    f = lambda x: F.lit(float(x))
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id")
    return _tally(p, evidence.page_error(f(600), f(800), f(10), F.when(k % 7 == 0, f("nan")).otherwise(f(20)), F.when(k % 5 == 0, f(591)).otherwise(f(590)), f(100), F.when(k % 8 == 0, F.lit(0)).otherwise(F.lit(1))))


@_query(
    "interval_wire",
    f"""WITH {_ORDERS} SELECT CASE WHEN k % 5 = 0 THEN 'InvalidWirePayload' WHEN k % 7 = 0 THEN 'InvalidWirePayload' WHEN k % 11 = 0 THEN 'InvalidWirePayload' WHEN k % 13 = 0 THEN 'ClockTypeMismatch' WHEN k % 17 = 0 THEN 'InvalidTimestamp'
      WHEN s > e THEN 'InvalidIntervalOrder' WHEN s = e THEN 'EmptyInterval' ELSE 'same' END AS outcome, count(*) AS n FROM ords GROUP BY 1""",
)
def interval_wire(spark: SparkSession, d: str) -> DataFrame:
    """Intervals as JSON and back: an unknown key in an end, a timestamp on an open end, a missing one, another clock, a malformed time."""
    at, k = clocks.from_timestamp, F.col("order")
    i = intervals.bounded(F.lit("included"), at(F.col("start")), F.lit("excluded"), at(F.col("end")), F.lit("day"))
    o = _orders(spark, d).select("order", i.alias("i")).withColumn("json", wire.encode_interval(F.col("i"), "event_time"))
    put = lambda a, b: F.regexp_replace("json", a, F.lit(b))
    o = o.withColumn(
        "json",
        F.when(k % 5 == 0, put(r'"lower":\{', '"lower":{"zone":"Z",'))
        .when(k % 7 == 0, put(r'"kind":"excluded"', '"kind":"unbounded"'))
        .when(k % 11 == 0, put(r'"lower":\{"kind":"included","timestamp":"[^"]*"\}', '"lower":{"kind":"included"}'))
        .when(k % 13 == 0, put("event_time", "system_time"))
        .when(k % 17 == 0, put(r'Z"', 'z"'))
        .otherwise(F.col("json")),
    )
    back, error = wire.decode_interval(F.col("json"), "event_time")
    return o.groupBy(F.coalesce(error, F.when(back == F.col("i"), "same"), F.lit("changed")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "document_wire",
    _TALLY.format(
        case="CASE WHEN doc_id % 5 = 0 THEN 'InvalidWirePayload' WHEN doc_id % 7 = 0 THEN 'UnsupportedSchemaVersion' WHEN length(text) = 0 THEN 'EmptyEvidence' WHEN doc_id % 11 = 0 THEN 'InvalidContentDigest' WHEN doc_id % 13 = 0 THEN 'DigestMismatch' ELSE 'same' END",
        rows="documents",
    ),
)
def document_wire(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON and back: an unknown key, another version, a malformed digest, another text's digest."""
    k, t = F.col("doc_id"), F.col("text")
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("json", wire.encode_document(k.cast("string"), F.lit("a"), t))
    h = F.sha2(t.cast("binary"), 256)
    docs = docs.withColumn(
        "json",
        F.when(k % 5 == 0, F.regexp_replace("json", r"^\{", F.lit('{"extra":1,')))
        .when(k % 7 == 0, F.regexp_replace("json", r'"schema_version":1', F.lit('"schema_version":2')))
        .when(k % 11 == 0, F.replace("json", h, F.lit("short")))
        .when(k % 13 == 0, F.replace("json", h, F.sha2(F.lit(b"another"), 256)))
        .otherwise(F.col("json")),
    )
    back, error = wire.decode_document(F.col("json"))
    return docs.groupBy(F.coalesce(error, F.when(back["text"] == t, "same"), F.lit("changed")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "span_wire",
    """WITH s AS (SELECT doc_id, length(text) AS n, strlen(text) AS b FROM documents)
      SELECT CASE WHEN doc_id % 5 = 0 THEN 'InvalidWirePayload' WHEN doc_id % 7 = 0 THEN 'SpanDocumentMismatch' WHEN doc_id % 11 = 0 THEN 'InvalidPageLocation' WHEN n = 0 THEN 'EmptySourceSpan' WHEN doc_id % 13 = 0 THEN 'ByteRangeOutOfBounds' ELSE 'same' END AS outcome, count(*) AS n FROM s GROUP BY 1""",
)
def span_wire(spark: SparkSession, d: str) -> DataFrame:
    """Spans of whole texts as JSON and back: an unknown key, another document, a box beyond its page, a range beyond the text."""
    k, t = F.col("doc_id"), F.col("text")
    f = lambda x: F.lit(float(x))
    docs = table(spark, d, "documents").select("doc_id", "text")
    ranges = [F.lit(0), F.octet_length(t) + F.when(k % 13 == 0, 1).otherwise(0), F.lit(0), F.char_length(t)]
    page = [F.lit(3), f(600), f(800), f(0), f(0), F.when(k % 11 == 0, f(601)).otherwise(f(600)), f(800)]
    plain, paged = wire.encode_span(k.cast("string"), ranges), wire.encode_span(k.cast("string"), ranges, page)
    docs = docs.withColumn("json", F.when((k % 2 == 0) & (k % 11 != 0), plain).otherwise(paged))
    docs = docs.withColumn("json", F.when(k % 5 == 0, F.regexp_replace("json", r"^\{", F.lit('{"extra":1,'))).otherwise(F.col("json")))
    back, error = wire.decode_span(F.col("json"), F.when(k % 7 == 0, F.lit("other")).otherwise(k.cast("string")), t)
    same = (back["byte_end"] == F.octet_length(t)) & (back["page_location"].isNull() == ((k % 2 == 0) & (k % 11 != 0)))
    return docs.groupBy(F.coalesce(error, F.when(same, "same"), F.lit("changed")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@_query(
    "timestamps_refused",
    """SELECT event_id, CASE WHEN event_id % 8 = 0 THEN epoch_us(date_trunc('second', ts)) // 1000000 END AS sec FROM events""",
)
def timestamps_refused(spark: SparkSession, d: str) -> DataFrame:
    """Seven of eight texts depart from the strict form, each in its own way."""
    base, k = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id") % 8
    wrong = [F.concat(base, F.lit("-00:00")), F.concat(base, F.lit(".Z")), F.concat(base, F.lit("z")), F.concat(F.substring(base, 1, 17), F.lit("60Z")), F.concat(F.substring(base, 1, 8), F.lit("32T00:00:00Z")), F.concat(base, F.lit("+24:00")), F.replace(F.concat(base, F.lit("Z")), F.lit("T"), F.lit(" "))]
    text = F.when(k == 0, F.concat(base, F.lit("Z")))
    for i, w in enumerate(wrong, 1):
        text = text.when(k == i, w)
    return table(spark, d, "events").select("event_id", clocks.parse_rfc3339(text)["sec"].alias("sec"))


# contracts


@_query(
    "payloads_minimized",
    """WITH o AS (SELECT doc_id, ['scientific_validation', 'operational_monitoring', 'partner_disclosure', 'modular_service_consumer'][doc_id % 4 + 1] AS purpose, doc_id % 3 = 0 AS text FROM documents)
      SELECT purpose, outcome, count(*) AS n, count(*) FILTER (outcome = 'ok' AND text) AS texts FROM (SELECT *, CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'InvalidWirePayload'
        WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0 OR (text AND purpose IN ('operational_monitoring', 'partner_disclosure')) THEN 'AuthorizationDenied' ELSE 'ok' END AS outcome FROM o) GROUP BY 1, 2""",
)
def payloads_minimized(spark: SparkSession, d: str) -> DataFrame:
    """Offers of documents, a grant each: late decisions, another tenant, a mapped identity, a blank artifact, a malformed stamp."""
    k = F.col("doc_id")
    purpose = F.element_at(F.array(*[F.lit(p) for p in contracts.PURPOSES]), (k % 4).cast("int") + 1)
    docs = table(spark, d, "documents")
    offers = docs.select(
        k.alias("grant_id"), F.when(k % 13 == 0, F.lit(" ")).otherwise(k.cast("string")).alias("artifact_id"), F.lit("opaque").alias("opaque_analytical_id"), F.when(k % 3 == 0, F.col("text")).alias("source_text"),
        F.lit("author").alias("membership_role"), F.when(k % 11 == 0, F.lit("someone")).alias("identity_mapping"), F.when(k % 17 == 0, F.lit("2024-13-01T00:00:00Z")).when(k % 5 == 0, F.lit("2025-01-01T00:00:01Z")).otherwise(F.lit("2024-06-01T00:00:00Z")).alias("decision_time"),
        F.lit("t").alias("tenant_workspace_id"),
    )
    grants = docs.select(k.alias("grant_id"), purpose.alias("purpose"), F.when(k % 7 == 0, F.lit("u")).otherwise(F.lit("t")).alias("tenant_workspace_id"), F.lit("2024-01-01T00:00:00Z").alias("valid_from"), F.lit("2025-01-01T00:00:00Z").alias("valid_to"))
    out = contracts.minimize_payloads(offers, grants)
    return out.groupBy("purpose", F.coalesce("error_code", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count("source_text").alias("texts"))


@_query(
    "disclosures",
    """WITH r AS (SELECT event_id, user_id, event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS ok FROM events)
      SELECT user_id::VARCHAR AS principal_id, CASE WHEN ok THEN 'allowed' ELSE 'denied' END AS outcome, count(*) AS n FROM r GROUP BY 1, 2""",
)
def disclosures(spark: SparkSession, d: str) -> DataFrame:
    """Requests to re-identify: without authority, for another purpose, of another tenant's mapping, after the grant."""
    k = F.col("event_id")
    e = table(spark, d, "events").select(
        F.lit("t").alias("tenant_workspace_id"), F.col("user_id").cast("string").alias("principal_id"), F.when(k % 5 == 0, F.lit("partner_disclosure")).otherwise(F.lit("scientific_validation")).alias("purpose"),
        F.lit("2024-01-01T00:00:00Z").alias("valid_from"), F.when(k % 2 == 0, F.lit("2024-12-31T00:00:00Z")).alias("valid_to"), (k % 3 != 0).alias("reidentification_authorized"),
        F.when(k % 7 == 0, F.lit("u")).otherwise(F.lit("t")).alias("mapping_tenant_workspace_id"), k.cast("string").alias("opaque_analytical_id"), F.lit("name").alias("direct_identity"),
        F.when(k % 11 == 0, F.lit("2023-12-31T23:59:59Z")).otherwise(F.lit("2024-06-01T00:00:00Z")).alias("decision_time"),
    )
    audit, _ = contracts.disclosures(e, "disclosure.v1")
    return audit.groupBy("principal_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "routing_preconditions",
    _TALLY.format(case="CASE WHEN event_id % 7 = 0 THEN 'UnsupportedContractVersion' WHEN event_id % 5 = 0 THEN 'AuthorizationDenied' WHEN event_id % 3 = 0 THEN 'LimitExceeded' WHEN event_id % 11 = 0 THEN 'InvalidWirePayload' ELSE 'ok' END", rows="events"),
)
def routing_preconditions(spark: SparkSession, d: str) -> DataFrame:
    """Requests of another policy, with a document that gives instructions, over the budget, and with an access entry twice."""
    k, half = F.col("event_id"), F.lit(0.5)
    e = table(spark, d, "events").select(
        F.when(k % 7 == 0, F.lit("orchestration-policy.v0")).otherwise(F.lit(contracts.POLICY_VERSION)).alias("policy_version"), F.when(k % 5 == 0, F.lit("instruction")).otherwise(F.lit("none")).alias("document_control"),
        F.lit("concept_alignment").alias("task"), half.alias("risk"), half.alias("ambiguity"), half.alias("evidence"), F.when(k % 3 == 0, F.lit(contracts.MAX_BUDGET + 1)).otherwise(F.lit(9_000)).alias("budget"), F.lit(True).alias("gate_passed"),
        F.when(k % 11 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("access_list"),
    )
    return _tally(contracts.route(e))


@_query(
    "plan_ablation",
    """SELECT CASE WHEN a % 3 = 0 OR a % 5 = 0 OR a % 7 = 0 THEN 'InvalidWirePayload' ELSE 'ok' END AS outcome, CASE WHEN a % 3 <> 0 AND a % 5 <> 0 AND a % 7 <> 0 THEN x > 0 AND y > 0 AND abs(x - y) * 10 <= greatest(x, y) END AS comparable, count(*) AS n
      FROM (SELECT o_orderkey AS a, o_orderkey % 1000 AS x, o_custkey % 1000 AS y FROM orders) GROUP BY 1, 2""",
)
def plan_ablation(spark: SparkSession, d: str) -> DataFrame:
    k, lit = F.col("o_orderkey"), F.lit
    p = table(spark, d, "orders").select(
        F.when(k % 3 == 0, lit("verify")).otherwise(lit("direct")).alias("baseline_mode"), lit("concept_alignment").alias("baseline_task"), F.when(k % 5 == 0, lit("schema_conversion")).otherwise(lit("concept_alignment")).alias("compared_task"),
        F.array(lit("a")).alias("baseline_access_list"), F.when(k % 7 == 0, F.array(lit("b"))).otherwise(F.array(lit("a"))).alias("compared_access_list"), (k % 1000).alias("baseline_budget"), (F.col("o_custkey") % 1000).alias("compared_budget"),
    )
    out = contracts.ablation(p)
    return out.groupBy(F.coalesce("error_code", F.lit("ok")).alias("outcome"), "comparable").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "plan_binding",
    _TALLY.format(case="CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'InvalidWirePayload' WHEN doc_id % 3 = 0 THEN 'AuthorizationDenied' ELSE 'ok' END", rows="documents"),
)
def plan_binding(spark: SparkSession, d: str) -> DataFrame:
    k, h = F.col("doc_id"), F.concat(F.lit("sha256:"), F.sha2(F.col("doc_id").cast("string"), 256))
    mode = F.when(k % 3 == 0, F.lit("abstain")).otherwise(F.lit("direct"))
    bound = F.when(k % 5 == 0, F.substring(h, 8, 64)).when(k % 7 == 0, F.concat(h, F.lit("0"))).otherwise(h)
    return _tally(table(spark, d, "documents").select(mode.alias("m"), bound.alias("h")), contracts.binding_error(F.col("m"), F.col("h")))


@_query(
    "export_manifests",
    """SELECT doc_id, '{"contract_version":1,"artifact_id":"' || doc_id || '","snapshot_id":"' || source || '","knowledge_cutoff":"2024-01-01T00:00:00Z","model_contract_version":"m.v1","engine_version":"e.v1","artifact_digest_sha256":"' || sha256(text) || '"}' AS manifest,
      '{"contract_version":1,"context":"https://schema.org","id":"' || doc_id || '","type_name":"Dataset","artifact_digest_sha256":"' || sha256(text) || '"}' AS linked FROM documents""",
)
def export_manifests(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("artifact_id"), F.col("source").alias("snapshot_id"), F.lit("2024-01-01T00:00:00Z").alias("knowledge_cutoff"), F.lit("m.v1").alias("model_contract_version"), F.lit("e.v1").alias("engine_version"),
        F.sha2("text", 256).alias("artifact_digest_sha256"), F.lit("https://schema.org").alias("context"), F.col("doc_id").cast("string").alias("id"), F.lit("Dataset").alias("type_name"),
    )
    return docs.select("doc_id", contracts.manifest_json().alias("manifest"), contracts.json_ld().alias("linked"))

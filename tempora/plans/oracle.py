"""Independent SQL for the queries of queries.py, in DuckDB's dialect over the same tables."""

from __future__ import annotations

from ..functions.allen import CONVERSE, RELATIONS
from ..operators.membership import ROLES
from ..operators.relations import KINDS, TRANSITIONS

_MID = "(SELECT make_timestamp(epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2) FROM events)"
_VERSIONS = """versions AS (
  SELECT user_id, event_id, ts AS system_from, event_type, value, lead(ts) OVER w AS system_to, row_number() OVER w AS revision
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
)"""
_ORDERS = """ords AS (
  SELECT o_custkey AS customer, o_orderkey AS k, least(o_orderdate, shipped) AS s, greatest(o_orderdate, shipped) AS e, o_totalprice AS price
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
)"""
_CLASS = """CASE WHEN NOT (a.s < a.e AND b.s < b.e) THEN NULL WHEN a.e < b.s THEN 'before' WHEN b.e < a.s THEN 'after' WHEN a.e = b.s THEN 'meets' WHEN b.e = a.s THEN 'met_by'
  WHEN a.s = b.s AND a.e = b.e THEN 'equals' WHEN a.s = b.s AND a.e < b.e THEN 'starts' WHEN a.s = b.s THEN 'started_by'
  WHEN a.e = b.e AND a.s > b.s THEN 'finishes' WHEN a.e = b.e THEN 'finished_by'
  WHEN a.s < b.s AND a.e < b.e THEN 'overlaps' WHEN a.s < b.s THEN 'contains' WHEN a.e < b.e THEN 'during' ELSE 'overlapped_by' END"""
_PAIRS = f"{_ORDERS}, pairs AS (SELECT a.customer AS a_customer, {_CLASS} AS r FROM ords a JOIN ords b ON a.customer = b.customer AND a.k < b.k)"
_NAMES = "[" + ", ".join(f"'{r}'" for r in RELATIONS) + "]"
_CONVERSES = "[" + ", ".join(f"'{CONVERSE[r]}'" for r in RELATIONS) + "]"
_ROLE_LIST = "[" + ", ".join(f"'{r}'" for r in ROLES) + "]"
_KIND_LIST = "[" + ", ".join(f"'{r}'" for r in KINDS) + "]"
_STEP_LIST = ", ".join(f"'{r}'" for r in TRANSITIONS)
_MEMBERS = f"{_ORDERS}, m AS (SELECT customer AS member_id, strftime(s, '%Y-%m') AS group_id, {_ROLE_LIST}[k % {len(ROLES)} + 1] AS role, price AS weight, s AS valid_from, e AS valid_to FROM ords WHERE s < e)"
_AT = "TIMESTAMP '1995-06-17 00:00:00'"
_PARTS = """pairs AS (
  SELECT p_partkey AS k, p_partkey % 10 AS g, p_retailprice AS t, r, lo, hi FROM part
  JOIN (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS r, min(l_extendedprice / l_quantity) AS lo, max(l_extendedprice / l_quantity) AS hi FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey
)"""
_RANKS = "(SELECT s, e FROM range(6) a(s), range(6) b(e) WHERE s < e)"


_EDGES = f"""e AS (
  SELECT user_id, event_id, lag(event_id) OVER w AS before, lag(event_id, 3) OVER w AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), edges AS (
  SELECT event_id * 2 AS seq, {_KIND_LIST}[event_id % 8 + 1] AS kind FROM e WHERE before IS NOT NULL
  UNION ALL SELECT event_id * 2 + 1, {_KIND_LIST}[event_id % 16 + 1] FROM e WHERE third IS NOT NULL AND event_id % 11 = 0
)"""

ORACLE_SQL: dict[str, str] = {
    "bitemporal_as_known_at": f"""WITH {_VERSIONS} SELECT user_id, event_id, revision, event_type, round(value, 6) AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY revision DESC) AS rn FROM versions WHERE system_from <= {_MID} AND (system_to IS NULL OR {_MID} < system_to)) WHERE rn = 1""",
    "bitemporal_as_valid_at": f"""WITH {_VERSIONS} SELECT user_id, event_id, revision FROM versions
      WHERE system_from <= {_MID} AND (system_to IS NULL OR {_MID} < system_to) AND {_MID} < system_from + INTERVAL 1 DAY""",
    "bitemporal_as_known_at_each": f"""WITH {_VERSIONS}, p AS (SELECT DISTINCT user_id, ts + INTERVAL 36 HOURS AS known FROM events)
      SELECT p.user_id, p.known::DATE AS known, v.event_id, v.revision FROM p ASOF JOIN versions v ON p.user_id = v.user_id AND p.known >= v.system_from WHERE v.system_to IS NULL OR p.known < v.system_to""",
    "bitemporal_as_valid_at_each": f"""WITH {_VERSIONS}, w AS (SELECT * REPLACE (CASE WHEN value > 50 THEN system_to + INTERVAL 2 DAYS ELSE system_to END AS system_to) FROM versions),
      p AS (SELECT DISTINCT user_id, ts + INTERVAL 36 HOURS AS known, ts + INTERVAL 30 HOURS AS valid FROM events)
      SELECT p.user_id, p.known::DATE AS known, arg_max(event_id, revision) AS event_id, max(revision) AS revision FROM p JOIN w ON p.user_id = w.user_id AND system_from <= known AND (system_to IS NULL OR known < system_to)
        AND system_from <= valid AND valid < system_from + INTERVAL 1 DAY GROUP BY p.user_id, p.known, p.valid""",
    "bitemporal_eligible_at_cutoff": f"WITH {_VERSIONS} SELECT user_id, event_id FROM versions WHERE system_to IS NULL AND system_from <= (SELECT make_timestamp(epoch_us(max(ts)) - (epoch_us(max(ts)) - epoch_us(min(ts))) // 50) FROM events)",
    "bitemporal_replay": "SELECT user_id, count(*) AS n, count(*) AS last, 1::BIGINT AS open FROM events GROUP BY user_id",
    "cutoff_snapshot": f"""SELECT CASE WHEN late THEN 'UnavailableAtCutoff' WHEN k > 1 THEN 'DuplicateDocument' ELSE 'eligible' END AS outcome, count(*) AS n, sum(event_id)::BIGINT AS ids
      FROM (SELECT event_id, ts > {_MID} AS late, row_number() OVER (PARTITION BY event_id // 2, ts > {_MID} ORDER BY event_id) AS k FROM events) GROUP BY 1""",
    "rolling_origin": "SELECT * FROM (SELECT d AS train_cutoff, lead(d) OVER (ORDER BY d) AS test_cutoff FROM (SELECT DISTINCT ts::DATE AS d FROM events)) WHERE test_cutoff IS NOT NULL",
    "allen_pairs": f"WITH {_PAIRS} SELECT coalesce(r, 'none') AS relation, count(*) AS n FROM pairs GROUP BY 1",
    "allen_sets": f"""WITH {_PAIRS}, s AS (SELECT a_customer, list_sort(list_distinct(list(list_position({_NAMES}, r)))) AS ps FROM pairs WHERE r IS NOT NULL GROUP BY a_customer)
      SELECT a_customer, list_sum(list_transform(ps, lambda p: 1 << (p::INT - 1)))::INT AS mask, len(ps)::INT AS size,
        list_sum(list_transform(ps, lambda p: 1 << (list_position({_NAMES}, {_CONVERSES}[p])::INT - 1)))::INT AS converse, array_to_string(list_transform(ps, lambda p: {_NAMES}[p]), ',') AS names FROM s""",
    "forward_order_violations": f"WITH {_PAIRS} SELECT CASE WHEN r IS NULL THEN 'UncertainRelation' WHEN r IN ('after', 'met_by') THEN 'ReverseTransition' ELSE 'forward' END AS outcome, count(*) AS n FROM pairs GROUP BY 1",
    "interval_contains": f"WITH {_ORDERS} SELECT count(*) FILTER (s <= {_AT} AND {_AT} <= e) AS closed, count(*) FILTER (s < {_AT} AND {_AT} < e) AS open, count(*) AS n FROM ords WHERE s < e",
    "interval_errors": f"WITH {_ORDERS} SELECT CASE WHEN s > e THEN 'InvalidIntervalOrder' WHEN s = e THEN 'EmptyInterval' ELSE 'ok' END AS outcome, count(*) AS n FROM ords GROUP BY 1",
    "rfc3339_parse": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, epoch_us(date_trunc('second', ts)) // 1000000 AS sec FROM events",
    "wire_round_trip": "SELECT count(*) AS same, 0::BIGINT AS errors, count(*) AS mismatches FROM events",
    "membership_active": f"WITH {_MEMBERS} SELECT member_id, count(DISTINCT group_id) AS multiplicity FROM m WHERE {_AT} BETWEEN valid_from AND valid_to GROUP BY member_id",
    "membership_weight_by_role": f"WITH {_MEMBERS} SELECT member_id, role, round(sum(weight), 2) AS weight FROM m WHERE {_AT} BETWEEN valid_from AND valid_to GROUP BY ALL",
    "membership_active_for": f"WITH {_MEMBERS}, t AS (SELECT DISTINCT member_id, valid_from AS at FROM m) SELECT m.member_id, count(*) AS n FROM m JOIN t ON m.member_id = t.member_id AND t.at BETWEEN valid_from AND valid_to GROUP BY 1",
    "membership_multiplicity_each": f"""WITH {_MEMBERS}, t AS (SELECT DISTINCT member_id, valid_from + INTERVAL 21 DAYS AS at FROM m)
      SELECT t.member_id, t.at::DATE AS at, count(DISTINCT group_id) AS multiplicity FROM t LEFT JOIN m ON m.member_id = t.member_id AND t.at BETWEEN valid_from AND valid_to GROUP BY t.member_id, t.at""",
    "membership_weight_each": f"""WITH {_MEMBERS}, t AS (SELECT DISTINCT member_id, valid_from + INTERVAL 21 DAYS AS at FROM m)
      SELECT t.member_id, role, t.at::DATE AS at, round(sum(weight), 2) AS weight FROM t JOIN m ON m.member_id = t.member_id AND t.at BETWEEN valid_from AND valid_to GROUP BY t.member_id, role, t.at""",
    "membership_errors": f"WITH {_MEMBERS} SELECT CASE WHEN c > 1 THEN 'DuplicateMembership' ELSE 'ok' END AS outcome, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY member_id, group_id, role ORDER BY valid_from, valid_to, weight) AS c FROM m) GROUP BY 1",
    "kish_ess": "SELECT o_custkey AS customer, round(sum(o_totalprice) * sum(o_totalprice) / sum(o_totalprice * o_totalprice), 6) AS ess, round(count(*) / (sum(o_totalprice) * sum(o_totalprice) / sum(o_totalprice * o_totalprice)), 6) AS design_effect FROM orders GROUP BY 1",
    "group_normalized_kish": "SELECT round(power(sum(w), 2) / sum(w * w), 3) AS ess FROM (SELECT o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS w FROM orders)",
    "split_group_normalized": "SELECT doc_id, round(n_chars / sum(n_chars) OVER (PARTITION BY source), 9) AS normalized FROM documents WHERE n_chars > 0",
    "split_effective_sample_size": "SELECT source, round(sum(n_chars::DOUBLE) * sum(n_chars::DOUBLE) / sum(n_chars::DOUBLE * n_chars), 6) AS ess FROM documents GROUP BY source",
    "leakage_groups": "SELECT doc_id AS document_id, min(doc_id) OVER (PARTITION BY text) AS group_id FROM documents",
    "chain_groups": "SELECT min(event_id) OVER (PARTITION BY event_id % 7) AS group_id, count(*) OVER (PARTITION BY event_id % 7) AS n FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) = 1",
    "group_leakage": "SELECT g AS group_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS g FROM documents) GROUP BY g HAVING min(doc_id % 2) <> max(doc_id % 2)",
    "recovery_metrics": f"""WITH {_PARTS} SELECT g, round(sqrt(avg((r - t) * (r - t))), 6) AS rmse, round(stddev_samp((r - t) * (r - t)) / (2 * sqrt(avg((r - t) * (r - t))) * sqrt(count(*))), 6) AS rmse_standard_error,
      round(avg(r - t), 6) AS mean_bias, round(stddev_samp(r - t) / sqrt(count(*)), 6) AS bias_standard_error, count(*) FILTER (abs(r - t) <= 300) AS match_count FROM pairs GROUP BY g""",
    "interval_coverage": f"""WITH {_PARTS}, c AS (SELECT g, avg(CASE WHEN lo <= t AND t <= hi THEN 1::DOUBLE ELSE 0 END) AS p, count(*)::DOUBLE AS n FROM pairs GROUP BY g)
      SELECT g, round(p, 6) AS coverage, round(greatest(0, (p + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS lower,
        round(least(1, (p + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS upper FROM c""",
    "edge_precision_recall": """WITH t AS (SELECT o_custkey AS a, o_orderkey AS b FROM orders), r AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS a, o_orderkey AS b FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
      b AS (SELECT count(*)::DOUBLE AS n FROM (SELECT * FROM t INTERSECT SELECT * FROM r)) SELECT round(n / (SELECT count(*) FROM r), 6) AS "precision", round(n / (SELECT count(*) FROM t), 6) AS recall FROM b""",
    "temporal_order_accuracy": "SELECT a.user_id, round(avg(CASE WHEN sign(epoch_us(a.ts) - epoch_us(b.ts)) = sign(a.value - b.value) THEN 1::DOUBLE ELSE 0 END), 6) AS accuracy FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id GROUP BY 1",
    "monte_carlo_summary": """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
      SELECT user_id, any_value(n) AS n, round(avg(value), 9) AS mean, round(coalesce(stddev_samp(value), 0), 9) AS sd, round(coalesce(stddev_samp(value), 0) / sqrt(count(*)), 9) AS se,
        round(max(value) FILTER (k = greatest(ceil(0.07::DOUBLE * n), 1)), 9) AS low, round(max(value) FILTER (k = greatest(ceil(0.93::DOUBLE * n), 1)), 9) AS high FROM r GROUP BY user_id""",
    "monte_carlo_acceptance": "SELECT user_id, CASE WHEN coalesce(stddev_samp(value), 0) = 0 THEN avg(value) = 50 ELSE abs(avg(value) - 50) <= stddev_samp(value) / sqrt(count(*)) END AS accepted FROM events GROUP BY user_id",
    "active_documents": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)",
    "blocked_deletions": "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "tenant_rows": "SELECT doc_id FROM documents WHERE source = 'src3'",
    "policy_succession": "SELECT event_type AS record_class, count(DISTINCT user_id) AS open, 0::BIGINT AS conflicts, count(*) AS n FROM events GROUP BY event_type",
    "restore_probe": "SELECT count(*) AS bad_windows, 0::BIGINT AS bad_digests FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate",
    "past_cutoff": "SELECT event_id FROM events e JOIN (SELECT user_id, max(ts) AS c FROM events WHERE event_type = 'purchase' GROUP BY user_id) p ON e.user_id = p.user_id AND e.ts > c",
    "evidence_digest": "SELECT doc_id, sha256(text) AS digest, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars, CASE WHEN strlen(text) = 0 THEN 'EmptyEvidence' END AS error FROM documents",
    "span_check": "SELECT doc_id, CASE WHEN length(text) = 0 THEN 'EmptySourceSpan' END AS good, CASE length(text) WHEN 0 THEN 'InvalidSourceSpanOrder' WHEN 1 THEN 'EmptySourceSpan' ELSE 'CharacterRangeMismatch' END AS bad, sha256(text) AS span_sha256 FROM documents",
    "relation_counts": f"WITH {_EDGES} SELECT count(*) AS edges, count(*) FILTER (kind IN ({_STEP_LIST})) AS transitions FROM edges",
    "ordered_dag": f"WITH {_EDGES} SELECT seq, kind, CASE WHEN seq % 2 = 1 AND kind IN ({_STEP_LIST}) THEN 'TransitionCycle' ELSE 'ok' END AS outcome FROM edges",
    "graphml_export": """WITH e AS (SELECT event_id, lag(event_id) OVER w AS before, lag(event_id, 3) OVER w AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      edges AS (SELECT event_id * 2 AS seq, before AS s, event_id AS t FROM e WHERE before IS NOT NULL UNION ALL SELECT event_id * 2 + 1, event_id, third FROM e WHERE third IS NOT NULL AND event_id % 11 = 0),
      numbered AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS k FROM edges)
      SELECT 0 AS part, '' AS "at", '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || '<graph id="events" edgedefault="directed">' AS line
      UNION ALL SELECT 3, '', '</graph>' || chr(10) || '</graphml>' UNION ALL SELECT 1, x::VARCHAR, '  <node id="' || x || '"/>' FROM (SELECT s AS x FROM edges UNION SELECT t FROM edges)
      UNION ALL SELECT 2, lpad(k::VARCHAR, 20, '0'), '  <edge id="e' || k || '" source="' || s || '" target="' || t || '"/>' FROM numbered""",
    "promote_events": """SELECT user_id::VARCHAR || '/' || ts::DATE::VARCHAR AS instance_id, count(*) AS n, round(avg(value / 1000), 9) AS confidence, CASE WHEN min(ts) >= max(ts) THEN 'EmptyInterval' ELSE 'ok' END AS outcome FROM events GROUP BY user_id, ts::DATE""",
    "mention_errors": "SELECT CASE WHEN event_id % 9 = 0 THEN 'InvalidWirePayload' WHEN value / 100 < 0 OR value / 100 > 1 THEN 'InvalidConfidence' ELSE 'ok' END AS outcome, count(*) AS n FROM events GROUP BY 1",
    "export_decisions": """SELECT purpose, with_text, CASE WHEN with_text AND purpose = 'operational_monitoring' THEN 'source_text_denied_for_purpose' WHEN with_text AND purpose = 'partner_disclosure' THEN 'partner_source_text_requires_elevated_grant' ELSE 'purpose_bound_export_allowed' END AS decision, count(*) AS n
      FROM (SELECT ['scientific_validation', 'operational_monitoring', 'partner_disclosure', 'modular_service_consumer'][doc_id % 4 + 1] AS purpose, doc_id % 3 = 0 AS with_text FROM documents) GROUP BY ALL""",
    "orchestration_routing": """WITH q AS (
      SELECT event_id, ['span_classification', 'concept_alignment', 'blinded_model_review', 'narrative_synthesis', 'adversarial_verification', 'schema_conversion'][user_id % 6 + 1] AS task,
        (event_id * 7 % 101) / 100 AS risk, (event_id * 13 % 101) / 100 AS amb, (event_id * 29 % 101) / 100 AS ev, event_id * 37 % 30000 AS budget, event_id % 2 = 0 AS gate FROM events
    ), p AS (
      SELECT *, CASE WHEN risk > 1 OR amb > 1 OR ev > 1 THEN NULL WHEN ev < 0.35 OR (task = 'blinded_model_review' AND NOT gate) THEN 0 WHEN task = 'schema_conversion' THEN 1 WHEN task = 'blinded_model_review' THEN 3 WHEN task = 'adversarial_verification' THEN 2
        WHEN task = 'span_classification' THEN CASE WHEN risk < 0.35 AND amb < 0.35 THEN 1 ELSE 2 END WHEN task = 'concept_alignment' THEN CASE WHEN amb >= 0.5 THEN 3 ELSE 2 END ELSE CASE WHEN risk >= 0.5 OR amb >= 0.5 THEN 4 ELSE 2 END END AS want,
        CASE WHEN budget >= 24000 THEN 4 WHEN budget >= 16000 THEN 3 WHEN budget >= 8000 THEN 2 WHEN budget >= 4000 THEN 1 ELSE 0 END AS paid FROM q
    ), m AS (SELECT *, CASE WHEN task = 'blinded_model_review' AND paid < 3 THEN 0 ELSE least(want, paid) END AS l FROM p)
    SELECT task, CASE WHEN want IS NULL THEN 'none' ELSE ['abstain', 'direct', 'verify', 'committee', 'conductor'][l + 1] END AS mode, CASE WHEN want IS NULL THEN 'InvalidWirePayload' ELSE 'ok' END AS outcome, count(*) AS n,
      sum(CASE WHEN want IS NULL THEN NULL WHEN l = 0 THEN 0 ELSE budget END)::BIGINT AS tokens, sum(CASE WHEN want IS NULL THEN NULL ELSE l END)::BIGINT AS roles FROM m GROUP BY 1, 2, 3""",
    "budget_comparison": "SELECT a > 0 AND b > 0 AND abs(a - b) * 10 <= greatest(a, b) AS comparable, count(*) AS n FROM (SELECT o_orderkey % 1000 AS a, o_custkey % 1000 AS b FROM orders) GROUP BY 1",
    "audit_digests": """SELECT event_id, 'sha256:' || sha256(from_hex(printf('%016x', 8) || hex('audit.v1') || printf('%016x', strlen(event_type)) || hex(event_type) || printf('%016x', strlen(user_id::VARCHAR)) || hex(user_id::VARCHAR))) AS digest FROM events""",
    "field_guards": "SELECT CASE WHEN length(trim(l, ' ')) = 0 OR regexp_matches(l, '[\\x00-\\x1F\\x7F]') OR strlen(l) > 256 THEN 'InvalidLabel' ELSE 'ok' END AS outcome, count(*) AS n FROM (SELECT text AS l FROM documents) GROUP BY 1",
}

"""Queries over the driver's tables: each derives the domain's rows from them and applies one operator (or a few).

A user's events are versions of one document, an order is an interval from its
date to its last shipment, a customer's orders are memberships, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import allen, clocks, intervals, wire
from ..functions.guards import code
from ..operators import bitemporal, contracts, events, evidence, governance, membership, metrics, reasoner, relations, splits
from ..sources.tables import table

CUTOFF = "2024-01-15 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _r(x: Column, name: str, digits: int = 6) -> Column:
    return F.round(x, digits).alias(name)


def versions(spark: SparkSession, d: str) -> DataFrame:
    """A user's events, each closed by the next."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("system_from"), F.col("ts").alias("available_time"), "event_type", "value")
    return bitemporal.replay(e, "user_id", "system_from")


def _middle(spark: SparkSession, d: str) -> DataFrame:
    """The middle of the events' time, as one row."""
    return table(spark, d, "events").agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("at"))


def _at_middle(spark: SparkSession, d: str) -> Column:
    return _middle(spark, d).scalar()


def as_known_at(spark: SparkSession, d: str) -> DataFrame:
    v = bitemporal.as_known_at(versions(spark, d), _at_middle(spark, d), "user_id", "revision")
    return v.select("user_id", "event_id", "revision", "event_type", _r(F.col("value"), "value"))


def as_valid_at(spark: SparkSession, d: str) -> DataFrame:
    """Versions are valid for a day from their event on."""
    v = versions(spark, d).withColumns({"valid_from": F.col("system_from"), "valid_to": F.col("system_from") + F.expr("INTERVAL 1 DAY")})
    at = _at_middle(spark, d)
    return bitemporal.as_valid_at(v, at, at, "user_id", "revision").select("user_id", "event_id", "revision")


def _probes(spark: SparkSession, d: str) -> DataFrame:
    """Each event asks about its user: as known 36 hours later, valid 30 hours later."""
    return table(spark, d, "events").select("user_id", (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("known"), (F.col("ts") + F.expr("INTERVAL 30 HOURS")).alias("valid"))


def as_known_at_each(spark: SparkSession, d: str) -> DataFrame:
    v = bitemporal.as_known_at_each(versions(spark, d), _probes(spark, d), "user_id", revision="revision")
    return v.select("user_id", F.col("known").cast("date").alias("known"), "event_id", "revision")


def as_valid_at_each(spark: SparkSession, d: str) -> DataFrame:
    """Versions are valid for a day from their event on, and events that weigh more than 50 stay open for two: windows of the system time that overlap."""
    late = F.when(F.col("value") > 50, F.col("system_to") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("system_to"))
    v = versions(spark, d).withColumns({"system_to": late, "valid_from": F.col("system_from"), "valid_to": F.col("system_from") + F.expr("INTERVAL 1 DAY")})
    v = bitemporal.as_valid_at_each(v, _probes(spark, d), "user_id", revision="revision")
    return v.select("user_id", F.col("known").cast("date").alias("known"), "event_id", "revision")


def eligible(spark: SparkSession, d: str) -> DataFrame:
    """The cutoff lies before the last fiftieth of the events' time, which some users' open rows are in."""
    late = table(spark, d, "events").agg((F.max("ts") - (F.max("ts") - F.min("ts")) / 50).alias("at")).scalar()
    return bitemporal.eligible_at_cutoff(versions(spark, d), late, "user_id").select("user_id", "event_id")


def version_replay(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("revision").alias("last"), F.count_if(F.col("system_to").isNull()).alias("open"))


def cutoff_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Two events name each document."""
    e = table(spark, d, "events").select(F.col("event_id").alias("document_id"), F.col("ts").alias("available_time"))
    s = splits.snapshot(e.withColumn("seq", F.col("document_id")).withColumn("document_id", F.floor(F.col("document_id") / 2)), _at_middle(spark, d), seq="seq")
    return s.groupBy(F.coalesce("error_code", F.lit("eligible")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("ids"))


def rolling_origin(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select(F.col("ts").cast("date").alias("cutoff")).distinct()
    return splits.rolling_origin(days)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """(customer, order, start, end): from the order's date to its last shipment, where that is later."""
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    o = table(spark, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"), F.least("o_orderdate", "shipped").alias("start"), F.greatest("o_orderdate", "shipped").alias("end"), F.col("o_totalprice").alias("price"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    a, b = o.select(*[F.col(c).alias(f"a_{c}") for c in o.columns]), o.select(*[F.col(c).alias(f"b_{c}") for c in o.columns])
    return a.join(b, F.col("a_customer") == F.col("b_customer")).where("a_order < b_order")


def allen_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = allen.classify(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    return _pairs(spark, d).select(F.coalesce(r, F.lit("none")).alias("relation")).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def allen_sets(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's set of relations between orders, its size and the set of the converses."""
    r = allen.classify(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    s = _pairs(spark, d).select("a_customer", allen.singleton(r).alias("bit")).groupBy("a_customer").agg(F.bit_or("bit").alias("mask")).where("mask IS NOT NULL")
    return s.select("a_customer", "mask", allen.size(F.col("mask")).alias("size"), allen.converse_mask(F.col("mask")).alias("converse"), F.array_join(allen.members(F.col("mask")), ",").alias("names"))


def forward_order(spark: SparkSession, d: str) -> DataFrame:
    e = relations.forward_order_error(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    return _pairs(spark, d).select(F.coalesce(e, F.lit("forward")).alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def interval_contains(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose interval contains the middle of all orders' time, ends counted or not."""
    o = _orders(spark, d).where("start < end")
    at = clocks.from_timestamp(_ntz("1995-06-17 00:00:00"))
    lo, hi = clocks.from_timestamp(F.col("start")), clocks.from_timestamp(F.col("end"))
    closed = intervals.bounded(F.lit("included"), lo, F.lit("included"), hi, F.lit("day"))
    open_ = intervals.bounded(F.lit("excluded"), lo, F.lit("excluded"), hi, F.lit("day"))
    return o.agg(F.count_if(intervals.contains(closed, at)).alias("closed"), F.count_if(intervals.contains(open_, at)).alias("open"), F.count(F.lit(1)).alias("n"))


def interval_errors(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    lo, hi = clocks.from_timestamp(F.col("start")), clocks.from_timestamp(F.col("end"))
    e = intervals.bounded_error(F.lit("included"), lo, F.lit("included"), hi, F.lit("day"))
    return o.groupBy(F.coalesce(e, F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def rfc3339(spark: SparkSession, d: str) -> DataFrame:
    """Every event's time as text with an offset of nine hours, parsed back."""
    text = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
    at = clocks.parse_rfc3339(text)
    return table(spark, d, "events").select("event_id", clocks.to_rfc3339(at).alias("utc"), at["sec"].alias("sec"))


def wire_round_trip(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(clocks.from_timestamp(F.date_trunc("second", "ts")).alias("at"))
    e = e.withColumn("json", wire.encode_clock(F.col("at"), "event_time"))
    back, error = wire.decode_clock(F.col("json"), "event_time")
    _, wrong = wire.decode_clock(F.col("json"), "system_time")
    return e.agg(F.count_if(back == F.col("at")).alias("same"), F.count_if(error.isNotNull()).alias("errors"), F.count_if(wrong == "ClockTypeMismatch").alias("mismatches"))


def _memberships(spark: SparkSession, d: str) -> DataFrame:
    """A customer belongs to the month's group of an order while it lasts, by its price."""
    o = _orders(spark, d).where("start < end")
    role = F.element_at(F.array(*[F.lit(r) for r in membership.ROLES]), (F.col("order") % len(membership.ROLES)).cast("int") + 1)
    return o.select(F.col("customer").alias("member_id"), F.date_format("start", "yyyy-MM").alias("group_id"), role.alias("role"), F.col("price").alias("weight"), F.col("start").alias("valid_from"), F.col("end").alias("valid_to"))


_AT = "1995-06-17 00:00:00"


def membership_active(spark: SparkSession, d: str) -> DataFrame:
    return membership.group_multiplicity(membership.active_at(_memberships(spark, d), _ntz(_AT)))


def membership_weight_by_role(spark: SparkSession, d: str) -> DataFrame:
    w = membership.weight_by_role(membership.active_at(_memberships(spark, d), _ntz(_AT)))
    return w.select("member_id", "role", _r(F.col("weight"), "weight", 2))


def membership_active_for(spark: SparkSession, d: str) -> DataFrame:
    """How many memberships are active when the member's own orders start."""
    m = _memberships(spark, d)
    moments = m.select("member_id", F.col("valid_from").alias("at")).distinct()
    return membership.active_for(m, moments).groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))


def _moments(spark: SparkSession, d: str) -> DataFrame:
    """A member's moments: three weeks after each of their orders begins."""
    return _memberships(spark, d).select("member_id", (F.col("valid_from") + F.expr("INTERVAL 21 DAYS")).alias("at")).distinct()


def membership_multiplicity_each(spark: SparkSession, d: str) -> DataFrame:
    m = membership.multiplicity_at(_memberships(spark, d), _moments(spark, d))
    return m.select("member_id", F.col("at").cast("date").alias("at"), "multiplicity")


def membership_weight_each(spark: SparkSession, d: str) -> DataFrame:
    w = membership.weight_by_role_at(_memberships(spark, d), _moments(spark, d))
    return w.select("member_id", "role", F.col("at").cast("date").alias("at"), _r(F.col("weight"), "weight", 2))


def membership_errors(spark: SparkSession, d: str) -> DataFrame:
    m = membership.network_error(_memberships(spark, d).withColumn("seq", F.struct("valid_from", "valid_to", "weight")), "seq").withColumnRenamed("error_code", "network")
    return m.groupBy(F.coalesce(membership.assignment_error(), F.col("network"), F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def kish_ess(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("weight"))
    return membership.kish(o, "customer").select("customer", _r(F.col("ess"), "ess"), _r(F.col("design_effect"), "design_effect"))


def group_normalized_kish(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("group"), F.col("o_totalprice").alias("weight"))
    return membership.group_normalized_kish(o).select(_r(F.col("ess"), "ess", 3))


def split_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("group"), F.col("n_chars").cast("double").alias("weight"))
    return splits.group_normalized(docs).select("doc_id", _r(F.col("normalized"), "normalized", 9))


def split_ess(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.col("n_chars").cast("double").alias("weight"))
    return docs.groupBy("source").agg(_r(splits.effective_sample_size(), "ess"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Documents of equal texts, each linked to the one before."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    before = F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))
    return docs.select(F.col("doc_id").alias("left"), before.alias("right")).where("right IS NOT NULL")


def leakage_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return splits.connected_groups(docs, _links(spark, d)).withColumnRenamed("group", "group_id")


def chain_groups(spark: SparkSession, d: str) -> DataFrame:
    """Long chains: an event links to the one 7 before it."""
    e = table(spark, d, "events").select(F.col("event_id").alias("document_id"))
    links = e.select(F.col("document_id").alias("left"), (F.col("document_id") - 7).alias("right"))
    g = splits.connected_groups(e, links)
    return g.groupBy(F.col("group").alias("group_id")).agg(F.count(F.lit(1)).alias("n"))


def group_leakage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    split = docs.select("document_id", (F.col("document_id") % 2).alias("partition"))
    return splits.group_leakage(splits.connected_groups(docs, _links(spark, d)), split).withColumnRenamed("group", "group_id")


def _recovered(spark: SparkSession, d: str) -> DataFrame:
    """A part's price and the mean price of its sold lines."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("truth"))
    line = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("recovered"), F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("lower"), F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("upper"))
    return p.join(line, "k")


def recovery_metrics(spark: SparkSession, d: str) -> DataFrame:
    pairs = metrics.paired(*(_recovered(spark, d).select("k", c) for c in ("truth", "recovered"))).withColumn("g", F.col("k") % 10)
    out = metrics.rmse(pairs, "g").select("g", _r(F.col("rmse"), "rmse"))
    for f, name in ((metrics.rmse_standard_error, "rmse_standard_error"), (metrics.mean_bias, "mean_bias"), (metrics.bias_standard_error, "bias_standard_error")):
        out = out.join(f(pairs, "g").select("g", _r(F.col(name), name)), "g")
    return out.join(metrics.match_count(pairs, 300.0, "g").select("g", F.col("match_count").cast("long").alias("match_count")), "g")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.interval_coverage(_recovered(spark, d).withColumn("g", F.col("k") % 10), "g")
    return metrics.wilson_interval(c, 1.96).select("g", _r(F.col("coverage"), "coverage"), _r(F.col("lower"), "lower"), _r(F.col("upper"), "upper"))


def edge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Edges from customers to orders, recovered from returned lines; of every third order with another customer."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") + 10_000_000).alias("b"), F.col("o_orderkey").alias("k"))
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    r = o.join(back, "k").select(F.col("b").alias("a"), F.when(F.col("k") % 3 == 0, F.col("a") + 1).otherwise(F.col("a")).alias("b"))
    return metrics.edge_scores(o, r).select(_r(F.col("precision"), "precision"), _r(F.col("recall"), "recall"))


def temporal_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("i"), F.unix_micros(F.col("ts").cast("timestamp")).alias("truth"), F.col("value").alias("recovered"))
    return metrics.temporal_order_accuracy(e, "user_id").where("error_code IS NULL").select("user_id", _r(F.col("accuracy"), "accuracy"))


def monte_carlo(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.summarize_replications(table(spark, d, "events").select("user_id", "value"), 0.07, 0.93, "user_id")
    return m.select("user_id", F.col("n").alias("n"), *[_r(F.col(c), c, 9) for c in ("mean", "sd", "se", "low", "high")])


def acceptance(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.summarize_replications(table(spark, d, "events").select("user_id", "value"), 0.1, 0.9, "user_id")
    ok = metrics.accept_within(F.col("mean"), F.lit(50.0), F.col("se"), F.lit(1.0))
    return m.select("user_id", ok.alias("accepted"))


def active_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents but toxic ones (their deletion is complete) and those of low quality (tombstones)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_record_id"), F.lit(None).cast("timestamp").alias("system_to"))
    labels = table(spark, d, "labels")
    stones = labels.where("quality = 0").select(F.col("doc_id").alias("document_record_id"))
    gone = labels.where("toxic = 1").select(F.col("doc_id").alias("document_record_id"), F.lit("completed").alias("status"), F.lit("revocation").alias("kind"))
    return governance.active_documents(docs, stones, gone).select(F.col("document_record_id").alias("doc_id"))


def blocked_deletions(spark: SparkSession, d: str) -> DataFrame:
    """Sources are tenants: two have a hold of their own, and toxic documents have one each."""
    docs = table(spark, d, "documents").select(F.col("source").alias("tenant_record_id"), F.col("doc_id").alias("document_record_id"))
    toxic = docs.join(table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_record_id")), "document_record_id")
    none = F.lit(None).cast("timestamp").alias("system_to")
    holds = toxic.select("tenant_record_id", "document_record_id", F.lit("document").alias("scope"), F.lit("active").alias("status"), none).union(
        spark.createDataFrame([("src1",), ("src2",)], "t string").select("t", F.lit(None).cast("long"), F.lit("tenant"), F.lit("active"), none)
    )
    return governance.blocked_deletions(docs, holds).select(F.col("document_record_id").alias("doc_id"), F.col("tenant_record_id").alias("source"))


def tenant_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("tenant_record_id"))
    return governance.of_tenant(docs, "src3").select("doc_id").unionAll(governance.of_tenant(docs, None).select("doc_id"))


def policy_succession(spark: SparkSession, d: str) -> DataFrame:
    """A user's events of a type are policies that succeed each other."""
    e = table(spark, d, "events").select(F.col("user_id").alias("tenant_record_id"), F.col("event_type").alias("record_class"), F.lit("p").alias("purpose"), F.col("ts").alias("system_from"), "event_id")
    return governance.policy_succession(e).groupBy("record_class").agg(F.count_if(F.col("system_to").isNull()).alias("open"), F.count("error_code").alias("conflicts"), F.count(F.lit(1)).alias("n"))


def restore_probe(spark: SparkSession, d: str) -> DataFrame:
    """Probes over order intervals (some are reversed or points) and the documents' digests."""
    line = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderdate").alias("system_from"), F.col("l_shipdate").alias("system_to"))
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("content_digest"))
    bad = governance.bad_windows(line).agg(F.count(F.lit(1)).alias("bad_windows"))
    return bad.withColumn("bad_digests", governance.bad_digests(docs).agg(F.count(F.lit(1)).alias("n")).scalar())


def past_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Events later than the last purchase of their user."""
    e = table(spark, d, "events").select(F.col("user_id").alias("tenant_record_id"), "event_id", "event_type", F.col("ts").alias("available_time"))
    m = e.where("event_type = 'purchase'").select("tenant_record_id", F.col("available_time").alias("knowledge_cutoff"))
    return governance.past_cutoff(e, m).select("event_id")


def evidence_digest(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    e = evidence.document_error(t, evidence.digest(t), F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", evidence.digest(t).alias("digest"), F.octet_length(t).cast("long").alias("bytes"), F.char_length(t).cast("long").alias("chars"), e.alias("error"))


def span_check(spark: SparkSession, d: str) -> DataFrame:
    """Each whole document as a span of bytes and characters; the same bytes with a character less; and the span's text."""
    docs = table(spark, d, "documents").withColumns({"b": F.octet_length("text"), "c": F.char_length("text")})
    t, zero = F.col("text"), F.lit(0)
    good = evidence.span_error(t, zero, F.col("b"), zero, F.col("c"))
    bad = evidence.span_error(t, zero, F.col("b"), zero, F.col("c") - 1)
    return docs.select("doc_id", good.alias("good"), bad.alias("bad"), F.sha2(evidence.span_text(t, zero, F.col("b")), 256).alias("span_sha256"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """A user's events follow each other; some edges point back."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("before"), F.lag("event_id", 3).over(w).alias("third"))
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in relations.KINDS]), (x % 16).cast("int") + 1)
    edge = lambda seq, source, target, k: F.struct(seq.alias("seq"), F.col(source).alias("s"), F.col(target).alias("t"), kind(k).alias("kind"))
    forward = F.when(F.col("before").isNotNull(), edge(F.col("event_id") * 2, "before", "event_id", F.col("event_id") % 8))
    back = F.when(F.expr("third IS NOT NULL AND event_id % 11 = 0"), edge(F.col("event_id") * 2 + 1, "event_id", "third", F.col("event_id")))
    both = e.select(F.explode(F.array(forward, back)).alias("e")).where("e IS NOT NULL").select("e.*")  # a user's edges lie together
    return both.select("seq", F.col("seq").cast("string").alias("edge_id"), "kind", F.col("s").cast("string").alias("source"), F.col("t").cast("string").alias("target"))


def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return relations.counts(_edges(spark, d))


def ordered_dag(spark: SparkSession, d: str) -> DataFrame:
    return relations.insert_edges(_edges(spark, d)).select("seq", "kind", F.coalesce("error_code", F.lit("ok")).alias("outcome"))


def promote_events(spark: SparkSession, d: str) -> DataFrame:
    """A user's day is an instance of its events."""
    m = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string")).alias("instance_id"), F.col("event_id").alias("mention_id"), F.col("ts").alias("at"), (F.col("value") / 1000).alias("confidence"))
    p = events.promote(m)
    return p.select("instance_id", F.size("supporting_mentions").cast("long").alias("n"), _r(F.col("confidence"), "confidence", 9), F.coalesce("error_code", F.lit("ok")).alias("outcome"))


def mention_errors(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select(F.when(F.col("event_id") % 9 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("surface_form"), (F.col("value") / 100).alias("confidence"))
    return m.groupBy(F.coalesce(events.mention_error(), F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """Assertions of a network for each customer: the relation of each of its orders to the next."""
    w = Window.partitionBy("customer").orderBy("order")
    o = _orders(spark, d).where("customer IS NOT NULL AND start < end")
    o = o.select("customer", F.row_number().over(w).alias("n"), "start", "end", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("start", "end")]).where("next_start IS NOT NULL")
    mask = allen.singleton(allen.classify(F.col("start"), F.col("end"), F.col("next_start"), F.col("next_end")))
    return o.select(F.col("customer").alias("network"), F.col("n").alias("step"), (F.col("n") - 1).alias("i"), F.col("n").alias("j"), mask.alias("mask"))


def reasoner_closure(spark: SparkSession, d: str) -> DataFrame:
    """The chain of each customer's orders, closed with counters and supports; networks over the reasoner's limits say BudgetExceeded."""
    return reasoner.close_networks(_chains(spark, d))


def graphml(spark: SparkSession, d: str) -> DataFrame:
    return contracts.graphml_lines(_edges(spark, d), "events", 10_000_000)


def export_decisions(spark: SparkSession, d: str) -> DataFrame:
    purpose = F.element_at(F.array(*[F.lit(p) for p in contracts.PURPOSES]), (F.col("doc_id") % 4).cast("int") + 1)
    docs = table(spark, d, "documents").select(purpose.alias("purpose"), (F.col("doc_id") % 3 == 0).alias("with_text"))
    return docs.groupBy("purpose", "with_text", contracts.export_decision(F.col("purpose"), F.col("with_text")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def routing(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests: the user's number gives the task, the value the scores and the budget."""
    task = F.element_at(F.array(*[F.lit(t) for t in contracts.TASKS]), (F.col("user_id") % 6).cast("int") + 1)
    frac = lambda k: (F.col("event_id") * k % 101) / F.lit(100.0)
    e = table(spark, d, "events").select("event_id", task.alias("task"), frac(7).alias("risk"), frac(13).alias("ambiguity"), frac(29).alias("evidence"), (F.col("event_id") * 37 % 30_000).alias("budget"), (F.col("event_id") % 2 == 0).alias("gate_passed"))
    r = contracts.route(e.withColumn("access_list", F.array(F.lit("a"))))
    return r.groupBy("task", F.coalesce("mode", F.lit("none")).alias("mode"), F.coalesce("error_code", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("token_budget").alias("tokens"), F.sum(F.size("roles")).alias("roles"))


def budget_comparison(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("a"), (F.col("o_custkey") % 1000).alias("b"))
    return o.groupBy(contracts.budgets_comparable(F.col("a"), F.col("b")).alias("comparable")).agg(F.count(F.lit(1)).alias("n"))


def audit_digests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", contracts.audit_digest(F.lit("audit.v1"), F.col("event_type"), F.col("user_id").cast("string")).alias("digest"))


def field_guards(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.guards import is_label

    docs = table(spark, d, "documents").select(F.col("text").alias("label"))
    return docs.groupBy(F.coalesce(code(~is_label(F.col("label")), "InvalidLabel"), F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Query] = {
    "bitemporal_as_known_at": as_known_at,
    "bitemporal_as_valid_at": as_valid_at,
    "bitemporal_as_known_at_each": as_known_at_each,
    "bitemporal_as_valid_at_each": as_valid_at_each,
    "bitemporal_eligible_at_cutoff": eligible,
    "bitemporal_replay": version_replay,
    "cutoff_snapshot": cutoff_snapshot,
    "rolling_origin": rolling_origin,
    "allen_pairs": allen_pairs,
    "allen_sets": allen_sets,
    "forward_order_violations": forward_order,
    "interval_contains": interval_contains,
    "interval_errors": interval_errors,
    "rfc3339_parse": rfc3339,
    "wire_round_trip": wire_round_trip,
    "membership_active": membership_active,
    "membership_weight_by_role": membership_weight_by_role,
    "membership_active_for": membership_active_for,
    "membership_multiplicity_each": membership_multiplicity_each,
    "membership_weight_each": membership_weight_each,
    "membership_errors": membership_errors,
    "kish_ess": kish_ess,
    "group_normalized_kish": group_normalized_kish,
    "split_group_normalized": split_weights,
    "split_effective_sample_size": split_ess,
    "leakage_groups": leakage_groups,
    "chain_groups": chain_groups,
    "group_leakage": group_leakage,
    "recovery_metrics": recovery_metrics,
    "interval_coverage": coverage,
    "edge_precision_recall": edge_scores,
    "temporal_order_accuracy": temporal_order,
    "monte_carlo_summary": monte_carlo,
    "monte_carlo_acceptance": acceptance,
    "active_documents": active_documents,
    "blocked_deletions": blocked_deletions,
    "tenant_rows": tenant_rows,
    "policy_succession": policy_succession,
    "restore_probe": restore_probe,
    "past_cutoff": past_cutoff,
    "evidence_digest": evidence_digest,
    "span_check": span_check,
    "relation_counts": relation_counts,
    "ordered_dag": ordered_dag,
    "promote_events": promote_events,
    "mention_errors": mention_errors,
    "reasoner_closure": reasoner_closure,
    "graphml_export": graphml,
    "export_decisions": export_decisions,
    "orchestration_routing": routing,
    "budget_comparison": budget_comparison,
    "audit_digests": audit_digests,
    "field_guards": field_guards,
}

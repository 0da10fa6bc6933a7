import datetime as dt
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.operators import bitemporal, contracts, events, evidence, governance, membership, metrics, relations, sequence, simulation, splits
from tempora.operators.components import connected_components

T = lambda m, d=1, y=2026: dt.datetime(y, m, d)
VERSION = "document_record_id string, content_digest string, available_time timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, system_from timestamp_ntz, system_to timestamp_ntz, revision_number bigint"


def codes(df, *by):
    return {tuple(r[b] for b in by) if len(by) > 1 else r[by[0]]: r.error_code for r in df.collect()}


def version(id, revision, start, end=None, digest="a" * 64):
    return (id, digest, T(1), T(1), None, start, end, revision)


def test_versions(spark):
    one = spark.createDataFrame([version("a", 1, T(1))], VERSION)
    two = bitemporal.revise(one, spark.createDataFrame([version("a", 2, T(2)), version("z", 1, T(2))], VERSION))
    assert {(r.revision_number, r.system_to) for r in two.collect()} == {(1, T(2)), (2, None)}
    known = lambda at: [r.revision_number for r in bitemporal.as_known_at(two, F.lit(at).cast("timestamp_ntz")).collect()]
    assert known(T(3)) == [2] and known(T(1, 15)) == [1] and known(T(2)) == [2] and known(T(12, 1, 2025)) == []
    assert [r.revision_number for r in bitemporal.eligible_at_cutoff(two, F.lit(T(12)).cast("timestamp_ntz")).collect()] == [2]
    assert bitemporal.as_valid_at(two, F.lit(T(1, 1, 2020)).cast("timestamp_ntz"), F.lit(T(3)).cast("timestamp_ntz")).count() == 0
    assert [r.error_code for r in bitemporal.revise_error(one, spark.createDataFrame([version("z", 1, T(2))], VERSION)).collect()] == ["HistoricalVersionNotFound"]


def test_inserts_are_guarded(spark):
    old = spark.createDataFrame([version("a", 1, T(1))], VERSION)
    new = spark.createDataFrame([version("a", 1, T(2)), version("b", 1, T(2), digest="short"), version("c", 1, T(2), digest="A" * 64)], VERSION)
    assert codes(bitemporal.insert_error(old, new), "document_record_id") == {"a": "DuplicateDocumentRecord", "b": "InvalidContentDigest", "c": None}
    assert bitemporal.insert(old, new).count() == 2
    audit = spark.createDataFrame([("x",)], "audit_event_id string")
    assert codes(bitemporal.append_audit(audit, spark.createDataFrame([("x",), ("y",)], "audit_event_id string")), "audit_event_id") == {"x": "ImmutableAuditViolation", "y": None}
    a = spark.createDataFrame([("i", "d1"), ("j", None)], "source_artifact_id string, digest string")
    b = spark.createDataFrame([("i", "d1"), ("j", "d2"), ("k", "d3")], "source_artifact_id string, digest string")
    assert codes(bitemporal.artifact_error(b, a), "source_artifact_id") == {"i": None, "j": "ArtifactConflict", "k": None}


def test_splits(spark):
    at = F.lit(dt.datetime(2025, 12, 31)).cast("timestamp_ntz")
    docs = spark.createDataFrame([("late", T(6)), ("ok", T(1, 1, 2025)), ("two", T(1, 1, 2025)), ("two", T(1, 1, 2025)), ("none", None)], "document_id string, available_time timestamp_ntz")
    assert codes(splits.snapshot(docs, at), "document_id") == {"late": "UnavailableAtCutoff", "ok": None, "two": "DuplicateDocument", "none": "UnavailableAtCutoff"}
    ids = spark.createDataFrame([(x,) for x in "abcdexy"], "document_id string")
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "a"), ("e", "a"), ("x", "x"), ("y", "outside")], "left string, right string")
    groups = splits.connected_groups(ids, links)
    assert {r.document_id: r.group for r in groups.collect()} == {**{x: "a" for x in "abcde"}, "x": "x", "y": "y"}
    leak = lambda rows: [r.group for r in splits.group_leakage(groups, spark.createDataFrame(rows, "document_id string, partition string")).collect()]
    assert leak([("a", "train"), ("b", "train"), ("c", None)]) == [] and leak([("a", "train"), ("b", "test")]) == ["a"]
    cuts = spark.createDataFrame([(T(1),), (T(2),), (T(3),)], "cutoff timestamp_ntz")
    assert splits.rolling_origin(cuts).count() == 2 and splits.cutoffs_error(cuts).first().error_code is None
    assert splits.cutoffs_error(cuts.limit(1)).first().error_code == splits.cutoffs_error(cuts.union(cuts)).first().error_code == "InvalidRollingOrigin"
    w = spark.createDataFrame([("g", 2.0), ("g", 2.0), ("z", 0.0), ("h", 1.0), ("h", -1.0)], "group string, weight double")
    assert sorted(r.normalized for r in splits.group_normalized(w).collect()) == [0.5, 0.5, 1.0]
    assert w.where("group = 'z'").agg(splits.effective_sample_size().alias("e")).first().e == 0.0


def test_long_chains_are_one_component(spark):
    n = 97
    got = connected_components(spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)] + [(1000, 1000), (None, 3)], "left int, right int"))
    assert {r.component for r in got.where("node < 1000").collect()} == {0} and got.count() == n + 1
    assert connected_components(spark.createDataFrame([], "left int, right int")).count() == 0


def test_membership(spark):
    rows = [("m", "g1", "author", 1.0, T(1), T(12)), ("m", "g2", "project", 0.6, T(1), T(12)), ("m", "g3", "customer", 0.4, T(1), T(6, 15)), ("n", "g1", "partner", 1.0, T(1, 1, 2025), T(6, 30, 2025))]
    m = spark.createDataFrame(rows, "member_id string, group_id string, role string, weight double, valid_from timestamp_ntz, valid_to timestamp_ntz")
    at = lambda x: membership.active_at(m, F.lit(x).cast("timestamp_ntz"))
    assert {r.member_id: r.multiplicity for r in membership.group_multiplicity(at(T(6, 15))).collect()} == {"m": 3}
    assert at(T(6, 16)).count() == 2 and membership.weight_by_role(at(T(6, 15))).count() == 3
    moments = spark.createDataFrame([("n", T(1, 15, 2025)), ("n", T(1))], "member_id string, at timestamp_ntz")
    assert membership.active_for(m, moments).count() == 1
    bad = spark.createDataFrame([("x", -0.1, T(1), T(2)), ("author", float("nan"), T(1), T(2)), ("author", 1.0, T(2), T(2)), ("author", 0.0, T(1), T(2))], "role string, weight double, valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert [r.e for r in bad.select(membership.assignment_error().alias("e")).collect()] == ["UnknownMembershipRole", "InvalidMembershipWeight", "InvalidMembershipValidity", None]
    assert set(codes(membership.network_error(m.union(m.limit(1))), "group_id", "role").values()) == {None, "DuplicateMembership"}


@pytest.mark.parametrize("weights, ess, error", [([1, 1, 1, 1], 4, None), ([1, 0, 0, 0], 1, None), ([], None, "InvalidMembershipWeight"), ([math.nan], None, "InvalidMembershipWeight"), ([-0.1, 1], None, "InvalidMembershipWeight"), ([0, 0], None, "InvalidMembershipWeight")])
def test_kish(spark, weights, ess, error):
    r = membership.kish(spark.createDataFrame([(float(w),) for w in weights], "weight double")).first()
    assert (r.ess, r.error_code) == (ess, error)


def test_group_normalized_kish(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0)], "group string, weight double")
    assert membership.group_normalized_kish(df).first().ess == pytest.approx(4 / 1.5)
    assert membership.group_normalized_kish(df.union(spark.createDataFrame([("z", 0.0)], df.schema))).first().error_code == "InvalidMembershipWeight"


def pairs(spark, t, r):
    return metrics.paired(spark.createDataFrame(list(enumerate(map(float, t))), "k int, truth double"), spark.createDataFrame(list(enumerate(map(float, r))), "k int, recovered double"))


def test_metrics(spark):
    assert metrics.rmse(pairs(spark, [0, 0, 0], [3, 4, 0])).first().rmse == pytest.approx(math.sqrt(25 / 3))
    p = pairs(spark, [1, 2, 3], [2, 3, 4])
    assert metrics.mean_bias(p).first().mean_bias == 1 and metrics.bias_standard_error(p).first().bias_standard_error == 0
    assert metrics.rmse_standard_error(pairs(spark, [1, 2], [1, 2])).first().rmse_standard_error == 0
    assert metrics.match_count(pairs(spark, [1, 2, 3], [1, 2.1, 2.5]), 0.11).first().match_count == 2
    for bad in (pairs(spark, [1, 2], [1]), pairs(spark, [], []), pairs(spark, [0], [1.8e308])):
        assert metrics.rmse(bad).first().error_code == "InvalidInput"
    assert metrics.bias_standard_error(pairs(spark, [1], [1])).first().error_code == "InvalidInput"
    c = spark.createDataFrame([(0.0, -0.5, 0.5), (1.0, 0.5, 1.5), (2.0, 1.5, 2.5), (3.0, 4.0, 5.0)], "truth double, lower double, upper double")
    w = metrics.wilson_interval(metrics.interval_coverage(c), 1.96).first()
    assert w.coverage == 0.75 and 0 <= w.lower < 0.75 < w.upper <= 1
    assert metrics.interval_coverage(c.selectExpr("truth", "upper as lower", "lower as upper")).first().error_code == "InvalidInput"


def test_order_edges_replications(spark):
    rows = lambda r: spark.createDataFrame([("u", i, float(t), float(x)) for i, (t, x) in enumerate(zip([1, 2, 3], r, strict=True))], "u string, i int, truth double, recovered double")
    assert metrics.temporal_order_accuracy(rows([0.5, 0.6, 0.4]), "u").first().accuracy == pytest.approx(1 / 3)
    e = lambda x: spark.createDataFrame(x, "a int, b int")
    s = metrics.edge_scores(e([(1, 2), (2, 3)]), e([(1, 2), (3, 4), (2, 1)])).first()
    assert (s.precision, s.recall) == (0.5, 0.5)
    s = metrics.edge_scores(e([(1, 2)]), e([])).first()
    assert s.precision is None and s.precision_error == "InvalidInput" and s.recall == 0
    m = metrics.summarize_replications(spark.createDataFrame([(float(x),) for x in (4, 2, 1, 3)], "value double"), 0.25, 0.75).first()
    assert (m.mean, m.low, m.high) == (2.5, 1, 3)
    one = metrics.summarize_replications(spark.createDataFrame([(7.0,)], "value double"), 0, 1).first()
    assert (one.sd, one.se, one.low, one.high) == (0, 0, 7, 7)
    a = spark.createDataFrame([(1.0, 1.0, 0.1, 1.0), (1.0, 2.0, 0.1, 1.0), (0.0, -0.0, 0.0, 1.0), (1.0, 1.0, 0.0, 0.0), (1.0, math.nan, 1.0, 1.0)], "e double, t double, s double, k double")
    assert [r.x for r in a.select(metrics.accept_within(*[F.col(c) for c in "etsk"]).alias("x")).collect()] == [True, False, False, True, None]
    r = metrics.report(spark.createDataFrame([(1.0, 2.0, 0.5), (math.inf, 0.0, 0.0)], "rmse double, mean_bias double, coverage double")).collect()
    assert r[0].summary == "rmse=1.000000 bias=2.000000 coverage=0.500000" and r[1].error_code == "InvalidInput"


#: Our own: the digest of the default configuration with seed 2026.
GOLDEN_DIGEST = "ae2bb6a2486e3158e01f81715eca50aea56e8492a3372269a70fac14c47a1884"
EDGE = "seq int, edge_id string, kind string, source string, target string"


def test_dag_refuses_the_closing_edge(spark):
    rows = [(1, "1", "causes", "a", "b"), (2, "2", "causes", "a", "c"), (3, "3", "causes", "b", "d"), (4, "4", "causes", "c", "d"), (5, "5", "leads_to", "s", "a"), (6, "6", "causes", "d", "a"), (7, "7", "summarizes", "d", "a"), (8, "7", "causes", "x", "y"), (9, "9", "causes", "q", "q")]
    got = codes(relations.insert_edges(spark.createDataFrame(rows, EDGE)), "seq")
    assert got == {**{i: None for i in range(1, 8)}, 6: "TransitionCycle", 8: "DuplicateRelationEdge", 9: "TransitionCycle"}
    flipped = codes(relations.insert_edges(spark.createDataFrame([(9 - s, *r) for s, *r in rows[:6]], EDGE)), "seq")
    assert flipped[3] is None and "TransitionCycle" in flipped.values()


def brute_insert(rows):
    """Edges one after the other: ids that are stored, then cycles of stored transitions."""
    stored, after, out = set(), {}, {}
    for seq, id_, kind, a, b in sorted(rows):
        def reaches(x, y):
            return x == y or any(reaches(z, y) for z in after.get(x, ()))

        step = kind in relations.TRANSITIONS
        out[seq] = "DuplicateRelationEdge" if id_ in stored else "TransitionCycle" if step and reaches(b, a) else None
        if out[seq] is None:
            stored.add(id_)
            if step:
                after.setdefault(a, []).append(b)
    return out


def test_a_refused_edge_leaves_its_id_free(spark):
    rows = [(1, "w", "causes", "a", "b"), (2, "X", "causes", "b", "a"), (3, "X", "causes", "p", "q"), (4, "X", "causes", "q", "r")]
    assert codes(relations.insert_edges(spark.createDataFrame(rows, EDGE)), "seq") == {1: None, 2: "TransitionCycle", 3: None, 4: "DuplicateRelationEdge"}
    rng = random.Random(11)
    for size in (30, 60):
        rows = [(k, f"e{rng.randrange(size // 2)}", rng.choice(["causes", "enables", "summarizes"]), f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for k in range(size)]
        assert codes(relations.insert_edges(spark.createDataFrame(rows, EDGE)), "seq") == brute_insert(rows)


def test_chains_are_folded_in_few_jobs(spark):
    """Chains of 60 nodes with edges back, lying together or dealt out; where a chain lies together, there are no rounds of jobs to label it."""
    rng, rows = random.Random(31), []
    for c in range(8):
        for k in range(60):
            rows.append((f"{c}.{k}", f"{c}.{k + 1}"))
            if rng.random() < 0.2:
                rows.append((f"{c}.{k + 1}", f"{c}.{max(0, k - rng.randrange(5))}"))
    seqs = list(range(len(rows)))
    together = [(s, f"e{s}", "causes", a, b) for s, (a, b) in zip(seqs, rows, strict=True)]
    rng.shuffle(seqs)
    apart = [(s, f"e{s}", "causes", a, b) for s, (a, b) in zip(seqs, rows, strict=True)]
    jobs = []
    for own, df in ((together, spark.createDataFrame(together, EDGE).coalesce(1)), (apart, spark.createDataFrame(apart, EDGE).repartition(7))):
        spark.sparkContext.setJobGroup(f"chains {len(jobs)}", "")
        try:
            got = codes(relations.insert_edges(df), "seq")
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chains {len(jobs)}")))
        assert got == brute_insert(own) and "TransitionCycle" in got.values()
    assert jobs[0] < 20, jobs


def test_a_large_component_loses_sources_and_sinks_first(spark):
    """Random edges, ids that repeat within and beyond a component, kinds of provenance: with and without taking off the ends."""
    rng = random.Random(12)
    for size, nodes in ((40, 9), (80, 40)):
        rows = [(k, f"e{rng.randrange(size)}", rng.choice(["causes", "enables", "causes", "summarizes"]), f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for k in range(size)]
        df, want = spark.createDataFrame(rows, EDGE), brute_insert(rows)
        assert codes(relations.insert_edges(df, 3), "seq") == want == codes(relations.insert_edges(df), "seq")
    nulls = [(1, "a", "causes", None, "x"), (2, "b", "causes", "x", None), (3, "a", "causes", "x", "x"), (4, "c", None, "x", "x"), (None, "d", "causes", "y", "y")]
    assert codes(relations.insert_edges(spark.createDataFrame(nulls, EDGE)), "seq") == {1: None, 2: None, 3: "DuplicateRelationEdge", 4: None, None: None}


def test_a_component_is_folded_whole(monkeypatch):
    """Batches and chunks of a few rows; most edges go forward, so few are looked at one by one."""
    rng, names = random.Random(9), ["component", "seq", "edge_id", "kind", "source", "target", "again", "a", "b"]
    for trial in range(60):
        monkeypatch.setattr(relations, "ROWS", rng.choice([1, 4, 30, 1000]))
        rows, want, seq = [], {}, 0
        for c in range(rng.randint(1, 5)):
            n, own = rng.randint(1, 12), []
            for _ in range(rng.randint(1, 25)):
                seq, ends = seq + 1, [rng.randrange(n), rng.randrange(n)]
                a, b = sorted(ends) if trial % 2 and rng.random() < 0.8 else ends
                own.append((seq, f"{c}-{rng.randrange(30)}", "causes", f"{c}.{a}", f"{c}.{b}"))
            want |= brute_insert(own)
            ids = [r[1] for r in own]
            rows += [(c, *r, ids.count(r[1]) > 1, *(1000 - 50 * c - int(x.split(".")[1]) for x in r[3:])) for r in own]
        step = rng.choice([1, 3, 50])
        batches = [pa.record_batch([pa.array(x) for x in zip(*rows[k : k + step], strict=True)], names=names) for k in range(0, len(rows), step)]
        got = {s: e for out in relations._folded(batches) for s, e in zip(out["seq"].to_pylist(), out["error_code"].to_pylist(), strict=True)}
        assert got == want


def test_a_batch_of_revisions_is_chained(spark):
    one = spark.createDataFrame([version("a", 1, T(1)), version("b", 1, T(1)), version("c", 1, T(1), T(2))], VERSION)
    batch = spark.createDataFrame([version("a", 3, T(5)), version("a", 2, T(3)), version("b", 2, T(4)), version("c", 2, T(6)), version("z", 1, T(2))], VERSION)
    got = sorted((r.document_record_id, r.revision_number, r.system_from, r.system_to) for r in bitemporal.revise(one, batch).collect())
    assert got == [("a", 1, T(1), T(3)), ("a", 2, T(3), T(5)), ("a", 3, T(5), None), ("b", 1, T(1), T(4)), ("b", 2, T(4), None), ("c", 1, T(1), T(2))]


def test_revisions_come_one_after_the_other(spark):
    """Random batches against a loop that holds one open row at a time."""
    rng = random.Random(5)
    for trial in range(3):
        old = [version(i, 0, T(1), T(2) if i == "d" else None) for i in "abcd"]
        new = []
        for k in range(60):
            at = dt.datetime(2026, 2, 1) + dt.timedelta(hours=rng.randrange(500))
            new.append((k, *version(rng.choice("aaabcde"), k + 1, at, at if rng.random() < 0.08 else None, "short" if rng.random() < 0.1 else "b" * 64)))
        rows, refused = [list(r) for r in old], {}
        for k, *r in new:
            there = [x for x in rows if x[0] == r[0] and x[6] is None]
            if r[1] == "short" or not there:
                refused[k] = "InvalidContentDigest" if r[1] == "short" else "HistoricalVersionNotFound"
                continue
            for x in there:
                x[6] = r[5]
            rows.append(r)
        one, batch = spark.createDataFrame(old, VERSION), spark.createDataFrame(new, f"seq int, {VERSION}").repartition(5)
        got = bitemporal.revise(one, batch, seq="seq").collect()
        assert sorted((r[0], r[7], r[5], str(r[6])) for r in got) == sorted((r[0], r[7], r[5], str(r[6])) for r in rows)
        assert codes(bitemporal.revise_error(one, batch, seq="seq"), "seq") == refused
    shut = spark.createDataFrame([(0, *version("a", 1, T(2), T(3))), (1, *version("a", 2, T(4)))], f"seq int, {VERSION}")
    one = spark.createDataFrame([version("a", 0, T(1))], VERSION)
    assert codes(bitemporal.revise_error(one, shut, seq="seq"), "seq") == {1: "HistoricalVersionNotFound"}
    assert bitemporal.revise(one, shut.limit(0), seq="seq").count() == 1


def test_neighbours_are_those_of_a_window(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(9000)]), rng.randrange(99)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, id string, at int, v int").repartition(7)
    got = {r.k: (r.following, r.place) for r in sequence.neighbours(df, ["id"], ["at", "k"], "v", "following", "place").collect()}
    want = {}
    for id_ in ("hot", "a", "b", None):
        own = sorted((r for r in rows if r[1] == id_), key=lambda r: (-1 if r[2] is None else r[2], r[0]))
        want |= {r[0]: (own[i + 1][3] if i + 1 < len(own) else None, i + 1) for i, r in enumerate(own)}
    assert got == want
    assert sequence.neighbours(df.limit(0), ["id"], ["at"], "v", "following").collect() == []


def test_artifacts_of_a_batch(spark):
    kind = "seq int, source_artifact_id string, digest string"
    new = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "a", "x"), (3, "b", "x"), (4, "b", None), (5, "c", None), (6, "c", None), (7, None, "x")], kind)
    stored = spark.createDataFrame([("b", None)], "source_artifact_id string, digest string")
    got = {r.seq: (r.error_code, r.is_new) for r in bitemporal.artifact_error(new, stored, seq="seq").collect()}
    bad = "ArtifactConflict"
    assert got == {0: (None, True), 1: (bad, False), 2: (None, False), 3: (bad, False), 4: (None, False), 5: (None, True), 6: (None, False), 7: (None, True)}


def test_an_order_is_kept_while_edges_come():
    """10,000 edges over 800 nodes against a search from every edge's target."""
    rng, graph, after = random.Random(3), relations.Forward(), {}
    for _ in range(10_000):
        a, b = rng.randrange(800), rng.randrange(800)
        seen, todo = {b}, [b]
        while todo and a not in seen:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert graph.add(a, b) == (a not in seen)
        if a not in seen:
            after.setdefault(a, set()).add(b)
    assert all(graph.rank[a] < graph.rank[b] for a, own in after.items() for b in own)


def test_the_first_of_a_repeated_id_is_stored(spark):
    new = spark.createDataFrame([(i, *version("x", 1, T(2), digest=d)) for i, d in enumerate(("short", "a" * 64, "b" * 64))], f"seq int, {VERSION}")
    assert codes(bitemporal.insert_error(new.limit(0), new, seq="seq"), "seq") == {0: "InvalidContentDigest", 1: None, 2: "DuplicateDocumentRecord"}
    assert bitemporal.insert(new.drop("seq").limit(0), new.drop("seq")).count() == 1
    docs = spark.createDataFrame([(0, "d", T(6)), (1, "d", T(1, 1, 2025)), (2, "d", T(1, 1, 2025))], "seq int, document_id string, available_time timestamp_ntz")
    assert codes(splits.snapshot(docs, F.lit(T(12, 1, 2025)).cast("timestamp_ntz"), seq="seq"), "seq") == {0: "UnavailableAtCutoff", 1: None, 2: "DuplicateDocument"}
    m = spark.createDataFrame([(i, "m", "g", "author") for i in range(3)], "seq int, member_id string, group_id string, role string")
    assert codes(membership.network_error(m, "seq"), "seq") == {0: None, 1: "DuplicateMembership", 2: "DuplicateMembership"}
    i = spark.createDataFrame([(0, "i", ["lost"]), (1, "i", ["known"]), (2, "i", ["known"])], "seq int, instance_id string, supporting_mentions array<string>")
    mentions = spark.createDataFrame([("known",)], "mention_id string")
    assert codes(events.registry_error(i, mentions, seq="seq"), "seq") == {0: "UnknownEventInstance", 1: None, 2: "DuplicateEventInstance"}
    audit = spark.createDataFrame([(0, "e"), (1, "e")], "seq int, audit_event_id string")
    assert codes(bitemporal.append_audit(audit.limit(0), audit, seq="seq"), "seq") == {0: None, 1: "ImmutableAuditViolation"}


def test_a_hold_of_a_tenant_sees_its_deletions(spark):
    done = spark.createDataFrame([("t", "d", "completed", T(5)), ("t", "e", "requested", T(9)), ("u", "f", "completed", T(1))], "tenant_record_id string, document_record_id string, status string, system_time timestamp_ntz")
    rows = [("1", "t", None, "tenant", T(4), None), ("2", "t", None, "tenant", T(6), None), ("3", "t", "e", "document", T(4), None), ("4", "t", "d", "document", T(5), None), ("5", "u", None, "tenant", T(4), None), ("6", "v", None, "tenant", T(4), T(5))]
    holds = spark.createDataFrame(rows, "id string, tenant_record_id string, document_record_id string, scope string, system_time timestamp_ntz, system_to timestamp_ntz")
    assert codes(governance.hold_insert_error(holds, done), "id") == {"1": "AlreadyDeleted", "2": None, "3": None, "4": "AlreadyDeleted", "5": None, "6": "HoldNotOpen"}


def test_order_accuracy_counts_all_pairs(spark):
    rng = random.Random(8)
    rows = [(u, i, float(rng.randint(0, k)), float(rng.randint(0, k))) for u, k, n in (("a", 3, 25), ("b", 1000, 40), ("c", 0, 6), ("d", 5, 1), ("e", 9, 3)) for i in range(n)]
    rows[-1] = ("e", 2, math.nan, 1.0)
    got = {r.u: (r.accuracy, r.error_code) for r in metrics.temporal_order_accuracy(spark.createDataFrame(rows, "u string, i int, truth double, recovered double"), "u").collect()}
    sign = lambda x: (x > 0) - (x < 0)
    for u in "abc":
        own = [r for r in rows if r[0] == u]
        pairs = [(x, y) for k, x in enumerate(own) for y in own[k + 1 :]]
        assert got[u] == (pytest.approx(sum(sign(x[2] - y[2]) == sign(x[3] - y[3]) for x, y in pairs) / len(pairs)), None)
    assert got["d"] == got["e"] == (None, "InvalidInput")


def test_schema_contract(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    want = StructType([StructField("id", LongType(), False), StructField("name", StringType(), True), StructField("gone", StringType(), True)])
    df = spark.createDataFrame([(1, 2, "x")], "id bigint, name int, more string")
    assert bitemporal.schema_error(df, want) == [("gone", "MissingColumn"), ("id", "UnexpectedNull"), ("more", "UnknownColumn"), ("name", "TypeMismatch")]
    assert bitemporal.schema_error(spark.createDataFrame([], want), want) == []


def test_partial_assignment_does_not_leak(spark):
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h"), ("d", "h")], "document_id string, group string")
    part = spark.createDataFrame([("a", "train"), ("c", "train"), ("d", "test")], "document_id string, partition string")
    assert [r.group for r in splits.group_leakage(groups, part).collect()] == ["h"]


def test_edge_errors(spark):
    rows = [("causes", "a", "a", 1, 2, 3, 4), ("causes", "a", "b", 3, 4, 1, 2), ("causes", "a", "b", 2, 3, 1, 2), ("causes", "a", "b", 1, 3, 2, 4), ("causes", "a", "b", 1, 1, 2, 4), ("revises", "a", "a", 3, 4, 1, 2), ("nope", "a", "b", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "k string, s string, t string, sf int, st int, tf int, tt int")
    e = relations.edge_error(F.col("s"), F.col("t"), F.col("k"), *[F.col(c) for c in ("sf", "st", "tf", "tt")])
    assert [r.e for r in df.select(e.alias("e")).collect()] == ["TransitionSelfLoop", "ReverseTransition", "ReverseTransition", None, "UncertainRelation", None, "UnknownRelationKind"]


def test_events(spark):
    m = spark.createDataFrame([("m1", "i", T(1), 0.5), ("m2", "i", T(2), 0.7), ("m3", "j", T(1), 1.0), ("m4", None, T(1), 1.0)], "mention_id string, instance_id string, at timestamp_ntz, confidence double")
    p = events.promote(m)
    assert codes(p, "instance_id") == {"i": None, "j": "EmptyInterval"}
    assert codes(events.registry_error(p.drop("error_code"), m.where("mention_id <> 'm2'")), "instance_id") == {"i": "UnknownEventInstance", "j": None}
    roles = spark.createDataFrame([("i", 2, "place", "x"), ("i", 1, "agent", "y"), ("i", 3, "nope", "z")], "instance_id string, seq int, role string, argument string")
    assert {r.instance_id: [tuple(x) for x in r.roles] for r in events.assign_roles(p, roles).collect()} == {"i": [("agent", "y"), ("place", "x")], "j": []}
    with pytest.raises(TypeError):
        events.mention_as_instance()


def test_governance(spark):
    docs = spark.createDataFrame([(x, "t1" if x < "c" else "t2", None) for x in "abcd"], "document_record_id string, tenant_record_id string, system_to timestamp_ntz")
    stones, gone = docs.where("document_record_id = 'a'"), spark.createDataFrame([("b", "completed", "identity"), ("c", "completed", "expiry"), ("d", "open", "revocation")], "document_record_id string, status string, kind string")
    assert {r.document_record_id for r in governance.active_documents(docs, stones, gone).collect()} == {"c", "d"}
    holds = spark.createDataFrame([("t1", None, "tenant", "active", None), ("t2", "c", "document", "active", None), ("t2", "d", "document", "released", T(2))], "tenant_record_id string, document_record_id string, scope string, status string, system_to timestamp_ntz")
    assert {r.document_record_id for r in governance.blocked_deletions(docs, holds).collect()} == {"a", "b", "c"}
    h = holds.withColumn("system_from", F.lit(T(1)).cast("timestamp_ntz")).withColumn("status", F.lit("active"))
    assert [r.e for r in h.select(governance.hold_error().alias("e")).collect()] == [None, None, "StatusWindowMismatch"]
    assert governance.of_tenant(docs, None).count() == 0 and governance.of_tenant(docs, "t1").count() == 2
    assert not governance.snapshot_usable(docs.limit(0), docs).first().usable and governance.snapshot_usable(docs.limit(0)).first().usable
    p = spark.createDataFrame([("t", "c", "p", T(1)), ("t", "c", "p", T(2)), ("t", "d", "p", T(1)), ("t", "d", "p", T(1))], "tenant_record_id string, record_class string, purpose string, system_from timestamp_ntz")
    got = governance.policy_succession(p).collect()
    assert {(r.record_class, r.error_code) for r in got} == {("c", None), ("d", "PolicyConflict")} and [r.system_to for r in got if r.record_class == "c" and r.system_from == T(1)] == [T(2)]


def test_spans(spark):
    text = "Aé🧠Z"
    cases = {(1, 7, 1, 3): None, (1, 1, 1, 2): "EmptySourceSpan", (7, 1, 1, 3): "InvalidSourceSpanOrder", (1, 9, 1, 4): "ByteRangeOutOfBounds", (1, 7, 1, 5): "ByteRangeOutOfBounds", (2, 7, 1, 3): "InvalidUtf8Boundary", (1, 7, 0, 3): "CharacterRangeMismatch"}
    df = spark.createDataFrame([(text, *c) for c in cases], "t string, bs int, be int, ss int, se int")
    e = evidence.span_error(*[F.col(c) for c in ("t", "bs", "be", "ss", "se")])
    assert [r.e for r in df.select(e.alias("e")).collect()] == list(cases.values())
    assert df.select(evidence.span_text(F.col("t"), F.lit(1), F.lit(7)).alias("x")).first().x == "é🧠"


def test_every_span_of_a_text(spark):
    text = "aß日🧠"
    bounds = [0, 1, 3, 6, 10]
    rows = [(text, a, b, c, d) for a in range(11) for b in range(a + 1, 11) for c in range(5) for d in range(c + 1, 5)]
    df = spark.createDataFrame(rows, "t string, bs int, be int, ss int, se int")
    good = {(r.bs, r.be, r.ss, r.se) for r in df.where(evidence.span_error(*[F.col(c) for c in ("t", "bs", "be", "ss", "se")]).isNull()).collect()}
    assert good == {(bounds[i], bounds[j], i, j) for i in range(5) for j in range(i + 1, 5)}


def test_simulation(spark):
    a, b = simulation.generate(simulation.Config(2026)), simulation.generate(simulation.Config(2026))
    assert a.digest == b.digest != simulation.generate(simulation.Config(2027)).digest
    assert simulation.SplitMix64(0).next() == 0xE220A8397B1DCDAF
    frames = a.frames(spark)
    assert simulation.manifest_errors(frames).count() == 0
    lost = simulation.generate(simulation.Config(1, missingness_rate_bps=10_000, relation_false_negative_bps=10_000))
    assert all(d[6] is None for d in lost.documents) and not any(o[-1] for o in lost.observed)
    broken = {**frames, "events": frames["events"].limit(1)}
    assert simulation.manifest_errors(broken).where("error_code = 'UnknownEvent'").count() > 0
    with pytest.raises(simulation.SimulationError):
        simulation.Config(1, event_count=0)
    with pytest.raises(simulation.SimulationError):
        simulation.generate(simulation.Config(1, event_count=100))


def test_generator_is_pinned():
    """Our own golden values: what a seed gives must not change from one version to the next."""
    assert simulation.generate(simulation.Config(2026)).digest == GOLDEN_DIGEST
    r = simulation.SplitMix64(2026)
    assert [r.next() for _ in range(2)] == [splitmix(2026, k) for k in (1, 2)]


def splitmix(seed, k):
    """The k-th number of the published generator, from its definition."""
    mask = (1 << 64) - 1
    z = (seed + k * 0x9E3779B97F4A7C15) & mask
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
    return z ^ (z >> 31)


def test_routing(spark):
    rows = [("narrative_synthesis", 0.7, 0.7, 0.9, 10_000, True), ("narrative_synthesis", 0.7, 0.7, 0.9, 30_000, True), ("span_classification", 0.1, 0.1, 0.9, 3_000, True), ("blinded_model_review", 0.1, 0.1, 0.9, 9_000, True), ("schema_conversion", 0.1, 0.1, 0.1, 9_000, True), ("x", 0.1, 0.1, 0.9, 9_000, True), ("schema_conversion", 0.1, 0.1, 0.9, 2_000_000, True)]
    df = spark.createDataFrame(rows, "task string, risk double, ambiguity double, evidence double, budget bigint, gate_passed boolean").withColumn("access_list", F.array(F.lit("a")))
    got = contracts.route(df).collect()
    assert [(r.mode, r.error_code) for r in got] == [("verify", None), ("conductor", None), ("abstain", None), ("abstain", None), ("abstain", None), (None, "InvalidWirePayload"), (None, "LimitExceeded")]
    assert [len(r.roles) for r in got[:3]] == [2, 4, 0] and got[0].fallback_mode == "direct"
    b = spark.createDataFrame([(100, 90), (100, 89), (0, 0)], "a int, b int")
    assert [r.c for r in b.select(contracts.budgets_comparable(F.col("a"), F.col("b")).alias("c")).collect()] == [True, False, False]


def test_requests():
    good = {"contract_version": 1, "idempotency_key": "k", "tenant_workspace_id": "t", "snapshot_id": "s", "knowledge_cutoff": "2026-08-01T00:00:00Z", "model_contract_version": "m", "output_profile": "o"}
    import json

    now = dt.datetime(2026, 9, 1, tzinfo=dt.UTC)
    parse = lambda d: contracts.AnalysisRunRequest.from_json(d if isinstance(d, str) else json.dumps(d), now)
    request = parse(good)
    for bad, name in ((good | {"x": 1}, "InvalidWirePayload"), (good | {"contract_version": 2}, "UnsupportedContractVersion"), (good | {"snapshot_id": " "}, "InvalidWirePayload"), (good | {"knowledge_cutoff": "2027-01-01T00:00:00Z"}, "InvalidWirePayload"), (json.dumps(good)[:-1] + ', "snapshot_id": "s"}', "InvalidWirePayload"), ("x" * 70_000, "LimitExceeded"), ("[]", "InvalidWirePayload")):
        with pytest.raises(contracts.ContractError, match=name):
            parse(bad)
    seen: dict = {}
    assert contracts.accept(request, seen, "r1") == contracts.accept(request, seen, "r2")
    with pytest.raises(contracts.ContractError, match="IdempotencyConflict"):
        contracts.accept(parse(good | {"output_profile": "other"}), seen, "r3")


def test_exports(spark):
    edges = spark.createDataFrame([(5, "b<", "a"), (2, "a", "c")], "seq int, source string, target string")
    lines = [r.line for r in contracts.graphml_lines(edges, "g", 10).orderBy("part", "at").collect()]
    assert '  <node id="b&lt;"/>' in lines and '  <edge id="e0" source="a" target="c"/>' in lines and lines.index('  <edge id="e1" source="b&lt;" target="a"/>') == len(lines) - 2
    with pytest.raises(contracts.ContractError, match="LimitExceeded"):
        contracts.graphml_lines(edges, "g", 1)
    grants = spark.createDataFrame([("g", "t", "partner_disclosure", "2026-01-01T00:00:00Z", None)], "grant_id string, tenant_workspace_id string, purpose string, valid_from string, valid_to string")
    offer = lambda t, text, identity, at: ("g", t, "art", "o", text, "r", identity, at)
    rows = [offer("t", None, None, "2026-02-01T00:00:00Z"), offer("t", "x", None, "2026-02-01T00:00:00Z"), offer("u", None, None, "2026-02-01T00:00:00Z"), offer("t", None, "me", "2026-02-01T00:00:00Z"), offer("t", None, None, "2025-02-01T00:00:00Z"), offer("t", None, None, "2026-02-30T00:00:00Z")]
    offers = spark.createDataFrame(rows, "grant_id string, tenant_workspace_id string, artifact_id string, opaque_analytical_id string, source_text string, membership_role string, identity_mapping string, decision_time string")
    got = sorted(r.error_code or "" for r in contracts.minimize_payloads(offers, grants).collect())
    assert got == ["", *["AuthorizationDenied"] * 4, "InvalidWirePayload"]


def test_audit_comes_before_denial(spark):
    cols = "tenant_workspace_id string, principal_id string, purpose string, valid_from string, valid_to string, reidentification_authorized boolean, mapping_tenant_workspace_id string, opaque_analytical_id string, direct_identity string, decision_time string"
    row = ("t", "p", "scientific_validation", "2026-01-01T00:00:00Z", None, True, "t", "o", "me", "2026-02-01T00:00:00Z")
    audit, shown = contracts.disclosures(spark.createDataFrame([row, row[:5] + (False,) + row[6:]], cols), "audit.v1")
    assert [r.outcome for r in audit.collect()] == ["allowed", "denied"] and shown.count() == 1
    assert len({r.decision_digest for r in audit.collect()}) == 2

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import allen, clocks, intervals, wire
from tempora.functions.guards import InvalidRows, assert_valid, code, with_code
from tempora.operators.reasoner import Compositions, Contradiction, Network, close_networks, closed_masks, compose_masks, converse_of
from tempora.plans import queries


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def stamp(date="2031-03-09", sep="T", hour="17", minute="05", second="42", fraction="", zone="Z"):
    """A text by the strict grammar's parts, any of which a test may put out of order."""
    return f"{date}{sep}{hour}:{minute}:{second}{fraction}{zone}"


def test_rfc3339_accepts_and_rejects(spark):
    base = datetime.datetime(2031, 3, 9, 17, 5, 42)
    good = {stamp(fraction="." + "7" * n): f"2031-03-09T17:05:42.{'7' * n}Z" for n in range(1, 10)}
    good |= {stamp(fraction=".250000000"): "2031-03-09T17:05:42.25Z", stamp(date="1583-12-31", second="00"): "1583-12-31T17:05:00Z", stamp(): f"{base.isoformat()}Z"}
    for sign, hours, minutes in (("+", 13, 45), ("-", 3, 30), ("+", 0, 0), ("-", 23, 59)):
        shift = datetime.timedelta(hours=hours, minutes=minutes) * (1 if sign == "+" else -1)
        good[stamp(zone=f"{sign}{hours:02}:{minutes:02}")] = f"{(base - shift).isoformat()}Z"
    # one violation each
    bad = [stamp(fraction="."), stamp(fraction="." + "1" * 10), stamp(second="60"), stamp(sep="t"), stamp(sep=" "), stamp(zone="z"), stamp(zone="-00:00"), stamp(zone="+1:00"), stamp(zone="+01-00"), stamp(zone="+24:00"), stamp(zone="+01:60"), stamp(zone="")]
    bad += [stamp(date=d) for d in ("2031-02-29", "2031-04-31", "2031-13-01", "2031-00-10", "2031-03-00", "31-03-09", "2O31-03-09")]
    bad += [stamp(hour="24"), stamp(hour="7"), stamp(minute="60"), stamp()[:16] + "Z", f" {stamp()}", "", None]
    df = column(spark, [*good, *bad]).orderBy("i")
    out = [r.t for r in df.select("i", clocks.to_rfc3339(clocks.parse_rfc3339(F.col("x"))).alias("t")).orderBy("i").collect()]
    assert out == [*good.values(), *[None] * len(bad)]


def test_instants_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2031-03-09 01:30:00.5' AS n, DATE '2031-03-09' AS d, timestamp_micros(1930000000123456) AS t, '2031-03-09T01:30:00Z' AS x")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            r = df.select(*[clocks.to_rfc3339(clocks.from_timestamp(F.col(c))).alias(c) for c in "ndt"], clocks.to_rfc3339(clocks.parse_rfc3339(F.col("x"))).alias("x")).first()
            want = datetime.datetime.fromtimestamp(1930000000, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.123456Z")
            assert (r.n, r.d, r.t, r.x) == ("2031-03-09T01:30:00.5Z", "2031-03-09T00:00:00Z", want, "2031-03-09T01:30:00Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_nanoseconds_are_kept(spark):
    ns = column(spark, ["1970-01-01T00:00:00.000000001Z"]).select(clocks.as_nanosecond(clocks.parse_rfc3339(F.col("x"))).alias("n")).first().n
    assert int(ns) == 1


def test_clocks_do_not_mix(spark):
    df = spark.range(1).select(F.current_timestamp().alias("a"), F.current_timestamp().alias("b"))
    df = clocks.clock(clocks.clock(df, "a", "event_time"), "b", "system_time")
    assert clocks.same_clock(df, "a") == "event_time"
    with pytest.raises(TypeError):
        clocks.same_clock(df, "a", "b")


@pytest.mark.parametrize(
    "lk, lo, uk, hi, precision, want",
    [
        ("unbounded", None, "unbounded", None, "day", "InvalidIntervalCertainty"),
        ("included", (2, 0), "included", (1, 0), "day", "InvalidIntervalOrder"),
        ("included", (1, 0), "included", (1, 0), "day", "EmptyInterval"),
        ("included", (1, 0), "included", (2, 0), "unknown", "InvalidTemporalPrecision"),
        ("excluded", (1, 0), "excluded", (1, 1), "nanosecond", "EmptyInterval"),
        ("excluded", (1, 0), "excluded", (1, 2), "nanosecond", None),
        ("included", (1, 0), "unbounded", None, "day", None),
    ],
)
def test_interval_errors(spark, lk, lo, uk, hi, precision, want):
    df = spark.createDataFrame([(lk, lo, uk, hi, precision)], "lk string, lo struct<sec:bigint,nano:int>, uk string, hi struct<sec:bigint,nano:int>, p string")
    assert df.select(intervals.bounded_error(*[F.col(c) for c in ("lk", "lo", "uk", "hi", "p")]).alias("e")).first().e == want


def test_open_gap_contains_only_its_middle(spark):
    df = spark.createDataFrame([((1, n),) for n in range(4)], "at struct<sec:bigint,nano:int>")
    end = lambda n: F.struct(F.lit(1).cast("long").alias("sec"), F.lit(n).alias("nano"))
    i = intervals.bounded(F.lit("excluded"), end(0), F.lit("excluded"), end(2), F.lit("nanosecond"))
    assert [r.c for r in df.select(intervals.contains(i, F.col("at")).alias("c"), "at").orderBy("at").collect()] == [False, True, False, False]
    assert not df.select(intervals.contains(intervals.unknown(), F.col("at")).alias("c")).first().c


CASES = [(1, 2, 3, 4, "before"), (1, 2, 2, 4, "meets"), (1, 3, 2, 4, "overlaps"), (1, 3, 1, 4, "starts"), (2, 3, 1, 4, "during"), (2, 4, 1, 4, "finishes"), (1, 4, 1, 4, "equals")]


def test_classification_and_converse(spark):
    both = CASES + [(c, d, a, b, allen.CONVERSE[r]) for a, b, c, d, r in CASES]
    df = spark.createDataFrame(both, "a int, b int, c int, d int, want string")
    got = df.select("want", allen.classify(*[F.col(x) for x in "abcd"]).alias("r")).withColumn("back", allen.converse(allen.converse(F.col("r")))).collect()
    assert all(r.want == r.r == r.back for r in got)
    assert all(allen.relation_of(*x[:4]) == x[4] for x in both)


def test_improper_intervals_have_no_relation(spark):
    df = spark.createDataFrame([(2, 1, 1, 2), (1, 1, 1, 2), (None, 1, 1, 2)], "a int, b int, c int, d int")
    assert [r.r for r in df.select(allen.classify(*[F.col(x) for x in "abcd"]).alias("r")).collect()] == [None] * 3


def test_composition_laws(spark):
    six, eight = allen.composition(6), allen.composition(8)
    assert six == eight and len(six) == 169 and all(six.values())
    rev = lambda m: sum(allen.BIT[allen.CONVERSE[n]] for n in allen.RELATIONS if m & allen.BIT[n])
    for a, b in itertools.product(allen.RELATIONS, repeat=2):
        assert rev(six[a, b]) == six[allen.CONVERSE[b], allen.CONVERSE[a]]
    assert six["overlaps", "overlaps"] == allen.mask_of("before", "meets", "overlaps")
    assert six["starts", "finishes"] == allen.mask_of("during")
    table = {(r.left, r.right): r.mask for r in allen.composition_table(spark).collect()}
    assert table == six


def test_sets(spark):
    df = spark.createDataFrame([(allen.mask_of("before", "equals"), allen.mask_of("meets"))], "a int, b int")
    r = allen.compose(df, "a", "b").select("composed", allen.size(F.col("a")).alias("n"), allen.members(F.col("a")).alias("m"), allen.converse_mask(F.col("a")).alias("c"), allen.union(F.col("a"), F.col("b")).alias("u"), allen.intersection(F.col("a"), F.col("b")).alias("i")).first()
    assert r.n == 2 and r.m == ["before", "equals"] and r.c == allen.mask_of("after", "equals") and r.i == 0
    assert r.composed == allen.composition()["before", "meets"] | allen.mask_of("meets") and r.u == allen.mask_of("before", "equals", "meets")


def test_reasoner_derives_and_rolls_back():
    net = Network()
    for _ in range(3):
        net.add_variable()
    net.assert_relation(0, 1, allen.BIT["before"])
    net.assert_relation(1, 2, allen.BIT["meets"])
    net.close()
    assert net.masks[0][2] == allen.BIT["before"] and net.masks[2][0] == allen.BIT["after"]
    assert net.support[0][2] == {0, 1} and not net.observed[0][2] and net.close()[1] == 0
    before = [r[:] for r in net.masks]
    with pytest.raises(Contradiction):
        net.assert_relation(2, 0, allen.BIT["before"])
    assert net.masks == before


def test_networks_beside_each_other(spark):
    rows = [("a", 0, 0, 1, allen.BIT["before"]), ("a", 1, 1, 2, allen.BIT["before"]), ("b", 0, 0, 1, allen.BIT["before"]), ("b", 1, 1, 2, allen.BIT["before"]), ("b", 2, 2, 0, allen.BIT["before"])]
    got = close_networks(spark.createDataFrame(rows, "network string, step int, i int, j int, mask int")).collect()
    assert next(r.mask for r in got if (r.network, r.i, r.j) == ("a", 0, 2)) == allen.BIT["before"]
    assert {r.error_code for r in got if r.network == "b"} == {"Contradiction"} and {r.error_code for r in got if r.network == "a"} == {None}


def test_masks_close_as_the_loop_closes_them(spark):
    """Random networks, consistent or not, and one whose assertions contradict, against the triple loop."""
    rng, rows, want, wrong = random.Random(2), [], {}, set()
    for name in range(40):
        n, net = rng.randint(2, 7), Network()
        spans = [sorted(rng.sample(range(12), 2)) for _ in range(n)]
        own = []
        for _ in range(rng.randint(1, 2 * n)):
            i, j = rng.sample(range(n), 2)
            true = allen.BIT[allen.relation_of(*spans[i], *spans[j])] if name % 4 else 0
            own.append((i, j, true | rng.getrandbits(13) & rng.getrandbits(13) or 1))
        rows += [(str(name), *r) for r in own]
        try:
            for _ in range(n):
                net.add_variable()
            for r in own:
                net.assert_relation(*r)
            net.close()
            want |= {(str(name), i, j): net.masks[i][j] for i in range(n) for j in range(n) if i != j and net.masks[i][j] != allen.ALL}
        except Contradiction:
            wrong.add(str(name))
    rows += [("self", 0, 0, allen.BIT["before"]), ("null", 0, None, 1), ("all", 0, 1, allen.ALL)]
    got = closed_masks(spark.createDataFrame(rows, "network string, i int, j int, mask int")).collect()
    assert 3 < len(wrong) < 37
    assert {(r.network, r.i, r.j): r.mask for r in got if r.error_code is None} == want
    assert {r.network for r in got if r.error_code == "Contradiction"} == wrong | {"self"}
    assert closed_masks(spark.createDataFrame([], "network string, i int, j int, mask int")).collect() == []


def test_small_networks_are_closed_without_rounds_of_joins(spark):
    """Chains of 20 links of any two relations: a handful of jobs, not some for each round, and no cell more or less than by the triple loop."""
    rng, rows, want = random.Random(23), [], {}
    for name in range(12):
        net = Network()
        for _ in range(21):
            net.add_variable()
        for k in range(20):
            mask = allen.BIT[rng.choice(allen.RELATIONS)] | allen.BIT[rng.choice(allen.RELATIONS)]
            rows.append((name, 10 * k - 70, 10 * k - 60, mask) if rng.random() < 0.5 else (name, 10 * k - 60, 10 * k - 70, converse_of(mask)))
            net.assert_relation(k, k + 1, mask)
        net.close()
        want |= {(name, 10 * i - 70, 10 * j - 70): net.masks[i][j] for i in range(21) for j in range(21) if i != j and net.masks[i][j] != allen.ALL}
    rng.shuffle(rows)
    spark.sparkContext.setJobGroup("small networks", "")
    try:
        got = closed_masks(spark.createDataFrame(rows, "network long, i int, j int, mask int")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == len(want) and {(r.network, r.i, r.j): r.mask for r in got} == want
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("small networks")) < 12


def test_small_and_large_networks_close_alike(spark):
    """Networks on either side of the limit of what a task closes, one of them contradictory on each side."""
    one = [(0, 1, allen.BIT["before"]), (1, 2, allen.BIT["overlaps"])]
    more = [*one, (2, 3, allen.BIT["during"] | allen.BIT["meets"]), (3, 4, allen.BIT["finishes"])]
    rows = [(name, *r) for name, own in (("a", one), ("b", more), ("c", [*one, (0, 2, allen.BIT["after"])]), ("d", [*more, (0, 2, allen.BIT["after"])])) for r in own]
    df = spark.createDataFrame(rows, "network string, i int, j int, mask int")
    by_limit = [sorted(map(tuple, closed_masks(df, n).collect()), key=str) for n in (0, 3, 64)]
    assert by_limit[0] == by_limit[1] == by_limit[2]
    assert {r[0] for r in by_limit[0] if r[4] == "Contradiction"} == {"c", "d"}


def test_compositions_of_arrays_by_numbers_and_by_parts():
    rng = np.random.default_rng(4)
    for most in (1, 5, 512):  # of few numbers, most masks get none
        composed = Compositions(most)
        for high in (8, 8192):
            a, b = rng.integers(0, high, (3, 5)).astype(np.int16), rng.integers(0, high, (4, 5)).astype(np.int16)
            assert composed(a, b).tolist() == [[[compose_masks(int(x), int(y)) for x, y in zip(p, q, strict=True)] for q in b] for p in a]


NAMED = [("before", (0, 1), (2, 3)), ("meets", (0, 1), (1, 2)), ("overlaps", (0, 2), (1, 3)), ("starts", (0, 1), (0, 2)), ("during", (1, 2), (0, 3)), ("finishes", (1, 2), (0, 2))]
NAMED += [(allen.CONVERSE[n], y, x) for n, x, y in NAMED] + [("equals", (0, 1), (0, 1))]


def test_closure_of_all_orders(spark, tmp_path):
    rng = random.Random(7)
    sizes = {1: 2, 2: 7, 3: 13, 4: 258}
    orders = [(c * 1000 + k, c, rng.randint(0, 40), rng.randint(1, 12)) for c, n in sizes.items() for k in range(n)]
    day = lambda x: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=x)
    spark.createDataFrame([(k, c, day(a), 1.0) for k, c, a, _ in orders], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, day(a + d)) for k, _, a, d in orders], "l_orderkey bigint, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.QUERIES["reasoner_closure"](spark, str(tmp_path)).where("network < 4 OR i + j = 0").collect()
    assert {(r.network, r.error_code) for r in got} == {(1, None), (2, None), (3, None), (4, "BudgetExceeded")}

    def relation(a, b):
        sign = lambda x, y: (x > y) - (x < y)
        return sign(a[0], b[0]), sign(a[0], b[1]), sign(a[1], b[0]), sign(a[1], b[1])

    spans = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    table = {}
    for x, y, z in itertools.product(spans, repeat=3):
        table.setdefault((relation(x, y), relation(y, z)), set()).add(relation(x, z))
    name = {relation(x, y): allen.BIT[n] for n, x, y in NAMED}
    for c in (1, 2, 3):
        own = [(a, a + d) for _, x, a, d in orders if x == c]
        cell = {(i, j): set(name) for i in range(len(own)) for j in range(len(own))}
        for i in range(len(own)):
            cell[i, i] = {relation(own[i], own[i])}
            if i:
                cell[i - 1, i], cell[i, i - 1] = {relation(own[i - 1], own[i])}, {relation(own[i], own[i - 1])}
        while True:
            less = {(i, j): cell[i, j].intersection(*(set().union(*(table[a, b] for a in cell[i, k] for b in cell[k, j])) for k in range(len(own)))) for i, j in cell}
            if less == cell:
                break
            cell = less
        assert {(r.i, r.j): r.mask for r in got if r.network == c} == {k: sum(name[x] for x in v) for k, v in cell.items()}


def test_wire_is_strict(spark):
    good = '{"schema_version":1,"clock_type":"event_time","timestamp":"2026-01-01T00:00:00Z"}'
    df = column(spark, [good, good.replace("}", ',"x":1}'), good.replace("1,", "2,", 1), good.replace("event", "system"), good.replace("-01T", "-41T"), "nonsense", None])
    _, e = wire.decode_clock(F.col("x"), "event_time")
    assert [r.e for r in df.select("i", e.alias("e")).orderBy("i").collect()] == [None, "InvalidWirePayload", "UnsupportedSchemaVersion", "ClockTypeMismatch", "InvalidTimestamp", "InvalidWirePayload", "InvalidWirePayload"]


def test_interval_round_trip(spark):
    df = spark.createDataFrame([((1, 0), (2, 5))], "lo struct<sec:bigint,nano:int>, hi struct<sec:bigint,nano:int>")
    i = intervals.bounded(F.lit("included"), F.col("lo"), F.lit("excluded"), F.col("hi"), F.lit("day"))
    df = df.withColumn("j", wire.encode_interval(i, "event_time"))
    back, e = wire.decode_interval(F.col("j"), "event_time")
    r = df.select(back.alias("b"), e.alias("e")).first()
    assert r.e is None and tuple(r.b.upper) == (2, 5) and r.b.certainty == "bounded"
    assert wire.clock_schema("event_time")["additionalProperties"] is False and "lower" in wire.interval_schema("event_time")["required"]


def test_interval_ends_are_strict(spark):
    end = lambda kind, at="": f'{{"kind":"{kind}"{at}}}'
    at = ',"timestamp":"2031-03-09T00:00:00Z"'
    whole = lambda lower, upper: f'{{"schema_version":1,"clock_type":"event_time","certainty":"bounded","precision":"day","lower":{lower},"upper":{upper}}}'
    cases = {
        whole(end("included", at), end("unbounded")): None,
        whole(end("included", at), end("unbounded", at)): "InvalidWirePayload",
        whole(end("included", at + ',"zone":"Z"'), end("unbounded")): "InvalidWirePayload",
        whole(end("included"), end("unbounded")): "InvalidWirePayload",
        whole(end("included", ',"timestamp":null'), end("unbounded")): "InvalidWirePayload",
        whole(end("nearly", at), end("unbounded")): "InvalidWirePayload",
        whole("null", end("unbounded")): "InvalidWirePayload",
        whole(end("included", ',"timestamp":"yesterday"'), end("unbounded")): "InvalidTimestamp",
    }
    _, e = wire.decode_interval(F.col("x"), "event_time")
    assert [r.e for r in column(spark, list(cases)).select("i", e.alias("e")).orderBy("i").collect()] == list(cases.values())


def test_documents_and_spans_are_validated_again(spark):
    df = column(spark, ["Füße und Hände"]).withColumn("j", wire.encode_document(F.lit("d"), F.lit("a"), F.col("x")))
    back, e = wire.decode_document(F.col("j"))
    r = df.select(back.alias("b"), e.alias("e")).first()
    assert r.e is None and (r.b.document_id, r.b.text) == ("d", "Füße und Hände")
    other = df.withColumn("j", F.replace("j", F.lit("Hände"), F.lit("Hunde"))).select(wire.decode_document(F.col("j"))[1].alias("e")).first()
    assert other.e == "DigestMismatch"
    span = wire.encode_span(F.lit("d"), [F.lit(0), F.lit(6), F.lit(0), F.lit(4)])
    errors = df.select(
        wire.decode_span(span, F.lit("d"), F.col("x"))[1].alias("good"), wire.decode_span(span, F.lit("other"), F.col("x"))[1].alias("document"),
        wire.decode_span(F.replace(span, F.lit('"byte_end":6'), F.lit('"byte_end":2')), F.lit("d"), F.col("x"))[1].alias("middle"),
        wire.decode_span(F.replace(span, F.lit('"page_location":null'), F.lit('"page_location":{"page_number":1}')), F.lit("d"), F.col("x"))[1].alias("page"),
    ).first()
    assert tuple(errors) == (None, "SpanDocumentMismatch", "InvalidUtf8Boundary", "InvalidWirePayload")


def test_artifacts_are_hashed_again(spark):
    df = column(spark, ["abc"]).withColumn("j", wire.encode_artifact(F.lit("id"), F.col("x")))
    for payload, want in ((F.col("j"), None), (F.replace(F.col("j"), F.lit("YWJj"), F.lit("YWJk")), "DigestMismatch")):
        assert df.select(wire.decode_artifact(payload)[1].alias("e")).first().e == want


def test_assert_valid(spark):
    df = with_code(spark.range(3), code(F.col("id") == 1, "One"))
    with pytest.raises(InvalidRows) as e:
        assert_valid(df)
    assert e.value.codes == {"One": 1}
    assert assert_valid(df.where("id <> 1")).count() == 2

"""Sweeps and stabbing joins against brute force on random rows."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import bitemporal, membership, sweeps


@pytest.fixture(scope="module")
def windows(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        member, start = ("hot" if i % 3 == 0 else f"m{r.randrange(12)}"), r.randrange(60)
        rows.append((member, f"g{r.randrange(4)}", r.choice(["author", "partner"]), r.randrange(1, 900) / 100, start, start + r.randrange(1, 20), i))
    rows += rows[:3]  # repeated rows
    moments = [("hot" if i % 3 == 0 else f"m{r.randrange(14)}", r.randrange(-2, 85)) for i in range(250)]
    w = spark.createDataFrame(rows, "member_id string, group_id string, role string, weight double, valid_from int, valid_to int, n int")
    return rows, moments, w, spark.createDataFrame(moments, "member_id string, at int").repartition(7)


def test_running_over_ranges(spark):
    r = random.Random(1)
    rows = [(None if i % 5 == 0 else i % 3, r.randrange(40), i, r.choice([None, r.randrange(100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t int, i int, v int").repartition(6)
    got = sweeps.running(df, ["k"], ["t", "i"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "last": ("last", F.col("v"))}, {"total": "whole"}).collect()
    assert len(got) == len(rows)
    for g in got:
        upto = sorted((t, i, v) for k, t, i, v in rows if k == g["k"] and (t, i) <= (g["t"], g["i"]) and v is not None)
        assert g["total"] == sum(x[2] for x in upto) and g["top"] == max((x[2] for x in upto), default=None) and g["last"] == (upto[-1][2] if upto else None)
        assert g["whole"] == sum(v for k, _, _, v in rows if k == g["k"] and v is not None)


def test_active_for_is_every_window_that_holds_the_moment(windows):
    rows, moments, w, m = windows
    got = sorted((x["member_id"], x["at"], x["n"]) for x in membership.active_for(w, m).collect())
    assert got == sorted((a, t, x[6]) for a, t in moments for x in rows if x[0] == a and x[4] <= t <= x[5])


@pytest.mark.parametrize("closed", [True, False])
def test_stabbing_with_open_ends_nulls_and_reversed_windows(spark, closed):
    rows = [("a", 0, None), ("a", 5, 5), ("a", 7, 3), ("a", 2, 6), (None, 0, 9), ("a", None, 4), ("b", 1, 2)]
    moments = [("a", t) for t in range(-1, 9)] + [("a", None), (None, 3), ("c", 1), ("b", 2)]
    got = sweeps.stabbed(spark.createDataFrame(rows, "k string, s int, e int"), spark.createDataFrame(moments, "k string, at int"), "k", "s", "e", "at", closed)
    want = [(k, at, s, e) for k, at in moments for k2, s, e in rows if None not in (k, at, s) and k == k2 and s <= at and (e is None or at < e or (closed and at == e))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_steps_at_every_moment(windows):
    rows, moments, w, m = windows
    got = sorted((x["member_id"], x["at"], x["multiplicity"]) for x in membership.multiplicity_at(w, m).collect())
    assert got == sorted((a, t, len({x[1] for x in rows if x[0] == a and x[4] <= t <= x[5]})) for a, t in moments)
    want = {}
    for a, t in set(moments):
        for x in rows:
            if x[0] == a and x[4] <= t <= x[5]:
                want[a, x[2], t] = want.get((a, x[2], t), 0) + x[3]
    weights = {(x["member_id"], x["role"], x["at"]): x["weight"] for x in membership.weight_by_role_at(w, m).collect()}
    assert weights == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


@pytest.mark.parametrize("overlapping", [False, True])
def test_reads_of_versions_at_each_instant(spark, overlapping):
    r = random.Random(4)
    rows = []
    for k in range(6):
        t = 0
        for revision in range(25):
            length = r.randrange(1, 6)
            rows.append((k % 5, t, None if revision == 24 and k < 5 else t + length + (r.randrange(15) if overlapping else 0), r.randrange(30), r.randrange(30, 70), revision + 100 * (k == 5)))
            t += length
        if not overlapping and k == 4:
            break
    probes = [(r.randrange(7), r.randrange(-2, 110), r.randrange(80)) for _ in range(200)]
    v = spark.createDataFrame(rows, "id int, system_from int, system_to int, valid_from int, valid_to int, revision int")
    p = spark.createDataFrame([*probes, *probes[:5], (None, 3, 3), (1, None, 3)], "id int, known int, valid int").repartition(5)

    def best(i, known, valid=None):
        held = [x for x in rows if x[0] == i and x[1] <= known and (x[2] is None or known < x[2]) and (valid is None or x[3] <= valid < x[4])]
        return max((x[5] for x in held), default=None)

    got = {(x["id"], x["known"]): x["revision"] for x in bitemporal.as_known_at_each(v, p, "id", revision="revision").collect()}
    assert got == {(i, k): b for i, k, _ in probes if (b := best(i, k)) is not None}
    got = {(x["id"], x["known"], x["valid"]): x["revision"] for x in bitemporal.as_valid_at_each(v, p, "id", revision="revision").collect()}
    assert got == {(i, k, a): b for i, k, a in probes if (b := best(i, k, a)) is not None}


def test_no_rows(windows):
    _, _, w, m = windows
    assert membership.active_for(w.limit(0), m).count() == 0 and membership.active_for(w, m.limit(0)).count() == 0
    assert membership.multiplicity_at(w.limit(0), m).where("multiplicity <> 0").count() == 0

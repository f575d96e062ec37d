import random
from datetime import date, datetime

from pyspark.sql import functions as F

from quarrylane.operators.asof import as_known_at

EVENTS = "id int, k string, t date"
VERSIONS = "k string, since timestamp_ntz, from_day date, v int, text string"


def known(spark, events, versions, **more):
    e = spark.createDataFrame(events, EVENTS)
    v = spark.createDataFrame(versions, VERSIONS)
    return as_known_at(e, v, entity=("k", "k"), event_time="t", available=[("since", True), ("from_day", False)], latest_by=["from_day", "since", "v"], take={"v": "version"}, **more)


def test_strict_and_inclusive_bounds(spark):
    day = date(2020, 5, 1)
    rows = [("a", datetime(2020, 5, 1), day, 1, "at the instant"), ("a", datetime(2020, 4, 30, 23), day, 2, "just before"), ("a", datetime(2020, 4, 1), date(2020, 5, 2), 3, "valid later")]
    got = known(spark, [(1, "a", day), (2, "a", date(2020, 5, 2)), (3, "b", day), (4, None, day), (5, "a", None)], rows).collect()
    assert {r.id: r.version for r in got} == {1: 2, 2: 3, 3: None, 4: None, 5: None}


def test_repeats_ties_and_empty(spark):
    d = date(2020, 1, 1)
    rows = [("a", datetime(2019, 1, 1), date(2019, 1, 1), 1, "x")] * 2 + [("a", datetime(2019, 1, 1), date(2019, 1, 1), 7, "y"), ("a", None, d, 9, "z")]
    assert [r.version for r in known(spark, [(1, "a", d), (1, "a", d)], rows).collect()] == [7, 7]
    assert [r.version for r in known(spark, [(1, "a", d)], []).collect()] == [None]
    assert known(spark, [], rows).count() == 0


def test_against_brute_force_over_segments(spark):
    rnd = random.Random(5)
    day = lambda: date(2000 + rnd.randrange(12), rnd.randrange(1, 13), rnd.randrange(1, 28))
    versions = [(rnd.choice("abc"), datetime.combine(day(), datetime.min.time()).replace(hour=rnd.choice([0, 9])), day(), i, None) for i in range(400)]
    events = [(i, rnd.choice("abcd"), day()) for i in range(300)]
    want = {}
    for i, k, t in events:
        at = datetime.combine(t, datetime.min.time())
        ok = [(f, s, v) for kk, s, f, v, _ in versions if kk == k and s < at and f <= t]
        want[i] = max(ok)[2] if ok else None
    for segment in (30, 366, 100000):
        got = known(spark, events, versions, segment_days=segment).repartition(7)
        assert {r.id: r.version for r in got.collect()} == want


def test_clashing_columns_are_refused_or_ignored(spark):
    e = spark.createDataFrame([(1, "a", date(2020, 1, 2), "mine")], EVENTS + ", v string")
    v = spark.createDataFrame([("a", datetime(2020, 1, 1), date(2020, 1, 1), 3, "x")], VERSIONS).withColumn("t", F.lit("other"))
    got = as_known_at(e, v, entity=("k", "k"), event_time="t", available=[("since", True)], latest_by=["since"], take={"v": "version"})
    assert got.columns == ["id", "k", "t", "v", "version"]
    assert got.first()["v"] == "mine"
    try:
        as_known_at(e, v, entity=("k", "k"), event_time="t", available=[("since", True)], latest_by=["since"], take={"v": "v"})
    except ValueError:
        return
    raise AssertionError("a clashing name must be refused")

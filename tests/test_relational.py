import random

import pytest
from pyspark.sql import functions as F

from quarrylane.operators import relational as L


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", None, "z"), (None, 5, "n"), ("a", 1, "y")], "k string, o int, v string").repartition(3)
    assert {(r.k, r.v) for r in L.pick_first(df, ["k"], ["o"]).collect()} == {("a", "y"), (None, "n")}
    assert {(r.k, r.v) for r in L.pick_last(df, ["k"], ["o"]).collect()} == {("a", "x"), (None, "n")}
    assert L.pick_first(df.limit(0), ["k"], ["o"]).count() == 0


def test_fallback_years(spark):
    left = spark.createDataFrame([(1, "a", 2010), (2, "a", 2012), (3, "a", None), (4, "b", 2010), (5, "a", 2014)], "id int, k string, y int")
    right = spark.createDataFrame([("a", 2009, 1, 91), ("a", 2011, 1, 111), ("a", 2011, 2, 112), ("a", 2015, 1, 151), (None, 2010, 1, 0)], "k string, y int, pos int, v int")
    got = L.with_fallbacks(left, right, key="k", year="y", offsets=[0, -1, 1], take=["v"], last_by=["pos"])
    assert {r.id: (r.matched_year, r.v) for r in got.collect()} == {1: (2009, 91), 2: (2011, 112), 3: (None, None), 4: (None, None), 5: (2015, 151)}


def test_pending_and_others(spark):
    work = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, f int")
    done = spark.createDataFrame([("a", 1), ("a", 1)], "k string, f int")
    assert {r.k for r in L.pending(work, done, ["k", "f"]).collect()} == {"b", None}
    others = L.others_of_group(work, ["f"], "k").first()
    assert others.all_k == ["a", "b"]


def test_null_counts_and_conform(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    assert {(r["column"], r.n_null, r.n_rows) for r in L.null_counts(df, ["x", "s"]).collect()} == {("x", 2, 3), ("s", 1, 3)}
    assert L.complete(df, ["x"]).count() == 1
    out = L.conform(spark.createDataFrame([("t",)], "response string"), {"response": "text", "gone": "y"}, {"provider": F.lit("?")})
    assert out.first().asDict() == {"text": "t", "provider": "?"}
    assert L.select_present(out, ["provider", "zzz", "text"]).columns == ["provider", "text"]


def test_all_and_any(spark):
    df = spark.createDataFrame([("d1", "m1", "S"), ("d1", "m2", "S"), ("d2", "m1", "S"), ("d3", "m2", "F")], "d string, m string, l string")
    assert {r.d: (r.all_of, r.any_of) for r in L.all_and_any(df, "d", "m", "l", "S").collect()} == {"d1": (True, True), "d2": (False, True), "d3": (False, False)}


def test_top_per_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 2)], "k string, v int")
    assert sorted((r.k, r.v) for r in L.top_per_group(df, ["k"], [F.desc("v")], 2).collect()) == [("a", 3), ("a", 3), ("b", 2)]


@pytest.mark.parametrize("parts", [1, 5])
def test_layout_does_not_matter(spark, parts):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.randrange(3), rnd.randrange(1000)) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(parts)
    best = {r.k: r.v for r in L.pick_last(df, ["k"], ["o"]).collect()}
    assert best == {k: max((o, v) for kk, o, v in rows if kk == k)[1] for k in "ab"}


def test_small_operators(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("b", 1, "y"), (None, 3, "z"), ("c", 1, "x")], "k string, n int, v string")
    assert L.drop_present(df, ["v", "none"]).columns == ["k", "n"]
    assert [r.k for r in L.first_rows(df, ["n"], 3).collect()] == ["b", "c", "a"]
    assert [tuple(r) for r in L.mapped(df, "k", {"a": "A", "c": "C"}, "s").orderBy("k").select("k", "s").collect()] == [("a", "A"), ("c", "C")]
    right = spark.createDataFrame([("a", "pool", None), ("q", "other", 5)], "k string, name string, size int")
    from pyspark.sql import functions as F

    got = {r.k: (r.name, r.size, r.found) for r in L.looked_up(df, right, "k", {"name": F.col("v"), "size": F.col("n")}).collect()}
    assert got == {"a": ("pool", None, True), "b": ("y", 1, False), None: ("z", 3, False), "c": ("x", 1, False)}
    nexts = {r.k: r.after for r in L.next_in_order(df.where("k IS NOT NULL").repartition(3), "k", F.col("v"), "after").collect()}
    assert nexts == {"a": "y", "b": "x", "c": None}
    assert L.next_in_order(df.limit(0), "k", F.col("v"), "after").count() == 0

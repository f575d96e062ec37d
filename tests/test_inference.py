import hashlib
import random

import pytest

from quarrylane.operators import inference as I


def draw(b, i, n, seed="42"):
    digest = hashlib.md5(f"{seed}|{b}|{i // 4}".encode()).hexdigest()
    return int(digest[i % 4 * 8 : i % 4 * 8 + 8], 16) % n


def quantile(xs, q):
    xs = sorted(xs)
    at = q * (len(xs) - 1)
    lo = int(at)
    return xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (at - lo)


def test_mean_interval_against_loop(spark):
    rnd = random.Random(2)
    rows = [("c", i, rnd.random()) for i in range(40)] + [("d", 0, 0.5), (None, 1, 0.1), ("c", 99, None), ("c", 98, float("nan"))]
    got = {r.c: r for r in I.mean_interval(spark.createDataFrame(rows, "c string, i int, v double").repartition(3), ["c"], "v", "i", resamples=50).collect()}
    v = [x for c, i, x in rows[:40]]
    means = [sum(v[draw(b, i, 40)] for i in range(40)) / 40 for b in range(50)]
    assert set(got) == {"c", "d"}
    assert got["c"].n == 40 and got["c"].low == pytest.approx(quantile(means, 0.025)) and got["c"].high == pytest.approx(quantile(means, 0.975))
    assert got["d"].low == got["d"].high == 0.5
    assert got["c"].low <= got["c"].mean <= got["c"].high


def test_no_difference(spark):
    rows = [("m", f"a{i % 5}", 0.0) for i in range(20)]
    r = I.paired_interval(spark.createDataFrame(rows, "k string, c string, d double"), ["k"], "d", "c", resamples=30).first()
    assert (r.mean, r.low, r.high, r.p_value, r.n, r.n_clusters) == (0, 0, 0, 1, 20, 5)


def test_clear_difference(spark):
    rows = [("m", f"a{i}", 1.0 + i % 3) for i in range(30)]
    r = I.paired_interval(spark.createDataFrame(rows, "k string, c string, d double"), ["k"], "d", "c", resamples=100).first()
    assert r.low > 0 and r.p_value == 0


def test_empty_subset_resample_raises(spark):
    rows = [("m", "a", 1.0, True), ("m", "b", 0.0, False)]
    df = spark.createDataFrame(rows, "k string, c string, v double, s boolean")
    with pytest.raises(Exception, match="no row of the subset"):
        I.subset_interval(df, ["k"], "v", "s", "c", resamples=40).collect()
    full = spark.createDataFrame([("m", f"a{i}", float(i), True) for i in range(6)], "k string, c string, v double, s boolean")
    r = I.subset_interval(full, ["k"], "v", "s", "c", resamples=40).first()
    assert r.difference == r.low == r.high == 0


def test_large_cells_are_never_gathered(spark, monkeypatch):
    monkeypatch.setattr(I, "MOST_UNITS", 100)
    rows = [("c", i, i / 400) for i in range(400)] + [("small", i, float(i)) for i in range(5)]
    got = {r.c: r for r in I.mean_interval(spark.createDataFrame(rows, "c string, i int, v double"), ["c"], "v", "i", resamples=200).collect()}
    half = 1.96 * (1 / 12) ** 0.5 / 20
    r = got["c"]
    assert r.n == 400 and r.mean == pytest.approx(0.49875) and r.low == pytest.approx(r.mean - half, abs=0.01) and r.high == pytest.approx(r.mean + half, abs=0.01)
    means = [sum(draw(b, i, 5) for i in range(5)) / 5 for b in range(200)]
    assert got["small"].low == pytest.approx(quantile(means, 0.025))
    paired = spark.createDataFrame([("m", f"a{i}", 1.0 + i % 3) for i in range(300)], "k string, c string, d double")
    p = I.paired_interval(paired, ["k"], "d", "c", resamples=100).first()
    assert p.low < p.mean < p.high and p.p_value == 0 and p.n_clusters == 300


def test_empty_resamples_can_be_counted(spark):
    df = spark.createDataFrame([("m", "a", 1.0, True), ("m", "b", 0.0, False), ("n", "a", 1.0, False)], "k string, c string, v double, s boolean")
    got = {r.k: r for r in I.subset_interval(df, ["k"], "v", "s", "c", resamples=40, strict=False).collect()}
    empty = sum(all(draw(b, i, 2) == 1 for i in range(2)) for b in range(40))
    assert 0 < empty == got["m"].n_empty and got["n"].n_empty == 40 and got["n"].low is None


def test_spearman(spark):
    x = [1.0, 2.0, 2.0, 4.0, 5.0]
    y = [2.0, 1.0, 3.0, 3.0, 9.0]
    df = spark.createDataFrame([("k", a, b) for a, b in zip(x, y, strict=True)] + [("k", None, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)], "k string, x double, y double")
    got = {r.k: r for r in I.with_p_value(I.spearman(df, ["k"], "x", "y")).collect()}
    rx, ry = [1, 2.5, 2.5, 4, 5], [2, 1, 3.5, 3.5, 5]
    mx, my = sum(rx) / 5, sum(ry) / 5
    want = sum((a - mx) * (b - my) for a, b in zip(rx, ry, strict=True)) / (sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry)) ** 0.5
    assert got["k"].rho == pytest.approx(want) and got["k"].n == 5
    assert got["flat"].rho is None and got["flat"].p_value is None


def test_t_tail():
    # the median of Cauchy's distribution (t with one degree of freedom): |t| = 1 has a two-sided p of 1/2
    assert I._two_sided(2**-0.5, 3) == pytest.approx(0.5, abs=1e-9)
    assert I._two_sided(0.0, 10) == pytest.approx(1.0)
    assert I._two_sided(1.0, 10) == 0.0

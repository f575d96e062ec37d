import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrylane.operators import retrieval as R


def groups(seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    out = {}
    for g in ("a", "b"):
        docs = [[rnd.choice(words) for _ in range(rnd.randrange(1, 12))] for _ in range(9)] + [[]]
        out[g] = (docs, [rnd.choice(words) for _ in range(6)] + ["w1", "w1", "zzz"])
    return out


def frame(spark, data):
    rows = [(g, i, d) for g, (docs, _) in data.items() for i, d in enumerate(docs, 1)]
    items = spark.createDataFrame(rows, "g string, i int, d array<string>").repartition(3)
    return items, spark.createDataFrame([(g, q) for g, (_, q) in data.items()], "g string, q array<string>")


def loop_bm25(docs, q):
    full = [d for d in docs if d]
    n, mean = len(full), sum(map(len, full)) / len(full)
    df = Counter(t for d in full for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    s = []
    for d in docs:
        f = Counter(d)
        s.append(round(sum(idf.get(t, 0) * f[t] * 2.5 / (f[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in q), 9) if d else -1.0)
    return s


def loop_tfidf(docs, q):
    n = len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    vec = lambda d: {t: (1 + math.log(c)) * idf[t] for t, c in Counter(d).items() if t in idf}
    qv = vec(q)
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for d in docs:
        v = vec(d)
        out.append(round(sum(x * qv.get(t, 0) for t, x in v.items()) / (norm(v) * norm(qv)), 9) if v and qv else 0.0)
    return out


@pytest.mark.parametrize("fn,loop", [(R.bm25, loop_bm25), (R.tfidf, loop_tfidf)])
def test_lexical_against_loop(spark, fn, loop):
    data = groups()
    got = {(r.g, r.i): r for r in fn(*frame(spark, data), group="g", item="i", doc="d", query="q").collect()}
    assert len(got) == 20
    for g, (docs, q) in data.items():
        want = loop(docs, q)
        order = sorted(range(len(docs)), key=lambda j: (-want[j], j))
        for place, j in enumerate(order, 1):
            assert got[g, j + 1].score == pytest.approx(want[j], abs=2e-9)
            assert got[g, j + 1].rank == place


@pytest.mark.parametrize("fn", [R.bm25, R.tfidf])
def test_edges(spark, fn):
    items = spark.createDataFrame([("a", 1, ["x", "y"]), ("a", 2, None), ("b", 1, ["x"]), (None, 1, ["x"])], "t string, n int, df array<string>")
    queries = spark.createDataFrame([("a", ["x"]), ("c", ["x"]), ("a2", None)], "t string, q array<string>")
    got = {(r.t, r.n): (r.rank, r.score) for r in fn(items, queries, group="t", item="n", doc="df", query="q").collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), (None, 1)}
    assert got["a", 2][0] == 2 and got["b", 1] == (1, 0.0)
    assert fn(items.limit(0), queries, group="t", item="n", doc="df", query="q").count() == 0


def test_words(spark):
    df = spark.createDataFrame([("The R&amp;D  unit of Acme-Co grew 5%!",), ("",), (None,)], "t string")
    got = df.select(R.tokens(F.col("t")).alias("a"), R.terms(F.col("t")).alias("b")).collect()
    assert got[0].a == ["the", "r", "d", "unit", "of", "acme-co", "grew", "5"]
    assert got[0].b == ["unit", "acme", "co", "grew", "unit acme", "acme co", "co grew"]
    assert got[1].a == got[2].a == got[1].b == got[2].b == []


def test_cosine_and_dense(spark):
    df = spark.createDataFrame([("g", 1, [1.0, 0.0], [1.0, 1.0]), ("g", 2, [2.0, 2.0], [1.0, 1.0]), ("g", 3, None, [1.0, 1.0]), ("g", 4, [0.0, 0.0], [1.0, 1.0])], "g string, i int, v array<float>, q array<float>")
    got = {r.i: (r.rank, r.score) for r in R.dense(df, group="g", item="i", vector="v", query="q").collect()}
    assert got[2] == (1, 1.0) and got[1] == (2, pytest.approx(math.sqrt(0.5))) and got[3] == (3, None) and got[4] == (4, None)


def test_nearest_in_blocks(spark):
    rnd = random.Random(4)
    vs = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(130)] + [(500, None)]
    df = spark.createDataFrame(vs, "k long, v array<float>")
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    u = {k: unit([float(x) for x in v]) for k, v in vs if v}
    got = {}
    for r in R.nearest(df, df.where("k % 10 = 0"), key="k", vector="v", k=5, block=30, query_block=4).collect():
        got.setdefault(r.query, []).append((r.rank, r.k))
    for q in range(0, 130, 10):
        want = sorted((k for k in u if k != q), key=lambda k: -sum(a * b for a, b in zip(u[q], u[k], strict=True)))[:5]
        assert [k for _, k in sorted(got[q])] == want
    assert 500 not in got

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.llm import matching as M
from quarrylane.llm import qgram_bits as Q

SECTORS = ["Staffing", "Kitchens", "Photonics", "Hydraulics", "Payments", "Software", "Outfitters", "Bearings"]


def core(rnd):
    return "".join(rnd.choice(["bre", "sko", "tal", "vex", "mor", "lin", "gru", "dal", "pra", "zen", "fir", "hol"]) for _ in range(3)).title()


def test_close_keys_are_all_found(spark):
    rnd = random.Random(1)
    words = list({core(rnd).lower() for _ in range(150)})
    typos = []
    for w in words[:60]:
        i = rnd.randrange(1, len(w) - 1)
        typos.append(rnd.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i] + w[i:]]))
    frame = lambda x: Q.with_vectors(spark.createDataFrame([(w,) for w in x] + [(None,)], "key string"), "key")
    got = {(r.left, r.right): r.distance for r in Q.close_keys(frame(set(typos)), frame(words)).collect()}
    want = {}
    for a in set(typos):
        for b in words:
            d = ((Q.vector(a) ^ Q.vector(b)) & (1 << 64) - 1).bit_count()
            n = [1] * (max(len(a), len(b)) <= 5) + [2] * (min(len(a), len(b)) >= 5)
            if d <= Q.RADIUS and any(a[:i] == b[:i] or a[-i:] == b[-i:] for i in n):
                want[a, b] = d
    assert got == want and len(want) > 10
    with pytest.raises(ValueError):
        Q.close_keys(frame(words), frame(words), radius=12)


def test_keys_within_leaves_no_pair_out(spark, monkeypatch):
    """Pairs without a common end, too, whether the keys fit one task or not."""
    rnd = random.Random(2)
    words = sorted({core(rnd).lower() for _ in range(300)})
    left = sorted({w[6:] + w[:6] for w in words[:80]} | {w[:2] + w[3:] for w in words[:40]} | {"a", "ab"})
    bits = lambda a, b: ((Q.vector(a) ^ Q.vector(b)) & (1 << 64) - 1).bit_count()
    want = sorted((a, b, bits(a, b)) for a in left for b in words if bits(a, b) <= Q.RADIUS)
    assert sum(a[:2] != b[:2] and a[-2:] != b[-2:] for a, b, _ in want) > 10
    frame = lambda x: Q.with_vectors(spark.createDataFrame([(w,) for w in x] + [(None,)], "key string"), "key")
    a, b = frame(left), frame(words)
    assert sorted(tuple(r) for r in Q.keys_within(a, b).collect()) == want
    monkeypatch.setattr(Q, "PART", 50)
    assert sorted(tuple(r) for r in Q.keys_within(a, b).collect()) == want
    assert Q.keys_within(a.limit(0), b).count() == Q.keys_within(a, b.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Q.keys_within(a, b, radius=12)


def test_names_without_a_common_end_are_met(spark):
    """The two keys are 10 bits apart, but neither their first nor their last two letters agree."""
    left = spark.createDataFrame([("t:BGSK", "Begrusko", "BGSK", 2011, 5000.0)], "group string, name string, ticker string, year int, figure double")
    right = spark.createDataFrame([("e1", "Gruskobre (NYSE: BGSK)", 2011, 5000.0), ("e2", "Talvexmor", 2011, 5000.0)], "entity string, name string, year int, figure double")
    best = M.match_entities(left, right, spark.createDataFrame([], "group string, entity string"))
    assert [(r.group, r.entity, r.confidence >= M.MATCH) for r in best.collect()] == [("t:BGSK", "e1", True)]


def test_every_single_edit_is_met(spark):
    """Whatever the length of the key and the kind of edit, the two searches together meet it."""
    from quarrylane.llm.edit_keys import one_edit_keys

    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(n))
    words = list({word(n) for n in range(3, 15) for _ in range(6)})
    edits = {}
    for w in words:
        i = rnd.randrange(len(w) - 1)
        for e in (w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]):
            edits.setdefault(e, set()).add(w)
    frame = lambda x: Q.with_vectors(spark.createDataFrame([(w,) for w in x], "key string"), "key")
    a, b = frame(edits), frame(words)
    got = {tuple(r) for r in Q.close_keys(a, b).select("left", "right").union(one_edit_keys(a, b)).collect()}
    assert {(e, w) for e, ws in edits.items() for w in ws} <= got


def test_initials_and_reliability(spark, world):
    left, right, known, truth = world
    extra = spark.createDataFrame([("i:1", "QZX Inc.", None, 2011, 777_000.0)], "group string, name string, ticker string, year int, figure double")
    filer = spark.createDataFrame([("e999", "Quellmor Zinc Xylene Inc", 2011, 776_000.0)], "entity string, name string, year int, figure double")
    best = M.match_entities(left.unionByName(extra), right.unionByName(filer), known)
    r = best.where("group = 'i:1'").first()
    assert r.entity == "e999" and r.score > 0.8
    by_tenth = M.reliability(best).collect()
    assert sum(x.n for x in by_tenth) > 20
    top, low = next(x for x in by_tenth if x.tenth == 9), next(x for x in by_tenth if x.tenth == 0)
    assert top.share_true > 0.85 and low.share_true < 0.15


def test_dice():
    assert Q.dice(Q.vector("abc"), Q.vector("abc")) == 1.0
    assert Q.dice(0, 0) == 0.0


def test_names():
    p = M.parse_name("Ostrel Merger Sub LLC d/b/a Gadumont Kitchens, Inc. (QXE: WKEXC)")
    assert p["words"] == ["gadumont", "kitchens"] and p["ticker"] == "WKEXC" and p["initials"] == "gki"
    assert M.parse_name("Bécastead Photonics")["words"] == ["becastead", "photonics"]
    assert M.parse_name(None)["words"] == [] and M.parse_name("")["words"] == []
    assert M._edits("abcd", "abdc", 2) == 1 and M._edits("abc", "xyz", 2) == 3 and M._edits("", "", 1) == 0
    for short, long in (("hydr", "hydraulics"), ("pkg", "packaging"), ("med", "medical")):
        assert M._short_for(short, long)
    assert not M._short_for("toys", "tooling")


@pytest.mark.parametrize("left,ok", [("Vexmor Staffing", True), ("Staffing of Vexmor", True), ("Vex mor Staffing", True), ("Vexmorstaffing", True), ("Vexmro Staff.", True), ("Vexmor Toys", False), ("Dalzen Staffing", False)])
def test_compare(left, ok):
    words, right = M.parse_name(left)["words"], ["vexmor", "staffing"]
    c, rest, known, _ = M.compare_names(words, right, set(words), {"vexmor"})
    assert (c >= 0.8 and (not known or rest > 0)) == ok


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(9)
    filers = {}
    while len(filers) < 160:
        filers[core(rnd)] = rnd.choice(SECTORS)
    filers = [(f"e{i:03d}", c, s, rnd.uniform(10, 5000)) for i, (c, s) in enumerate(filers.items())]
    right = [(e, f"{c} {s} Inc", y, f * 1.05 ** (y - 2010) * 1000) for e, c, s, f in filers for y in (2010, 2011, 2012)]
    right += [(e, f"{c.upper()} {s.upper()} INC /DE/", 2012, None) for e, c, s, _ in filers[:50]] + right[:5] + [(None, "No Key Inc", 2010, 5.0), ("e000", None, 2010, None)]
    left, truth = [], {}
    for i, (e, c, s, f) in enumerate(filers):
        g = f"t:{i}"
        name = [f"{c} {s}, Inc.", f"{s} of {c}", f"{c[:4]} {c[4:]} {s}", f"{c}{s.lower()} plc", f"{c[:5]}{c[6]}{c[5]}{c[7:]} {s}", f"{c} {s[:4]}."][i % 6]
        left.append((g, name, f"TK{i}", 2011, f * 1.05 * 1000 * rnd.uniform(0.97, 1.03)))
        truth[g] = e
    for i in range(40):  # companies that do not file, some with a filer's first word
        c = filers[i][1] if i % 2 else core(rnd) + "o"
        s = next(x for x in SECTORS if x != filers[i][2])
        left.append((f"x:{i}", f"{c} {s} plc", None, 2011, filers[i][3] * 40_000))
    left += [("t:0", left[0][1], None, None, None), ("n:null", None, None, 2011, 1.0)] + left[:3]
    known = [(f"t:{i}", e) for i, (e, *_) in enumerate(filers) if i % 6 == 0]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    return frame(left, "group string, name string, ticker string, year int, figure double"), frame(right, "entity string, name string, year int, figure double"), frame(known, "group string, entity string"), truth


def test_matching(world):
    left, right, known, truth = world
    left = left.withColumn("entity", F.lit("clash")).withColumn("key", F.lit(1))
    rows = M.match_entities(left, right, known).collect()
    assert len({r.group for r in rows}) == len(rows)
    found = {r.group: r.entity for r in rows if r.confidence >= M.MATCH}
    right_ones = sum(found.get(g) == e for g, e in truth.items())
    assert right_ones >= 0.95 * len(truth)
    assert sum(truth.get(g) != e for g, e in found.items()) <= 0.03 * len(found)


def test_empty_sides(spark, world):
    left, right, known, _ = world
    assert M.match_entities(left.limit(0), right, known).count() == 0
    assert M.match_entities(left, right.limit(0), known).count() == 0
    assert M.match_entities(left, right, known.limit(0)).where("confidence >= 0.5").count() > 100


def test_logistic():
    x = np.array([0.2, 0.3, 0.4, 0.6, 0.7, 0.9] * 20)
    slope, offset = M.fit_logistic(x, (x > 0.5).astype(float), np.ones(len(x)))
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    assert slope > 0 and ((p > 0.5) == (x > 0.5)).all()


def test_slip(spark):
    df = spark.createDataFrame([("ABCD", "ABCD"), ("ABCD", "ABDC"), ("ABCD", "ABCCD"), ("ABCD", "WXYZ"), ("ABCD", None)], "a string, b string")
    assert [r[0] for r in df.select(M.slip("a", "b")).collect()] == [True, True, True, False, None]


@pytest.fixture
def plans(monkeypatch):
    """First plans of all that the matching writes or checkpoints, in order."""
    from quarrylane.llm import filers

    seen = []
    for module, name in ((M, "write_once"), (filers, "cut_lineage")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, real=real: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    return seen


def test_nothing_that_grows_is_broadcast(spark, plans):
    """Whatever Spark takes the sides of a join for, none of them is gathered on the driver."""
    from quarrylane.llm.filers import p1_found

    found = p1_found(spark, "/root/testdata/sf0.001")
    assert found.count() > 5
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) >= 5
    assert not [p for p in plans if "Broadcast" in p]


def test_pairs_of_the_fit_are_chosen_before_they_are_collected(spark, plans, monkeypatch):
    """Each task's largest rows are merged on an executor; the driver gets FIT_PAIRS rows, not that many of every task."""
    monkeypatch.setattr(M, "FIT_PAIRS", 40)
    best = spark.range(400, numPartitions=8).select(F.concat(F.lit("t:"), "id").alias("group"), F.lit(1).alias("n_true"), (0.5 + F.col("id") / 1000).alias("true_score"), (F.col("id") / 1000).alias("other_score"))
    told = M.known_scores(best).orderBy(F.xxhash64("group"), "y").limit(40).toPandas()
    assert M.calibrate(best) == pytest.approx(M.fit_logistic(told["score"].to_numpy(), told["y"].to_numpy(), np.full(40, 1 / 40), ridge=1e-5))
    assert len(plans) == 1 and "TakeOrdered" in plans[0]

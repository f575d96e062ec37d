import pytest
from pyspark.sql import functions as F

from quarrylane.operators import corpus as C

SECTORS = ["Technology", "Healthcare", "Finance", "Utilities", "Consumer"]


@pytest.fixture(scope="module")
def drawn(spark):
    pool = [(f"T{i:03d}", SECTORS[i % 5], C.SIZE_LABELS[i % 4] if i % 11 else "Unknown") for i in range(400)]
    deals = [(f"d{i}", f"T{i:03d}", SECTORS[i % 5], C.SIZE_LABELS[i % 5]) for i in range(30)] + [("x", None, "Nowhere", "Unknown"), (None, "T001", "Finance", "$2-10B")]
    p, d = spark.createDataFrame(pool, "ticker string, sector string, size string"), spark.createDataFrame(deals, "deal_id string, ticker string, sector string, size string")
    return pool, deals, C.draw_candidates(d, p), d, p


def test_quotas(drawn):
    pool, deals, out, d, p = drawn
    rows = out.collect()
    of = {t: (s, z) for t, s, z in pool}
    by = {}
    for r in rows:
        by.setdefault(r.deal_id, []).append(r)
    assert set(by) == {x[0] for x in deals if x[0]}
    for deal, own, sector, size in deals[:30]:
        got = by[deal]
        assert len(got) == len({r.ticker for r in got}) == 49 and own not in {r.ticker for r in got}
        n = {s: sum(r.stratum == s for r in got) for s in ("same", "adjacent", "other", "fill")}
        assert n["same"] <= 22 and n["adjacent"] <= 18 and n["other"] <= 9 and sum(n.values()) == 49
        assert all(of[r.ticker][0] == sector for r in got if r.stratum == "same")
        assert all(of[r.ticker][0] != sector for r in got if r.stratum == "other")
        window = {C.SIZE_LABELS[j] for j in range(5) if abs(j - C.SIZE_LABELS.index(size)) <= 1}
        assert all(of[r.ticker][1] in window for r in got if r.stratum != "fill")
    assert len(by["x"]) == 49


def test_draw_does_not_depend_on_layout(drawn):
    _, _, out, d, p = drawn
    again = C.draw_candidates(d.repartition(5), p.repartition(3))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_small_pool(spark):
    p = spark.createDataFrame([("A", "Finance", "$2-10B"), ("B", "Finance", "$2-10B")], "ticker string, sector string, size string")
    d = spark.createDataFrame([("d", "A", "Finance", "$2-10B")], "deal_id string, ticker string, sector string, size string")
    assert [r.ticker for r in C.draw_candidates(d, p).collect()] == ["B"]
    assert C.draw_candidates(d, p.limit(0)).count() == 0
    assert C.draw_candidates(d.limit(0), p).count() == 0


def test_numbers_are_a_permutation(drawn):
    numbered = C.number_candidates(drawn[2].select("deal_id", "ticker"))
    for r in numbered.groupBy("deal_id").agg(F.sort_array(F.collect_list("candidate_no")).alias("n")).collect():
        assert r.n == list(range(1, 50))


def test_seed(spark):
    assert spark.createDataFrame([("SPTRD1880825",)], "d string").select(C.seed_of(F.col("d"))).first()[0] == 2033744129


def wide(spark, rows):
    df = spark.createDataFrame(rows, "deal_id string, no int, line string, ticker string, hit boolean")
    return C.to_wide(df, "deal_id", "no", "line", "ticker", "hit").withColumn("target", F.lit("T07"))


def test_invariants(spark):
    good = [("d", i, f"Candidate #{i:02d} | x", f"T{i:02d}", i == 7) for i in range(1, 51)]
    assert C.violations(wide(spark, good), "deal_id", "target").count() == 0
    C.assert_valid(wide(spark, good), "deal_id", "target")
    short = good[:49]
    found = {r.problem for r in C.violations(wide(spark, short), "deal_id", "target").collect()}
    assert found == {"line_count", "numbers"}
    twice = good[:48] + [("d", 49, "Candidate #49 | x", "t07", False), ("d", 50, "Candidate #50 | x", None, None)]
    assert {r.problem for r in C.violations(wide(spark, twice), "deal_id", "target").collect()} == {"duplicate_tickers", "target_not_once"}
    with pytest.raises(C.CorpusError, match="line_count"):
        C.assert_valid(wide(spark, short), "deal_id", "target")
    none = [(a, b, c, d, False) for a, b, c, d, _ in good]
    assert {r.problem for r in C.violations(wide(spark, none), "deal_id", "target").collect()} == {"position"}
    both = wide(spark, good).unionByName(wide(spark, good))
    assert {r.problem for r in C.violations(both, "deal_id", "target").collect()} == {"duplicate_key"}


def test_lines(spark):
    df = spark.createDataFrame([(3, "Tech", "$1", "$2", "words")], "n int, i string, s string, r string, d string")
    line = C.candidate_line(*[F.col(c) for c in "nisrd"])
    r = df.select(line.alias("l")).select("l", C.line_number(F.col("l")).alias("n"), C.without_description(F.col("l")).alias("w")).first()
    assert r.l == "Candidate #03 | Industry: Tech | Market Cap: $1 | Revenue: $2 | Description: words" and r.n == 3 and r.w == "Candidate #03 | Industry: Tech | Market Cap: $1 | Revenue: $2"

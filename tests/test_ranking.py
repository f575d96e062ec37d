import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylane.functions import ranking as R


def one(spark, value, fn, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("... FINAL RANKING: [2, 1, 7, 4, 5, 10, 6, 9, 3, 8]", [2, 1, 7, 4, 5, 10, 6, 9, 3, 8]),
        ("FINAL RANKING: [1, 2]\nFINAL RANKING: [3, 4]", [3, 4]),
        ('{"ranking": [9, 8]}\nFINAL RANKING: [1, 2]', [9, 8]),
        ("Rank 2: #05 and Rank 1: Candidate #7", [7, 5]),
        ("Candidate #5 beats #9", []),
        ("FINAL RANKING: [100, 7]", [10, 7]),
        ("FINAL RANKING: []\nRank 1: #3", [3]),
        ('{"ranking": ["12", 12, 0, 51, 4]}', [12, 4]),
        ('{"ranking": [1, 2', []),
        ("", []),
        (None, []),
    ],
)
def test_strict_parser(spark, text, want):
    assert one(spark, text, R.parse_ranking) == want


def test_loose_parser(spark):
    assert one(spark, "Candidate #5 beats #9", R.parse_ranking_loose) == [5, 9]
    assert one(spark, None, R.parse_ranking_loose) == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("1. - **Acme Robotics** — why", ["**Acme Robotics**"]),
        ("1. Coca-Cola — why", ["Coca"]),
        ('x\nFINAL TARGETS: ["A Co", "B Co"]', ["A Co", "B Co"]),
        ('{"targets": ["X", " ", "Y"]}', ["X", "Y"]),
        ("prose only", []),
        (None, []),
    ],
)
def test_names(spark, text, want):
    assert one(spark, text, R.parse_names) == want


def test_metrics(spark):
    df = spark.createDataFrame([([45, 12, 7], 7), (list(range(1, 51)), 11), ([], 3), (None, 3), ([3], None)], "r array<int>, t int")
    rows = df.select(*[c.alias(k) for k, c in R.metrics(F.col("r"), F.col("t")).items()]).collect()
    assert rows[0].mrr == pytest.approx(1 / 3) and rows[0].ndcg_5 == 0.5 and rows[0].target_rank == 3
    assert rows[1].mrr == 0 and rows[1].target_rank is None
    assert all(r.mrr == 0 and r.recall_10 == 0 for r in rows[2:])
    assert R.chance_reciprocal_rank() == pytest.approx(0.05857936507936508)
    assert R.chance_recall(5) == 0.1


def test_ordered_distinct(spark):
    assert one(spark, [0, 3, 3, 51, 2], R.ordered_distinct, "x array<int>") == [3, 2]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=15, unique=True), st.integers(1, 50))
def test_metric_bounds(spark, ids, target):
    df = spark.createDataFrame([(ids, target)], "r array<int>, t int")
    m = df.select(*[c.alias(k) for k, c in R.metrics(F.col("r"), F.col("t")).items()]).first()
    assert 0 <= m.recall_1 <= m.recall_5 <= m.recall_10 <= 1
    assert m.mrr <= m.recall_10

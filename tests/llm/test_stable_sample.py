import random

from pyspark.sql import functions as F

from quarrylane.llm import stable_sample as S


def ids(n, seed=1):
    rnd = random.Random(seed)
    return [f"DLX{rnd.randrange(10**7):07d}" if rnd.random() < 0.5 else f"DL-{rnd.randrange(1999, 2025)}-{rnd.randrange(10**7):07d}" for _ in range(n)]


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "k string")


def test_permutation_can_be_undone_and_never_collides(spark):
    keys = sorted(set(ids(3000))) + ["A", "AA", "0", "_-_", "Z" * 22]
    rows = S.permuted(frame(spark, keys), "k", "s").collect()
    assert len({(r.permuted_high, r.permuted_low) for r in rows}) == len(keys)
    assert all(0 <= r.permuted_high < S.MODULUS and 0 <= r.permuted_low < S.MODULUS for r in rows)
    import hashlib

    def number(half):
        n = 0
        for c in half:
            n = n * S.BASE + S.ALPHABET.find(c) + 1
        return n

    for r in rows[:50] + rows[-5:]:  # the rounds backwards give the identifier's number
        left, right = r.permuted_high, r.permuted_low
        for i in reversed(range(S.ROUNDS)):
            f = int(hashlib.md5(f"s|{i}|{left}".encode()).hexdigest()[:15], 16) % S.MODULUS
            left, right = (right - f) % S.MODULUS, left
        k = r.k.ljust(22)
        assert (left, right) == (number(k[:11]), number(k[11:]))


def test_sample_is_stable_and_near_its_rate(spark):
    first, later = ids(4000), ids(4000, 2)
    one = {r.k for r in S.stable_sample(frame(spark, first), "k", "0.1").collect()}
    both = {r.k for r in S.stable_sample(frame(spark, later + first).repartition(7), "k", "0.1").collect()}
    assert both & set(first) == one
    assert 0.08 < len(one) / len(set(first)) < 0.12
    assert one <= {r.k for r in S.stable_sample(frame(spark, first), "k", "0.25").collect()}
    assert S.stable_sample(frame(spark, first), "k", "0").count() == 0
    assert S.stable_sample(frame(spark, first), "k", "1").count() == len(first)


def test_nulls_repeats_strange_keys_and_empty(spark):
    keys = [None, "a", "a", "é" * 40, "x" * 5000, "k with blanks"]
    rows = S.stable_sample(frame(spark, keys), "k", "1").collect()
    assert sorted(r.k for r in rows) == sorted(k for k in keys if k)
    assert S.stable_sample(frame(spark, []), "k", "0.5").count() == 0
    extra = frame(spark, ["a"]).withColumn("left", F.lit(1)).withColumn("l", F.lit(2))
    assert S.stable_sample(extra, "k", "1").first()["l"] == 2


def test_canonical(spark):
    got = [r[0] for r in frame(spark, [" dlx1 ", "DLX1", "\t", None, " dlx1"]).select(S.canonical("k")).collect()]
    assert got == ["DLX1", "DLX1", None, None, "DLX1"]

import random

from pyspark.sql import functions as F

from quarrylane.llm import edit_keys as E
from quarrylane.llm import matching as M


def edits(w, rnd):
    """One edit of each kind at each place."""
    for i in range(len(w)):
        x = rnd.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != w[i]])
        yield from (("missing", w[:i] + w[i + 1 :]), ("added", w[:i] + x + w[i:]), ("replaced", w[:i] + x + w[i + 1 :]))
        if i + 1 < len(w) and w[i] != w[i + 1]:
            yield "swapped", w[:i] + w[i + 1] + w[i] + w[i + 2 :]


def test_every_single_edit_is_found(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (5, 6, 7, 8, 10) for _ in range(12)} | {"aabbaa", "aaaaa"})
    made = {(kind, e, w) for w in words for kind, e in edits(w, rnd) if e != w}
    frame = lambda x: spark.createDataFrame([(w,) for w in sorted(x)] + [(None,), ("",)], "key string")
    lefts = {e for _, e, _ in made}
    got = {(r.left, r.right) for r in E.one_edit_keys(frame(lefts), frame(words)).collect()}
    for kind in ("missing", "added", "replaced", "swapped"):
        assert {(e, w) for k, e, w in made if k == kind} <= got, kind
    assert got == {(a, b) for a in lefts for b in words if M._edits(a, b, 1) == 1}


def test_swapped_core_with_other_second_word(spark):
    # no joined key is close here: only the swapped core leads to the filer
    cores = ["bresko", "talvex", "morlin", "grudal", "prazen", "firhol"]
    right = [(f"e{i}", f"{c.title()} Hydraulics Inc", 2011, 1000.0 * (i + 1)) for i, c in enumerate(cores)]
    left = [(f"t:{i}", f"{c[:2]}{c[3]}{c[2]}{c[4:]}".title() + " Hydr.", None, 2011, 1000.0 * (i + 1)) for i, c in enumerate(cores)]
    none = spark.createDataFrame([], "group string, entity string")
    # many names share the second word, so that it is no key
    right += [(f"o{i}", f"{a}{b} Hydraulics", 2011, 9e6) for i, (a, b) in enumerate((a, b) for a in ("Wod", "Juk", "Yig") for b in ("quut", "nij", "kyo", "wuff", "xobb"))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = M.match_entities(frame(left, "group string, name string, ticker string, year int, figure double"), frame(right, "entity string, name string, year int, figure double"), none)
    assert {r.group: r.entity for r in rows.where(F.col("confidence") >= M.MATCH).collect()} == {f"t:{i}": f"e{i}" for i in range(len(cores))}


def test_no_search_is_broadcast(spark):
    """A small table of keys has many more forms than Spark reckons with; none of them is gathered on the driver."""
    from quarrylane.llm.qgram_bits import keys_within, with_vectors

    keys = with_vectors(spark.createDataFrame([("bresko",), ("talvex",)], "key string"), "key")
    for met in (E.one_edit_keys(keys, keys), keys_within(keys, keys)):
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Exchange" in plan

import pytest
from pyspark.sql import functions as F

from quarrylane.functions import business as V
from quarrylane.functions import names as N
from quarrylane.functions import redaction as D
from quarrylane.functions import similarity as S
from quarrylane.operators.entities import dictionary, fuzzy_match, rule_match


def one(spark, value, fn, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(fn(F.col("x")).alias("y")).first()["y"]


def test_normal_forms(spark):
    amazon = "Amazon.com, Inc. (NasdaqGS:AMZN)"
    assert one(spark, amazon, lambda c: N.normalize(c, "merge")) == "amazoncom"
    assert one(spark, amazon, lambda c: N.normalize(c, "entity")) == "amazon com"
    assert one(spark, "1Life Healthcare, Inc. (d/b/a One Medical)", lambda c: N.normalize(c, "entity")) == "1life healthcare"
    assert one(spark, "Société Générale SA", lambda c: N.normalize(c, "entity")) == "société générale"
    for form in ("merge", "pit", "entity"):
        again = one(spark, amazon, lambda c, f=form: N.normalize(N.normalize(c, f), f))
        assert again == one(spark, amazon, lambda c, f=form: N.normalize(c, f))
        assert one(spark, None, lambda c, f=form: N.normalize(c, f)) is None


def test_aliases(spark):
    got = one(spark, "1Life Healthcare, Inc. (d/b/a One Medical)", N.aliases)
    assert "1Life Healthcare" in got and any(a.startswith("One Medical") for a in got)
    assert one(spark, "IT", lambda c: N.is_ambiguous(N.normalize(c, "entity")))


def test_tickers_in_names(spark):
    df = spark.createDataFrame([("it services", "IT"), ("IT services", "IT"), ("buy amzn now", "AMZN"), (None, "AMZN"), ("x", None)], "p string, t string")
    assert [r[0] for r in df.select(N.has_ticker(F.col("p"), F.col("t"))).collect()] == [False, True, True, None, False]


@pytest.mark.parametrize("value,want", [(0.0, "<$100M"), (99.99, "<$100M"), (100.0, "$100-500M"), (10000.0, ">$10B"), (-1.0, "Unknown"), (None, "Unknown"), (float("nan"), "Unknown"), (float("inf"), "Unknown")])
def test_size_bucket(spark, value, want):
    assert one(spark, value, V.size_bucket, "x double") == want


@pytest.mark.parametrize("value,want", [("Prepackaged Software (7372)", "Technology"), ("3674", "Technology"), ("9995", "SPAC"), ("3835", "Other"), ("abc", "Unknown"), (None, "Unknown"), ("7990", "Consumer")])
def test_sector(spark, value, want):
    assert one(spark, value, V.sector) == want


def redacted(spark, text, name, ticker, year):
    df = spark.createDataFrame([(text, name, ticker, year)], "t string, n string, k string, y int")
    red = D.redact(F.col("t"), N.aliases(F.col("n")), F.col("k"), F.col("y"))
    return df.select(red.alias("r"), D.residual(red, F.col("n")).alias("left")).first()


def test_redaction(spark):
    assert redacted(spark, "Acme was acquired by Foo. Acme makes bolts.", "Acme", None, 2020).r == "[COMPANY] makes bolts."
    r = redacted(spark, "Acme Robotics, Inc. (NYSE: ACR) builds arms. See www.acme.com. In 2022 it grew. ACR trades.", "Acme Robotics, Inc.", "ACR", 2020)
    assert "Acme" not in r.r and "ACR" not in r.r and "2022" not in r.r and not r.left
    assert redacted(spark, None, "Acme", None, 2020).r == ""
    assert redacted(spark, "A.B (x) [y] \\E $1 stays", "A.B (x) [y] \\E $1", "", None).r == "[COMPANY] stays"
    assert redacted(spark, "Robotics firm", "Acme Robotics", None, None).left


def test_description_sources(spark):
    long = "Acme Robotics, Inc. builds welding arms for shipyards and sells them through nine distributors."
    rows = [(long, "fallback text"), ("too short", long), (None, long), (None, None), (long.replace("Inc.", "Inc. and RoboticsOne"), None), (None, "Robotics of all kinds are sold here by the firm, which has many plants.")]
    df = spark.createDataFrame(rows, "pit string, fb string").withColumn("n", F.lit("Acme Robotics, Inc."))
    d = D.described(F.col("pit"), F.col("fb"), N.aliases(F.col("n")), F.col("n"), F.lit(None).cast("string"), F.lit(2020))
    got = df.select(*[c.alias(k) for k, c in d.items()]).collect()
    assert [r.source for r in got] == ["pit", "fallback", "fallback", "fallback_empty", "pit", "fallback"]
    assert got[0].description == got[1].description and "Acme" not in got[0].description and not got[0].residual
    assert got[3].description == got[5].description == D.NO_DESCRIPTION and got[5].residual and not got[3].residual


def test_masking(spark):
    df = spark.createDataFrame([("Campbell&#39;s sells soup. CPB rose. Campbell grew.", "Campbell Soup Company (NYSE:CPB)", "CPB"), (None, "X", None), ("text", None, None)], "t string, n string, k string")
    got = [r[0] for r in df.select(D.mask_acquirer(F.col("t"), F.col("n"), F.col("k"))).collect()]
    assert "Campbell" not in got[0] and got[1] is None and got[2] == "text"


def test_overlap(spark):
    f = spark.createDataFrame([("Acme Bolts", "Acme Bolts"), ("a1 b1", "c1 d1"), ("", ""), ("", "x1")], "a string, b string")
    a, b = S.name_words(F.col("a")), S.name_words(F.col("b"))
    assert [tuple(r) for r in f.select(S.f1(a, b), S.jaccard(a, b)).collect()] == [(1.0, 1.0), (0.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    assert one(spark, "AAPL, msft. the 3M IT", S.tickers) == ["AAPL", "MSFT"]


def test_indel():
    assert S.indel("", "") == 100 and S.indel("abc", "") == 0
    assert S.indel("kitten", "sitting") == pytest.approx(200 * 4 / 13)
    assert S.token_sort("new york mets", "mets york new") == 100
    assert S.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100


def test_resolution(spark):
    df = spark.createDataFrame(
        [("Aerohive Networks Inc", "Aerohive Networks, Inc.", "HIVE"), ("Aryaka Networks", "Aerohive Networks, Inc.", "HIVE"), ("buy HIVE", "Aerohive Networks, Inc.", "HIVE"), ("Aerohive Netwerks Systemz", "Aerohive Networks Systems", None), (None, "A B", None)],
        "p string, t string, k string",
    )
    rows = df.select(rule_match(F.col("p"), F.col("t"), F.col("k"), N.aliases(F.col("t"))).alias("r"), fuzzy_match(F.col("p"), F.col("t")).alias("f")).collect()
    assert [r.r for r in rows] == [True, False, True, False, False]
    assert [r.f for r in rows] == [True, False, False, True, False]


def test_dictionary(spark):
    df = spark.createDataFrame([(1, "Acme, Inc.", "acm"), (2, "ACME Inc", None), (3, "Acme Inc. (NYSE:ACX)", "ACX"), (4, None, "Q"), (5, "Inc.", "Z")], "o int, n string, t string")
    rows = dictionary(df, name="n", ticker="t", order="o").collect()
    assert len(rows) == 1
    assert rows[0].canonical == "Acme, Inc." and rows[0].ticker == "ACX" and "ACME Inc" in rows[0].aliases


def test_html_and_dotted_tickers(spark):
    from quarrylane.functions.names import has_ticker
    from quarrylane.functions.redaction import identity_profile, names_in, profile, unescape

    df = spark.createDataFrame([("Caf&eacute; &#8217;n&#x20;bar &amp; grill", "BRK.B", "sold to BRK.B today"), (None, None, None), ("plain", "AB", "ab AB")], "t string, k string, x string")
    got = df.select(unescape(F.col("t")).alias("t"), has_ticker(F.col("x"), F.col("k")).alias("h")).collect()
    assert [r.t for r in got] == ["Café ’n bar & grill", None, "plain"] and [r.h for r in got] == [True, False, True]
    c = lambda v: F.lit(v).cast("string")
    p = profile(c("Norvane Foods makes bread."), c(None), c("Norvane Foods Inc"), c("NRVN"), F.lit(2015), F.lit(12.5), F.lit(None).cast("double"))
    r = spark.range(1).select(p.alias("p")).select("p", names_in(F.col("p"), c("Norvane Foods Inc")).alias("leak"), names_in(c("by norvane itself"), c("Norvane (X:Y)")).alias("seen"), identity_profile(c("Norvane"), c(None), F.lit(2015), F.lit(1.0), F.lit(2.0)).alias("i")).first()
    assert "[ACQUIRER]" in r.p and "Norvane" not in r.p and "FY2014" in r.p and "Revenue $12.5M | EBITDA margin N/A%" in r.p and not r.leak and r.seen
    assert r.i.startswith("COMPANY: Norvane (N/A)\nFISCAL YEAR: FY2014")


def test_recall_labels(spark):
    from quarrylane.operators.entities import recall_labels

    rows = [
        (1, "It bought Norvane Foods Inc.", "Acme Corp (NYSE:ACM)", 2015, "Norvane Foods Inc.", "NRVN"), (2, "Tarrow Grid", "acme corp", 2015, "Norvane Foods Inc.", "NRVN"), (3, "UNKNOWN", "Acme Corp", 2015, "Tarrow Grid", None),
        (4, "I cannot say", "Acme Corp", 2015, "Tarrow Grid", None), (5, None, None, None, None, None), (6, "Quell Systems", "Acme Corp", 2016, "Norvane Foods Inc.", "NRVN"), (7, "Mellow of Inc", "Zed", 2016, "Mellow Inc", "MLW"),
        (8, "surely NRVN", None, 2016, "Norvane Foods Inc.", "NRVN"),
    ]
    df = spark.createDataFrame(rows, "id int, r string, a string, y int, n string, t string")
    got = {x.id: x for x in recall_labels(df, key="id", response="r", acquirer="a", year="y", name="n", ticker="t").collect()}
    assert {k: x.label for k, x in got.items()} == {1: "SUCCESS", 2: "SUCCESS", 3: "UNKNOWN", 4: "UNKNOWN", 5: "UNKNOWN", 6: "FAILURE", 7: "PARTIAL", 8: "SUCCESS"}
    assert got[2].n_others == 1 and got[6].n_others == 0 and got[1].score == 100 and 85 <= got[7].score <= 100 and got[6].score < 85
    assert recall_labels(df.limit(0), key="id", response="r", acquirer="a", year="y", name="n", ticker="t").count() == 0

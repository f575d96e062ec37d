import random

import numpy as np
from pyspark.sql import functions as F

from quarrylane.llm import layout_hmm as L
from quarrylane.llm.pages import is_spam

SUBJECTS = ["The board", "A regional court", "One large customer", "The finance team", "Our plant in Lindmoor", "The union at Zelford", "Several landlords"]
VERBS = ["approved", "delayed", "tested", "insured", "trimmed", "relocated", "questioned"]
OBJECTS = ["spare parts", "freight rates", "price lists", "safety drills", "rural patents", "audit findings", "storage tanks"]
ENDS = ["although returns were thin", "with the consent of the lenders", "because the market asked for it", "within 40 weeks", "ahead of the June deadline"]
KEYS = ["cheap valuation report", "online buyout financing", "penny stocks", "annual report pdf", "sell my company", "deal sourcing", "exit planning"]


def prose(rnd, n):
    return " ".join(f"{rnd.choice(SUBJECTS)} {rnd.choice(VERBS)} {rnd.choice(OBJECTS)} {rnd.choice(ENDS)}." for _ in range(n))


def spam(rnd, kind):
    if kind == 0:
        return " ".join(rnd.choice(KEYS) for _ in range(120))
    if kind == 1:
        return "\n".join(f"- {rnd.choice(KEYS).title()} = https://site{rnd.randrange(999)}.example/{rnd.randrange(99)}" for _ in range(40))
    if kind == 2:
        return " | ".join(rnd.choice(KEYS).title() for _ in range(60))
    if kind == 3:
        k, j = rnd.sample(KEYS, 2)
        return " ".join(f"Looking for {k}? Get {k} with {j} {k} today. Our {k} is the {k} for {k} buyers who need {j}." for _ in range(12))
    return "\n".join(f"{KEYS[2]} near {c}" for c in ["Lindmoor", "Zelford", "Norwick", "Ostrel", "Kesslow"] * 8)


def documents():
    rnd = random.Random(8)
    good = {i: prose(rnd, rnd.randrange(3, 30)) for i in range(300)}
    good |= {400: prose(rnd, 12) + "\n\nSegment    Sales    Margin\nExport    783.3    23%\nCore    12.1    4%\n\n" + prose(rnd, 6), 401: prose(rnd, 20) + " See https://a.example/x for more.", 402: "Home | News | Contact\n\n" + prose(rnd, 10), 403: prose(rnd, 900)}
    bad = {500 + i: spam(rnd, i % 5) for i in range(40)} | {600 + i: prose(rnd, 2) + "\n\n" + spam(rnd, i % 5) for i in range(10)}
    return good, bad


def test_pages(spark):
    good, bad = documents()
    odd = {700: None, 701: "", 702: " \n ", 703: "...", 704: good[1]}
    rows = [(k, t) for k, t in {**good, **bad, **odd}.items()] + [(500, bad[500])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("words", F.lit(2)).repartition(3)
    got = L.layout_shares(df).collect()
    assert len(got) == len(rows)
    flagged = {r.doc_id for r in got if r.non_prose_share > 0.5}
    assert flagged == set(bad)
    assert all(r.n_words == 0 and r.non_prose_share == 0 for r in got if r.doc_id in (700, 701, 702, 703))
    links = next(r for r in got if r.doc_id == 501)
    assert links.link_words > links.menu_words + links.tag_words
    assert L.layout_shares(df.limit(0)).count() == 0


def test_ordinary_pages_with_lists_and_stubs(spark):
    """Held-out layouts: a glossary, a table, a list, contact lines within sentences, and stubs of a few words."""
    rnd = random.Random(9)
    good, bad = documents()
    around = prose(rnd, 4)
    kept = {
        900: around + "\n\nGlossary\nEBITDA: earnings before interest and taxes\nLTV: loan to value\nSPAC: a company without a business\n\n" + prose(rnd, 3),
        901: around + "\n\n| Segment | Sales | Margin |\n|---|---|---|\n| Pumps | 120 | 12% |\n| Valves | 80 | 9% |\n\n" + prose(rnd, 2),
        902: "The plant makes three products for the region:\n- pumps\n- valves\n- bearings\n\n" + around, 903: around + "\nContact: www.acme.example", 904: "None.", 905: "Page not found.", 906: "Text to follow.", 907: "n/a",
    }
    spam_too = {910: "#" + " #".join(w.title().replace(" ", "") for w in KEYS * 4), 911: spam(rnd, 2) + "\n\n" + prose(rnd, 1)}
    df = spark.createDataFrame([*{**good, **bad, **kept, **spam_too}.items()], "doc_id long, text string")
    flagged = {r.doc_id for r in L.layout_shares(df).where(is_spam()).collect()}
    assert flagged == set(bad) | set(spam_too)


def test_viterbi_against_enumeration():
    from itertools import product

    rnd = np.random.default_rng(0)
    m = L.Model.prior()
    pages = [np.stack([rnd.integers(0, s, n) for s in L.SIZES], axis=1).astype(np.uint8).reshape(n, len(L.SIZES)) for n in (0, 1, 4, 3, 2)]
    for page, states in zip(pages, m.viterbi(pages), strict=True):
        if not len(page):
            assert len(states) == 0
            continue
        e = m.emit[:, page + L.OFFSETS[:-1]].sum(axis=2)
        score = lambda p: m.start[p[0]] + sum(e[s, i] for i, s in enumerate(p)) + sum(m.move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731, B023
        best = max(product(range(L.K), repeat=len(page)), key=score)
        assert score(states.tolist()) >= score(best) - 1e-9


def test_tables_are_chances():
    for rows in L.EMISSIONS.values():
        assert len(rows) == L.K and all(abs(sum(r) - 1) < 1e-9 for r in rows)
    assert abs(L.START.sum() - 1) < 1e-9

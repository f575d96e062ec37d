import random

import pytest
from pyspark.sql import functions as F

from quarrylane.llm.answers import is_placeholder, is_refusal
from quarrylane.llm.languages import language
from quarrylane.llm.pairs import CopyMeter, judge
from quarrylane.llm.truncation import cut_texts, describe, trie

WORDS = "margin revenue customer network pumps bearings software pricing quality regional depot plan filing service segment growth brand patents labor capital".split()


def answer(rnd, n=10, closing=True, dot=True):
    lines = [f"Rank {i}: Candidate #{rnd.randrange(1, 51):02d} — Score: {11 - i}/10 — Its {rnd.choice(WORDS)} supports the {rnd.choice(WORDS)} in the filing" + "." * dot for i in range(1, n + 1)]
    return "\n".join(lines) + ("\n\nFINAL RANKING: [" + ", ".join(str(rnd.randrange(1, 51)) for _ in range(n)) + "]" if closing else "")


def _cases():
    rnd = random.Random(6)
    full = [answer(rnd, closing=i % 4 != 0, dot=i % 3 != 0) for i in range(420)]
    broken = {}
    for j in range(5):
        one = full[j * 12 + 1 : j * 12 + 13]
        broken |= {
            1000 + 10 * j: one[0][: one[0].rindex("supports") + 4],  # in a word
            1001 + 10 * j: one[1][: one[1].rindex("[") + 5],  # in the closing line
            1002 + 10 * j: "\n".join(one[2].split("\n")[: 4 + j]),  # after a line
            1003 + 10 * j: one[4][: 300 + j] + "…",
            1004 + 10 * j: one[5][: one[5].index("\n\n")].rsplit(" the ", 1)[0] + " the",  # after a known word
            1005 + 10 * j: one[6][: 200 + j] + "�",
        }
    whole = {2000: "FINAL RANKING: [1, 2]", 2001: None, 2002: "", 2003: "   ", 2004: '{"ranking": []}', 2005: "word " * 20_000 + "\n" + full[9], 2006: full[10]}
    rows = [(i, t, "B", False) for i, t in enumerate(full)]
    return rows + [(k, t, "B", False) for k, t in {**broken, **whole}.items()] + [(1000, broken[1000], "B", False)], broken


def _cut(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string, cond string, met boolean").withColumn("k", F.lit("x")).withColumn("n", F.lit(0))
    return {r.id: r for r in cut_texts(df, key="id", text="text", group="cond", limit=F.col("met")).collect()}


def test_cuts_are_found_at_any_size(spark):
    rows, broken = _cases()
    got = _cut(spark, rows)
    assert {k for k, r in got.items() if r.is_cut} == set(broken)
    assert got[1000].final == 5 and got[1001].open and got[1002].listed == 1 and got[1003].marker and got[1004].context == 0
    assert not set(got) & {2001, 2002, 2003, 2004}
    # the same texts ten times under other keys: the same verdicts
    again = _cut(spark, [(k + 10_000 * i, *rest) for i in range(10) for k, *rest in rows])
    assert {k for k, r in again.items() if r.is_cut} == {k + 10_000 * i for i in range(10) for k in broken}


def test_texts_without_lists(spark):
    """Plain sentences: the trie and the terminal context decide alone."""
    rnd = random.Random(3)
    text = lambda: " ".join(f"The {rnd.choice(WORDS)} of the {rnd.choice(WORDS)} supports {rnd.choice(WORDS)} and {rnd.choice(WORDS)} this year." for _ in range(6))
    full = [text() for _ in range(300)]
    stumps = [t[: t.rindex("supports") + 3 + i % 4] for i, t in enumerate(full[:20])]
    got = _cut(spark, [(i, t, "g", False) for i, t in enumerate([*full, *stumps])])
    assert {k for k, r in got.items() if r.is_cut} == set(range(300, 320))


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string, cond string")
    assert cut_texts(df, key="id", text="text", group="cond").count() == 0


def test_trie(spark):
    df = spark.createDataFrame([("car", 5), ("cart", 2), ("dog", 1)], "k string, n long")
    got = {r.prefix: (r.as_word, r.begins) for r in trie(df).collect()}
    assert got["car"] == (5, 2) and got["ca"] == (0, 5) and got["dog"] == (1, 0) and len(got) == 7


def test_describe_handles_odd_texts():
    for t in ("x", "\n\n.", "```", "- a\n- b", "1.", "| 1 |", "é", "#", "[", '{"', "a" * 100_000):
        assert isinstance(describe(t), dict)


def test_placeholders_refusals_languages():
    assert all(map(is_placeholder, [None, "", " \n", "...", "**", "N/A", "[]", "{}", "```json\n{}\n```", "<think>\n</think>", '{"ranking": []}', "FINAL RANKING: []", "​", "None"]))
    assert not any(map(is_placeholder, ["No", "Acme", '{"ranking": [3]}', "收入稳定"]))
    assert all(map(is_refusal, ["I'm sorry, but I won't give an ordering here.", "Can't do that.", "Request declined.", "No comment on specific acquisition targets is possible from my side.", "This request conflicts with my usage policy."]))
    assert all(map(is_refusal, ["Regretfully I must abstain.", "rankings of real firms are off the table for me.", "I'm unable to comply with this."]))
    held_out = ["I can't rule out the others, but the strongest fit is Candidate #7.", "Vexmor Staffing, then Dalzen. I won't list the rest.", "Candidate #4 would not accept an offer, Candidate #5 would."]
    assert not any(map(is_refusal, held_out))
    assert not any(map(is_refusal, ["I cannot verify the audited figures.\n\nRank 1: Candidate #04 — fits", "I am unable to see post-deal data. FINAL RANKING: [1, 2]"]))
    assert is_refusal("I am not able to say what Vexmor Staffing will buy.", "The acquirer is Vexmor Staffing.")


HELD_OUT = {
    "en": "The candidate fits the profile because revenue growth is stable.", "de": "Der Umsatz ist stabil, und das Angebot schließt eine Lücke im Profil.", "fr": "Le chiffre d'affaires est régulier et comble un manque du profil.",
    "es": "El tamaño encaja con el presupuesto y la integración parece sencilla.", "pt": "As receitas são estáveis e preenchem uma lacuna do perfil.", "it": "La crescita dei ricavi rende il candidato adatto al profilo.",
    "nl": "Eerst vergeleek ik de sector en de omzet, daarna de kandidaten.", "pl": "Najpierw porównałem sektor i przychody, a następnie oceniłem dopasowanie kandydatów.",
    "sv": "Jag jämförde först bransch och omsättning och bedömde sedan hur bra kandidaterna passar.", "da": "Jeg sammenlignede først branche og omsætning og vurderede derefter, hvor godt kandidaterne passer.",
    "tr": "Önce sektörü ve gelirleri karşılaştırdım, sonra adayların uygunluğunu değerlendirdim.", "ro": "Mai întâi am comparat sectorul și veniturile, apoi am evaluat candidații.",
    "id": "Pertama saya membandingkan sektor dan pendapatan, kemudian menilai kecocokan kandidat.", "vi": "Trước tiên tôi so sánh ngành và doanh thu, sau đó đánh giá mức độ phù hợp của các ứng viên.",
    "hu": "Először összehasonlítottam az ágazatot és az árbevételt, majd értékeltem a jelöltek illeszkedését.", "fi": "Vertasin ensin toimialaa ja liikevaihtoa ja arvioin sitten ehdokkaiden sopivuutta.",
    "cs": "Nejprve jsem porovnal odvětví a tržby a poté jsem posoudil kandidáty.", "lt": "Pirmiausia palyginau sektorių ir pajamas, tada įvertinau kandidatus.", "hr": "Prvo sam usporedio sektor i prihode, a zatim ocijenio kandidate.",
    "ru": "Сначала я сравнил отрасль и выручку, затем оценил кандидатов.", "ja": "まず業種と売上高を比較し、その後候補企業を評価しました。", "zh": "首先比较行业和收入,然后评估候选公司。",
}


@pytest.mark.parametrize("name", HELD_OUT)
def test_languages(name):
    assert language(HELD_OUT[name], "en") == name and language(HELD_OUT[name]) == name


def test_odd_languages():
    assert language("#39: 收入稳定，弥补了现有产品的不足。 FINAL RANKING: [39]", "en") == "zh"
    assert language("") is None and language("#12 #13") is None and language("Rank 1: Candidate #08 — Score: 10/10 — Enzyme therapies; crop insurance.", "en") == "en"


def test_copy_meter():
    prompt = "You advise boards. " + " ".join(f"Candidate #{i} | Industry: {w} | makes {w} for the {WORDS[-i % 20]} market." for i, w in enumerate(WORDS * 3))
    m = CopyMeter()
    assert m.share(prompt, prompt[100:600].upper()) < 0.1
    assert m.share(prompt, "> " + prompt[40:400].replace("market.", "market.\n>")) < 0.2
    rnd = random.Random(1)
    assert m.share(prompt, answer(rnd)) > 0.25
    assert not m.is_copy("tiny", m.share(prompt, "tiny"))


def test_judge(spark):
    rnd = random.Random(2)
    prompt = "Rank the companies. " + " ".join(f"Candidate #{i} | Industry: {w} with {WORDS[-i % 20]} and {WORDS[i * 7 % 20]}." for i, w in enumerate(WORDS * 2))
    rows = [
        (1, "h", prompt[50:500]), (2, "h", answer(rnd)), (3, "h", None), (4, "h", "I won't give an ordering here."), (5, "h", "Le chiffre est stable et le profil est bon pour la suite."), (6, None, answer(rnd)),
        (7, "none", answer(rnd)), (2, "h", answer(rnd)), (8, "h", "x" * 200_000),
    ]
    r = spark.createDataFrame(rows, "id long, h string, t string").withColumn("k", F.lit(1))
    p = spark.createDataFrame([("h", "sys", prompt), ("h", "sys", prompt), (None, None, None)], "h string, s string, u string").withColumn("t", F.lit("clash"))
    got = {x.id: x.defect_type for x in judge(r, p, key="id", link="h", prompt=["s", "u"], text="t", group="h").collect()}
    assert got.pop(8) in (None, "truncated")  # one endless word, in too small a corpus to tell
    assert got == {1: "copied", 2: None, 3: "empty", 4: "refusal", 5: "other_language", 6: None, 7: None}
    assert judge(r.limit(0), p, key="id", link="h", prompt=["s", "u"], text="t", group="h").count() == 0

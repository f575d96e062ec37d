"""What a single answer is, apart from the corpus: placeholders and refusals."""

from __future__ import annotations

import re
from functools import cache
from itertools import islice

import numpy as np

_TAG = re.compile(r"<[^<>\n]{0,40}>")
_LETTERS = re.compile(r"[^\W_]+")
#: Words that name a wrapper or a missing value and carry no content.
PLACEHOLDERS = frozenset("none null nil na n a nan undefined empty tbd todo json text answer response output result ranking rankings targets final rank final_ranking id ids placeholder".split())


def is_placeholder(text: str | None) -> bool:
    """Null, blank, or only wrappers and placeholders: tags, fences, brackets, names of fields without values."""
    if not text:
        return True
    first = _LETTERS.search(text)
    if first and first[0].lower() not in PLACEHOLDERS and (not first.start() or text[first.start() - 1] not in "</"):
        return False  # most texts end here
    return all(w[0] in PLACEHOLDERS for w in _LETTERS.finditer(_TAG.sub(" ", text).lower()))


#: Words of a refusal by their part in it; a star stands for any ending.
DICTIONARY = {
    "self": "i i'm i'd i'll i've we we're we'd we'll me us my our assistant model",
    "not": "not n't cannot no never nothing none neither nor without unable impossible won't can't",
    "able": "can could able will would shall may feel comfortable willing position permitted allowed possible going rather appropriate something",
    "task": "rank* order* list* name* recommend* provid* give* given answer* help* assist* comply do doing done shar* comment* speculat* predict* advi* opinion* score* scoring select* pick* choos* choose evaluat* assess* guess* respond* complet*",
    "decline": "declin* refus* abstain* pass reject* denied deny den* withh* forgo refrain* blocked",
    "sorry": "sorry apolog* regret* unfortunately afraid respect however",
    "rule": "polic* guideline* rule* prohibit* against violat* outside beyond scope confidential* manipulation legal compliance regulat* licensed liability table limits basis adviser professional",
    "offer": "instead glad happy explain* summar* general outline otherwise else",
    "pick": "first second third best strongest top lead* leading prefer* followed then ahead behind fit* fits suits match* because since choice winner highest #",
}
_OTHER_TONGUES = re.compile(r"lo\s+siento|no\s+puedo|je\s+(?:ne\s+peux|refuse)|désolé|kann\s+ich\s+(?:leider\s+)?nicht|leider\s+nicht|não\s+posso|mi\s+dispiace|non\s+posso|het\s+spijt|抱歉|无法|申し訳", re.IGNORECASE)
_REFERENCE = re.compile(r"#\s?\d+|\bcandidate\s+\d+", re.IGNORECASE)
_ITEM = re.compile(r"^\W*(?:[^\W\d_]+\s+)?\W*\d{1,3}\b[^\w\n]*\s", re.MULTILINE)
_FILLED = re.compile(r"[\[(]\s*[\"\d][^\])]*[\])]")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")
_TOKEN = re.compile(r"#|[^\W\d_]+(?:['’][^\W\d_]+)?")
_NAME = re.compile(r"(?<![.!?;\n]\s)(?<!^)\b[A-Z][a-z]{2,}\b")


def _parts(words: list[str]) -> np.ndarray:
    """Which parts of the dictionary the words have."""
    exact, starts = _looked_up()
    out = np.zeros(len(DICTIONARY))
    for w in words:
        for i in exact.get(w, ()):
            out[i] = 1
        for n in range(3, len(w) + 1):
            for i in starts.get(w[:n], ()):
                out[i] = 1
        if w.endswith("n't"):
            out[1] = 1
    return out


@cache
def _looked_up() -> tuple[dict, dict]:
    exact: dict[str, list[int]] = {}
    starts: dict[str, list[int]] = {}
    for i, words in enumerate(DICTIONARY.values()):
        for w in words.split():
            (starts if w.endswith("*") else exact).setdefault(w.rstrip("*"), []).append(i)
    return exact, starts


def refusal_features(text: str, prompt: str | None = None) -> np.ndarray:
    """Evidence of a refusal: by sentence what the dictionary finds together, the end of the text, and what the text delivers."""
    sentences = [s for s in _SENTENCE.split(text.strip().replace("’", "'")) if s.strip()]
    parts = [_parts([w.lower() for w in _TOKEN.findall(s)]) for s in sentences] or [np.zeros(len(DICTIONARY))]
    me, no, able, task, decline, sorry, rule, offer, pick = np.array(parts).T
    last = parts[-1]
    known = prompt or ""
    names = [n for n in _NAME.findall(text) if n not in known and n.lower() not in ("candidate", "rank", "final", "score")]
    references = len(_REFERENCE.findall(text))
    return np.array(
        [
            1.0, (me * no * np.maximum(able, task)).max(), decline.max(), (task * np.maximum(no, rule)).max(), rule.max(), sorry.max(), (me * decline).max(),
            max(last[6], last[7] * (1 - last[8])), (pick * (1 - np.maximum.reduce([no, decline, offer]))).max(), float(references == 1), float(references > 1), min(len(names), 2) / 2, float(len(text) > 600),
        ]
    )


#: Labelled answers that the model is fitted on.
REFUSING = """I'm sorry, but I can't help with that.|I cannot rank these companies.|I am unable to provide a recommendation.|I must decline.|I'd rather not say.|We are not able to answer this question.
I won't give an opinion on these firms. Please consult a licensed adviser.|This is not something I can do.|I have to pass on this one.|Regrettably I refuse to name targets.|No recommendation can be given.
Providing such a list would be against our policy.|My guidelines do not permit opinions on securities.|Request denied.|Declined.|Answer withheld for compliance reasons.|I have no basis for an answer. I can explain the criteria instead.
Unfortunately I can't assist. The material may be confidential. I'd be happy to summarise the profile instead.|As a language model I am not permitted to advise on investments.|That request is outside my scope.|The question was blocked by policy.
I would prefer to abstain from naming any company.|Sorry, naming acquisition targets is off the table for me.|I will not order candidates #1 to #50.|I cannot comment on Candidate #7 or any other.|I do not feel comfortable choosing among these.
I'm not going to speculate about real firms.|It would not be appropriate for me to answer. Is there anything else you need?|I apologize; no list will be given.|With respect, I can't select any of them. There is a risk of market manipulation.|Rankings of companies are not possible here.|I'd rather not.
I respectfully refrain from scoring anyone.|We can't share an assessment; it could amount to advice.|Your request has been rejected. Reason: policy|No comment.|I never give recommendations on shares.|This violates our rules, so nothing can be provided.""".replace("\n", "|").split("|")
ANSWERING = """Candidate #4 is the best match.|The strongest fit is #12, then #7.|I can't rule out the others, but the strongest fit is Candidate #9.|Tellmore Holdings, then Drax. I won't list the rest.|My first choice is Candidate #3. Behind it come #8 and #2.
It is not clear how margins develop, but #21 leads.|I would pick Norvane Foods first because it adds reach.|1. Norvane Foods\n2. Tarrow Grid|No candidate is perfect; #5 comes closest.|I cannot be certain, yet #30 and #2 suit the profile.|The profile says little about size. Even so #11 is my choice.
Probably Quell Systems. I am not able to name a second.|None of the names is a close match; Merrow Labs is the least bad.|The firm has no overlap with the buyer, so it ranks last. #14 is first.|FINAL RANKING: [3, 1, 2]|The company declined to comment on the offer, so I looked at #8 and #9 first.
Regulators may object, but #17 remains the leading target.|Rank 1: Candidate #02 - cannot be beaten on cost.|Our guidelines favour growth, so #6 and #40 come first.|I considered policy risks. #44 is ahead of #13.|The best is Vantor Tools, followed by Kell Energy.|Without more data I choose #1.
Sorry for the short answer: #22, #23, #24.|Let me think about sector fit first. Utilities match the plan.|The acquirer sells pumps to water boards and wants regional reach.|Overlap is limited, and the price cannot exceed cash on hand.|First I compare the sectors, then the size.|Costs fall quickly where plants are shared.|Size is not given.
The buyer has never paid more than its cash, so small names fit.""".split("\n")
ANSWERING = [x.replace("\\n", "\n") for line in ANSWERING for x in line.split("|")]


@cache
def refusal_weights() -> np.ndarray:
    """Logistic weights fitted on REFUSING and ANSWERING by Newton's method with a ridge."""
    x = np.array([refusal_features(t) for t in (*REFUSING, *ANSWERING)])
    y = np.array([1.0] * len(REFUSING) + [0.0] * len(ANSWERING))
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (y - p) - 0.05 * b)
    return b


def _more(pattern: re.Pattern, text: str, n: int) -> bool:
    """Whether the pattern is found more than ``n`` times; looks no further than that."""
    return next(islice(pattern.finditer(text), n, None), None) is not None


def is_refusal(text: str, prompt: str | None = None) -> bool:
    """Declines, and names or orders nothing: an excuse in front of an answer is none.

    Names that the prompt has are no answer. Texts with two list items or a filled list are never a refusal.
    """
    if _FILLED.search(text) or _more(_REFERENCE, text, 2) or _more(_ITEM, text, 1):
        return False
    return bool(_OTHER_TONGUES.search(text)) or float(refusal_features(text, prompt) @ refusal_weights()) > 0

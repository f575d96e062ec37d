"""Keyword-stuffed pages and link lists (problem 8).

A page is cut in segments (lines, and within a line sentences of at most SEGMENT_WORDS words).
Each segment is described by seven small discrete features, and a hidden Markov model with the
states prose, link list, tag list, menu and stuffed sentences (search words set into sentences, counted
as tag list) labels the sequence. A page is flagged when more than
half of its words lie in segments that are not prose.

The model starts from the tables below and is then fitted to the whole corpus by hard EM: counts
of (state, feature value) and of transitions are summed over all pages on the executors, and only
those few dozen sums come to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage

STATES = ("prose", "link list", "tag list", "menu", "stuffed sentences")
K = len(STATES)
SEGMENT_WORDS = 40
#: Segments before the present one in which its word pairs are looked up.
REPEAT_WINDOW = 8

#: Frequent function words by language; a page's share of them is that of the language it has most of.
FUNCTION_WORDS = {
    "en": """the of and to in a is was for on that with we our by as at from it its be are were or an this which these not has
    have had will their they but than after before since all no into under over during although because while where who
    he she his her you your i can could would may might should been being there here more most some any each other such""",
    "de": """der die das und in im den dem des ein eine einen einem einer zu zum zur mit von für auf ist sind nicht sich bei nach
    vor aus an um als auch über durch seit wegen ohne soll sollen wird werden wurde haben hat trotz alle mehrere rund""",
    "fr": """le la les un une des du de et en au aux pour par sur est dans que qui avec ce cette ses son sa ne pas plus se a été sont
    sans après avant depuis leur leurs elle il ils nous vous mais ou où tout tous comme aussi entre""",
    "es": "el la los las un una unos unas de del y al por para con que es su sus no más lo como fue sin tras desde hasta entre sobre ya en se a o",
    "pt": "o a os as um uma do da dos das de e com não mais foi são pelo pela em que para por se no na ao sua seu como",
    "it": "il lo la gli le i un una di del della dei e che con per non è sono al alla nel ma come più anche senza dal si in",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als dan maar bij door uit naar wordt",
}
_KNOWN = [frozenset(v.split()) for v in FUNCTION_WORDS.values()]

#: Starting point and pseudo-counts of the model: for each feature, the states' chances of its values.
START = np.array([0.82, 0.05, 0.06, 0.05, 0.02])
STAY = 0.9
EMISSIONS = {
    # share of function words: none, to 0.08, to 0.16, to 0.25, more
    "function": [[0.06, 0.10, 0.22, 0.30, 0.32], [0.80, 0.10, 0.05, 0.03, 0.02], [0.66, 0.12, 0.10, 0.07, 0.05], [0.80, 0.10, 0.05, 0.03, 0.02], [0.08, 0.10, 0.22, 0.25, 0.35]],
    # ends like a sentence of four words or more: no, yes
    "ending": [[0.10, 0.90], [0.93, 0.07], [0.86, 0.14], [0.98, 0.02], [0.30, 0.70]],
    # addresses: none, some, one for eight words or fewer
    "links": [[0.965, 0.03, 0.005], [0.04, 0.10, 0.86], [0.97, 0.02, 0.01], [0.95, 0.04, 0.01], [0.985, 0.01, 0.005]],
    # share of tokens in pieces of four or fewer between separators: to 0.3, to 0.7, more
    "pieces": [[0.80, 0.15, 0.05], [0.30, 0.20, 0.50], [0.45, 0.05, 0.50], [0.05, 0.10, 0.85], [0.96, 0.03, 0.01]],
    # share of word pairs met again and again nearby: to 0.1, to 0.25, to 0.45, more
    "repeats": [[0.93, 0.05, 0.012, 0.008], [0.55, 0.20, 0.15, 0.10], [0.20, 0.15, 0.20, 0.45], [0.40, 0.20, 0.20, 0.20], [0.35, 0.25, 0.20, 0.20]],
    # share of word pairs met earlier in the same segment: to 0.05, to 0.12, more
    "inner": [[0.965, 0.025, 0.01], [0.90, 0.06, 0.04], [0.40, 0.20, 0.40], [0.80, 0.10, 0.10], [0.06, 0.14, 0.80]],
    # letters: begins small, sentence case, mostly capitalised words
    "case": [[0.06, 0.84, 0.10], [0.40, 0.30, 0.30], [0.62, 0.10, 0.28], [0.06, 0.14, 0.80], [0.32, 0.58, 0.10]],
}
SIZES = [len(v[0]) for v in EMISSIONS.values()]
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])
#: What the tables above weigh in the fit, against all segments of the corpus; the rare fifth state has at least a twentieth of it.
PRIOR_SHARE = 0.02

_WORD = re.compile(r"\w+")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ0-9])(?=[A-ZÀ-Þ])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_LINK = re.compile(r"https?://\S+|www\.\S+|\b[\w-]+\.(?:[\w-]+\.)*[a-z]{2,10}(?:[/?]\S*)?(?=\s|$)", re.IGNORECASE)
_CHUNK = re.compile(r"[|«»;#=•·>,→:*]| [-–—/] ")
_SPACE = re.compile(r"&nbsp;|[  -​ 　]")


def segments(text: str) -> Iterator[str]:
    for line in _SPACE.sub(" ", text).split("\n"):
        for part in _SENTENCE.split(line):
            words = part.split()
            if len(words) <= SEGMENT_WORDS:
                if words:
                    yield part.strip()
                continue
            for i in range(0, len(words), SEGMENT_WORDS):
                yield " ".join(words[i : i + SEGMENT_WORDS])


def _bin(value: float, edges: tuple[float, ...]) -> int:
    for i, e in enumerate(edges):
        if value <= e:
            return i
    return len(edges)


def encode(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature values of each segment (segments x features, uint8) and its number of words."""
    codes, sizes = bytearray(), []
    cut = []
    for s in segments(text or ""):
        prose, links, link_words = s, 0, 0
        if "." in s[:-1]:
            prose, links = _LINK.subn(" ", s)
            if links:
                link_words = len(_WORD.findall(s)) - len(_WORD.findall(prose))
        cut.append((s, prose, links, link_words, _WORD.findall((_CAMEL.sub(" ", prose) if "#" in prose else prose).lower())))
    known = max(_KNOWN, key=lambda k: sum(sum(map(k.__contains__, c[4])) for c in cut)).__contains__
    last: dict[tuple[str, str], tuple[int, int]] = {}  # word pair -> its last two segments
    for at, (s, prose, links, link_words, words) in enumerate(cut):
        n = len(words)
        repeats, inner = 0.0, 0
        if n > 1:
            for p in zip(words, words[1:]):  # noqa: B905
                one, two = last.get(p, (-99, -99))
                if at - two <= REPEAT_WINDOW:
                    repeats += 1
                elif at - one <= REPEAT_WINDOW:
                    repeats += 0.3
                inner += one == at
                last[p] = (at, one)
            # a heading of two words says little by repeating
            repeats = repeats / (n - 1) if n > 3 else 0.4 * repeats / (n - 1)
        share = sum(map(known, words)) / n if n else 0
        bare = s.rstrip("\"”)'")
        ends = 1 if n >= 4 and bare and bare[-1] in ".!?:" else 0
        if ends and share > 0.25:  # a plain sentence: its pieces and capitals tell nothing more
            pieces, case = 0, 0 if s[0].islower() else 1
        else:
            firsts = [t[0] for t in prose.split()]
            capital, letters = sum(map(str.isupper, firsts)), sum(map(str.isalpha, firsts))
            case = (0 if firsts[0].islower() else 2 if letters > 1 and capital > 0.62 * letters and not prose.isupper() else 1) if firsts else 0
            pieces = 0
            for c in _CHUNK.split(prose):
                k = len(c.split())
                if k <= 4:
                    pieces += k
            pieces = _bin(pieces / max(1, len(firsts)), (0.3, 0.7))
        codes += bytes(
            (
                _bin(share, (0.0, 0.08, 0.16, 0.25)),
                ends,
                0 if not links else 2 if links * 8 >= n + links else 1,
                pieces,
                _bin(repeats, (0.1, 0.25, 0.45)),
                _bin(inner / max(1, n - 1), (0.05, 0.12)),
                case,
            )
        )
        sizes.append(n + link_words)
    return np.frombuffer(bytes(codes), dtype=np.uint8).reshape(-1, len(SIZES)), np.array(sizes, dtype=np.uint32)


class Model:
    """Logarithms of the start, transition and emission chances."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = np.log(start), np.log(move), np.log(emit)

    @classmethod
    def prior(cls) -> Model:
        move = np.full((K, K), (1 - STAY) / (K - 1))
        np.fill_diagonal(move, STAY)
        emit = np.concatenate([np.array(v) for v in EMISSIONS.values()], axis=1)
        return cls(START, move, emit)

    def refit(self, counts: np.ndarray) -> Model:
        """Add the corpus counts (starts, moves, emissions) to the prior's weight."""
        first = Model.prior()
        weight = PRIOR_SHARE * counts[K + K * K : K + K * K + OFFSETS[-1] * K].sum() / len(SIZES)
        if not weight:
            return first
        start = np.exp(first.start) * weight + counts[:K]
        move = np.exp(first.move) * weight + counts[K : K + K * K].reshape(K, K)
        emit = np.exp(first.emit) * weight + counts[K + K * K :].reshape(K, -1)
        parts = [emit[:, a:b] / emit[:, a:b].sum(axis=1, keepdims=True) for a, b in zip(OFFSETS, OFFSETS[1:], strict=False)]
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), np.concatenate(parts, axis=1))

    def viterbi(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest states of each page; pages advance together, one segment a step."""
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
        lengths = np.array([len(pages[i]) for i in order], dtype=int)
        most = int(lengths[0]) if len(lengths) else 0
        out: list[np.ndarray] = [np.empty(0, dtype=np.uint8)] * len(pages)
        if not most:
            return out
        scores = [self.emit[:, pages[i] + OFFSETS[:-1]].sum(axis=2).T if len(pages[i]) else np.empty((0, K)) for i in order]
        begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        flat = np.concatenate(scores)
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(most)]  # pages longer than t
        best = flat[begins[: active[0]]] + self.start
        back = []
        final = np.empty((active[0], K))
        for t in range(1, most):
            n = active[t]
            final[n : len(best)] = best[n:]
            through = best[:n, :, None] + self.move[None]
            back.append(through.argmax(axis=1).astype(np.uint8))
            best = through.max(axis=1) + flat[begins[:n] + t]
        final[: len(best)] = best
        state = final.argmax(axis=1)
        states = np.empty(len(flat), dtype=np.uint8)
        for t in range(most - 1, -1, -1):
            n = active[t]
            states[begins[:n] + t] = state[:n]
            if t:
                state[:n] = back[t - 1][np.arange(n), state[:n]]
        for j, i in enumerate(order[: active[0]]):
            out[i] = states[begins[j] : begins[j] + lengths[j]]
        return out


def _unpack(codes: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(codes, dtype=np.uint8).reshape(-1, len(SIZES)), np.frombuffer(words, dtype=np.uint32)


def encoded(documents: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [encode(t) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "codes": [c.tobytes() for c, _ in pairs], "words": [w.tobytes() for _, w in pairs]})

    df = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return df.mapInPandas(run, df.select("k").schema.add("codes", "binary").add("words", "binary"))


def _counted(pages: DataFrame, model: Model) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(K + K * K + K * OFFSETS[-1])
        for b in batches:
            codes = [_unpack(c, w)[0] for c, w in zip(b["codes"], b["words"], strict=True)]
            for c, s in zip(codes, model.viterbi(codes), strict=True):
                if not len(s):
                    continue
                total[s[0]] += 1
                np.add.at(total, K + K * s[:-1].astype(int) + s[1:], 1)
                at = K + K * K + s.astype(int)[:, None] * OFFSETS[-1] + c + OFFSETS[:-1]
                np.add.at(total, at.ravel(), 1)
        yield pd.DataFrame({"i": np.arange(len(total)), "n": total})

    sums = pages.mapInPandas(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(K + K * K + K * OFFSETS[-1])
    for r in sums:
        counts[r["i"]] = r["n"]
    return counts


def layout_shares(documents: DataFrame, *, key: str = "doc_id", text: str = "text", rounds: int = 2) -> DataFrame:
    """Words of each document and how many of them lie in link lists, tag lists and menus.

    Result: the key, n_words, link_words, tag_words, menu_words, and non_prose_share (0 for a text
    without words: null, empty or white space). Repeated rows stay repeated; other columns of
    ``documents`` play no part. An empty table gives an empty result.
    """
    pages = cut_lineage(encoded(documents, key, text))
    model = Model.prior()
    for _ in range(rounds):
        model = model.refit(_counted(pages, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [_unpack(c, w) for c, w in zip(b["codes"], b["words"], strict=True)]
            states = model.viterbi([c for c, _ in pairs])
            sums = np.array([np.bincount(s, weights=w, minlength=K) if len(s) else np.zeros(K) for s, (_, w) in zip(states, pairs, strict=True)]).reshape(-1, K)
            sums[:, 2] += sums[:, 4]
            n = sums.sum(axis=1)
            yield pd.DataFrame(
                {
                    "k": b["k"], "n_words": n.astype("int64"),
                    **{f"{x}_words": sums[:, i].astype("int64") for i, x in ((1, "link"), (2, "tag"), (3, "menu"))},
                    "non_prose_share": (n - sums[:, 0]) / np.maximum(n, 1),
                }
            )

    schema = pages.select("k").schema
    for x in ("n_words", "link_words", "tag_words", "menu_words"):
        schema = schema.add(x, "long")
    return pages.mapInPandas(run, schema.add("non_prose_share", "double")).withColumnRenamed("k", key)

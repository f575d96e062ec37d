"""Rankings in model answers, and metrics of a ranking with one relevant item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_RANKS, MOST_NAMES, CANDIDATES, K = 10, 5, 50, 10

#: The places of an answer that hold a ranking or a list of names.
JSON_RANKING = r'(?is)\{[^{}]*"ranking"\s*:\s*\[[^\]]*\][^{}]*\}'
FINAL_RANKING = r"(?i)FINAL\s+RANKING\s*[:=]\s*\[([^\]]*)\]"
RANK_LINE = r"[Rr]ank\s*\**\s*(\d+)\**\s*[:\.\)]?\s*(?:[Cc]andidate\s*)?#(\d+)"
JSON_TARGETS = r'(?is)\{[^{}]*"targets"\s*:\s*\[[^\]]*\][^{}]*\}'
FINAL_TARGETS = r"(?i)FINAL\s+TARGETS\s*[:=]\s*(\[[^\]]*\])"
NUMBERED_LINE = r"^\s*\d+[.)]\s*(?:[—\-]\s*)?([^—\-:\n]+)"
LOOSE_RANK = r"(?i)rank\s*\**\s*\d+\**\s*[:\.]?\s*.*?candidate\s*#(\d+)"
LOOSE_CANDIDATE = r"(?i)candidate\s*#(\d+)"
LOOSE_NUMBER = r"(?<!\w)#(\d{1,2})(?!\w)"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def ordered_distinct(ids: Column, low: int = 1, high: int = CANDIDATES, most: int = MOST_RANKS) -> Column:
    """Numbers from ``low`` to ``high``, each at its first place, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(ids, lambda x: x.between(low, high))), 1, most)


def _ints(strings: Column) -> Column:
    return F.transform(strings, lambda x: F.trim(x).try_cast("int"))


def _some(ids: Column) -> Column:
    return F.when(F.size(ids) > 0, ids)


def ranking_tiers(text: Column) -> dict[str, Column]:
    """For each tier of the strict parser its ranking, or null: the last JSON object, the last final line, lines with an explicit rank."""
    blob = F.try_element_at(_all(text, JSON_RANKING, 0), F.lit(-1))
    listed = F.from_json(blob, "ranking array<string>")["ranking"]
    whole = F.filter(listed, lambda x: x.rlike(r"^\s*-*\d+\s*$"))
    final = F.try_element_at(_all(text, FINAL_RANKING), F.lit(-1))
    rank, item = _all(text, RANK_LINE, 1), _all(text, RANK_LINE, 2)
    lines = F.transform(F.arrays_zip(rank.alias("k"), item.alias("i")), lambda x, n: F.struct(x["k"].try_cast("int").alias("k"), n.alias("n"), x["i"].try_cast("int").alias("i")))
    by_rank = F.transform(F.array_sort(lines), lambda x: x["i"])
    return {
        "json": _some(ordered_distinct(_ints(whole))),
        "final": _some(ordered_distinct(_ints(_all(final, r"(\d{1,2})")))),
        "lines": _some(ordered_distinct(by_rank)),
    }


def parse_ranking(text: Column) -> Column:
    """The ranking of the first tier that yields one; an empty array if none does or the text is null."""
    return F.coalesce(*ranking_tiers(text).values(), F.array().cast("array<int>"))


def parse_ranking_loose(text: Column) -> Column:
    """Every candidate number anywhere in the text, by falling strictness of the pattern; for old answers only."""
    found = F.concat(_all(text, LOOSE_RANK), _all(text, LOOSE_CANDIDATE), _all(text, LOOSE_NUMBER))
    return F.coalesce(ordered_distinct(_ints(found)), F.array().cast("array<int>"))


def parse_names(text: Column) -> Column:
    """At most five generated names: the last final line, the last JSON object, or numbered lines of three characters or more."""
    clean = lambda a: F.slice(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""), 1, MOST_NAMES)
    final = F.from_json(F.try_element_at(_all(text, FINAL_TARGETS), F.lit(-1)), "array<string>")
    blob = F.from_json(F.try_element_at(_all(text, JSON_TARGETS, 0), F.lit(-1)), "targets array<string>")["targets"]
    lines = F.transform(F.split(F.trim(text), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_extract(x, NUMBERED_LINE, 1)))
    lines = F.slice(F.filter(lines, lambda x: F.length(x) >= 3), 1, MOST_NAMES)
    return F.coalesce(_some(clean(final)), _some(clean(blob)), lines, F.array().cast("array<string>"))


def position(ranked: Column, target: Column, k: int = K) -> Column:
    """Place of the target among the first k, 0 if it is not there or anything is null."""
    return F.coalesce(F.array_position(F.slice(ranked, 1, k), target), F.lit(0)).cast("int")


def reciprocal_rank(place: Column, k: int = K) -> Column:
    return F.when(place.between(1, k), 1.0 / place).otherwise(0.0)


def recall(place: Column, k: int) -> Column:
    return place.between(1, k).cast("double")


def gain(place: Column, k: int) -> Column:
    """Discounted gain; the ideal is 1 with one relevant item."""
    return F.when(place.between(1, k), 1.0 / F.log2(place + 1.0)).otherwise(0.0)


def metrics(ranked: Column, target: Column, k: int = K) -> dict[str, Column]:
    """mrr, recall_1/5/10, ndcg_5/10 and target_rank (null beyond k)."""
    p = position(ranked, target, k)
    return {
        "mrr": reciprocal_rank(p, k), "recall_1": recall(p, 1), "recall_5": recall(p, 5), "recall_10": recall(p, 10),
        "ndcg_5": gain(p, 5), "ndcg_10": gain(p, 10), "target_rank": F.nullif(p, F.lit(0)),
    }


def chance_reciprocal_rank(k: int = K, n: int = CANDIDATES) -> float:
    """Expected reciprocal rank at k of a uniform ranking of n items."""
    return sum(1.0 / r for r in range(1, k + 1)) / n


def chance_recall(k: int, n: int = CANDIDATES) -> float:
    return k / n


def chance_gain(k: int, n: int = CANDIDATES) -> float:
    from math import log2

    return sum(1.0 / log2(r + 1) for r in range(1, k + 1)) / n

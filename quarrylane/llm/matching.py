"""Matching entities across sources without keys (problem 1).

Records of two sources are compared by name, ticker, and yearly figures:

1. Names are split in words. A name's search keys are its rarest words, each word with the first letter
   of the next, its words by two and all of them written together, and its initials. What is a key does
   not depend on how many names there are. Keys are encoded as bit vectors of their bigrams.
2. Close keys are found by multi-index Hamming hashing within RADIUS bits; keys that one edit sets apart
   are found as well, since an edit may change more than RADIUS bits.
3. Each pair of names gets Dice scores of its fields (core, further words, initials), and each pair of
   entities those of its tickers and the agreement of its yearly figures. Their weighted mean is turned
   into a confidence by a logistic curve, fitted to groups whose entity is known: the score of the true
   entity against the best score that another one gets, which is what a group without an entity would get.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import spread, write_once
from .edit_keys import one_edit_keys
from .qgram_bits import dice, keys_within, vector, with_vectors

#: Words of names that do not tell companies apart.
LEGAL = frozenset(
    "inc incorporated corp corporation llc ltd limited plc co company companies holdings holding group international intl global worldwide enterprises the of and subsidiaries north america sa nv ag se lp trust".split()
) - {"trust"}
#: Spellings of one legal form.
FORMS = {"incorporated": "inc", "corporation": "corp", "limited": "ltd", "company": "co", "intl": "international", "holding": "holdings"}
_AS = re.compile(r"\b(?:d/b/a|dba|f/k/a|fka|formerly)\b\s*(.+)$", re.IGNORECASE)
_LISTED = re.compile(r"\([A-Za-z]{2,8}\s*:\s*([A-Za-z.]{1,6})\)")
_PAREN = re.compile(r"\([^)]*\)")
_STATE = re.compile(r"\s*/[A-Za-z]{2,4}/?\s*$")
_TOKEN = re.compile(r"[a-z0-9]+")
#: Words at most so many times as frequent as a name's rarest one may be its core (an abbreviation can be rarer).
RARE = 12
#: Weights of the fields in the score.
WEIGHTS = {"core": 4.0, "rest": 2.0, "ticker": 3.0, "figures": 3.0}
#: What equal initials are worth as a core, since many names share them.
INITIALS = 0.85
#: Figures of one year agree within this ratio.
AGREE = 1.075
#: Pairs with known truth that the calibration is fitted on, at most; chosen by hash.
FIT_PAIRS = 50_000
#: Confidence from which a pair counts as a match.
MATCH = 0.5


def parse_name(name: str | None) -> dict:
    """words (without legal forms), initials of all words, and the ticker set in brackets."""
    s = name or ""
    listed = _LISTED.search(s)
    other = _AS.search(s)
    s = _STATE.sub(" ", _PAREN.sub(" ", other[1] if other else s))
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    tokens = _TOKEN.findall(re.sub(r"(?<=[a-z])-(?=[a-z])|['’.](?=[a-z]\b)", "", s))
    words = [t for t in tokens if t not in LEGAL]
    forms = sorted({FORMS.get(t, t) for t in tokens if t in LEGAL})
    return {"words": words or tokens, "forms": forms, "initials": "".join(t[0] for t in tokens if t not in ("the", "of", "and")), "ticker": listed[1].upper() if listed else None}


def slip(a: str, b: str):
    """Whether two ticker columns are equal but for one letter more, less, other or swapped."""
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    return (F.levenshtein(a, b) <= 1) | (F.levenshtein(a, b) == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b))


def _edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, at most ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _short_for(a: str, b: str) -> bool:
    """One word abbreviates the other: its beginning, or its letters in order from the same first letter."""
    short, long = sorted((a, b), key=len)
    if not short or short[0] != long[0]:
        return False
    if long.startswith(short):
        return len(short) >= 3 or len(short) == len(long)
    rest = iter(long)
    return len(short) >= 3 and len(short) <= len(long) // 2 + 1 and all(c in rest for c in short)


def compare_names(left: list[str], right: list[str], rare_left: set[str], rare_right: set[str], initials_right: str = "") -> tuple[float, float, bool, bool]:
    """(core, rest, whether rest is known on both sides, whether left abbreviates right to initials)."""
    if len(left) == 1 and len(right) > 1 and 1 < len(left[0]) <= len(initials_right):
        if dice(vector(left[0]), vector(initials_right[: len(left[0])])) == 1.0:
            return 0.0, 0.0, False, True
    joined_left, joined_right = "".join(left), "".join(right)
    if joined_left == joined_right:
        return 1.0, 1.0, len(right) > 1, False
    best = (0.0, 0.0, False)
    # the core of the left name may be one word or two that belong together; the rest are its other words
    parts = [(w, left[:i] + left[i + 1 :]) for i, w in enumerate(left) if w in rare_left]
    parts += [(left[i] + left[i + 1], left[:i] + left[i + 2 :]) for i in range(len(left) - 1) if len(left) > 1]
    for core_right in sorted(rare_right & set(right)) or right[:1]:
        at = right.index(core_right)
        rest_right = right[:at] + right[at + 1 :]
        options = list(parts)
        if len(left) >= 1 and rest_right:
            for i, w in enumerate(left):  # a core with a further word glued on
                for r in rest_right:
                    if len(w) > len(r) + 3 and w.endswith(r):
                        options.append((w[: -len(r)], [r, *left[:i], *left[i + 1 :]]))
        for core, rest in options:
            if core == core_right:
                c = 1.0
            else:
                most = 1 if min(len(core), len(core_right)) < 9 else 2
                e = _edits(core, core_right, most)
                c = dice(vector(core), vector(core_right)) * (1.0 if e <= 1 else 0.85 if e <= most else 0.6)
                c = max(c, 0.85) if e <= 1 and min(len(core), len(core_right)) >= 5 else c
            if rest and rest_right:
                hits = sum(1 for w in rest if any(w == r or _short_for(w, r) or _edits(w, r, 1) <= 1 for r in rest_right))
                back = sum(1 for r in rest_right if any(w == r or _short_for(w, r) or _edits(w, r, 1) <= 1 for w in rest))
                r_score, known = max(hits / len(rest), back / len(rest_right)), True
            else:
                r_score, known = 0.0, False
            if (c * 4 + (r_score * 2 if known else 1.2)) > (best[0] * 4 + (best[1] * 2 if best[2] else 1.2)):
                best = (c, r_score, known)
    return (*best, False)


def _keys(names: DataFrame) -> DataFrame:
    """Add ``rare`` (words that may be its core) and ``keys`` to distinct names with ``words``."""
    words = names.select("name", F.explode(F.array_distinct("words")).alias("w"))
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    per_name = spread(words).join(df, "w").groupBy("name").agg(F.collect_list(F.struct("df", "w")).alias("d"))
    least = F.array_min(F.transform("d", lambda x: x["df"]))
    within = lambda times: F.transform(F.filter("d", lambda x: (x["df"] <= times * least) & (F.length(x["w"]) >= 2)), lambda x: x["w"])
    per_name = per_name.select("name", within(RARE).alias("rare"), within(1).alias("rarest"))
    none = F.array().cast("array<string>")
    out = names.join(spread(per_name), "name", "left").withColumns({"rare": F.coalesce("rare", none), "rarest": F.coalesce("rarest", none)})
    pairs = F.expr("transform(sequence(1, greatest(size(words) - 1, 1)), i -> concat_ws('', slice(words, i, 2)))")
    begun = F.expr("transform(sequence(1, greatest(size(words) - 1, 1)), i -> IF(i < size(words), concat(words[i - 1], left(words[i], 1)), ''))")
    # a name of a few letters is met by names that have these initials; the mark keeps both apart from words
    spelled = F.expr("transform(sequence(2, greatest(2, least(4, length(initials)))), n -> concat('=', left(initials, n)))")
    short = F.when(F.length(F.get("words", F.lit(0))).between(2, 4), F.array(F.concat(F.lit("="), F.get("words", F.lit(0))))).otherwise(none)
    initials = F.when(F.size("words") > 1, spelled).otherwise(short)
    keys = F.concat("rarest", begun, pairs, F.array(F.concat_ws("", "words")), initials)
    return out.withColumn("keys", F.filter(F.array_distinct(keys), lambda k: F.length(k) >= 2)).drop("rarest")


def _parsed(names: DataFrame) -> DataFrame:
    """Distinct ``name`` -> words, initials, listed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [parse_name(n) for n in b["name"]]
            yield pd.DataFrame({"name": list(b["name"]), "words": [x["words"] for x in p], "forms": [x["forms"] for x in p], "initials": [x["initials"] for x in p], "listed": pd.Series([x["ticker"] for x in p], dtype=object)})

    return names.where("name IS NOT NULL").select("name").distinct().mapInPandas(run, "name string, words array<string>, forms array<string>, initials string, listed string")


def _name_scores(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """core, rest, rest_known, acronym for distinct (left, right) pairs of names."""
    l = left.select(F.col("name").alias("left"), F.col("words").alias("lw"), F.col("rare").alias("lr"), F.col("forms").alias("lf"))  # noqa: E741
    r = right.select(F.col("name").alias("right"), F.col("words").alias("rw"), F.col("rare").alias("rr"), F.col("initials").alias("ri"), F.col("forms").alias("rf"))
    rows = pairs.join(spread(l), "left").join(spread(r), "right")
    same = F.size(F.array_intersect("lf", "rf")) * 2.0 / F.greatest(F.size("lf") + F.size("rf"), F.lit(1))
    rows = rows.withColumn("forms", same).drop("lf", "rf")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [compare_names(list(a), list(c), set(d), set(e), i or "") for a, c, d, e, i in zip(b["lw"], b["rw"], b["lr"], b["rr"], b["ri"], strict=True)]
            yield pd.DataFrame({"left": list(b["left"]), "right": list(b["right"]), "core": [x[0] for x in s], "rest": [x[1] for x in s], "rest_known": [x[2] for x in s], "acronym": [x[3] for x in s], "forms": list(b["forms"])})

    return rows.mapInPandas(run, "left string, right string, core double, rest double, rest_known boolean, acronym boolean, forms double")


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve by Newton's method."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def match_entities(left: DataFrame, right: DataFrame, known: DataFrame) -> DataFrame:
    """The right entity that each left group most likely is.

    left: group, name, ticker, year, figure - several rows a group. right: entity, name, year,
    figure - several rows an entity. known: group, entity pairs known to be the same, for the
    calibration; their groups are searched too.

    Result: group, entity, score, confidence; at most one row a group, whatever the confidence.
    n_true, true_score and other_score tell what is known of the group: its number of known entities,
    and the best score of the known one and of the others.

    Null names never match, null tickers, years and figures are no evidence. Repeated rows count
    once. Ties go to the entity with more agreeing figures, then to the one whose legal forms fit better, then by a digest of the entity. Without known
    pairs the confidence is a fixed curve about a score of 0.75. Empty sides give no rows.
    """
    # the tables from here on are far smaller than the input; what is read more than once is written once, which also keeps the plans short
    l_names = left.where("name IS NOT NULL").select("group", "name").distinct()
    r_names = right.where("name IS NOT NULL AND entity IS NOT NULL").select("entity", "name").distinct()
    sides = write_once(l_names.select(F.lit("l").alias("side"), F.col("group").alias("of"), "name").unionByName(r_names.select(F.lit("r").alias("side"), F.col("entity").alias("of"), "name")))
    l_names, r_names = sides.where("side = 'l'").select(F.col("of").alias("group"), "name"), sides.where("side = 'r'").select(F.col("of").alias("entity"), "name")
    sided = sides.groupBy("name").agg(F.max((F.col("side") == "l").cast("int")).alias("l"), F.max((F.col("side") == "r").cast("int")).alias("r"))
    names = write_once(_keys(_parsed(sides.select("name"))).join(spread(sided), "name"))
    ln, rn = names.where("l = 1"), names.where("r = 1")
    # on the left only names of a few letters stand for initials, on the right only names of several words have them
    one = F.size("words") == 1
    l_of = ln.select("name", F.explode(F.filter("keys", lambda k: ~k.startswith("=") | one)).alias("left"))
    r_of = rn.select("name", F.explode(F.filter("keys", lambda k: ~k.startswith("=") | ~one)).alias("right"))
    keys = l_of.select(F.col("left").alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(r_of.select(F.col("right").alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    keys = write_once(with_vectors(keys.groupBy("key").agg(F.max("l").alias("l"), F.max("r").alias("r")), "key"))
    lk, rk = keys.where("l = 1").select("key", "bits"), keys.where("r = 1").select("key", "bits")

    # yearly figures: one for each group and year
    l_fig = left.where("year IS NOT NULL AND figure > 0").groupBy("group", "year").agg(F.avg("figure").alias("lf"))
    r_fig = right.where("year IS NOT NULL AND figure > 0").groupBy("entity", "year").agg(F.max("figure").alias("rf"))
    l_tick = left.where("ticker IS NOT NULL").select("group", F.col("ticker").alias("lt")).distinct()
    r_tick = rn.where("listed IS NOT NULL").select("name", "listed").join(spread(r_names), "name").select("entity", F.col("listed").alias("rt")).distinct()

    def entities(name_pairs: DataFrame) -> DataFrame:
        """Scores of (group, entity) for pairs of names."""
        s = name_pairs.join(spread(l_names.withColumnRenamed("name", "left")), "left").join(spread(r_names.withColumnRenamed("name", "right")), "right")
        quality = F.struct((F.col("core") * 4 + F.when(F.col("rest_known"), F.col("rest") * 2).otherwise(1.2)).alias("q"), "forms", "core", "rest", "rest_known")
        s = s.groupBy("group", "entity").agg(F.max(quality).alias("b"), F.max("acronym").alias("acronym"))
        s = s.select("group", "entity", "b.core", "b.rest", "b.rest_known", "b.forms", "acronym")
        ratio = F.greatest(F.col("lf") / F.col("rf"), F.col("rf") / F.col("lf"))
        fig = s.select("group", "entity").join(spread(l_fig), "group").join(spread(r_fig), ["entity", "year"]).groupBy("group", "entity")
        fig = fig.agg(F.avg((ratio <= AGREE).cast("double")).alias("figures"), F.count_if(ratio <= AGREE).alias("n_figures"))
        tick = s.select("group", "entity").join(spread(l_tick), "group").join(spread(r_tick), "entity").groupBy("group", "entity").agg(F.max(slip("lt", "rt").cast("double")).alias("ticker"))
        s = s.join(spread(fig), ["group", "entity"], "left").join(spread(tick), ["group", "entity"], "left")
        w = {k: F.lit(v) for k, v in WEIGHTS.items()}
        zero = F.lit(0.0)
        core = F.when(F.col("acronym") & (F.col("core") < 0.5), INITIALS).otherwise(F.col("core"))
        top = core * w["core"] + F.when(F.col("rest_known"), F.col("rest") * w["rest"]).otherwise(0) + F.coalesce(F.col("ticker") * w["ticker"], zero) + F.coalesce(F.col("figures") * w["figures"], zero)
        low = w["core"] + F.when(F.col("rest_known"), w["rest"]).otherwise(0) + F.when(F.col("ticker").isNotNull(), w["ticker"]).otherwise(0) + F.when(F.col("figures").isNotNull(), w["figures"]).otherwise(0)
        # a further word that disagrees, or initials alone, cannot be outweighed by a core that many share
        score = top / low - F.when(F.col("rest_known") & (F.col("rest") == 0) & (F.coalesce("ticker", zero) == 0), 0.25).otherwise(0)
        score = F.when(F.col("acronym") & (F.col("core") < 0.5) & (F.coalesce("figures", zero) < 0.5) & (F.coalesce("ticker", zero) == 0), 0.4).otherwise(score)
        return s.withColumn("score", score)

    def through(key_pairs: DataFrame) -> DataFrame:
        pairs = key_pairs.join(spread(l_of.withColumnRenamed("name", "ln")), "left").join(spread(r_of.withColumnRenamed("name", "rn")), "right")
        return pairs.select(F.col("ln").alias("left"), F.col("rn").alias("right")).distinct()

    words = "NOT startswith(key, '=')"  # initials must be equal
    # what both searches give stays twice here, since the pairs of names are made distinct
    near = keys_within(lk, rk).where("left = right OR NOT startswith(left, '=')").select("left", "right").unionByName(one_edit_keys(lk.where(words), rk.where(words)))
    pairs = through(near)
    scored = entities(write_once(_name_scores(pairs, names, names)))
    vague = (F.col("acronym") & (F.col("core") < 0.5) | ~F.col("rest_known") & F.col("figures").isNull()) & (F.coalesce("ticker", F.lit(0.0)) == 0)
    # initials, or a core without a further word, fit many: they count only where they point to one entity
    by_group = W.partitionBy("group")
    ranked = scored.withColumn("vague", vague).withColumn("rivals", F.count_if(F.col("score") > 0.7).over(by_group))
    ranked = ranked.withColumn("score", F.when(F.col("vague") & (F.col("rivals") > 1), F.least("score", F.lit(0.5))).otherwise(F.col("score")))
    truth = known.where("group IS NOT NULL AND entity IS NOT NULL").groupBy("group").agg(F.min("entity").alias("__true"), F.count_distinct("entity").alias("__n"))
    ranked = ranked.join(spread(truth), "group", "left")
    is_true = F.coalesce(F.col("entity") == F.col("__true"), F.lit(False))
    first = lambda c: F.max_by(F.struct("entity", "score", "forms", "core"), c)
    best = ranked.withColumn("o", F.struct("score", F.coalesce("n_figures", F.lit(0)).alias("n"), "forms", "core", (-F.conv(F.substring(F.md5("entity"), 1, 15), 16, 10).cast("long")).alias("e")))
    best = write_once(best.groupBy("group").agg(first(F.col("o")).alias("b"), F.max("__n").alias("n_true"), F.max(F.when(is_true, F.col("score"))).alias("true_score"), F.max(F.when(~is_true, F.col("score"))).alias("other_score")))
    slope, offset = calibrate(best)
    confidence = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("b.score") * slope + offset)))
    return best.select("group", "b.entity", "b.score", confidence.alias("confidence"), "n_true", "true_score", "other_score")


def known_scores(best: DataFrame) -> DataFrame:
    """(group, score, y) of groups with exactly one known entity: the score that it has (y 1), and the best that another has (y 0); a side without a candidate scores 0."""
    sides = F.array(F.struct(F.coalesce("true_score", F.lit(0.0)).alias("score"), F.lit(1.0).alias("y")), F.struct(F.coalesce("other_score", F.lit(0.0)).alias("score"), F.lit(0.0).alias("y")))
    return best.where("n_true = 1").select("group", F.inline(sides))


def calibrate(best: DataFrame) -> tuple[float, float]:
    """Slope and offset of the confidence curve, from at most FIT_PAIRS scores of groups chosen by hash; the score itself about one half if no entity is known."""
    # chosen on the executors: collecting the ordered limit at once would bring that many rows of every task to the driver
    told = write_once(known_scores(best).orderBy(F.xxhash64("group"), "y").limit(FIT_PAIRS)).toPandas()
    if not len(told):
        return 10.0, -7.5
    return fit_logistic(told["score"].to_numpy(dtype=float), told["y"].to_numpy(dtype=float), np.full(len(told), 1.0 / len(told)), ridge=1e-5)


def reliability(best: DataFrame) -> DataFrame:
    """tenth, n, mean_confidence, share_true: how far confidences hold on groups that the curve was not fitted on.

    The groups with one known entity are halved by hash; each half's scores (of the known entity, and
    of the best other) are judged by the curve of the other half.
    """
    half = F.pmod(F.xxhash64("group"), F.lit(2))
    parts = []
    for side in (0, 1):
        slope, offset = calibrate(best.where(half != side))
        told = known_scores(best.where(half == side))
        parts.append(told.select("y", (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("score") * slope + offset)))).alias("c")))
    both = parts[0].unionByName(parts[1])
    tenth = F.least(F.floor(F.col("c") * 10), F.lit(9)).cast("long")
    return both.groupBy(tenth.alias("tenth")).agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean_confidence"), F.round(F.avg("y"), 6).alias("share_true"))

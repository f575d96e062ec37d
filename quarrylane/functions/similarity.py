"""Overlap and edit similarity of short texts."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Words left out of the overlap of names.
NAME_STOP = "inc corp llc ltd the and co group holdings company international technologies".split()
#: Upper-case words that are no tickers in an answer.
TICKER_STOP = (
    "A AN AS AT BE BY DO GO HE IF IN IS IT ME MY NO OF ON OR SO TO UP US WE AND ARE FOR HAS NOT THE WITH FROM THAT THIS HAVE WERE BEEN THEY ALSO EACH SUCH THAN THEN WHEN WILL YEAR "
    "LIST DEAL DEALS FIRM FIRMS ONLY SOME MANY MOST BOTH WELL HERE OVER INTO EVEN JUST BELOW ABOVE THESE THOSE WHERE WOULD COULD ABOUT OTHER AFTER UNDER WHICH BASED THEIR THERE SHOULD "
    "SURE IQ SP MA MB NA TA TE SA SE LA LE LI CO DE DI DA AL"
).split()


def name_words(c: Column) -> Column:
    """Distinct words of two characters or more that are not in NAME_STOP."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(NAME_STOP)))


def f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of distinct words, 0 if either is empty or nothing is shared."""
    hit = F.size(F.array_intersect(a, b))
    return F.when(hit > 0, 2.0 * hit / (F.size(a) + F.size(b))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all; 1 for two empty arrays, 0 if one is empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)).cast("double"))


def tickers(c: Column) -> Column:
    """Words of two to five letters of an upper-cased answer that are no common words."""
    raw = F.split(F.regexp_replace(F.upper(c), r"[^A-Z0-9,\s.]", ""), r"[,\s]+")
    clean = F.transform(raw, lambda w: F.rtrim(w, F.lit(".")))
    return F.array_distinct(F.filter(clean, lambda w: w.rlike("^[A-Z]{2,5}$") & ~w.isin(TICKER_STOP)))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    s = (1 << len(a)) - 1
    full = s
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def indel(a: str, b: str) -> float:
    """Similarity from 0 to 100 by insertions and deletions alone; 100 for two empty texts."""
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    """indel of the sorted words."""
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best indel among the shared words and the shared words with either rest; 0 if either has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(indel(one, two), *((indel(both, one), indel(both, two)) if both else (0.0,)))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where either text is null."""
    return pd.Series([token_sort(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")  # noqa: B905


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where either text is null."""
    return pd.Series([token_set(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b)], dtype="float64")  # noqa: B905

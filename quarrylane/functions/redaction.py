"""Removal of identities and of what became known later from texts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .names import OTHER_NAME, distinctive, normalize

COMPANY, ACQUIRER = "[COMPANY]", "[ACQUIRER]"
#: Language of a deal that is already done.
LATER = (
    r"(?iu)was acquired by|has been acquired|to be acquired|reverse merger|business combination|special purpose acquisition|\bSPAC\b|"
    r"completed (?:its|the) (?:merger|acquisition)|following the (?:merger|acquisition)|as of \w+ \d{1,2},? \d{4}"
)
#: Addresses, listings, legal forms after a placeholder or at a name's end.
URL = r"(?i)\b(?:https?://|www\.)\S+|\b[\w-]+\.(?:com|net|org|io|co)\b"
LISTED = r"(?i)\((?:NYSE|NASDAQ|NASDAQGS|NYSEMKT|AMEX|OTC)[:\s]*[A-Z.]{1,6}\)"
EXCHANGE = r"(?i)\b(?:NYSE|NASDAQ|NASDAQGS|NASDAQGM|NASDAQCM|NYSEMKT|NYSEArca|AMEX|OTCQB|OTCQX|OTC)\b"
LOOSE_FORM = r"(?i)\[COMPANY\]\s*,?\s*(?:Inc|Corp|Corporation|LLC|Ltd|Limited|PLC|Holdings?|Group|Co|Company|International|Technologies?)\.?"
#: Words of an acquirer's name that are no sign of it.
COMMON = "and the for with from into that this its company companies group holdings corporation soup".split()
NAME_END = r"(?i),?\s*(?:Inc\.?|Corp\.?|Corporation|LLC|Ltd\.?|Limited|PLC|Holdings?|Group|Co\.?|Company|International|Technologies?)$"
NO_DESCRIPTION = "No description available."


def sentences(text: Column) -> Column:
    """Pieces after a full stop, exclamation or question mark and white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def known_sentences(text: Column, max_year: Column | None = None) -> Column:
    """The sentences that neither speak of a deal as done nor name a year from 2000 on beyond ``max_year``, joined by blanks."""

    def keep(s: Column) -> Column:
        ok = ~s.rlike(LATER)
        if max_year is not None:
            late = F.exists(F.regexp_extract_all(s, F.lit(r"\b(20\d{2})\b"), 1), lambda y: y.cast("int") > max_year)
            ok = ok & ~F.coalesce(late, F.lit(False))
        return ok

    return F.trim(F.array_join(F.filter(sentences(text), keep), " "))


def _literal(c: Column, flags: str = "(?iu)") -> Column:
    """A pattern for the text itself, whatever characters it has."""
    return F.concat(F.lit(flags + r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def redact(text: Column, names: Column, ticker: Column, max_year: Column | None = None) -> Column:
    """The text without later knowledge and with every sign of the company replaced by ``COMPANY``.

    names: array of surface forms, replaced longest first. Null or wholly later texts become empty.
    """
    t = known_sentences(text, max_year)
    for p in (URL, LISTED, EXCHANGE):
        t = F.regexp_replace(t, p, r"\[COMPANY\]")
    longest = F.transform(F.array_sort(F.transform(names, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))), lambda x: x["a"])
    t = F.aggregate(F.coalesce(longest, F.array().cast("array<string>")), t, lambda s, a: F.regexp_replace(s, _literal(a), F.lit(r"\[COMPANY\]")))
    bare = F.concat(F.lit(r"(?iU)\b\Q"), ticker, F.lit(r"\E\b"))
    t = F.when(F.length(ticker) >= 2, F.regexp_replace(t, bare, F.lit(r"\[COMPANY\]"))).otherwise(t)
    t = F.regexp_replace(t, rf"(?iU)\b{OTHER_NAME}\b.*$", r"\[COMPANY\]")
    t = F.regexp_replace(t, LOOSE_FORM, r"\[COMPANY\]")
    t = F.regexp_replace(F.regexp_replace(t, r"(?:\[COMPANY\]\s*)+", r"\[COMPANY\] "), r"\s+([,.;])", "$1")
    return F.coalesce(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def residual(redacted: Column, name: Column) -> Column:
    """Whether a distinctive word of the name (four characters or more) still stands in the text as a word."""
    words = F.split(F.lower(redacted), r"(?U)[^\w]+")
    return F.coalesce(F.arrays_overlap(words, distinctive(normalize(name, "entity"), 4)), F.lit(False))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return pd.Series([html.unescape(t) if isinstance(t, str) else None for t in texts], dtype=object)


def unescape(text: Column) -> Column:
    """HTML references, named and numbered, as characters; texts without an ampersand are not given to Python."""
    return F.when(F.contains(text, F.lit("&")), _unescaped(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)


def mask_acquirer(text: Column, name: Column, ticker: Column) -> Column:
    """Replace the acquirer's name, its forms, its ticker and its significant words by ``ACQUIRER``.

    Words of five letters or more count when there are two of them, a single one from six letters on.
    """
    plain = unescape(text)
    for char, other in (("\u00a0", " "), ("\u200b", ""), ("\ufeff", "")):
        plain = F.replace(plain, F.lit(char), F.lit(other))
    plain = F.translate(plain, "‘’“”", "''\"\"")
    raw = F.trim(F.coalesce(name, F.lit("")))
    paren = F.instr(raw, "(") > 1
    base = F.when(paren, F.trim(F.substring_index(raw, "(", 1))).otherwise(raw)
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(base, NAME_END, "")), r",+$", ""))
    listed = F.regexp_extract(raw, r"\(([A-Z]+:[A-Z.]+)\)", 1)
    mark = F.lit(r"\[ACQUIRER\]")
    tick = F.trim(F.coalesce(ticker, F.lit("")))
    venues = [F.when((F.length(tick) >= 2) & (F.instr(tick, ":") == 0), F.concat(F.lit(v + ":"), tick)).otherwise("") for v in ("NYSE", "NASDAQ", "NASDAQGS")]
    forms = F.array_distinct(F.filter(F.array(raw, F.when(paren, base).otherwise(""), F.when(paren, bare).otherwise(""), F.concat(F.lit("("), listed, F.lit(")")), listed, tick, *venues), lambda v: F.length(v) >= 4))
    ordered = F.transform(F.array_sort(F.transform(forms, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))), lambda x: x["a"])
    t = F.aggregate(F.filter(ordered, lambda v: F.instr(v, " ") > 0), plain, lambda s, v: F.regexp_replace(s, _literal(v), mark))
    word = lambda s, v: F.regexp_replace(s, F.concat(F.lit(r"(?iU)\b\Q"), v, F.lit(r"\E\b")), mark)
    t = F.aggregate(F.filter(ordered, lambda v: F.instr(v, " ") == 0), t, word)
    significant = F.filter(F.transform(F.split(bare, r"\s+"), lambda w: F.regexp_replace(w, "['’]s?$", "")), lambda w: (F.length(w) >= 5) & ~F.lower(w).isin(COMMON))
    significant = F.when((F.size(significant) >= 2) | (F.length(F.get(significant, F.lit(0))) >= 6), significant).otherwise(F.array().cast("array<string>"))
    t = F.aggregate(significant, t, word)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?:\[ACQUIRER\]\s*)+", r"\[ACQUIRER\] "), " {2,}", " "))


def profile(item1: Column, mda: Column, name: Column, ticker: Column, deal_year: Column, revenue: Column, margin: Column) -> Column:
    """What a prompt says of an acquirer: masked and cut filing texts, revenue in millions and margin, without the name."""
    part = lambda c, first, most: F.substring(mask_acquirer(F.substring(F.coalesce(c, F.lit("")), 1, first), name, ticker), 1, most)
    number = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    return F.concat_ws(
        "\n", F.concat(F.lit("ACQUIRER PROFILE -- Company A, FY"), F.coalesce((deal_year - 1).cast("string"), F.lit("N/A"))), F.concat(F.lit("CORE BUSINESS: "), part(item1, 500, 400)),
        F.concat(F.lit("STATED STRATEGY: "), part(mda, 400, 300)), F.concat(F.lit("KEY FINANCIALS: Revenue $"), number(revenue), F.lit("M | EBITDA margin "), number(margin), F.lit("%")),
    )


def identity_profile(name: Column, ticker: Column, deal_year: Column, revenue: Column, margin: Column) -> Column:
    """The counterpart with the name and without texts."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    return F.concat_ws(
        "\n", F.concat(F.lit("COMPANY: "), F.trim(F.coalesce(name, F.lit(""))), F.lit(" ("), F.coalesce(ticker, F.lit("N/A")), F.lit(")")), F.concat(F.lit("FISCAL YEAR: FY"), F.coalesce((deal_year - 1).cast("string"), F.lit("N/A"))),
        F.concat(F.lit("KEY FINANCIALS: Revenue $"), number(revenue), F.lit("M | EBITDA margin "), number(margin), F.lit("%")),
    )


def names_in(profile_text: Column, name: Column) -> Column:
    """Whether a distinctive word (five characters or more) of the name before a bracket stands between blanks in the text."""
    words = distinctive(normalize(F.trim(F.split_part(F.coalesce(name, F.lit("")), F.lit("("), F.lit(1))), "entity"), 5)
    low = F.concat(F.lit(" "), F.lower(profile_text), F.lit(" "))
    return F.coalesce(F.exists(words, lambda w: F.contains(low, F.concat(F.lit(" "), w, F.lit(" ")))), F.lit(False))


def described(pit: Column, fallback: Column, names: Column, name: Column, ticker: Column, max_year: Column, most: int = 250) -> dict[str, Column]:
    """description, source and residual of a candidate: the text known at the time if it has more than 60
    characters, else the fallback; redacted and cut; a placeholder where fewer than 40 characters remain or an
    identity is left."""
    use_pit = F.coalesce(F.length(pit) > 60, F.lit(False))
    raw = F.when(use_pit, pit).otherwise(F.coalesce(fallback, F.lit("")))
    red = redact(raw, names, ticker, max_year)
    short = F.trim(F.substring(red, 1, most))
    empty = F.length(short) < 40
    left = ~empty & residual(red, name)
    source = F.concat(F.when(use_pit, "pit").otherwise("fallback"), F.when(empty, "_empty").otherwise(""))
    return {"description": F.when(empty | left, NO_DESCRIPTION).otherwise(short), "source": source, "residual": left}

"""Company names: three normal forms, aliases, ambiguity, display form.

All functions take and return columns and keep nulls null. Letters of any script count as word
characters. The three normal forms make different keys and are not interchangeable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that each normal form drops.
MERGE_WORDS = "inc corp ltd llc plc co the group holdings company international technologies technology solutions services systems".split()
PIT_WORDS = "inc corp ltd llc plc co the group holdings".split()
ENTITY_FORMS = [
    "incorporated", "inc", "corp", "corporation", "llc", r"l\.l\.c", "ltd", "limited", "plc", "holdings?", "holding", "group", "co", "company",
    "international", "technologies", "technology", "sa", "nv", "ag", "se", "lp", r"l\.p", "trust", "bancorp", "financial", "solutions",
]
#: Words that never identify a company on their own.
STOP_WORDS = (
    "the and of for group holdings holding company corp inc co international systems technologies technology solutions services capital partners "
    "global industries networks communications financial pharmaceuticals energy resources healthcare health media digital"
).split()
#: What introduces another name of the same company.
OTHER_NAME = r"(?:d/b/a|dba|formerly|f/k/a|fka|n/k/a|nka)"

PAREN = r"\([^)]*\)"
NOT_WORD = r"[^\p{L}\p{N}_\s]"
FORM = r"(?iU)\b(?:" + "|".join(ENTITY_FORMS) + r")\b\.?"
TAIL = rf"(?iU)\b{OTHER_NAME}\b.*$"


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def normalize(c: Column, form: str) -> Column:
    """Normal form 'merge' or 'pit' (punctuation deleted) or 'entity' (punctuation becomes space)."""
    c = F.lower(c)
    if form == "entity":
        return F.trim(_chain(c, (TAIL, ""), (PAREN, " "), (FORM, " "), (NOT_WORD, " "), (r"\s+", " ")))
    words = {"merge": MERGE_WORDS, "pit": PIT_WORDS}[form]
    return F.trim(_chain(c, (PAREN, ""), (r"(?U)\b(?:" + "|".join(words) + r")\b", ""), (NOT_WORD, ""), (r"\s+", " ")))


def aliases(c: Column) -> Column:
    """Surface forms of at least three characters: the name, its other name, the base, the base without legal form; in that order."""
    raw = F.trim(c)
    other = F.rtrim(F.regexp_extract(raw, rf"(?iU)\b{OTHER_NAME}\b\s+(.+)$", 1), F.lit("."))
    base = F.trim(F.split_part(_chain(raw, (TAIL, ""), (PAREN, "")), F.lit(","), F.lit(1)))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(base, FORM, "")), r",+$", ""))
    return F.array_distinct(F.filter(F.array(raw, F.trim(other), base, bare), lambda a: F.length(a) >= 3))


def distinctive(normal: Column, least: int = 1) -> Column:
    """Words of an entity form that are no stop words and have at least ``least`` characters."""
    return F.filter(F.array_except(F.split(normal, " "), F.array(*map(F.lit, STOP_WORDS))), lambda w: F.length(w) >= least)


def is_ambiguous(normal: Column) -> Column:
    """Too short or too generic an entity form to be resolved safely."""
    return (F.size(distinctive(normal)) == 0) | (F.length(normal) < 4)


def display_name(c: Column) -> Column:
    """What stands before an opening bracket, if that is not the first character."""
    return F.when(F.instr(c, "(") > 1, F.trim(F.substring_index(c, "(", 1))).otherwise(c)


def has_ticker(text: Column, ticker: Column) -> Column:
    """The ticker stands between word boundaries; one of two characters only in its exact spelling."""
    literal = F.concat(F.lit(r"\Q"), ticker, F.lit(r"\E"))
    word = lambda flags: F.rlike(text, F.concat(F.lit(flags + r"(?<![\w])"), literal, F.lit(r"(?![\w])")))
    return F.when(F.length(ticker) >= 3, word("(?iuU)")).when(F.length(ticker) == 2, word("(?U)")).otherwise(False)

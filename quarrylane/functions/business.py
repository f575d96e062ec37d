"""Buckets, sectors and other classifications of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower edges of the size buckets in millions, and their labels.
SIZE_EDGES = [0.0, 100.0, 500.0, 2000.0, 10000.0]
SIZE_LABELS = ["<$100M", "$100-500M", "$500M-2B", "$2-10B", ">$10B"]
UNKNOWN = "Unknown"
#: SIC ranges of each sector; the first sector that holds a code wins.
SECTORS = [
    ("SPAC", [(9995, 9995)]),
    ("Technology", [(7370, 7379), (3570, 3579), (3670, 3679), (3810, 3829)]),
    ("Healthcare", [(2830, 2836), (8000, 8099), (3840, 3859), (8700, 8734)]),
    ("Industrials", [(1000, 1499), (1500, 1799), (2000, 3569), (3580, 3809), (3900, 3999), (4000, 4799)]),
    ("Consumer", [(5000, 5999), (7000, 7099), (7200, 7299), (7800, 7999)]),
    ("Telecom", [(4800, 4899)]),
    ("Utilities", [(4900, 4999)]),
    ("Real Estate", [(6500, 6799)]),
    ("Finance", [(6000, 6499), (6800, 6999)]),
    ("Services", [(7100, 7199), (7300, 7799), (8735, 8999)]),
]
#: Sectors next to each sector.
ADJACENT = {
    "Technology": ["Healthcare", "Services", "Industrials"],
    "Healthcare": ["Technology", "Services", "Consumer"],
    "Industrials": ["Technology", "Consumer", "Utilities"],
    "Consumer": ["Healthcare", "Industrials", "Services"],
    "Telecom": ["Technology", "Services", "Consumer"],
    "Utilities": ["Industrials", "Real Estate", "Finance"],
    "Real Estate": ["Finance", "Utilities", "Consumer"],
    "Finance": ["Real Estate", "Services", "Technology"],
    "Services": ["Technology", "Healthcare", "Finance"],
    "Other": ["Industrials", "Consumer", "Services"],
}
#: Upper edges of an acquirer's revenue in millions, and the labels of its budget.
BUDGETS = [(500.0, "small (<$0.5B revenue acquirer)"), (5000.0, "mid ($0.5-5B revenue acquirer)"), (20000.0, "large ($5-20B revenue acquirer)")]
BUDGET_TOP = "mega (>$20B revenue acquirer)"


def number(c: Column) -> Column:
    """The value as a double; null where it is no number or NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def size_bucket(millions: Column) -> Column:
    """Half-open buckets; null, NaN, negative and non-numeric values are unknown."""
    x = number(millions)
    out = F.when(x < 0, UNKNOWN)
    for edge, label in zip(SIZE_EDGES[1:], SIZE_LABELS, strict=False):
        out = out.when(x < edge, label)
    return out.when(x < float("inf"), SIZE_LABELS[-1]).otherwise(UNKNOWN)


def sector(sic: Column) -> Column:
    """Sector of an industry code, given as a number or in brackets behind its name."""
    code = F.coalesce(F.nullif(F.regexp_extract(sic, r"\((\d+)\)", 1), F.lit("")).try_cast("int"), F.trim(sic).try_cast("double").try_cast("int"))

    def named(c: Column) -> Column:
        out = F.when(c.isNull(), UNKNOWN)
        for name, ranges in SECTORS:
            test = F.lit(False)
            for low, high in ranges:
                test = test | c.between(low, high)
            out = out.when(test, name)
        return out.otherwise("Other")

    # the code is worked out once and named within a lambda, else each comparison would repeat the parsing
    return F.get(F.transform(F.array(code), named), F.lit(0))


def adjacent_sectors(c: Column) -> Column:
    """The sectors next to one; none for a sector without an entry."""
    table = F.create_map(*[x for k, v in ADJACENT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, c), F.array().cast("array<string>"))


def budget(revenue_millions: Column) -> Column:
    """Bucket of what an acquirer of this revenue can spend; null for no number."""
    x = number(revenue_millions)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, label in BUDGETS:
        out = out.when(x < edge, label)
    return out.otherwise(BUDGET_TOP)


def graded(c: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    """The label of the first threshold that ``c`` exceeds, thresholds falling; null counts as lowest."""
    out = F.when(F.lit(False), F.lit(lowest))
    for threshold, label in steps:
        out = out.when(c > threshold, label)
    return out.otherwise(lowest)

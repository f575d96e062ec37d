"""A sample of identifiers that is the same on every run and layout and stable as data grows (problem 5).

An identifier is written as a number of a fixed domain and sent through a Feistel permutation of
that domain. It is selected when its permuted value lies under rate x domain size. Nothing but the
identifier, the rate and the seed decides, so no row that arrives later can push another one out,
and no two identifiers of the domain can meet.

The domain has BASE ** (2 * HALF) numbers: identifiers of at most 2 * HALF characters of ALPHABET,
read as two numbers of HALF digits each, the missing characters at the end being the digit 0.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_-"
BASE = len(ALPHABET) + 1
HALF = 11
#: Size of a half; below 2**59, so that a sum of two stays a long.
MODULUS = BASE**HALF
ROUNDS = 6


def canonical(column: str) -> Column:
    """Trimmed of white space and upper-cased; null when nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")), F.lit(""))


def halves(key: Column) -> tuple[Column, Column]:
    """The two halves of a canonical identifier's number.

    An identifier that is longer or has other characters does not lie in the domain; it gets the
    two numbers from its MD5 digest, where two identifiers could meet, with a chance below 2**-100
    for any pair.
    """
    inside = (F.length(key) <= 2 * HALF) & ~key.rlike(f"[^{ALPHABET}]")
    padded = F.rpad(key, 2 * HALF, " ")

    def number(first: int) -> Column:
        # one loop, not HALF terms: the padded identifier is worked out once
        add = lambda n, c: n * BASE + F.instr(F.lit(ALPHABET), c)
        return F.aggregate(F.split(F.substring(padded, first, HALF), ""), F.lit(0).cast("long"), add)

    def digest(first: int) -> Column:
        return F.conv(F.substring(F.md5(key), first, 15), 16, 10).cast("long") % MODULUS

    return F.when(inside, number(1)).otherwise(digest(1)), F.when(inside, number(1 + HALF)).otherwise(digest(17))


def permuted(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Add the halves ``permuted_high`` and ``permuted_low`` of the permuted number of ``key``.

    Each round is (left, right) -> (right, left + f(round, right) mod MODULUS), which can be undone
    whatever f is; f is the first 60 bits of an MD5 digest.
    """
    left, right = halves(F.col(key))

    def turn(s: Column, i: Column) -> Column:
        mixed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), i.cast("string"), s["r"].cast("string"))), 1, 15), 16, 10).cast("long") % MODULUS
        return F.struct(s["r"].alias("l"), ((s["l"] + mixed) % MODULUS).alias("r"))

    turns = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.alias("l"), right.alias("r")), turn)
    return df.withColumn("__p", turns).select(*df.columns, F.col("__p.l").alias("permuted_high"), F.col("__p.r").alias("permuted_low"))


def stable_sample(df: DataFrame, key: str, rate: str, seed: str = "s1") -> DataFrame:
    """The rows of ``df`` (one for each canonical ``key``) that belong to the sample.

    rate: a decimal between 0 and 1 as text, used exactly. A larger rate gives a superset under the
    same seed. Rows without a key are never selected; repeated keys are all selected or all not.
    """
    under = Fraction(rate)
    if not 0 <= under <= 1:
        raise ValueError("rate must lie between 0 and 1")
    high, low = divmod(int(under * MODULUS * MODULUS), MODULUS)
    at = permuted(df.where(F.col(key).isNotNull()), key, seed)
    return at.where((F.col("permuted_high") < high) | (F.col("permuted_high") == high) & (F.col("permuted_low") < low))


def _deals(spark: SparkSession, root: str) -> DataFrame:
    """One row for each deal. Rows are combined as their ids are written before the ids are brought to one form, on either side of the shuffle."""
    written = table(spark, root, "corpus_per_deal").groupBy("deal_id").agg(F.count("*").alias("n"), F.min("loaded_at").alias("a"), F.max("loaded_at").alias("b"))
    return written.groupBy(canonical("deal_id").alias("deal_id")).agg(F.sum("n").alias("n_rows"), F.min("a").alias("first_loaded"), F.max("b").alias("last_loaded"))


RATE = "0.1"
LATER = "0.25"


def p5_sample(spark: SparkSession, root: str) -> DataFrame:
    """Deals of the 10 % sample, with the number of their rows."""
    out = stable_sample(_deals(spark, root), "deal_id", RATE)
    return out.select("deal_id", "n_rows", F.date_format("first_loaded", "yyyy-MM-dd HH:mm:ss").alias("first_loaded"), "permuted_high", "permuted_low")


def p5_growth(spark: SparkSession, root: str) -> DataFrame:
    """For each year of first arrival: new deals, and those selected at either rate; no year changes an earlier one."""
    deals = permuted(_deals(spark, root).where("deal_id IS NOT NULL"), "deal_id", "s1")

    def under(rate: str) -> Column:
        high, low = divmod(int(Fraction(rate) * MODULUS * MODULUS), MODULUS)
        return (F.col("permuted_high") < high) | (F.col("permuted_high") == high) & (F.col("permuted_low") < low)

    return deals.groupBy(F.year("first_loaded").cast("long").alias("year")).agg(
        F.count("*").alias("n_new"), F.count_if(under(RATE)).alias("n_sample"), F.count_if(under(LATER)).alias("n_larger_sample")
    )


QUERIES = {"p5_sample": p5_sample, "p5_growth": p5_growth}


def _sql() -> str:
    digits = lambda first: " + ".join(f"instr('{ALPHABET}', substr(padded, {i}, 1)) * {BASE ** (HALF - 1 - k)}::BIGINT" for k, i in enumerate(range(first, first + HALF)))
    rounds, last = "", "c0"
    for i in range(ROUNDS):
        rounds += f""",
{last}_{i} AS (SELECT deal_id, n_rows, first_loaded, r AS l, (l + ('0x' || substr(md5('s1|{i}|' || r), 1, 15))::BIGINT % {MODULUS}) % {MODULUS} AS r FROM {last})"""
        last = f"{last}_{i}"
    return rf"""WITH d AS (
  SELECT upper(regexp_replace(deal_id, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')) AS deal_id, count(*) AS n_rows, min(loaded_at) AS first_loaded
  FROM corpus_per_deal GROUP BY 1),
p AS (SELECT *, rpad(deal_id, {2 * HALF}, ' ') AS padded FROM d WHERE deal_id <> ''),
c0 AS (SELECT deal_id, n_rows, first_loaded, {digits(1)} AS l, {digits(1 + HALF)} AS r FROM p){rounds},
z AS (SELECT deal_id, n_rows, first_loaded, l AS permuted_high, r AS permuted_low FROM {last})
"""


def _under(rate: str) -> str:
    high, low = divmod(int(Fraction(rate) * MODULUS * MODULUS), MODULUS)
    return f"(permuted_high < {high} OR permuted_high = {high} AND permuted_low < {low})"


ORACLE = {
    "p5_sample": _sql() + f"SELECT deal_id, n_rows, strftime(first_loaded, '%Y-%m-%d %H:%M:%S') AS first_loaded, permuted_high, permuted_low FROM z WHERE {_under(RATE)}",
    "p5_growth": _sql() + f"SELECT CAST(year(first_loaded) AS BIGINT) AS year, count(*) AS n_new, count(*) FILTER ({_under(RATE)}) AS n_sample, count(*) FILTER ({_under(LATER)}) AS n_larger_sample FROM z GROUP BY 1",
}

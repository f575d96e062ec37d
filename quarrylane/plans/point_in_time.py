"""Queries of problem 2: attributes as known at event time."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import as_known_at
from ..sources.tables import table

#: Anything but white space, Unicode's included.
NOT_BLANK = r"(?U)\S"


def _sides(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    deals = table(spark, root, "deal_filing").where(F.col("announced_date").isNotNull())
    filings = table(spark, root, "filings").where(F.col("item1_text").rlike(NOT_BLANK))
    pool = table(spark, root, "pool").where(F.col("ciq_desc").rlike(NOT_BLANK))
    filings = filings.withColumn("text_chars", F.length("item1_text").cast("long"))
    pool = pool.withColumn("text_chars", F.length("ciq_desc").cast("long"))
    acquirer = as_known_at(
        deals.where("hf_match").select("deal_id", "hf_cik", "announced_date"), filings,
        entity=("hf_cik", "hf_cik"), event_time="announced_date", available=[("hf_filing_date", True)],
        latest_by=["hf_filing_date", "filing_id"], take={"filing_id": "version_id", "text_chars": "text_chars"},
    )
    target = as_known_at(
        deals.select("deal_id", "target_ticker", "announced_date"), pool,
        entity=("target_ticker", "ticker"), event_time="announced_date", available=[("published_at", True), ("valid_from", False)],
        latest_by=["valid_from", "published_at", "pool_id"], take={"pool_id": "version_id", "text_chars": "text_chars"},
    )
    return acquirer, target


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The version of either side's text that was known on announced_date."""
    acquirer, target = _sides(spark, root)
    one = lambda df, side: df.where("version_id is not null").select("deal_id", F.lit(side).alias("side"), "version_id")
    return one(acquirer, "acquirer").unionByName(one(target, "target")).distinct()


def p2_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Per deal year and side: deals, deals with a known text, and characters known."""
    acquirer, target = _sides(spark, root)

    def one(df: DataFrame, side: str) -> DataFrame:
        return df.distinct().select(F.year("announced_date").cast("long").alias("year"), F.lit(side).alias("side"), "version_id", "text_chars")

    return (
        one(acquirer, "acquirer").unionByName(one(target, "target"))
        .groupBy("year", "side")
        .agg(F.count("*").alias("n_deals"), F.count("version_id").alias("n_known"), F.coalesce(F.sum("text_chars"), F.lit(0)).alias("chars_known"))
    )


QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage}

_BEST = r"""
WITH d AS (SELECT DISTINCT deal_id, hf_match, hf_cik, target_ticker, announced_date FROM deal_filing WHERE announced_date IS NOT NULL),
a AS (
  SELECT d.deal_id, d.hf_cik AS k, d.announced_date, f.filing_id AS version_id, length(f.item1_text) AS n,
    row_number() OVER (PARTITION BY d.deal_id, d.hf_cik, d.announced_date ORDER BY f.hf_filing_date DESC NULLS LAST, f.filing_id DESC NULLS LAST) AS r
  FROM (SELECT DISTINCT deal_id, hf_cik, announced_date FROM d WHERE hf_match) d
  LEFT JOIN filings f ON f.hf_cik = d.hf_cik AND f.hf_filing_date < CAST(d.announced_date AS TIMESTAMP) AND regexp_matches(f.item1_text, '[^\s\pZ]')
),
t AS (
  SELECT d.deal_id, d.target_ticker AS k, d.announced_date, p.pool_id AS version_id, length(p.ciq_desc) AS n,
    row_number() OVER (PARTITION BY d.deal_id, d.target_ticker, d.announced_date ORDER BY p.valid_from DESC NULLS LAST, p.published_at DESC NULLS LAST, p.pool_id DESC NULLS LAST) AS r
  FROM (SELECT DISTINCT deal_id, target_ticker, announced_date FROM d) d
  LEFT JOIN pool p ON p.ticker = d.target_ticker AND p.published_at < CAST(d.announced_date AS TIMESTAMP)
    AND p.valid_from <= d.announced_date AND regexp_matches(p.ciq_desc, '[^\s\pZ]')
),
u AS (
  SELECT deal_id, announced_date, 'acquirer' AS side, version_id, n FROM a WHERE r = 1
  UNION ALL SELECT deal_id, announced_date, 'target', version_id, n FROM t WHERE r = 1
)
"""

ORACLE = {
    "p2_found": _BEST + "SELECT DISTINCT deal_id, side, version_id FROM u WHERE version_id IS NOT NULL",
    "p2_coverage": _BEST + """SELECT CAST(year(announced_date) AS BIGINT) AS year, side, count(*) AS n_deals, count(version_id) AS n_known,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS chars_known FROM u GROUP BY ALL""",
}

"""Queries of problem 1: unmatched deals tied to the filer that is their acquirer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut_lineage, spread
from ..sources.tables import table
from .matching import MATCH, match_entities, reliability, slip

#: Where a management discussion states the year's revenue, in millions or billions of dollars.
_REVENUE = r"(?i)(?:net sales|revenues?|turnover)[^$\n]{0,60}\$([\d,]+(?:\.\d+)?) (million|billion)"
#: A ticker after its exchange in brackets, in a name.
_LISTED = r"\([A-Za-z]{2,8}\s*:\s*([A-Za-z.]{1,6})\)"


def _ticker(column: str):
    """Upper case, without an exchange in front."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(column)), r"^.*:\s*", ""), F.lit(""))


def _name_key(column: str):
    return F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))


def sides(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """deals (deal_id, hf_match, group), and left, right and known of ``match_entities``.

    A group is the deals of one ticker (slips of the pen allowed for), or of one name where no ticker
    is given and the name does not stand beside exactly one ticker elsewhere.
    """
    d = table(spark, root, "deal_filing").select(
        "deal_id", "hf_match", "hf_cik", "acquirer_name", _name_key("acquirer_name").alias("n"),
        F.coalesce(_ticker("acquirer_ticker"), F.nullif(F.upper(F.regexp_extract("acquirer_name", _LISTED, 1)), F.lit(""))).alias("ticker"),
        F.coalesce("tenk_year", F.year("announced_date") - 1).cast("int").alias("year"), F.coalesce("acquirer_revenue_ciq_000", "acquirer_revenue_000").alias("figure"),
    )
    # the ticker most often given with a name stands for those a slip away from it, and for a missing one if it is the only one
    seen = d.where("ticker IS NOT NULL AND n IS NOT NULL").groupBy("n", "ticker").agg(F.count("*").alias("c"))
    main = seen.groupBy("n").agg(F.max_by("ticker", F.struct("c", "ticker")).alias("main"))
    seen = seen.join(spread(main), "n").withColumn("same", slip("ticker", "main"))
    one = seen.groupBy("n").agg(F.first("main").alias("main"), F.bool_and("same").alias("only"))
    d = d.join(spread(one), "n", "left")
    d = d.withColumn("ticker", F.when(F.col("ticker").isNull(), F.when(F.col("only"), F.col("main"))).when(slip("ticker", "main"), F.col("main")).otherwise(F.col("ticker")))
    group = F.coalesce(F.concat(F.lit("t:"), "ticker"), F.concat(F.lit("n:"), "n"))
    d = cut_lineage(d.select("deal_id", "hf_match", "hf_cik", "acquirer_name", "ticker", "year", "figure", group.alias("group")).where("group IS NOT NULL"))
    left = d.select("group", F.col("acquirer_name").alias("name"), "ticker", "year", "figure").distinct()
    known = d.where("hf_match AND hf_cik IS NOT NULL").select("group", F.col("hf_cik").alias("entity"))

    f = table(spark, root, "filings").where("hf_cik IS NOT NULL")
    number = F.regexp_replace(F.regexp_extract("mda_text", _REVENUE, 1), ",", "").try_cast("double")
    figure = number * F.when(F.lower(F.regexp_extract("mda_text", _REVENUE, 2)) == "billion", 1e6).otherwise(1e3)
    year = F.coalesce("fiscal_year", F.col("hf_filing_year") - 1).cast("int")
    right = f.select(F.col("hf_cik").alias("entity"), F.col("hf_company").alias("name"), year.alias("year"), figure.alias("figure")).distinct()
    return d.select("deal_id", "hf_match", "group"), left, cut_lineage(right), known


def p1_matches(spark: SparkSession, root: str) -> DataFrame:
    """Every unmatched deal with its likeliest filer, the score and the confidence."""
    deals, left, right, known = sides(spark, root)
    best = match_entities(left, right, known)
    ours = deals.where(~F.col("hf_match")).select("deal_id", "group").distinct()
    out = ours.join(spread(best), "group").select("deal_id", F.col("entity").alias("hf_cik"), "score", "confidence")
    first = W.partitionBy("deal_id").orderBy(F.desc("confidence"), "hf_cik")
    return out.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Unmatched deals whose acquirer is a company filing in filings."""
    return p1_matches(spark, root).where(F.col("confidence") >= MATCH).select("deal_id", "hf_cik").distinct()


def p1_confidence(spark: SparkSession, root: str) -> DataFrame:
    """Unmatched deals by tenth of confidence."""
    tenth = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("long")
    return p1_matches(spark, root).groupBy(tenth.alias("tenth")).agg(F.count("*").alias("n_deals"), F.count_distinct("hf_cik").alias("n_filers"))


def _best(spark: SparkSession, root: str) -> DataFrame:
    _, left, right, known = sides(spark, root)
    return match_entities(left, right, known)


def p1_reliability(spark: SparkSession, root: str) -> DataFrame:
    """Confidence against truth, by tenth of confidence, on acquirers whose filer is known, each judged by a curve fitted without it."""
    return reliability(_best(spark, root))


def p1_search_recall(spark: SparkSession, root: str) -> DataFrame:
    """Of the acquirers whose one filer is known, how many the search met it for, and how many it also ranked first."""
    b = _best(spark, root).where("n_true = 1")
    met = F.col("true_score").isNotNull()
    first = met & (F.col("true_score") >= F.coalesce("other_score", F.lit(0.0)))
    return b.agg(F.count("*").alias("n_groups"), F.count_if(met).alias("n_met"), F.count_if(first).alias("n_first"), F.round(F.count_if(met) / F.nullif(F.count("*"), F.lit(0)), 6).alias("search_recall"))


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p1_confidence": p1_confidence, "p1_reliability": p1_reliability, "p1_search_recall": p1_search_recall}
ORACLE: dict[str, str] = {}

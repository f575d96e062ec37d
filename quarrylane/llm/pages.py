"""Queries of problem 8: keyword-stuffed and link-list pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .layout_hmm import layout_shares

#: A page consists mostly of spam when more than this share of its words is not prose.
SPAM_SHARE = 0.5
#: A page of fewer words is a stub: too short for a list or for a word to be repeated.
LEAST_WORDS = 6


def is_spam():
    return (F.col("non_prose_share") > SPAM_SHARE) & (F.col("n_words") >= LEAST_WORDS)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose words mostly lie in link lists, tag lists or menus."""
    return layout_shares(table(spark, root, "documents")).where(is_spam()).select("doc_id")


def p8_by_source(spark: SparkSession, root: str) -> DataFrame:
    """For each source: documents, flagged ones, and words by kind of layout."""
    docs = table(spark, root, "documents")
    shares = layout_shares(docs)
    source = F.lower(F.trim("source")).alias("source")
    return (
        docs.select("doc_id", source).join(shares, "doc_id")
        .groupBy("source")
        .agg(
            F.count("*").alias("n_docs"), F.count_if(is_spam()).alias("n_spam"), F.sum("n_words").alias("n_words"),
            F.sum("link_words").alias("link_words"), F.sum("tag_words").alias("tag_words"), F.sum("menu_words").alias("menu_words"),
        )
    )


QUERIES = {"p8_found": p8_found, "p8_by_source": p8_by_source}
ORACLE: dict[str, str] = {}

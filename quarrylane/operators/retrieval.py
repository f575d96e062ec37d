"""Lexical and dense ranking of items against a query, each group of items being its own corpus.

The lexical rankers hash-partition the words of items and queries by group once; all counts,
windows and sums after that are within a group, so no further shuffle follows and the input is
read once. A group's words must fit a task.

Scores are rounded to nine digits before ranking; ties go to the smaller item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.redaction import unescape

#: Published defaults of Okapi BM25, and the share of the mean idf that replaces a negative one.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: English function words that the tf-idf ranker leaves out unless told otherwise.
STOP_WORDS = (
    "about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers him his how if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same "
    "she should so some such than that the their theirs them then there these they this those through to too under until up very was we were what when where which while who whom why "
    "will with would you your yours"
).split()
DIGITS = 9


def lexical_text(c: Column) -> Column:
    """ASCII letters, digits and hyphens in lower case, single spaces; HTML references decoded."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(unescape(c), r"[^a-zA-Z0-9\s-]", " "), r"\s+", " ")))


def tokens(c: Column) -> Column:
    """Words of the lexical text; an empty array for null or empty text."""
    t = lexical_text(c)
    return F.when(F.length(t) > 0, F.split(t, " ")).otherwise(F.array().cast("array<string>"))


def terms(c: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words of two characters or more without stop words, and their neighbouring pairs."""
    words = F.regexp_extract_all(lexical_text(c), F.lit(r"\b(\w\w+)\b"), 1)
    kept = F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: ~w.isin(stop_words))
    pairs = F.zip_with(kept, F.slice(kept, F.lit(2), F.size(kept)), lambda w, x: F.when(x.isNotNull(), F.concat_ws(" ", w, x)))
    return F.concat(kept, F.array_compact(pairs))


def _rank(scored: DataFrame, group: str, item: str) -> DataFrame:
    order = W.partitionBy(group).orderBy(F.desc("score"), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order))


def _counts(items: DataFrame, queries: DataFrame, group: str, item: str, doc: str, query: str) -> DataFrame:
    """One row for each (group, item, word): n, and with the item's length; words of the query have no item but ``asked``.

    A row without a word stands for each item, so that empty items stay. The rows are partitioned
    by group here and nowhere else; the number of partitions is fixed, since counting words costs
    far more than the bytes of the rows would let Spark expect. After the count, each row also has
    the group's number of items with words (n_items) and their words (n_words), and its word's
    number of items (df) and count in the query (qf).
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = F.coalesce(F.col(doc), F.array().cast("array<string>"))
    marked = F.concat(words, F.array(F.lit(None).cast("string")))
    rows = items.select(F.col(group).alias("g"), F.col(item).alias("i"), F.size(words).alias("len"), F.lit(False).alias("asked"), F.explode(marked).alias("t"))
    none = F.lit(None).cast(rows.schema["i"].dataType)
    ask = queries.select(F.col(group).alias("g"), none.alias("i"), F.lit(0).alias("len"), F.lit(True).alias("asked"), F.explode(query).alias("t"))
    tf = rows.unionByName(ask).repartition(parts, "g").groupBy("g", "i", "len", "asked", "t").agg(F.count("*").alias("n"))
    item_row = ~F.col("asked") & F.col("t").isNull() & (F.col("len") > 0)
    by_word, by_group = W.partitionBy("g", "t"), W.partitionBy("g")
    tf = tf.withColumns({"df": F.count_if(~F.col("asked")).over(by_word), "qf": F.coalesce(F.max(F.when(F.col("asked"), F.col("n"))).over(by_word), F.lit(0))})
    return tf.withColumns({"n_items": F.count_if(item_row).over(by_group), "n_all": F.count_if(~F.col("asked") & F.col("t").isNull()).over(by_group), "n_words": F.sum(F.when(item_row, F.col("len"))).over(by_group)})


def bm25(items: DataFrame, queries: DataFrame, *, group: str, item: str, doc: str, query: str) -> DataFrame:
    """(group, item, score, rank) by Okapi BM25; repeated query words count each time.

    items: (group, item) once each, with an array of words. queries: one array of words for each
    group. Items without words come last with the score -1; groups without a query score 0.
    """
    c = _counts(items, queries, group, item, doc, query)
    word = ~F.col("asked") & F.col("t").isNotNull()
    raw = F.log(F.col("n_items") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    c = c.withColumn("raw", F.when(word, raw))
    # each word counts once in the mean: its rows share its weight
    once = F.when(word, 1.0 / F.col("df"))
    by_group = W.partitionBy("g")
    c = c.withColumn("floor", EPSILON * F.sum(F.col("raw") * once).over(by_group) / F.sum(once).over(by_group))
    idf = F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))
    mean = F.col("n_words") / F.col("n_items")
    part = F.col("qf") * idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("len") / mean))
    sums = c.where(~F.col("asked")).groupBy("g", "i", "len").agg(F.sum(F.when(F.col("qf") > 0, part)).alias("s"))
    score = F.when(F.col("len") > 0, F.round(F.coalesce("s", F.lit(0.0)), DIGITS)).otherwise(-1.0)
    return _rank(sums.select(F.col("g").alias(group), F.col("i").alias(item), score.alias("score")), group, item)


def tfidf(items: DataFrame, queries: DataFrame, *, group: str, item: str, doc: str, query: str) -> DataFrame:
    """(group, item, score, rank) by the cosine of tf-idf vectors fitted on the group's items.

    Input as for ``bm25``. tf is 1 + ln(count), idf is ln((1 + n) / (1 + df)) + 1, vectors have unit
    length; query terms that no item has are ignored. Items or queries without terms score 0.
    """
    c = _counts(items, queries, group, item, doc, query)
    idf = F.log((1.0 + F.col("n_all")) / (1.0 + F.col("df"))) + 1
    c = c.withColumn("w", F.when(F.col("t").isNotNull() & (F.col("df") > 0), (1 + F.log("n")) * idf))
    c = c.withColumn("qw", F.when(F.col("t").isNotNull() & (F.col("qf") > 0), (1 + F.log("qf")) * idf))
    c = c.withColumn("q2", F.sum(F.when(F.col("asked"), F.col("w") * F.col("w"))).over(W.partitionBy("g")))
    sums = c.where(~F.col("asked")).groupBy("g", "i").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("d2"), F.max("q2").alias("q2"))
    score = F.round(F.coalesce(F.col("dot") / (F.sqrt("d2") * F.sqrt("q2")), F.lit(0.0)), DIGITS)
    return _rank(sums.select(F.col("g").alias(group), F.col("i").alias(item), score.alias("score")), group, item)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for arrays of unequal length or zero length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def dense(items: DataFrame, *, group: str, item: str, vector: str, query: str) -> DataFrame:
    """(group, item, score, rank) by cosine; vectors that cannot be compared rank last with a null score."""
    scored = items.select(group, item, F.round(cosine(F.col(vector), F.col(query)), DIGITS).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc_nulls_last("score"), F.col(item))))


def nearest(rows: DataFrame, queries: DataFrame, *, key: str, vector: str, k: int = 10, block: int = 20_000, query_block: int = 500) -> DataFrame:
    """(query, key, score, rank): the k rows of greatest cosine for each row of a stated query set, itself left out.

    Exact. Rows are hashed to blocks; each block of rows meets each block of queries as one matrix
    product, keeps its best k for each query, and only those are merged. The number of blocks
    follows the number of rows, so a task holds a bounded part of either side. Rows and queries
    without a vector are left out, vectors of zero length score 0; all vectors must have one length.
    """
    part = lambda df, n: df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias("block"))
    n_rows, n_queries = max(1, -(-rows.count() // block)), max(1, -(-queries.count() // query_block))
    of_rows = part(rows, n_rows).select(F.col("block").alias("rb"), "k", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))).alias("qb"))
    of_queries = part(queries, n_queries).select(F.col("block").alias("qb"), "k", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))).alias("rb"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "k": [], "score": []}
        if len(left) and len(right):
            unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
            s = np.round(unit(np.stack(right["v"].to_numpy())) @ unit(np.stack(left["v"].to_numpy())).T, DIGITS)
            keys = left["k"].to_numpy()
            for q, row in zip(right["k"], s, strict=True):
                order = np.lexsort((keys, -row))
                order = order[keys[order] != q][:k]
                out["query"] += [q] * len(order)
                out["k"] += keys[order].tolist()
                out["score"] += row[order].tolist()
        return pd.DataFrame(out)

    kind = rows.schema[key].dataType.simpleString()
    met = of_rows.groupBy("rb", "qb").cogroup(of_queries.groupBy("rb", "qb")).applyInPandas(best, f"query {kind}, k {kind}, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "k"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query", F.col("k").alias(key), "score", "rank")

"""Mixing sources to target weights (problem 7).

The tokens of each source are laid in a seeded order and cut in blocks of equal length, shard by
shard. Sainte-Lague apportionment (highest quotients share / 1, share / 3, share / 5, ...) gives
each source a whole number of blocks, and again each shard of a source its part of them. Within a
shard all blocks are taken as often as the quota holds them whole, and a seeded choice of blocks
once more.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut_lineage, write_once
from ..sources.tables import table
from .tokens import VOCABULARY, token_counts

#: Tokens of a shard aimed at, and the most shards of a source; the latter bounds what the driver holds.
SHARD_TOKENS = 5_000_000
MOST_SHARDS = 4096
#: Blocks that the least target of a mix should make up, within these sizes in tokens.
LEAST_BLOCKS = 200
BLOCK_RANGE = (256, 65536)


def sainte_lague(weights: Sequence[float], seats: int) -> list[int]:
    """Whole numbers in proportion to ``weights`` that sum to ``seats``; ties go to the first.

    Equal to handing out one seat after another to the highest quotient weight / (2 * given + 1),
    but starts from the rounded shares, so that the last few seats alone are handed out singly.
    """
    w = np.maximum(np.asarray(weights, dtype=float), 0)
    if seats <= 0 or not w.sum():
        return [0] * len(w)
    given = np.floor(w / w.sum() * seats + 0.5).astype(int)
    while given.sum() > seats:  # take back the seats won with the lowest quotients
        quotient = np.where(given > 0, w / np.maximum(1, 2 * given - 1), np.inf)
        given[len(w) - 1 - int(np.argmin(quotient[::-1]))] -= 1
    while given.sum() < seats:
        given[int(np.argmax(w / (2 * given + 1)))] += 1
    while True:  # a seat may still sit with a lower quotient than another source would have
        lost = np.where(given > 0, w / np.maximum(1, 2 * given - 1), np.inf)
        won = w / (2 * given + 1)
        worst, best = len(w) - 1 - int(np.argmin(lost[::-1])), int(np.argmax(won))
        if won[best] <= lost[worst]:
            return given.tolist()
        given[worst] -= 1
        given[best] += 1


def _source(column: str):
    return F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))


def mix(records: DataFrame, targets: DataFrame, *, key: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: str = "m1") -> DataFrame:
    """How often each record appears in each mix.

    targets: mix_name, source, target_share, max_repeats; few rows, they are read by the driver.
    A mix is as large as its scarcest source allows at its most repeats. Result: mix_name, source,
    key, n_tokens, repeats (1 to max_repeats); records that a mix does not use have no row.

    Sources are compared trimmed and in lower case. Records with a null source or one without a
    target are in no mix; null sizes count as 0; repeated records count each time. A target source
    without tokens stays empty, and the shares of the others keep their proportion. Empty tables
    give no rows. Two different targets of one source in a mix raise an error. The result depends on the rows and the seed, not on the layout.
    """
    plan = targets.select("mix_name", _source("source").alias("source"), "target_share", "max_repeats").na.drop().toPandas()
    plan = plan[plan["target_share"] > 0].drop_duplicates()
    twice = plan[plan.duplicated(["mix_name", "source"])]
    if len(twice):
        raise ValueError(f"two targets for one source: {twice[['mix_name', 'source']].values.tolist()}")
    rows = records.select(F.col(key).alias("k"), _source(source).alias("source"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))
    rows = rows.where(F.col("source").isin(sorted(set(plan["source"])))) if len(plan) else rows.where("false")
    held = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # at most a row for each target source

    shards = {s: int(min(MOST_SHARDS, max(1, -(-n // SHARD_TOKENS)))) for s, n in held.items()}
    shard = F.lit(0)
    for s, k in shards.items():
        shard = F.when(F.col("source") == s, F.pmod(F.xxhash64("k", "n"), F.lit(k))).otherwise(shard)
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("k").cast("string")))
    line = W.partitionBy("source", "shard").orderBy("o", "k", "n").rowsBetween(W.unboundedPreceding, W.currentRow)
    sizes = {}
    for name, p in plan.groupby("mix_name"):
        p = p[p["source"].map(lambda s: held.get(s, 0) > 0)]
        total = min((held[r.source] * r.max_repeats / r.target_share for r in p.itertuples()), default=0)
        sizes[name] = (p, total)
    least = min((total * p["target_share"].min() for p, total in sizes.values() if total), default=0)
    block = int(min(BLOCK_RANGE[1], max(BLOCK_RANGE[0], least / LEAST_BLOCKS)))
    placed = rows.withColumn("shard", shard).withColumn("o", order)
    placed = placed.withColumn("block", F.floor((F.sum("n").over(line) - F.col("n")) / block)).drop("o")
    placed = cut_lineage(placed)

    blocks = placed.groupBy("source", "shard", "block").agg(F.sum("n").alias("n"))
    of_shard = blocks.groupBy("source", "shard").agg(F.sum("n").alias("n")).orderBy("source", "shard").toPandas()  # at most MOST_SHARDS for each source
    quotas = []
    for name, (p, total) in sizes.items():
        for r, seats in zip(p.itertuples(), sainte_lague(list(p["target_share"]), int(total // block)), strict=True):
            own = of_shard[of_shard["source"] == r.source]
            for h, n, q in zip(own["shard"], own["n"], sainte_lague(list(own["n"]), seats), strict=True):
                whole = min(int(r.max_repeats), q * block // int(n)) if n else 0
                rest = q * block - whole * int(n) if whole < r.max_repeats else 0
                quotas.append((name, r.source, int(h), whole, rest))
    spark = records.sparkSession
    quota = spark.createDataFrame(pd.DataFrame(quotas, columns=["mix_name", "source", "shard", "whole", "rest"]), "mix_name string, source string, shard int, whole long, rest long")
    drawn = W.partitionBy("mix_name", "source", "shard").orderBy("o", "block").rowsBetween(W.unboundedPreceding, W.currentRow)
    taken = blocks.withColumn("shard", F.col("shard").cast("int")).join(F.broadcast(quota), ["source", "shard"])
    taken = taken.withColumn("o", F.md5(F.concat_ws("|", F.lit(seed), "mix_name", F.col("shard").cast("string"), F.col("block").cast("string"))))
    first = F.sum("n").over(drawn) - F.col("n") / 2 <= F.col("rest")
    taken = taken.withColumn("once", F.when(first, 1).otherwise(0))
    # a long record may end the first pass early; blocks that fit what is then missing fill it
    missing = F.col("rest") - F.sum(F.col("n") * F.col("once")).over(W.partitionBy("mix_name", "source", "shard"))
    taken = taken.withColumn("missing", missing).withColumn("small", F.when((F.col("once") == 0) & (F.col("n") <= F.col("missing")), F.col("n")).otherwise(0))
    second = (F.col("once") == 0) & (F.col("small") > 0) & (F.sum("small").over(drawn) - F.col("n") / 2 <= F.col("missing"))
    taken = taken.withColumn("repeats", F.col("whole") + F.when((F.col("once") == 1) | second, 1).otherwise(0))
    taken = taken.where(F.col("repeats") > 0).select("mix_name", "source", "shard", "block", "repeats")
    out = placed.withColumn("shard", F.col("shard").cast("int")).join(taken, ["source", "shard", "block"])
    return out.select("mix_name", "source", F.col("k").alias(key), F.col("n").alias("n_tokens"), "repeats")


def _mixed(spark: SparkSession, root: str, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    records = cut_lineage(token_counts(table(spark, root, "documents"), keep=["doc_id", "source"], vocabulary=vocabulary))
    targets = table(spark, root, "mix_targets")
    return mix(records, targets), targets


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    """Every record of every mix and how often it appears."""
    return _mixed(spark, root)[0]


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """For each mix and source: target share, share reached, tokens, records and most repeats."""
    mixed, targets = _mixed(spark, root)
    reached = mixed.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.count("*").alias("n_records"), F.max("repeats").alias("most_repeats")
    )
    wanted = targets.select("mix_name", _source("source").alias("source"), "target_share", F.col("max_repeats").cast("long").alias("max_repeats")).distinct()
    zero = F.lit(0).cast("long")
    out = wanted.join(reached, ["mix_name", "source"], "left")
    n = F.coalesce("n_tokens", zero)
    share = n / F.nullif(F.sum(n).over(W.partitionBy("mix_name")), zero)
    return out.select(
        "mix_name", "source", "target_share", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("actual_share"), n.alias("n_tokens"),
        F.coalesce("n_records", zero).alias("n_records"), "max_repeats", F.coalesce("most_repeats", zero).alias("most_repeats"),
    )


#: What must hold of every mix: shares within this of their targets and one longest record, as long as each source has tokens.
NEAR = 0.01


def p7_invariants(spark: SparkSession, root: str) -> DataFrame:
    """For each mix: records repeated too often, of a source that is no target, sources off their share (where all have tokens), and records in two rows."""
    mixed, targets = _mixed(spark, root)
    mixed = write_once(mixed)
    wanted = targets.select("mix_name", _source("source").alias("source"), "target_share", "max_repeats").distinct()
    rows = mixed.join(F.broadcast(wanted), ["mix_name", "source"], "left")
    often = rows.groupBy("mix_name").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("n0"), F.count_if(F.col("max_repeats").isNull() | (F.col("repeats") < 1)).alias("n1"))
    twice = mixed.groupBy("mix_name", "doc_id").agg(F.count("*").alias("n")).groupBy("mix_name").agg(F.count_if(F.col("n") > 1).alias("n3"))
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n"), F.max(F.col("n_tokens") * F.col("repeats")).alias("longest"))
    total, longest = F.sum("n").over(W.partitionBy("mix_name")), F.max("longest").over(W.partitionBy("mix_name"))
    share = wanted.join(got, ["mix_name", "source"], "left").withColumns({"total": total, "most": longest})
    far = F.abs(F.col("n") - F.col("target_share") * F.col("total")) > NEAR * F.col("total") + F.col("most")
    off = share.groupBy("mix_name").agg(F.when(F.count_if(F.col("n").isNull()) > 0, 0).otherwise(F.count_if(far)).alias("n2"))
    out = wanted.select("mix_name").distinct().join(often, "mix_name", "left").join(off, "mix_name", "left").join(twice, "mix_name", "left")
    names = ("repeated_too_often", "source_without_target", "share_off_target", "record_in_two_rows")
    return out.select("mix_name", F.inline(F.array(*[F.struct(F.lit(x).alias("invariant"), F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("long").alias("n_violations")) for i, x in enumerate(names)])))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_invariants": p7_invariants}
ORACLE = {
    "p7_invariants": "SELECT DISTINCT mix_name, invariant, 0::BIGINT AS n_violations FROM mix_targets, (VALUES ('repeated_too_often'), ('source_without_target'), ('share_off_target'), ('record_in_two_rows')) t(invariant)"
}

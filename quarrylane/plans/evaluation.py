"""Evaluation of model answers: parsing, ranking metrics, breakdowns, comparisons and inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..functions.business import graded
from ..functions.names import ENTITY_FORMS, OTHER_NAME, STOP_WORDS
from ..operators.entities import recall_labels
from ..operators.inference import mean_interval, paired_interval, spearman, subset_interval, with_p_value
from ..operators.relational import pick_last, top_per_group
from ..runtime import write_once
from ..sources.tables import table
from . import sql
from .deals import sql_normal

CUT_REASONS = ("length", "max_tokens")
#: The three largest models.
BIG_MODELS = ("kestrel_large", "orrin_70b", "tallow_v3")


def answers(spark: SparkSession, root: str) -> DataFrame:
    """responses_raw with one row for each response_id (rows appended twice are equal)."""
    return table(spark, root, "responses_raw").dropDuplicates(["response_id"])


def _ranked_answers(spark: SparkSession, root: str) -> DataFrame:
    """Evaluated answers under B and C, each response_id once: parsed before repeated rows go, so that no text is shuffled."""
    return evaluate(table(spark, root, "responses_raw")).dropDuplicates(["response_id"])


def evaluate(df: DataFrame) -> DataFrame:
    """Answers under conditions B and C with parsed ranking, diagnostics and metrics."""
    ranked = R.parse_ranking(F.col("response_text"))
    df = df.where(F.col("condition").isin("B", "C")).withColumn("ranked", ranked)
    m = R.metrics(F.col("ranked"), F.col("target_position"))
    return df.select(
        "response_id", "deal_id", "acquirer_ticker", "industry", "deal_year", "condition", "model_key", *[c for c in ("model_id", "provider") if c in df.columns], "strategy", "target_position", "ranked",
        (F.size("ranked") > 0).alias("parse_success"), F.size("ranked").alias("n_parsed"),
        F.coalesce(F.lower("finish_reason").isin(*CUT_REASONS), F.lit(False)).alias("truncated"), *[c.alias(k) for k, c in m.items()],
    )


def _evaluated(spark: SparkSession, root: str) -> DataFrame:
    return _ranked_answers(spark, root)


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


CELL = ["condition", "model_key", "strategy"]
MEANS = ["mrr", "recall_1", "recall_5", "recall_10", "ndcg_5", "ndcg_10"]


def rank_eval_by_cell(spark: SparkSession, root: str) -> DataFrame:
    """Means of the metrics and rates by condition, model and strategy."""
    e = _evaluated(spark, root).na.drop(subset=CELL)
    rate = lambda c: _r(F.avg(F.col(c).cast("double")))
    return e.groupBy(*CELL).agg(
        F.count("*").alias("n"), rate("parse_success").alias("parse_rate"), rate("truncated").alias("truncated_rate"), *[_r(F.avg(c)).alias(c) for c in MEANS],
        _r(F.avg("target_rank")).alias("mean_rank"), F.median("target_rank").alias("median_rank"),
    )


def rank_eval_five_keys(spark: SparkSession, root: str) -> DataFrame:
    """Means by condition, model, served model id, provider and strategy; rows with a null key are left out, sorted by the keys."""
    keys = ["condition", "model_key", "model_id", "provider", "strategy"]
    e = _evaluated(spark, root).na.drop(subset=keys)
    return e.groupBy(*keys).agg(F.count("*").alias("n_deals"), _r(F.avg(F.col("parse_success").cast("double")), 4).alias("parse_success_pct"), *[_r(F.avg(c), 4).alias(c) for c in MEANS]).orderBy(*keys)


#: Rates of failed and of truncated answers, and distinct deals of a full run, that call for a look.
MOST_FAILED, MOST_TRUNCATED = 0.05, 0.05


def parse_warnings(spark: SparkSession, root: str) -> DataFrame:
    """Cells with a warning: parse failures or truncation beyond 5 %, or fewer deals than the condition's fullest cell."""
    e = _evaluated(spark, root).na.drop(subset=CELL)
    c = e.groupBy(*CELL).agg(F.count_distinct("deal_id").alias("deals"), (1 - F.avg(F.col("parse_success").cast("double"))).alias("failed"), F.avg(F.col("truncated").cast("double")).alias("cut"))
    most = c.groupBy("condition").agg(F.max("deals").alias("full"))
    found = F.array(
        F.when(F.col("failed") > MOST_FAILED, F.struct(F.lit("parse_failures").alias("warning"), F.round("failed", 6).alias("value"))),
        F.when(F.col("cut") > MOST_TRUNCATED, F.struct(F.lit("truncation").alias("warning"), F.round("cut", 6).alias("value"))),
        F.when(F.col("deals") < F.col("full"), F.struct(F.lit("incomplete").alias("warning"), F.col("deals").cast("double").alias("value"))),
    )
    return c.join(most, "condition").select(*CELL, F.inline(F.array_compact(found)))


def chance_check(spark: SparkSession, root: str) -> DataFrame:
    """Chance of a uniform ranking at k by formula and by simulation: 1,000 places by digest for each condition, cut at k."""
    n = _evaluated(spark, root).where("condition IS NOT NULL").groupBy("condition").agg(F.count_distinct("deal_id").alias("n_deals"))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("42"), "condition", F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % R.CANDIDATES + 1
    drawn = n.select("condition", "n_deals", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("i")).withColumn("p", place.cast("int"))
    return drawn.groupBy("condition", "n_deals").agg(_r(F.avg(R.reciprocal_rank(F.col("p"))), 4).alias("empirical_mrr")).select(
        "condition", "n_deals", F.lit(round(R.chance_reciprocal_rank(), 6)).alias("chance_mrr"), "empirical_mrr", F.lit(R.chance_recall(1)).alias("recall_1"), F.lit(R.chance_recall(5)).alias("recall_5"), F.lit(R.chance_recall(10)).alias("recall_10")
    )


def rank_eval_parse_tiers(spark: SparkSession, root: str) -> DataFrame:
    """Answers by the tier that their ranking came from, with mean length of the ranking."""
    df = table(spark, root, "responses_raw").where(F.col("condition").isin("B", "C"))
    tiers = R.ranking_tiers(F.col("response_text"))
    name, size = F.lit("none"), F.lit(0)
    for k in reversed(tiers):
        name, size = F.when(tiers[k].isNotNull(), k).otherwise(name), F.when(tiers[k].isNotNull(), F.size(tiers[k])).otherwise(size)
    return df.select("response_id", name.alias("tier"), size.alias("size")).dropDuplicates(["response_id"]).groupBy("tier").agg(F.count("*").alias("n"), _r(F.avg("size")).alias("mean_size"))


def rank_eval_loose(spark: SparkSession, root: str) -> DataFrame:
    """Strict and loose parser side by side, by condition and strategy."""
    df = table(spark, root, "responses_raw").where(F.col("condition").isin("B", "C")).select("response_id", "condition", "strategy", R.parse_ranking(F.col("response_text")).alias("s"), R.parse_ranking_loose(F.col("response_text")).alias("l")).dropDuplicates(["response_id"])
    return df.groupBy("condition", "strategy").agg(
        F.count("*").alias("n"), F.count_if(F.size("s") > 0).alias("n_strict"), F.count_if(F.size("l") > 0).alias("n_loose"), F.count_if(F.col("s") == F.col("l")).alias("n_equal"),
        F.sum(F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x)).alias("sum_loose"),
    )


def rank_moderators(spark: SparkSession, root: str) -> DataFrame:
    """Breakdowns by year and by industry of each cell, in one pass of grouping sets."""
    e = _evaluated(spark, root).na.drop(subset=CELL)
    g = e.groupingSets([[*CELL, "deal_year"], [*CELL, "industry"]], *CELL, "deal_year", "industry").agg(
        F.grouping("industry").alias("no_industry"), F.count("*").alias("n"), _r(F.avg("mrr")).alias("mrr"), _r(F.avg("recall_10")).alias("recall_10")
    )
    value = F.when(F.col("no_industry") == 1, F.col("deal_year").cast("string")).otherwise(F.col("industry"))
    return g.select(*CELL, F.when(F.col("no_industry") == 1, "year").otherwise("industry").alias("moderator"), value.alias("value"), "n", "mrr", "recall_10").where("value IS NOT NULL")


PIVOTED = ("mrr", "recall_10", "n")


def rank_summary_pivot(spark: SparkSession, root: str) -> DataFrame:
    """One row for each condition and model, columns by every strategy there is."""
    cells = rank_eval_by_cell(spark, root)
    wide = cells.groupBy("condition", "model_key").pivot("strategy").agg(*[F.first(v, ignorenulls=True).alias(v) for v in PIVOTED])
    found = sorted({c.rsplit(f"_{v}", 1)[0] for v in PIVOTED for c in wide.columns if c.endswith(f"_{v}")})
    return wide.select("condition", "model_key", *[F.col(f"`{s}_{v}`").alias(f"{v}_{s}") for s in found for v in PIVOTED])


def best_cell_per_condition(spark: SparkSession, root: str) -> DataFrame:
    """The best strategy of each model in each condition, and the best model of each condition."""
    best = top_per_group(rank_eval_by_cell(spark, root), ["condition", "model_key"], [F.desc("mrr"), F.asc("strategy")])
    order = F.struct((-F.col("mrr")).alias("m"), "model_key")
    top = best.groupBy("condition").agg(F.min(order).alias("b"))
    return best.join(top, "condition").select("condition", "model_key", "strategy", "n", "mrr", "recall_10", (F.col("model_key") == F.col("b.model_key")).alias("is_best"))


def chance_panel(spark: SparkSession, root: str) -> DataFrame:
    """Best cells next to what a uniform ranking reaches."""
    best = best_cell_per_condition(spark, root).where("is_best").select("condition", F.col("model_key").alias("method"), "mrr", "recall_10")
    chance = best.select("condition", F.lit("chance").alias("method"), F.lit(round(R.chance_reciprocal_rank(), 6)).alias("mrr"), F.lit(R.chance_recall(10)).alias("recall_10"))
    return best.unionByName(chance)


def _paired(spark: SparkSession, root: str) -> DataFrame:
    """B and C answers of the same deal, model and strategy; of several answers the last response_id."""
    e = pick_last(_evaluated(spark, root).select("response_id", "deal_id", "acquirer_ticker", *CELL, "mrr", "recall_10", "ndcg_10").na.drop(subset=["deal_id", *CELL]), ["deal_id", *CELL], ["response_id"])
    keys = ["deal_id", "model_key", "strategy"]
    b = e.where("condition = 'B'").select(*keys, F.coalesce("acquirer_ticker", "deal_id").alias("cluster"), *[F.col(c).alias(f"{c}_b") for c in ("mrr", "recall_10", "ndcg_10")])
    c = e.where("condition = 'C'").select(*keys, *[F.col(c).alias(f"{c}_c") for c in ("mrr", "recall_10", "ndcg_10")])
    return b.join(c, keys)


def delta_bc_paired(spark: SparkSession, root: str) -> DataFrame:
    """Mean differences between conditions B and C over paired deals."""
    p = _paired(spark, root)
    d = lambda c: _r(F.avg(F.col(f"{c}_b") - F.col(f"{c}_c"))).alias(f"delta_{c}")
    return p.groupBy("model_key", "strategy").agg(F.count("*").alias("n"), d("mrr"), d("recall_10"), d("ndcg_10"))


def _round_all(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def delta_bc_cluster_bootstrap(spark: SparkSession, root: str) -> DataFrame:
    """Intervals and p-values of the difference of mrr, drawing whole acquirers 1,000 times."""
    p = _paired(spark, root).withColumn("d", F.col("mrr_b") - F.col("mrr_c"))
    return _round_all(paired_interval(p, ["model_key", "strategy"], "d", "cluster"), [])


def bootstrap_ci_by_cell(spark: SparkSession, root: str) -> DataFrame:
    """Percentile intervals of the mean mrr of each cell from 1,000 resamples."""
    return _round_all(mean_interval(_evaluated(spark, root), CELL, "mrr", "response_id"), [])


def unpaired_delta_bc(spark: SparkSession, root: str) -> DataFrame:
    """Differences of the cells' means between conditions B and C, whatever deals each has: aggregates joined with aggregates."""
    c = rank_eval_by_cell(spark, root)
    take = lambda k: c.where(F.col("condition") == k).select("model_key", "strategy", *[F.col(m).alias(f"{m}_{k.lower()}") for m in DELTAS])
    both = take("B").join(take("C"), ["model_key", "strategy"])
    return both.select("*", *[_r(F.col(f"{m}_b") - F.col(f"{m}_c"), 4).alias(f"delta_{m}") for m in DELTAS])


DELTAS = ("mrr", "recall_10", "ndcg_10")


def _recalled(spark: SparkSession, root: str) -> DataFrame:
    """(deal_id, model_key, label, score, n_others) of answers under condition A; the last answer counts."""
    a = answers(spark, root).where("condition = 'A' AND deal_id IS NOT NULL AND model_key IS NOT NULL")
    a = a.select("response_id", "deal_id", "model_key", "response_text", "acquirer_name", "deal_year", "target_name", "target_ticker")
    labels = recall_labels(a, key="response_id", response="response_text", acquirer="acquirer_name", year="deal_year", name="target_name", ticker="target_ticker")
    return pick_last(a.select("response_id", "deal_id", "model_key").join(labels, "response_id"), ["deal_id", "model_key"], ["response_id"]).drop("response_id")


def _subsets(labels: DataFrame) -> DataFrame:
    """(deal_id, unknown_big, unknown_all): deals that none of the three largest, and none of all, models recalled; a missing label counts as not recalled, a deal without any label is in neither."""
    known = F.col("label") == "SUCCESS"
    return labels.groupBy("deal_id").agg((F.count_if(known & F.col("model_key").isin(*BIG_MODELS)) == 0).alias("unknown_big"), (F.count_if(known) == 0).alias("unknown_all"))


def _with_subsets(spark: SparkSession, root: str) -> DataFrame:
    """Evaluated answers with the flags of the subsets: the model's own deals not recalled (a missing label is not in it), unknown_big and unknown_all."""
    labels = write_once(_recalled(spark, root))
    own = labels.select("deal_id", "model_key", (F.col("label") != "SUCCESS").alias("own"))
    e = _evaluated(spark, root).na.drop(subset=CELL).join(own, ["deal_id", "model_key"], "left").join(_subsets(labels), "deal_id", "left")
    return e.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("own", "unknown_big", "unknown_all")})


def subset_delta_ci(spark: SparkSession, root: str) -> DataFrame:
    """Mean mrr over the deals that a model itself did not recall against all its deals, by model, drawing whole acquirers 1,000 times."""
    return _round_all(subset_interval(_with_subsets(spark, root).where("acquirer_ticker IS NOT NULL"), ["model_key"], "mrr", "own", "acquirer_ticker", strict=False), [])


SUBSETS = {"full": "true", "own_unknown": "own", "unknown_big": "unknown_big", "unknown_all": "unknown_all"}


def subset_aggregates(spark: SparkSession, root: str) -> DataFrame:
    """Means over all deals of a cell and over its subsets, in one pass; an empty subset gives zeros."""
    e = _with_subsets(spark, root)
    one = e.groupBy(*CELL).agg(*[x for k, f in SUBSETS.items() for x in (F.count_if(F.expr(f)).alias(f"n_{k}"), *[F.avg(F.when(F.expr(f), F.col(m))).alias(f"{m}_{k}") for m in MEANS])])
    rows = F.array(*[F.struct(F.lit(k).alias("subset"), F.col(f"n_{k}").alias("n_deals"), *[_r(F.coalesce(F.col(f"{m}_{k}"), F.lit(0.0)), 4).alias(m) for m in MEANS]) for k in SUBSETS])
    return one.select(*CELL, F.inline(rows))


def spearman_rank_agreement(spark: SparkSession, root: str) -> DataFrame:
    """Agreement of two models on the target's rank, over at least ten deals answered by both under one condition and strategy; ranks beyond ten count as eleven."""
    e = pick_last(_evaluated(spark, root).select("response_id", "deal_id", *CELL, "target_rank").na.drop(subset=["deal_id", *CELL]), ["deal_id", *CELL], ["response_id"])
    keys = ["deal_id", "condition", "strategy"]
    rank = F.coalesce("target_rank", F.lit(11)).cast("double")
    # a deal has one answer of each model here, so a deal gives at most a pair for each two models
    both = e.select(*keys, F.col("model_key").alias("model_a"), rank.alias("x")).join(e.select(*keys, F.col("model_key").alias("model_b"), rank.alias("y")), keys).where("model_a < model_b")
    pair = ["condition", "model_a", "model_b"]
    out = spearman(both, pair, "x", "y").where("n >= 10")
    # the same over deals where both have the target among the first ten, with its own number
    seen = spearman(both.where(f"x <= {R.K} AND y <= {R.K}"), pair, "x", "y").select(*pair, F.col("n").alias("n_observed"), _r("rho").alias("rho_observed"))
    out = out.join(seen, pair, "left")
    return out.select("condition", "model_a", "model_b", "n", _r("rho").alias("rho"), F.coalesce("n_observed", F.lit(0)).alias("n_observed"), "rho_observed", graded(F.col("rho"), [(0.6, "HIGH"), (0.3, "MODERATE")], "LOW").alias("agreement"))


def spearman_significance(spark: SparkSession, root: str) -> DataFrame:
    """As spearman_rank_agreement, with p-values."""
    return with_p_value(spearman_rank_agreement(spark, root))


def min_support_breakdown(spark: SparkSession, root: str) -> DataFrame:
    """Industries with at least five distinct deals."""
    e = _evaluated(spark, root).where("industry IS NOT NULL")
    return e.groupBy("industry").agg(F.count_distinct("deal_id").alias("n_deals"), F.count("*").alias("n"), _r(F.avg("mrr")).alias("mrr")).where("n_deals >= 5")


def generated_names(spark: SparkSession, root: str) -> DataFrame:
    """Names that answers under condition A give, by how many answers give them at which place."""
    a = answers(spark, root).where("condition = 'A'").select(F.posexplode(R.parse_names(F.col("response_text"))).alias("i", "name"))
    return a.groupBy("name").agg(F.count("*").alias("n"), F.sum("i").alias("places"))


def recall_label_rates(spark: SparkSession, root: str) -> DataFrame:
    """Counts and rates of the four labels and the mean score, by model."""
    count = lambda k: F.count_if(F.col("label") == k)
    return _recalled(spark, root).groupBy("model_key").agg(
        F.count("*").alias("n"), *[count(k).alias(f"n_{k.lower()}") for k in LABELS], *[_r(count(k) / F.count("*"), 4).alias(f"{k.lower()}_rate") for k in LABELS],
        _r(F.avg(F.greatest("score", F.lit(0.0))), 2).alias("mean_score"), F.count_if(F.col("n_others") > 0).alias("n_ambiguous"),
    )


LABELS = ("SUCCESS", "PARTIAL", "FAILURE", "UNKNOWN")


def rank_year_trend(spark: SparkSession, root: str) -> DataFrame:
    """Trend of the yearly mean mrr: rank correlation of year and mean, for each condition and model with three years or more."""
    y = _evaluated(spark, root).na.drop(subset=["condition", "model_key", "deal_year"]).groupBy("condition", "model_key", "deal_year").agg(_r(F.avg("mrr"), 4).alias("mrr"))
    out = spearman(y, ["condition", "model_key"], "deal_year", "mrr").where("n >= 3")
    return out.select("condition", "model_key", F.col("n").alias("n_years"), _r("rho").alias("rho"))


def stale_metrics(spark: SparkSession, root: str) -> DataFrame:
    """metrics_raw_bc against metrics computed anew: rows by whether flags and values still agree."""
    new = _evaluated(spark, root).select("response_id", F.col("parse_success").alias("p"), F.col("mrr").alias("m"))
    old = table(spark, root, "metrics_raw_bc").dropDuplicates(["response_id"]).select("response_id", "parse_success", "mrr")
    both = new.join(old, "response_id")
    same = lambda a, b: F.coalesce((a == b), F.lit(False))
    return both.groupBy(same(F.col("p"), F.col("parse_success")).alias("same_flag"), same(_r("m"), _r("mrr")).alias("same_mrr")).agg(F.count("*").alias("n"))


NAMES = """rank_eval_by_cell rank_eval_five_keys parse_warnings chance_check rank_eval_parse_tiers rank_eval_loose rank_moderators rank_summary_pivot best_cell_per_condition chance_panel
delta_bc_paired unpaired_delta_bc delta_bc_cluster_bootstrap bootstrap_ci_by_cell subset_delta_ci subset_aggregates spearman_rank_agreement spearman_significance rank_year_trend
min_support_breakdown generated_names recall_label_rates stale_metrics""".split()
QUERIES = {n: globals()[n] for n in NAMES}

_ORDERED = lambda x: f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"
_IDS = lambda x: f"list_filter(list_transform({x}, lambda s: TRY_CAST(trim(s) AS INTEGER)), lambda x: x BETWEEN 1 AND 50)"
#: e: answers under B and C with metrics; nm: names under A.
BASE = rf"""
WITH r AS (SELECT DISTINCT ON (response_id) * FROM responses_raw ORDER BY response_id),
t0 AS (SELECT *, coalesce(response_text, '') AS tx FROM r WHERE condition IN ('B', 'C')),
t1 AS (SELECT *,
  regexp_extract_all(tx, '(?is)\{{[^{{}}]*"ranking"\s*:\s*\[[^\]]*\][^{{}}]*\}}') AS blobs,
  regexp_extract_all(tx, '(?i)FINAL\s+RANKING\s*[:=]\s*\[([^\]]*)\]', 1) AS finals,
  regexp_extract_all(tx, '[Rr]ank\s*\**\s*(\d+)\**\s*[:\.\)]?\s*(?:[Cc]andidate\s*)?#(\d+)', 1) AS ks,
  regexp_extract_all(tx, '[Rr]ank\s*\**\s*(\d+)\**\s*[:\.\)]?\s*(?:[Cc]andidate\s*)?#(\d+)', 2) AS cs FROM t0),
t2 AS (SELECT *,
  {_IDS("list_filter(coalesce(TRY(CAST(json_extract_string(CASE WHEN json_valid(blobs[len(blobs)]) THEN blobs[len(blobs)] END, '$.ranking[*]') AS VARCHAR[])), []::VARCHAR[]), lambda s: regexp_full_match(s, '\\s*-*\\d+\\s*'))")} AS j,
  {_IDS("regexp_extract_all(coalesce(finals[len(finals)], ''), '[0-9][0-9]?')")} AS f,
  {_IDS("list_transform(list_sort(list_transform(ks, lambda k, i: {'k': TRY_CAST(k AS INTEGER), 'n': i, 'c': cs[i]})), lambda s: s.c)")} AS l FROM t1),
t3 AS (SELECT *, ({_ORDERED("j")})[1:10] AS dj, ({_ORDERED("f")})[1:10] AS df, ({_ORDERED("l")})[1:10] AS dl FROM t2),
t4 AS (SELECT *, CASE WHEN len(dj) > 0 THEN 'json' WHEN len(df) > 0 THEN 'final' WHEN len(dl) > 0 THEN 'lines' ELSE 'none' END AS tier,
  CASE WHEN len(dj) > 0 THEN dj WHEN len(df) > 0 THEN df WHEN len(dl) > 0 THEN dl ELSE []::INTEGER[] END AS ranked FROM t3),
t5 AS (SELECT *, coalesce(list_position(ranked, target_position), 0) AS p FROM t4),
e AS (SELECT response_id, deal_id, acquirer_ticker, industry, deal_year, condition, model_key, model_id, provider, strategy, tier, ranked, tx,
  len(ranked) > 0 AS parse_success, coalesce(lower(finish_reason) IN ('length', 'max_tokens'), false) AS truncated,
  CASE WHEN p > 0 THEN 1.0 / p ELSE 0 END::DOUBLE AS mrr, (p = 1)::INT::DOUBLE AS recall_1, (p BETWEEN 1 AND 5)::INT::DOUBLE AS recall_5, (p BETWEEN 1 AND 10)::INT::DOUBLE AS recall_10,
  CASE WHEN p BETWEEN 1 AND 5 THEN 1 / log2(p + 1) ELSE 0 END::DOUBLE AS ndcg_5, CASE WHEN p > 0 THEN 1 / log2(p + 1) ELSE 0 END::DOUBLE AS ndcg_10, nullif(p, 0) AS target_rank FROM t5),
cells AS (SELECT condition, model_key, strategy, count(*) AS n, round(avg(parse_success::INT), 6) AS parse_rate, round(avg(truncated::INT), 6) AS truncated_rate,
  round(avg(mrr), 6) AS mrr, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(ndcg_10), 6) AS ndcg_10,
  round(avg(target_rank), 6) AS mean_rank, median(target_rank) AS median_rank FROM e WHERE condition IS NOT NULL AND model_key IS NOT NULL AND strategy IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY condition, model_key ORDER BY mrr DESC, strategy) = 1),
panel AS (SELECT condition, model_key, strategy, n, mrr, recall_10, row_number() OVER (PARTITION BY condition ORDER BY mrr DESC, model_key) = 1 AS is_best FROM best),
le AS (SELECT * FROM e WHERE deal_id IS NOT NULL AND model_key IS NOT NULL AND strategy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY deal_id, condition, model_key, strategy ORDER BY response_id DESC) = 1),
pairs AS (SELECT b.deal_id, model_key, strategy, coalesce(b.acquirer_ticker, b.deal_id) AS cluster, b.mrr AS mrr_b, b.recall_10 AS recall_10_b, b.ndcg_10 AS ndcg_10_b, c.mrr AS mrr_c, c.recall_10 AS recall_10_c, c.ndcg_10 AS ndcg_10_c,
  coalesce(b.target_rank, 11)::DOUBLE AS x, coalesce(c.target_rank, 11)::DOUBLE AS y
  FROM (SELECT * FROM le WHERE condition = 'B') b JOIN (SELECT * FROM le WHERE condition = 'C') c USING (deal_id, model_key, strategy)),
na0 AS (SELECT *, regexp_extract_all(coalesce(response_text, ''), '(?i)FINAL\s+TARGETS\s*[:=]\s*(\[[^\]]*\])', 1) AS finals,
  regexp_extract_all(coalesce(response_text, ''), '(?is)\{{[^{{}}]*"targets"\s*:\s*\[[^\]]*\][^{{}}]*\}}') AS blobs FROM r WHERE condition = 'A'),
na1 AS (SELECT *, list_filter(list_transform(coalesce(TRY(CAST(json_extract_string(CASE WHEN json_valid(finals[len(finals)]) THEN finals[len(finals)] END, '$[*]') AS VARCHAR[])), []::VARCHAR[]), lambda s: trim(s)), lambda s: s <> '')[1:5] AS a,
  list_filter(list_transform(coalesce(TRY(CAST(json_extract_string(CASE WHEN json_valid(blobs[len(blobs)]) THEN blobs[len(blobs)] END, '$.targets[*]') AS VARCHAR[])), []::VARCHAR[]), lambda s: trim(s)), lambda s: s <> '')[1:5] AS b,
  list_filter(list_transform(string_split_regex(trim(coalesce(response_text, '')), '\r\n|\r|\n'), lambda x: trim(regexp_extract(x, '^\s*\d+[.)]\s*(?:[—\-]\s*)?([^—\-:\n]+)', 1))), lambda s: length(s) >= 3)[1:5] AS c FROM na0),
nm AS (SELECT response_id, deal_id, model_key, target_name, target_ticker, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END AS names FROM na1)"""


def draws(units: str, keys: str, columns: str, order: str) -> str:
    """CTEs u (numbered units of each cell) and z (sums over the drawn units of each resample)."""
    sums = ", ".join(f"sum(u.{c}) AS {c}" for c in columns.split())
    on = " AND ".join(f"u.{k} IS NOT DISTINCT FROM g.{k}" for k in keys.split(", "))
    g = ", ".join("g." + k for k in keys.split(", "))
    return f"""
, u AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS i FROM {units}),
g AS (SELECT {keys}, count(*) AS m FROM u GROUP BY {keys}),
z AS (SELECT {g}, b.b, {sums} FROM g, range(0, 1000) b(b), range(0, (SELECT max(m) FROM g)) d(d), u
  WHERE d.d < g.m AND {on} AND u.i = ('0x' || substr(md5('42|' || b.b || '|' || (d.d // 4)), 1 + 8 * (d.d % 4), 8))::BIGINT % g.m GROUP BY {g}, b.b)
"""


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_CORE = lambda x: f"list_filter(string_split({x}, ' '), lambda w: NOT list_contains({_STOP}, w) AND w <> '')"


def sql_aliases(c: str) -> str:
    """The surface forms of a name in SQL."""
    form = r"(?i)\b(?:" + "|".join(ENTITY_FORMS) + r")\b\.?"
    raw = f"trim({c})"
    other = f"trim(rtrim(regexp_extract({raw}, '(?i)\\b{OTHER_NAME}\\b\\s+(.+)$', 1), '.'))"
    base = f"trim(split_part(regexp_replace(regexp_replace({raw}, '(?i)\\b{OTHER_NAME}\\b.*$', '', 'g'), '\\([^)]*\\)', '', 'g'), ',', 1))"
    bare = f"trim(regexp_replace(trim(regexp_replace({base}, '{form}', '', 'g')), ',+$', ''))"
    a = f"list_filter([{raw}, {other}, {base}, {bare}], lambda a: length(a) >= 3)"
    return f"list_filter({a}, lambda a, i: list_position({a}, a) = i)"


def sql_ticker(text: str, ticker: str) -> str:
    """The ticker stands between word boundaries; one of two characters only in its exact spelling."""
    return f"coalesce(CASE WHEN length({ticker}) >= 3 THEN regexp_matches({text}, '(?i)\\b' || regexp_escape({ticker}) || '\\b') WHEN length({ticker}) = 2 THEN regexp_matches({text}, '\\b' || regexp_escape({ticker}) || '\\b') ELSE false END, false)"


_P, _T = sql_normal("c", "entity"), sql_normal("n", "entity")
_SORTED = lambda x: f"array_to_string(list_sort({sql.words(x)}), ' ')"
#: rl: response_id, label, score and n_others of the answers under A; lab: the last answer of each deal and model.
RECALL = BASE + f"""
, ra AS (SELECT response_id AS k, deal_id, model_key, regexp_replace(coalesce(response_text, ''), '^\\s+|\\s+$', '', 'g') AS c, lower(CASE WHEN instr(acquirer_name, '(') > 1 THEN trim(split_part(acquirer_name, '(', 1)) ELSE acquirer_name END) AS a,
  deal_year AS y, target_name AS n, target_ticker AS t FROM r WHERE condition = 'A' AND deal_id IS NOT NULL AND model_key IS NOT NULL),
rt AS (SELECT DISTINCT a, y, n, t FROM ra WHERE a IS NOT NULL AND y IS NOT NULL AND n IS NOT NULL),
rp AS (SELECT k, c, n, t, 0 AS other FROM ra WHERE n IS NOT NULL UNION ALL SELECT ra.k, ra.c, rt.n, rt.t, 1 FROM ra JOIN rt ON ra.a = rt.a AND ra.y = rt.y AND ra.n <> rt.n),
rq AS (SELECT *, {_P} AS p, {_T} AS q, list_transform({sql_aliases("n")}, lambda a: {sql_normal("a", "entity")}) AS al FROM rp),
rh AS (SELECT *, p <> '' AND q <> '' AND (p = q OR list_contains(al, p) OR {sql_ticker("c", "t")} OR (len({_CORE("q")}) >= 2 AND contains(p, array_to_string(list_filter({_CORE("q")}, lambda w, i: list_position({_CORE("q")}, w) = i), ' ')))) AS hit FROM rq),
rz AS (SELECT *, unnest(list_distinct(q || al)) AS z FROM (SELECT * EXCLUDE (q), [q] AS q FROM rh WHERE NOT hit)),
ry AS (SELECT k, n, {_SORTED("p")} AS u, {_SORTED("z")} AS v FROM rz WHERE p <> '' AND z <> '' AND 200 * least(length(p), length(z)) >= 90 * (length(p) + length(z))
  AND len(list_filter(list_intersect(string_split(p, ' '), string_split(z, ' ')), lambda w: length(w) >= 4 AND NOT list_contains({_STOP}, w))) > 0),
rf AS (SELECT k, n, bool_or({sql.indel("u", "v")} >= 90) AS near FROM ry GROUP BY ALL),
rr AS (SELECT k, max((hit OR coalesce(near, false))::INT) = 1 AS hit, CAST(sum(other) AS BIGINT) AS n_others FROM rh LEFT JOIN rf USING (k, n) GROUP BY k),
rb AS (SELECT ra.*, coalesce(n_others, 0) AS n_others, c = '' OR upper(c) = 'UNKNOWN' OR contains(lower(c), 'cannot') AS unk, coalesce(hit, false) AS hit FROM ra LEFT JOIN rr USING (k)),
rx AS (SELECT * FROM rb WHERE NOT unk AND NOT hit AND n IS NOT NULL), {sql.set_ratio("rx", "c", "n", "sc")},
rl AS (SELECT k AS response_id, deal_id, model_key, n_others, CASE WHEN unk THEN 0.0 WHEN rb.hit THEN 100.0 ELSE coalesce(st.sc, 0.0) END AS score,
  CASE WHEN unk THEN 'UNKNOWN' WHEN rb.hit THEN 'SUCCESS' WHEN st.sc >= 85 THEN 'PARTIAL' ELSE 'FAILURE' END AS label FROM rb LEFT JOIN (SELECT k, sc FROM st) st USING (k)),
lab AS (SELECT * FROM rl QUALIFY row_number() OVER (PARTITION BY deal_id, model_key ORDER BY response_id DESC) = 1),
sb AS (SELECT deal_id, count(*) FILTER (label = 'SUCCESS' AND model_key IN ({", ".join(f"'{m}'" for m in BIG_MODELS)})) = 0 AS unknown_big, count(*) FILTER (label = 'SUCCESS') = 0 AS unknown_all FROM lab GROUP BY 1),
es AS (SELECT e.*, coalesce(lab.label <> 'SUCCESS', false) AS own, coalesce(sb.unknown_big, false) AS unknown_big, coalesce(sb.unknown_all, false) AS unknown_all FROM e LEFT JOIN lab ON lab.deal_id = e.deal_id AND lab.model_key = e.model_key
  LEFT JOIN sb ON sb.deal_id = e.deal_id WHERE condition IS NOT NULL AND e.model_key IS NOT NULL AND strategy IS NOT NULL)
"""
ORACLE = {
    "rank_eval_by_cell": BASE + "SELECT * FROM cells",
    "rank_eval_parse_tiers": BASE + "SELECT tier, count(*) AS n, round(avg(len(ranked)), 6) AS mean_size FROM e GROUP BY 1",
    "rank_eval_loose": BASE
    + rf""", q AS (SELECT *, regexp_replace(tx, '(\w)#', '\1@', 'g') AS t7 FROM e),
q1 AS (SELECT *, {_IDS(r"regexp_extract_all(tx, '(?i)rank\s*\**\s*\d+\**\s*[:\.]?\s*.*?candidate\s*#(\d+)', 1) || regexp_extract_all(tx, '(?i)candidate\s*#(\d+)', 1) || list_filter(regexp_extract_all(t7, '#(\w+)', 1), lambda s: regexp_full_match(s, '\d\d?'))")} AS al FROM q),
q2 AS (SELECT *, ({_ORDERED("al")})[1:10] AS lo FROM q1)
SELECT condition, strategy, count(*) AS n, count(*) FILTER (len(ranked) > 0) AS n_strict, count(*) FILTER (len(lo) > 0) AS n_loose, count(*) FILTER (lo = ranked) AS n_equal, CAST(sum(coalesce(list_sum(lo), 0)) AS BIGINT) AS sum_loose FROM q2 GROUP BY ALL""",
    "rank_moderators": BASE
    + """, k AS (SELECT * FROM e WHERE condition IS NOT NULL AND model_key IS NOT NULL AND strategy IS NOT NULL)
SELECT condition, model_key, strategy, 'year' AS moderator, CAST(deal_year AS VARCHAR) AS value, count(*) AS n, round(avg(mrr), 6) AS mrr, round(avg(recall_10), 6) AS recall_10 FROM k WHERE deal_year IS NOT NULL GROUP BY ALL
UNION ALL SELECT condition, model_key, strategy, 'industry', industry, count(*), round(avg(mrr), 6), round(avg(recall_10), 6) FROM k WHERE industry IS NOT NULL GROUP BY ALL""",
    "rank_summary_pivot": BASE
    + "SELECT condition, model_key, "
    + ", ".join(f"max({v}) FILTER (strategy = '{s}') AS {v}_{s}" for s in ("cot", "fewshot", "zeroshot") for v in ("mrr", "recall_10", "n"))
    + " FROM cells GROUP BY ALL",
    "best_cell_per_condition": BASE + "SELECT * FROM panel",
    "chance_panel": BASE
    + "SELECT condition, model_key AS method, mrr, recall_10 FROM panel WHERE is_best UNION ALL SELECT condition, 'chance', round((SELECT sum(1.0 / i) FROM range(1, 11) t(i)) / 50, 6), 0.2 FROM panel WHERE is_best",
    "delta_bc_paired": BASE
    + "SELECT model_key, strategy, count(*) AS n, round(avg(mrr_b - mrr_c), 6) AS delta_mrr, round(avg(recall_10_b - recall_10_c), 6) AS delta_recall_10, round(avg(ndcg_10_b - ndcg_10_c), 6) AS delta_ndcg_10 FROM pairs GROUP BY ALL",
    "bootstrap_ci_by_cell": BASE
    + ", un AS (SELECT condition, model_key, strategy, response_id, mrr, 1 AS c FROM e WHERE model_key IS NOT NULL AND strategy IS NOT NULL)"
    + draws("un", "condition, model_key, strategy", "mrr c", "response_id")
    + """SELECT condition, model_key, strategy, f.n, round(f.mean, 6) AS mean, round(p[1], 6) AS low, round(p[2], 6) AS high FROM
(SELECT condition, model_key, strategy, count(*) AS n, avg(mrr) AS mean FROM un GROUP BY ALL) f JOIN
(SELECT condition, model_key, strategy, quantile_cont(mrr / c, [0.025, 0.975]) AS p FROM z GROUP BY ALL) USING (condition, model_key, strategy)""",
    "delta_bc_cluster_bootstrap": BASE
    + ", un AS (SELECT model_key, strategy, cluster, sum(mrr_b - mrr_c) AS s, count(*)::DOUBLE AS c FROM pairs GROUP BY ALL)"
    + draws("un", "model_key, strategy", "s c", "cluster")
    + """, fl AS (SELECT model_key, strategy, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_clusters, sum(s) / sum(c) AS mean FROM un GROUP BY ALL),
mm AS (SELECT model_key, strategy, fl.*, z.s / z.c AS m FROM z JOIN fl USING (model_key, strategy))
SELECT model_key, strategy, any_value(n) AS n, any_value(n_clusters) AS n_clusters, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high,
round(least(1.0, 2 * least(avg((round(m - mean, 12) >= round(mean, 12))::INT), avg((round(m - mean, 12) <= round(mean, 12))::INT))), 6) AS p_value FROM mm GROUP BY model_key, strategy""",
    "subset_delta_ci": RECALL
    + """, un AS (SELECT model_key, acquirer_ticker, sum(CASE WHEN own THEN mrr ELSE 0 END) AS ss, count(*) FILTER (own)::DOUBLE AS sc, sum(mrr) AS s, count(*)::DOUBLE AS c FROM es WHERE acquirer_ticker IS NOT NULL GROUP BY ALL)"""
    + draws("un", "model_key", "ss sc s c", "acquirer_ticker")
    + """SELECT model_key, CAST(f.sc AS BIGINT) AS n_subset, CAST(f.c AS BIGINT) AS n, round(f.ss / nullif(f.sc, 0), 6) AS mean_subset, round(f.s / f.c, 6) AS mean, round(f.ss / nullif(f.sc, 0) - f.s / f.c, 6) AS difference, round(p[1], 6) AS low, round(p[2], 6) AS high, n_empty
FROM (SELECT model_key, sum(ss) AS ss, sum(sc) AS sc, sum(s) AS s, sum(c) AS c FROM un GROUP BY 1) f JOIN (SELECT model_key, quantile_cont(ss / nullif(sc, 0) - s / c, [0.025, 0.975]) AS p, count(*) FILTER (sc = 0) AS n_empty FROM z GROUP BY 1) USING (model_key)""",
    "subset_aggregates": RECALL
    + " UNION ALL ".join(
        f"SELECT condition, model_key, strategy, '{k}' AS subset, count(*) FILTER ({f}) AS n_deals, " + ", ".join(f"round(coalesce(avg({m}) FILTER ({f}), 0), 4) AS {m}" for m in MEANS) + " FROM es GROUP BY ALL" for k, f in SUBSETS.items()
    ),
    "recall_label_rates": RECALL
    + "SELECT model_key, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (label = '{k}') AS n_{k.lower()}" for k in LABELS) + ", " + ", ".join(f"round(count(*) FILTER (label = '{k}') / count(*)::DOUBLE, 4) AS {k.lower()}_rate" for k in LABELS)
    + ", round(avg(score), 2) AS mean_score, count(*) FILTER (n_others > 0) AS n_ambiguous FROM lab GROUP BY 1",
    "rank_eval_five_keys": BASE + "SELECT condition, model_key, model_id, provider, strategy, count(*) AS n_deals, round(avg(parse_success::INT), 4) AS parse_success_pct, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in MEANS)
    + " FROM e WHERE condition IS NOT NULL AND model_key IS NOT NULL AND model_id IS NOT NULL AND provider IS NOT NULL AND strategy IS NOT NULL GROUP BY ALL ORDER BY ALL",
    "parse_warnings": BASE
    + """, w AS (SELECT condition, model_key, strategy, count(DISTINCT deal_id) AS deals, 1 - avg(parse_success::INT) AS failed, avg(truncated::INT) AS cut FROM e WHERE condition IS NOT NULL AND model_key IS NOT NULL AND strategy IS NOT NULL GROUP BY ALL),
f AS (SELECT *, max(deals) OVER (PARTITION BY condition) AS full_run FROM w)
SELECT condition, model_key, strategy, 'parse_failures' AS warning, round(failed, 6) AS value FROM f WHERE failed > 0.05 UNION ALL SELECT condition, model_key, strategy, 'truncation', round(cut, 6) FROM f WHERE cut > 0.05
UNION ALL SELECT condition, model_key, strategy, 'incomplete', deals::DOUBLE FROM f WHERE deals < full_run""",
    "chance_check": BASE
    + """, n AS (SELECT condition, count(DISTINCT deal_id) AS n_deals FROM e GROUP BY 1),
p AS (SELECT condition, n_deals, ('0x' || substr(md5('42|' || condition || '|' || i), 1, 8))::BIGINT % 50 + 1 AS p FROM n, range(0, 1000) t(i))
SELECT condition, n_deals, round((SELECT sum(1.0 / i) FROM range(1, 11) t(i)) / 50, 6)::DOUBLE AS chance_mrr, round(avg(CASE WHEN p <= 10 THEN 1.0 / p ELSE 0 END), 4) AS empirical_mrr, 0.02::DOUBLE AS recall_1, 0.1::DOUBLE AS recall_5, 0.2::DOUBLE AS recall_10 FROM p GROUP BY condition, n_deals""",
    "unpaired_delta_bc": BASE
    + "SELECT b.model_key, b.strategy, " + ", ".join(f"b.{m} AS {m}_b" for m in DELTAS) + ", " + ", ".join(f"c.{m} AS {m}_c" for m in DELTAS) + ", " + ", ".join(f"round(b.{m} - c.{m}, 4) AS delta_{m}" for m in DELTAS)
    + " FROM cells b JOIN cells c ON b.condition = 'B' AND c.condition = 'C' AND b.model_key = c.model_key AND b.strategy = c.strategy",
    "rank_year_trend": BASE
    + """, y AS (SELECT condition, model_key, deal_year AS x, round(avg(mrr), 4) AS y FROM e WHERE condition IS NOT NULL AND model_key IS NOT NULL AND deal_year IS NOT NULL GROUP BY ALL),
rk AS (SELECT condition, model_key, rank() OVER (PARTITION BY condition, model_key ORDER BY x) AS rx, rank() OVER (PARTITION BY condition, model_key ORDER BY y) + (count(*) OVER (PARTITION BY condition, model_key, y) - 1) / 2.0 AS ry FROM y)
SELECT condition, model_key, count(*) AS n_years, round(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS rho FROM rk GROUP BY ALL HAVING count(*) >= 3""",
    "spearman_rank_agreement": BASE
    + """, mp AS (SELECT a.condition, a.model_key AS model_a, b.model_key AS model_b, coalesce(a.target_rank, 11) AS x, coalesce(b.target_rank, 11) AS y FROM le a JOIN le b USING (deal_id, condition, strategy) WHERE a.model_key < b.model_key),
rk AS (SELECT 0 AS o, condition, model_a, model_b, rank() OVER (PARTITION BY condition, model_a, model_b ORDER BY x) + (count(*) OVER (PARTITION BY condition, model_a, model_b, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY condition, model_a, model_b ORDER BY y) + (count(*) OVER (PARTITION BY condition, model_a, model_b, y) - 1) / 2.0 AS ry FROM mp
  UNION ALL SELECT 1, condition, model_a, model_b, rank() OVER (PARTITION BY condition, model_a, model_b ORDER BY x) + (count(*) OVER (PARTITION BY condition, model_a, model_b, x) - 1) / 2.0,
  rank() OVER (PARTITION BY condition, model_a, model_b ORDER BY y) + (count(*) OVER (PARTITION BY condition, model_a, model_b, y) - 1) / 2.0 FROM mp WHERE x <= 10 AND y <= 10),
co AS (SELECT o, condition, model_a, model_b, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS r FROM rk GROUP BY ALL)
SELECT a.condition, a.model_a, a.model_b, a.n, round(a.r, 6) AS rho, coalesce(b.n, 0) AS n_observed, round(b.r, 6) AS rho_observed, CASE WHEN a.r > 0.6 THEN 'HIGH' WHEN a.r > 0.3 THEN 'MODERATE' ELSE 'LOW' END AS agreement
FROM co a LEFT JOIN co b ON b.o = 1 AND a.condition = b.condition AND a.model_a = b.model_a AND a.model_b = b.model_b WHERE a.o = 0 AND a.n >= 10""",
    "min_support_breakdown": BASE + "SELECT industry, count(DISTINCT deal_id) AS n_deals, count(*) AS n, round(avg(mrr), 6) AS mrr FROM e WHERE industry IS NOT NULL GROUP BY 1 HAVING count(DISTINCT deal_id) >= 5",
    "generated_names": BASE + "SELECT name, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM (SELECT unnest(names) AS name, unnest(range(0, len(names))) AS i FROM nm) GROUP BY 1",
    "stale_metrics": BASE
    + """, o AS (SELECT DISTINCT ON (response_id) response_id, parse_success, mrr FROM metrics_raw_bc ORDER BY response_id)
SELECT coalesce(e.parse_success = o.parse_success, false) AS same_flag, coalesce(round(e.mrr, 6) = round(o.mrr, 6), false) AS same_mrr, count(*) AS n FROM e JOIN o USING (response_id) GROUP BY ALL""",
}

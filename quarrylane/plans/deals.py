"""Queries over deals and filings: cleaning, precedence joins, duplicates, buckets and sectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import business as V
from ..functions import names as N
from ..operators.asof import as_known_at
from ..operators.relational import complete, conform, drop_present, first_rows, looked_up, mapped, null_counts, others_of_group, pending, pick_first, pick_last, with_fallbacks
from ..sources.tables import table

#: Columns that a deal must have.
CRITICAL = ["deal_id", "acquirer_name", "acquirer_ticker", "target_name", "target_ticker", "announced_date", "closed_date", "target_sic", "deal_value_usd_m", "target_mktcap_usd_m"]


#: Headings of an exported sheet of deals and the names they get.
RENAMES = {
    "Target/Issuer Name": "target_name",
    "MI Transaction ID": "deal_id",
    "Announced Date\nMM/dd/yyyy": "announced_date",
    "Completion Date\nMM/dd/yyyy": "closed_date",
    "Definitive Agreement Date\nMM/dd/yyyy": "def_agreement_date",
    "Transaction Type": "transaction_type",
    "Transaction Status": "status",
    "Description of Consideration": "consideration_desc",
    "Deal Summary": "deal_summary",
    "Buyers/Investors Name": "acquirer_name",
    "Buyer Ticker(s)": "acquirer_ticker",
    "Actual Acquirer Country/Region": "acquirer_country",
    "Target/Issuer Ticker": "target_ticker",
    "SIC Code\n(Target/Issuer)": "target_sic",
    "Target Country/ Region": "target_country",
    "Target/Issuer Business Description": "target_business_desc",
    "Target/Issuer Long Business Description": "target_long_desc",
    "Total Transaction Value\n($M)": "deal_value_usd_m",
    "Buyer: CIQ Total Revenue\n($000)": "acquirer_revenue_ciq_000",
    "Buyer: CIQ EBITDA Incl EQ Income from Affiliates\n($000)": "acquirer_ebitda_ciq_000",
    "Buyer: Total Revenue\n($000)": "acquirer_revenue_000",
    "Buyer: EBITDA\n($000)": "acquirer_ebitda_000",
    "Buyer: Total Equity\n($000)": "acquirer_equity_000",
    "Target: Period Ended\nMM/dd/yyyy": "target_period_end",
    "Target: CIQ Total Revenue\n($000)": "target_revenue_ciq_000",
    "Target: CIQ EBITDA Incl EQ Income from Affiliates\n($000)": "target_ebitda_ciq_000",
    "Target: Market Capitalization\n($M)": "target_mktcap_usd_m",
    "Premium Paid\n($000)": "premium_paid_000",
    "Deal Premium 1 Day Before\n(%)": "premium_1day_pct",
    "Deal Premium 1 Week Before\n(%)": "premium_1week_pct",
    "Deal Premium 1 Year Before\n(%)": "premium_1year_pct",
    "Consideration: Cash\n($M)": "consideration_cash_m",
    "Consideration: Common Stock\n($M)": "consideration_stock_m",
    "Consideration: Earnout/ Contingent Payments\n($M)": "consideration_earnout_m",
    "Adviser Name\n(All Roles Target/Issuer)": "adviser_target",
    "Adviser Name\n(All Roles Buyer/Investor)": "adviser_acquirer",
}


def _deals(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "deal_filing")


def distinct_on_first(spark: SparkSession, root: str) -> DataFrame:
    """The first delivery of each deal."""
    d = _deals(spark, root).select("deal_id", "loaded_at", "status", "acquirer_name", "target_name")
    return pick_first(d, ["deal_id"], ["loaded_at", "status", "acquirer_name", "target_name"]).drop("loaded_at")


def last_wins(spark: SparkSession, root: str) -> DataFrame:
    """The last delivered status of each deal, counted by status and year."""
    d = _deals(spark, root).select("deal_id", "loaded_at", "status", "deal_year")
    last = pick_last(d, ["deal_id"], ["loaded_at", "status", "deal_year"])
    return last.groupBy("deal_year", "status").agg(F.count("*").alias("n"))


def critical_null_audit(spark: SparkSession, root: str) -> DataFrame:
    """Nulls of each critical column."""
    return null_counts(_deals(spark, root), CRITICAL)


def critical_complete(spark: SparkSession, root: str) -> DataFrame:
    """Deals without a null in a critical column, split by whether a filing is attached."""
    d = complete(_deals(spark, root), CRITICAL)
    return d.groupBy("hf_match").agg(F.count("*").alias("n"), F.count_distinct("deal_id").alias("n_deals"), F.round(F.avg("deal_value_usd_m"), 4).alias("mean_value"))


def priority_year_join(spark: SparkSession, root: str) -> DataFrame:
    """A filing of the acquirer for the year before the deal, else the year before or after that; by normalised name."""
    f = table(spark, root, "filings").select(N.normalize(F.col("hf_company"), "merge").alias("k"), F.col("hf_filing_year").alias("y"), "filing_id", "hf_filing_date").where("k <> ''")
    d = _deals(spark, root).select("deal_id", N.normalize(F.col("acquirer_name"), "merge").alias("k"), F.col("tenk_year").alias("y")).distinct()
    out = with_fallbacks(d, f, key="k", year="y", offsets=[0, -1, 1], take=["filing_id"], last_by=["hf_filing_date", "filing_id"])
    how = F.when(F.col("matched_year").isNull(), "no_match").otherwise(F.concat(F.lit("name_norm+year_"), F.col("matched_year").cast("string")))
    return out.select("deal_id", "k", how.alias("method"), "filing_id")


def lag_year(spark: SparkSession, root: str) -> DataFrame:
    """Deals by year of announcement and the year before, against the stored year of the filing."""
    y = F.year("announced_date")
    return _deals(spark, root).groupBy(y.alias("deal_year"), (y - 1).alias("lag_year")).agg(F.count("*").alias("n"), F.count_if(F.col("tenk_year") == y - 1).alias("n_same"))


def text_quality_flags(spark: SparkSession, root: str) -> DataFrame:
    """Deals by whether their filing texts have more than 200 characters, against the stored flags."""
    d = _deals(spark, root)
    long = lambda c: F.coalesce(F.length(c) > 200, F.lit(False))
    return d.groupBy(long("item1_text").alias("item1_long"), long("mda_text").alias("mda_long"), "item1_ok", "mda_ok").agg(F.count("*").alias("n"))


def asof_prior_filing(spark: SparkSession, root: str) -> DataFrame:
    """The last filing strictly before the announcement under the acquirer's normalised name."""
    f = table(spark, root, "filings").select(N.normalize(F.col("hf_company"), "pit").alias("k"), "hf_filing_date", "filing_id").where("k <> ''")
    d = _deals(spark, root).select("deal_id", N.normalize(F.col("acquirer_name"), "pit").alias("k"), "announced_date").distinct()
    return as_known_at(d, f, entity=("k", "k"), event_time="announced_date", available=[("hf_filing_date", True)], latest_by=["hf_filing_date", "filing_id"], take={"filing_id": "filing_id"})


def co_occurring_targets(spark: SparkSession, root: str) -> DataFrame:
    """Other targets of the same acquirer in the same year."""
    d = _deals(spark, root).select("deal_id", F.lower("acquirer_name").alias("a"), "deal_year", "target_name").where("a IS NOT NULL AND target_name IS NOT NULL AND deal_year IS NOT NULL").distinct()
    both = d.join(others_of_group(d, ["a", "deal_year"], "target_name"), ["a", "deal_year"])
    others = F.array_except("all_target_name", F.array("target_name"))
    return both.where(F.size("all_target_name") > 1).select("deal_id", "target_name", F.size(others).alias("n_others"), F.array_join(others, "|").alias("others"))


def resume_anti_join(spark: SparkSession, root: str) -> DataFrame:
    """Prompts that have no answer yet from a model, by model: the cells left to run."""
    r = table(spark, root, "responses_raw").where("model_key IS NOT NULL")
    models = sorted(x[0] for x in r.select("model_key").distinct().collect())  # a handful
    p = table(spark, root, "prompts_raw").select("user_prompt_hash", "condition", "strategy").distinct()
    work = p.select("*", F.explode(F.array(*map(F.lit, models)).cast("array<string>")).alias("model_key"))
    left = pending(work, r, ["user_prompt_hash", "model_key"])
    return left.groupBy("model_key", "condition", "strategy").agg(F.count("*").alias("n_pending"))


def experiment_grid(spark: SparkSession, root: str) -> DataFrame:
    """All cells of conditions, models and strategies, with answers so far; cells without any count 0."""
    r = table(spark, root, "responses_raw").dropDuplicates(["response_id"]).na.drop(subset=["condition", "model_key", "strategy"])
    grid = r.agg(*[F.collect_set(c).alias(c) for c in ("condition", "model_key", "strategy")])  # one row
    for c in ("condition", "model_key", "strategy"):
        grid = grid.withColumn(c, F.explode(c))
    n = r.groupBy("condition", "model_key", "strategy").agg(F.count("*").alias("n"))
    return grid.join(n, ["condition", "model_key", "strategy"], "left").select("condition", "model_key", "strategy", F.coalesce("n", F.lit(0)).alias("n"))


def size_bucket_hist(spark: SparkSession, root: str) -> DataFrame:
    """Pool companies by size and revenue bucket, against the stored ones."""
    p = table(spark, root, "pool")
    size, revenue = V.size_bucket(F.col("mktcap_usd_m")), V.size_bucket(F.col("revenue_000") / 1000)
    return p.groupBy(size.alias("size"), revenue.alias("revenue")).agg(
        F.count("*").alias("n"), F.count_if(size == F.col("mktcap_bucket")).alias("same_size"), F.count_if(revenue == F.col("revenue_bucket")).alias("same_revenue")
    )


def code_to_sector(spark: SparkSession, root: str) -> DataFrame:
    """Sector of each industry code of pool and deals, with its neighbours."""
    p = table(spark, root, "pool").select("sic").unionByName(_deals(spark, root).select(F.col("target_sic").alias("sic"))).unionByName(table(spark, root, "filings").select(F.col("hf_sic").alias("sic")))
    s = V.sector(F.col("sic"))
    return p.groupBy("sic").agg(F.count("*").alias("n")).select("sic", s.alias("sector"), F.array_join(V.adjacent_sectors(s), ",").alias("adjacent"), "n")


def budget_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Deals by the acquirer's budget bucket."""
    b = V.budget(F.coalesce("acquirer_revenue_ciq_000", "acquirer_revenue_000") / 1000)
    return _deals(spark, root).groupBy(b.alias("budget")).agg(F.count("*").alias("n"), F.count_distinct("deal_id").alias("n_deals"))


def value_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Least, greatest and mean premium by year, NaN counting as null."""
    x = V.number(F.col("premium_1day_pct"))
    return _deals(spark, root).where("deal_year IS NOT NULL").groupBy("deal_year").agg(F.min(x).alias("least"), F.max(x).alias("greatest"), F.round(F.avg(x), 4).alias("mean"), F.count(x).alias("n"))


#: Dollars for a million tokens in and out, by model; the default for other models.
PRICES = {"kestrel_small": (0.03, 0.05), "kestrel_large": (0.2, 0.77), "orrin_1b": (0.027, 0.2), "orrin_70b": (0.12, 0.4), "mirrane_mini": (0.1, 0.3), "tallow_v3": (0.2, 0.77)}
DEFAULT_PRICE = (1.0, 3.0)


def cost_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Calls, tokens and cost by model, and in all."""
    prices = spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "model_key string, p_in double, p_out double")
    r = table(spark, root, "responses_raw").dropDuplicates(["response_id"]).select("model_key", "input_tokens", "output_tokens")
    n_in, n_out = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    cost = n_in / 1e6 * F.coalesce("p_in", F.lit(DEFAULT_PRICE[0])) + n_out / 1e6 * F.coalesce("p_out", F.lit(DEFAULT_PRICE[1]))
    priced = r.join(F.broadcast(prices), "model_key", "left").select(F.coalesce("model_key", F.lit("unknown")).alias("model_key"), n_in.alias("i"), n_out.alias("o"), cost.alias("c"))
    out = priced.rollup("model_key").agg(F.count("*").alias("calls"), F.sum("i").alias("tokens_in"), F.sum("o").alias("tokens_out"), F.round(F.sum("c"), 6).alias("cost"))
    return out.select(F.coalesce("model_key", F.lit("all")).alias("model_key"), "calls", "tokens_in", "tokens_out", "cost")


def probe_records(spark: SparkSession, root: str) -> DataFrame:
    """Records under probe names brought to canonical names, beside canonical ones."""
    r = table(spark, root, "responses_raw").dropDuplicates(["response_id"])
    probe = r.where("condition = 'A'").select("response_id", F.col("model_key").alias("model_slug"), F.col("response_text").alias("response"), F.col("input_tokens").alias("tokens_in"))
    plain = r.where("condition <> 'A'").select("response_id", "model_key", "response_text", "input_tokens", "provider")
    names = {"model_slug": "model_key", "response": "response_text", "tokens_in": "input_tokens"}
    both = conform(probe, names, {"provider": F.lit("unknown")}).unionByName(conform(plain, names, {"provider": F.lit("unknown")}))
    return both.groupBy("model_key", "provider").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"), F.sum(F.length("response_text")).alias("chars"))


def target_rows(spark: SparkSession, root: str) -> DataFrame:
    """The pool's row of each deal's target, or where the pool has none one built from the deal; how many deals have which, by sector and size."""
    d = _deals(spark, root).where("deal_id IS NOT NULL").select("deal_id", "loaded_at", "target_ticker", "target_name", "target_sic", "target_mktcap_usd_m")
    d = pick_last(d, ["deal_id"], ["loaded_at", "target_ticker", "target_name", "target_sic", "target_mktcap_usd_m"])
    p = table(spark, root, "pool").where("ticker IS NOT NULL").select(F.col("ticker").alias("target_ticker"), "published_at", "pool_id", "company_name", V.sector(F.col("sic")).alias("sector"), V.size_bucket(F.col("mktcap_usd_m")).alias("size"))
    p = pick_last(p, ["target_ticker"], ["published_at", "pool_id"])
    built = {"company_name": F.col("target_name"), "sector": V.sector(F.col("target_sic")), "size": V.size_bucket(F.col("target_mktcap_usd_m"))}
    return looked_up(d, p, "target_ticker", built).groupBy("found", "sector", "size").agg(F.count("*").alias("n_deals"), F.count_distinct("company_name").alias("n_names"))


#: Short names of the models; a model without one is left out.
SLUGS = {"kestrel_small": "kestrel-s", "kestrel_large": "kestrel-l", "orrin_1b": "orrin-1", "orrin_70b": "orrin-70", "mirrane_mini": "mirrane-m"}


def slugged_answers(spark: SparkSession, root: str) -> DataFrame:
    """Answers by short name of the model; models without a short name are left out."""
    r = table(spark, root, "responses_raw").select("response_id", "model_key").dropDuplicates(["response_id"])
    return mapped(r, "model_key", SLUGS, "model_slug").groupBy("model_slug").agg(F.count("*").alias("n"))


def pilot_deals(spark: SparkSession, root: str) -> DataFrame:
    """The first ten deals by announcement and id: a pilot run's input (a limit is the feature)."""
    d = drop_present(_deals(spark, root), ["item1_text", "mda_text", "no_such_column"]).where("announced_date IS NOT NULL").select("deal_id", "announced_date").distinct()
    return first_rows(d, ["announced_date", "deal_id"], 10)


def excluded_deals(spark: SparkSession, root: str) -> DataFrame:
    """Build status of deals: excluded by a given list, without a target ticker, or ok."""
    listed = table(spark, root, "deal_filing").where("status = 'Cancelled'").select("deal_id").distinct().withColumn("x", F.lit(True))
    d = _deals(spark, root).select("deal_id", "target_ticker").groupBy("deal_id").agg(F.max("target_ticker").alias("t"))
    status = F.when(F.col("x"), "excluded").when(F.col("t").isNull(), "no_target").otherwise("ok")
    return d.join(listed, "deal_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


NAMES = """distinct_on_first last_wins critical_null_audit critical_complete priority_year_join text_quality_flags asof_prior_filing co_occurring_targets
resume_anti_join experiment_grid size_bucket_hist code_to_sector budget_buckets value_ranges cost_rollup probe_records target_rows slugged_answers pilot_deals lag_year excluded_deals""".split()
QUERIES = {n: globals()[n] for n in NAMES}


def sql_normal(c: str, form: str) -> str:
    """A normal form of a name in SQL."""
    if form == "entity":
        forms = "|".join(N.ENTITY_FORMS)
        steps = [(rf"(?i)\b{N.OTHER_NAME}\b.*$", ""), (r"\([^)]*\)", " "), (rf"(?i)\b(?:{forms})\b\.?", " "), (r"[^\pL\pN_\s]", " "), (r"\s+", " ")]
    else:
        words = "|".join({"merge": N.MERGE_WORDS, "pit": N.PIT_WORDS}[form])
        steps = [(r"\([^)]*\)", ""), (rf"\b(?:{words})\b", ""), (r"[^\pL\pN_\s]", ""), (r"\s+", " ")]
    out = f"lower({c})"
    for a, b in steps:
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"trim({out})"


def sql_sector(c: str) -> str:
    code = f"coalesce(TRY_CAST(nullif(regexp_extract({c}, '\\((\\d+)\\)', 1), '') AS INTEGER), CAST(trunc(TRY_CAST(trim({c}) AS DOUBLE)) AS INTEGER))"
    cases = " ".join("WHEN " + " OR ".join(f"{code} BETWEEN {a} AND {b}" for a, b in ranges) + f" THEN '{name}'" for name, ranges in V.SECTORS)
    return f"CASE WHEN {code} IS NULL THEN 'Unknown' {cases} ELSE 'Other' END"


def sql_bucket(x: str) -> str:
    cases = " ".join(f"WHEN {x} < {e} THEN '{label}'" for e, label in zip(V.SIZE_EDGES[1:], V.SIZE_LABELS, strict=False))
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} < 0 THEN 'Unknown' {cases} WHEN {x} < 'inf'::DOUBLE THEN '{V.SIZE_LABELS[-1]}' ELSE 'Unknown' END"


_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL{f' OR isnan({c})' if c.endswith('_m') else ''}) AS n_null, count(*) AS n_rows FROM deal_filing" for c in CRITICAL
)
_FULL = " AND ".join(f"{c} IS NOT NULL" + (f" AND NOT isnan({c})" if c.endswith("_m") else "") for c in CRITICAL)
_ADJACENT = " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in V.ADJACENT.items())
_PRICE = "VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in PRICES.items())
_REV = "(coalesce(acquirer_revenue_ciq_000, acquirer_revenue_000) / 1000)"
ORACLE = {
    "distinct_on_first": "SELECT DISTINCT ON (deal_id) deal_id, status, acquirer_name, target_name FROM deal_filing ORDER BY deal_id, loaded_at NULLS LAST, status NULLS LAST, acquirer_name NULLS LAST, target_name NULLS LAST",
    "last_wins": "SELECT deal_year, status, count(*) AS n FROM (SELECT DISTINCT ON (deal_id) deal_year, status FROM deal_filing ORDER BY deal_id, loaded_at DESC NULLS LAST, status DESC NULLS LAST, deal_year DESC NULLS LAST) GROUP BY ALL",
    "critical_null_audit": _NULLS,
    "critical_complete": f"SELECT hf_match, count(*) AS n, count(DISTINCT deal_id) AS n_deals, round(avg(deal_value_usd_m), 4) AS mean_value FROM deal_filing WHERE {_FULL} GROUP BY 1",
    "priority_year_join": f"""
WITH f AS (SELECT DISTINCT ON (k, y) k, y, filing_id FROM (SELECT {sql_normal("hf_company", "merge")} AS k, hf_filing_year AS y, filing_id, hf_filing_date FROM filings)
  WHERE k <> '' AND y IS NOT NULL ORDER BY k, y, hf_filing_date DESC NULLS LAST, filing_id DESC),
d AS (SELECT DISTINCT deal_id, {sql_normal("acquirer_name", "merge")} AS k, tenk_year AS y FROM deal_filing)
SELECT d.deal_id, d.k, coalesce('name_norm+year_' || coalesce(a.y, b.y, c.y), 'no_match') AS method, coalesce(a.filing_id, b.filing_id, c.filing_id) AS filing_id
FROM d LEFT JOIN f a ON a.k = d.k AND a.y = d.y LEFT JOIN f b ON b.k = d.k AND b.y = d.y - 1 LEFT JOIN f c ON c.k = d.k AND c.y = d.y + 1""",
    "text_quality_flags": "SELECT coalesce(length(item1_text) > 200, false) AS item1_long, coalesce(length(mda_text) > 200, false) AS mda_long, item1_ok, mda_ok, count(*) AS n FROM deal_filing GROUP BY ALL",
    "asof_prior_filing": f"""
WITH f AS (SELECT {sql_normal("hf_company", "pit")} AS k, hf_filing_date AS t, filing_id FROM filings), d AS (SELECT DISTINCT deal_id, {sql_normal("acquirer_name", "pit")} AS k, announced_date FROM deal_filing)
SELECT deal_id, k, announced_date, filing_id FROM (SELECT d.*, f.filing_id, row_number() OVER (PARTITION BY d.deal_id, d.k, d.announced_date ORDER BY f.t DESC NULLS LAST, f.filing_id DESC NULLS LAST) AS r
  FROM d LEFT JOIN f ON f.k = d.k AND f.k <> '' AND f.t < CAST(d.announced_date AS TIMESTAMP)) WHERE r = 1""",
    "co_occurring_targets": """
WITH d AS (SELECT DISTINCT deal_id, lower(acquirer_name) AS a, deal_year, target_name FROM deal_filing WHERE acquirer_name IS NOT NULL AND target_name IS NOT NULL AND deal_year IS NOT NULL),
g AS (SELECT a, deal_year, list_sort(list(DISTINCT target_name)) AS l FROM d GROUP BY ALL)
SELECT deal_id, target_name, len(l) - 1 AS n_others, array_to_string(list_filter(l, lambda x: x <> target_name), '|') AS others FROM d JOIN g USING (a, deal_year) WHERE len(l) > 1""",
    "resume_anti_join": """
WITH p AS (SELECT DISTINCT user_prompt_hash, condition, strategy FROM prompts_raw), m AS (SELECT DISTINCT model_key FROM responses_raw WHERE model_key IS NOT NULL)
SELECT model_key, condition, strategy, count(*) AS n_pending FROM p, m WHERE NOT EXISTS (SELECT 1 FROM responses_raw r WHERE r.user_prompt_hash = p.user_prompt_hash AND r.model_key = m.model_key) GROUP BY ALL""",
    "experiment_grid": """
WITH r AS (SELECT DISTINCT response_id, condition, model_key, strategy FROM responses_raw WHERE condition IS NOT NULL AND model_key IS NOT NULL AND strategy IS NOT NULL)
SELECT a.condition, b.model_key, c.strategy, (SELECT count(*) FROM r WHERE r.condition = a.condition AND r.model_key = b.model_key AND r.strategy = c.strategy) AS n
FROM (SELECT DISTINCT condition FROM r) a, (SELECT DISTINCT model_key FROM r) b, (SELECT DISTINCT strategy FROM r) c""",
    "size_bucket_hist": f"""SELECT {sql_bucket("mktcap_usd_m")} AS size, {sql_bucket("(revenue_000 / 1000)")} AS revenue, count(*) AS n, count(*) FILTER ({sql_bucket("mktcap_usd_m")} = mktcap_bucket) AS same_size,
count(*) FILTER ({sql_bucket("(revenue_000 / 1000)")} = revenue_bucket) AS same_revenue FROM pool GROUP BY ALL""",
    "code_to_sector": f"""WITH a AS (SELECT sic FROM pool UNION ALL SELECT target_sic FROM deal_filing UNION ALL SELECT hf_sic FROM filings), b AS (SELECT sic, count(*) AS n, {sql_sector("sic")} AS sector FROM a GROUP BY sic)
SELECT sic, sector, CASE sector {_ADJACENT} ELSE '' END AS adjacent, n FROM b""",
    "budget_buckets": f"""SELECT CASE WHEN {_REV} IS NULL OR isnan({_REV}) THEN NULL WHEN {_REV} < 500 THEN '{V.BUDGETS[0][1]}' WHEN {_REV} < 5000 THEN '{V.BUDGETS[1][1]}' WHEN {_REV} < 20000 THEN '{V.BUDGETS[2][1]}' ELSE '{V.BUDGET_TOP}' END AS budget,
count(*) AS n, count(DISTINCT deal_id) AS n_deals FROM deal_filing GROUP BY 1""",
    "value_ranges": "SELECT deal_year, min(x) AS least, max(x) AS greatest, round(avg(x), 4) AS mean, count(x) AS n FROM (SELECT deal_year, CASE WHEN NOT isnan(premium_1day_pct) THEN premium_1day_pct END AS x FROM deal_filing) WHERE deal_year IS NOT NULL GROUP BY 1",
    "cost_rollup": f"""WITH p(model_key, a, b) AS ({_PRICE}), r AS (SELECT DISTINCT ON (response_id) model_key, coalesce(input_tokens, 0) AS i, coalesce(output_tokens, 0) AS o FROM responses_raw ORDER BY response_id)
SELECT CASE WHEN grouping(k) = 1 THEN 'all' ELSE k END AS model_key, count(*) AS calls, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round(sum(c), 6) AS cost FROM
(SELECT coalesce(r.model_key, 'unknown') AS k, i, o, i / 1e6 * coalesce(a, 1.0) + o / 1e6 * coalesce(b, 3.0) AS c FROM r LEFT JOIN p USING (model_key)) GROUP BY ROLLUP (k)""",
    "probe_records": """WITH r AS (SELECT DISTINCT ON (response_id) * FROM responses_raw ORDER BY response_id)
SELECT model_key, CASE WHEN condition = 'A' THEN 'unknown' ELSE provider END AS provider, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS tokens, CAST(sum(length(response_text)) AS BIGINT) AS chars FROM r WHERE condition IS NOT NULL GROUP BY ALL""",
    "lag_year": "SELECT year(announced_date)::INT AS deal_year, year(announced_date)::INT - 1 AS lag_year, count(*) AS n, count(*) FILTER (tenk_year = year(announced_date) - 1) AS n_same FROM deal_filing GROUP BY ALL",
    "slugged_answers": "WITH s(k, model_slug) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SLUGS.items()) + ") SELECT model_slug, count(DISTINCT response_id) AS n FROM responses_raw JOIN s ON s.k = model_key GROUP BY 1",
    "pilot_deals": "SELECT DISTINCT deal_id, announced_date FROM deal_filing WHERE announced_date IS NOT NULL ORDER BY announced_date, deal_id NULLS LAST LIMIT 10",
    "target_rows": f"""WITH d AS (SELECT DISTINCT ON (deal_id) * FROM deal_filing WHERE deal_id IS NOT NULL ORDER BY deal_id, loaded_at DESC NULLS LAST, target_ticker DESC NULLS LAST, target_name DESC NULLS LAST, target_sic DESC NULLS LAST, target_mktcap_usd_m DESC NULLS LAST),
p AS (SELECT DISTINCT ON (ticker) ticker, company_name, {sql_sector("sic")} AS sector, {sql_bucket("mktcap_usd_m")} AS size FROM pool WHERE ticker IS NOT NULL ORDER BY ticker, published_at DESC NULLS LAST, pool_id DESC NULLS LAST),
b AS (SELECT p.ticker IS NOT NULL AS found, CASE WHEN p.ticker IS NOT NULL THEN company_name ELSE target_name END AS nm, CASE WHEN p.ticker IS NOT NULL THEN p.sector ELSE {sql_sector("target_sic")} END AS sector, CASE WHEN p.ticker IS NOT NULL THEN p.size ELSE {sql_bucket("target_mktcap_usd_m")} END AS size
  FROM d LEFT JOIN p ON p.ticker = d.target_ticker) SELECT found, sector, size, count(*) AS n_deals, count(DISTINCT nm) AS n_names FROM b GROUP BY ALL""",
    "excluded_deals": """SELECT CASE WHEN x THEN 'excluded' WHEN t IS NULL THEN 'no_target' ELSE 'ok' END AS status, count(*) AS n FROM
(SELECT deal_id, max(target_ticker) AS t, bool_or(coalesce(status = 'Cancelled', false)) AS x FROM deal_filing GROUP BY 1) GROUP BY 1""",
}

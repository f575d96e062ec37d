"""Queries over candidate corpora: construction, invariants, and lexical and dense baselines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import business as V
from ..functions import ranking as R
from ..functions.redaction import mask_acquirer
from ..operators import corpus as C
from ..operators.asof import as_known_at
from ..operators.inference import mean_interval, paired_interval
from ..operators.relational import pick_last
from ..operators.retrieval import STOP_WORDS, bm25, dense, lexical_text, nearest, terms, tfidf, tokens
from ..operators.responder import offline_vector
from ..runtime import write_once
from ..sources.tables import table
from .evaluation import BASE, _evaluated, _round_all, draws
from .deals import sql_bucket, sql_sector
from .texts import sql_mask, sql_masked

MEANS = ["mrr", "recall_1", "recall_5", "recall_10", "ndcg_5", "ndcg_10"]


def corpus_rows(spark: SparkSession, root: str) -> DataFrame:
    """corpus_per_deal with one row for each deal (its id trimmed and upper-cased) and candidate number, the last delivered."""
    c = table(spark, root, "corpus_per_deal").withColumn("deal_id", F.upper(F.trim("deal_id"))).withColumn("no", F.col("candidate_id").try_cast("int")).where("deal_id IS NOT NULL AND no IS NOT NULL")
    c = c.select("deal_id", "no", "loaded_at", "acquirer_ticker", "target_ticker", "candidate_ticker", "is_target", "anon_description")
    return pick_last(c, ["deal_id", "no"], ["loaded_at", "candidate_ticker", "anon_description"])


def _pool(spark: SparkSession, root: str) -> DataFrame:
    """The last published version of each pool company with sector and size, without shells."""
    p = table(spark, root, "pool").where("ticker IS NOT NULL").select("ticker", "published_at", "pool_id", "company_name", V.sector(F.col("sic")).alias("sector"), V.size_bucket(F.col("mktcap_usd_m")).alias("size"), V.size_bucket(F.col("revenue_000") / 1000).alias("revenue"))
    return pick_last(p, ["ticker"], ["published_at", "pool_id"]).where("sector <> 'SPAC'")


def _targets(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "deal_filing").where("deal_id IS NOT NULL").select("deal_id", "loaded_at", F.col("target_ticker").alias("ticker"), V.sector(F.col("target_sic")).alias("sector"), V.size_bucket(F.col("target_mktcap_usd_m")).alias("size"), "announced_date")
    return pick_last(d, ["deal_id"], ["loaded_at", "ticker", "sector", "size", "announced_date"])


def quota_sample(spark: SparkSession, root: str) -> DataFrame:
    """Candidates drawn for every deal: 22, 18 and 9 by stratum, filled up to 49."""
    return C.draw_candidates(_targets(spark, root), _pool(spark, root))


def quota_report(spark: SparkSession, root: str) -> DataFrame:
    """Build status: deals by number of candidates drawn in each stratum."""
    q = quota_sample(spark, root).groupBy("deal_id").pivot("stratum", ["same", "adjacent", "other", "fill"]).agg(F.count("ticker")).na.fill(0)
    total = F.col("same") + F.col("adjacent") + F.col("other") + F.col("fill")
    status = F.when(total == C.N_CANDIDATES - 1, "ok").otherwise("dropped_insufficient_candidates")
    return q.groupBy(status.alias("status")).agg(F.count("*").alias("n_deals"), F.sum("same").alias("same"), F.sum("adjacent").alias("adjacent"), F.sum("other").alias("other"), F.sum("fill").alias("fill"))


def built_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Numbered candidates of every deal, the target among them, each with the description known when the deal was announced."""
    targets = write_once(_targets(spark, root).where("ticker IS NOT NULL"))
    drawn = quota_sample(spark, root).join(targets.select("deal_id"), "deal_id", "left_semi").select("deal_id", "ticker", F.lit(False).alias("is_target"))
    items = C.number_candidates(drawn.unionByName(targets.select("deal_id", "ticker", F.lit(True).alias("is_target"))))
    items = write_once(items.join(targets.select("deal_id", "announced_date"), "deal_id"))
    pool = table(spark, root, "pool").where(F.col("ciq_desc").rlike(r"(?U)\S")).withColumn("n_chars", F.length("ciq_desc").cast("long"))
    known = as_known_at(
        items, pool, entity=("ticker", "ticker"), event_time="announced_date", available=[("published_at", True), ("valid_from", False)],
        latest_by=["valid_from", "published_at", "pool_id"], take={"pool_id": "version_id", "n_chars": "description_chars"},
    )
    return known.select("deal_id", "candidate_no", "ticker", "is_target", "version_id", "description_chars")


def deal_seeds(spark: SparkSession, root: str) -> DataFrame:
    """The seed of each deal: the low 32 bits of the MD5 digest of its id."""
    return table(spark, root, "deal_filing").select("deal_id").distinct().select("deal_id", C.seed_of(F.col("deal_id")).alias("seed"))


def size_windows(spark: SparkSession, root: str) -> DataFrame:
    """Pool companies that fall into the size window of each target size, by stratum of one sector."""
    p = _pool(spark, root).select("ticker", F.explode(C.sector_strata(F.col("sector"))).alias("s"), F.explode(C.size_windows(F.col("size"))).alias("target_size"))
    return p.groupBy("s.target_sector", "target_size", "s.stratum").agg(F.count("*").alias("n"))


def _wide(spark: SparkSession, root: str) -> DataFrame:
    c = corpus_rows(spark, root)
    one = c.groupBy("deal_id").agg(F.max("target_ticker").alias("target_ticker"))
    return C.to_wide(c, "deal_id", "no", "anon_description", "candidate_ticker", "is_target").join(one, "deal_id")


def wide_from_long(spark: SparkSession, root: str) -> DataFrame:
    """Wide form of every deal: digest of its lines, number and position."""
    return _wide(spark, root).select("deal_id", F.md5("candidate_list").alias("list_md5"), F.length("candidate_list").alias("n_chars"), "n", "target_position")


def corpus_invariants(spark: SparkSession, root: str) -> DataFrame:
    """Broken invariants of every deal."""
    return C.violations(_wide(spark, root), "deal_id", "target_ticker")


def _queries(spark: SparkSession, root: str, masked: bool) -> DataFrame:
    """(deal_id, q): the acquirer's filing texts of deals that have some."""
    d = table(spark, root, "deal_filing").where("hf_match").select("deal_id", "loaded_at", "acquirer_name", "acquirer_ticker", "item1_text", "mda_text")
    d = pick_last(d, ["deal_id"], ["loaded_at", "acquirer_name", "acquirer_ticker", "item1_text", "mda_text"])
    cut = lambda c, first, most: F.substring(mask_acquirer(F.substring(c, 1, first), F.col("acquirer_name"), F.col("acquirer_ticker")) if masked else F.col(c), 1, most)
    d = d.select(F.upper(F.trim("deal_id")).alias("deal_id"), cut("item1_text", 500, 400).alias("a"), cut("mda_text", 400, 300).alias("b"))
    return d.select("deal_id", F.concat_ws(" ", "a", "b").alias("q")).where(lexical_text(F.col("q")) != "")


def _lines(spark: SparkSession, root: str, queries: DataFrame) -> DataFrame:
    """(deal_id, no, is_target, line) of the deals with a query."""
    return corpus_rows(spark, root).select("deal_id", "no", "is_target", F.col("anon_description").alias("line")).join(queries.select("deal_id"), "deal_id", "left_semi")


def _ranked(rank, words, lines: DataFrame, queries: DataFrame, group: str = "deal_id") -> DataFrame:
    items = lines.select(group, "no", words(F.col("line")).alias("d"))
    return rank(items, queries.select(group, words(F.col("q")).alias("q")), group=group, item="no", doc="d", query="q")


def bm25_rank(spark: SparkSession, root: str) -> DataFrame:
    """Candidates of every deal ranked by BM25 against the acquirer's filing texts."""
    q = _queries(spark, root, False)
    return _ranked(bm25, tokens, _lines(spark, root, q), q).select("deal_id", "no", F.round("score", 4).alias("score"), "rank")


def tfidf_rank(spark: SparkSession, root: str) -> DataFrame:
    """Candidates of every deal ranked by the cosine of tf-idf vectors of words and word pairs."""
    q = _queries(spark, root, False)
    return _ranked(tfidf, terms, _lines(spark, root, q), q).select("deal_id", "no", F.round("score", 6).alias("score"), "rank")


@F.pandas_udf(ArrayType(DoubleType()))
def vector_of(texts: pd.Series) -> pd.Series:
    """The offline responder's vector of each text; another model's takes its place here. Zeros for a text without words."""
    return pd.Series([offline_vector(t or "") for t in texts], dtype=object)


def dense_deal_rank(spark: SparkSession, root: str) -> DataFrame:
    """Candidates of every deal ranked by the cosine of their line's vector with that of the acquirer's masked filing texts."""
    q = _queries(spark, root, True)
    return _dense(_lines(spark, root, q), q, "deal_id").select("deal_id", "no", F.round("score", 6).alias("score"), "rank")


def _dense(lines: DataFrame, queries: DataFrame, group: str) -> DataFrame:
    asked = queries.select(group, vector_of(lexical_text(F.col("q"))).alias("qv"))
    items = lines.select(group, "no", vector_of(lexical_text(F.col("line"))).alias("v"))
    return dense(items.join(asked, group), group=group, item="no", vector="v", query="qv")


def _baselines(spark: SparkSession, root: str) -> DataFrame:
    """(method, condition, deal_id, p): the target's place under each baseline with (B) and without (C) descriptions, 0 beyond the tenth."""
    q = write_once(_queries(spark, root, True))
    lines = _lines(spark, root, q)
    key = lambda condition: F.concat(F.lit(condition), "deal_id").alias("g")
    both = write_once(lines.select(key("B"), "no", "is_target", "line").unionByName(lines.select(key("C"), "no", "is_target", C.without_description(F.col("line")).alias("line"))))
    asked = q.select(key("B"), "q").unionByName(q.select(key("C"), "q"))
    gold = both.where("is_target").select("g", "no")

    def places(method: str, ranked: DataFrame) -> DataFrame:
        place = ranked.join(gold, ["g", "no"]).groupBy("g").agg(F.min("rank").alias("place"))
        return place.select(F.lit(method).alias("method"), F.left("g", F.lit(1)).alias("condition"), F.expr("substring(g, 2)").alias("deal_id"), F.when(F.col("place") <= R.K, F.col("place")).otherwise(0).alias("p"))

    lexical = places("bm25", _ranked(bm25, tokens, both, asked, "g")).unionByName(places("tfidf", _ranked(tfidf, terms, both, asked, "g")))
    return lexical.unionByName(places("dense", _dense(both, asked, "g")))


def baseline_panel(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of the lexical and dense baselines with and without descriptions, with intervals of the mean mrr, beside chance, which has none."""
    placed = write_once(_baselines(spark, root).withColumn("mrr", R.reciprocal_rank(F.col("p"))))
    p = F.col("p")
    m = {"recall_1": R.recall(p, 1), "recall_5": R.recall(p, 5), "recall_10": R.recall(p, 10), "ndcg_5": R.gain(p, 5), "ndcg_10": R.gain(p, 10)}
    means = placed.groupBy("method", "condition").agg(F.count("*").alias("n"), F.round(F.avg("mrr"), 6).alias("mrr"), *[F.round(F.avg(v), 6).alias(k) for k, v in m.items()])
    ci = mean_interval(placed, ["method", "condition"], "mrr", "deal_id").select("method", "condition", F.round("low", 6).alias("mrr_low"), F.round("high", 6).alias("mrr_high"))
    out = means.join(ci, ["method", "condition"])
    chance = {"mrr": R.chance_reciprocal_rank(), "recall_1": R.chance_recall(1), "recall_5": R.chance_recall(5), "recall_10": R.chance_recall(10), "ndcg_5": R.chance_gain(5), "ndcg_10": R.chance_gain(10)}
    none = F.lit(None).cast("double")
    row = out.groupBy("condition").agg(F.max("n").alias("n")).select(F.lit("chance").alias("method"), "condition", "n", *[F.lit(round(v, 6)).alias(k) for k, v in chance.items()], none.alias("mrr_low"), none.alias("mrr_high"))
    return out.unionByName(row)


def baseline_delta(spark: SparkSession, root: str) -> DataFrame:
    """mrr of the models' answers less that of each baseline on the same deals, for every condition, baseline, model and strategy, with intervals that draw whole acquirers 1,000 times."""
    base = _baselines(spark, root).select("method", "condition", "deal_id", R.reciprocal_rank(F.col("p")).alias("base"))
    keys = ["condition", "deal_id", "model_key", "strategy"]
    e = pick_last(_evaluated(spark, root).select("response_id", "acquirer_ticker", *keys, "mrr").na.drop(subset=keys), keys, ["response_id"])
    both = e.join(base, ["condition", "deal_id"]).withColumn("d", F.col("mrr") - F.col("base")).withColumn("cluster", F.coalesce("acquirer_ticker", "deal_id"))
    return _round_all(paired_interval(both, ["condition", "method", "model_key", "strategy"], "d", "cluster"), [])


def dense_rank(spark: SparkSession, root: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100, and whether they share its label."""
    e = table(spark, root, "embeddings")
    near = nearest(e, e.where("vec_id % 100 = 0"), key="vec_id", vector="embedding")
    label = e.select("vec_id", "label")
    out = near.join(label, "vec_id").join(label.select(F.col("vec_id").alias("query"), F.col("label").alias("own")), "query")
    return out.select("query", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), (F.col("label") == F.col("own")).alias("same_label"))


def dense_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of the first neighbour with the query's label, by label."""
    d = dense_rank(spark, root)
    first = d.groupBy("query").agg(F.min(F.when(F.col("same_label"), F.col("rank"))).alias("p"))
    label = table(spark, root, "embeddings").select(F.col("vec_id").alias("query"), "label")
    p = F.coalesce("p", F.lit(0))
    return first.join(label, "query").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(R.reciprocal_rank(p)), 6).alias("mrr"), F.round(F.avg(R.recall(p, 10)), 6).alias("recall_10"), F.round(F.avg(R.gain(p, 10)), 6).alias("ndcg_10"))


NAMES = """quota_sample quota_report built_corpus deal_seeds size_windows wide_from_long corpus_invariants bm25_rank tfidf_rank dense_deal_rank baseline_panel baseline_delta dense_rank dense_metrics""".split()
QUERIES = {n: globals()[n] for n in NAMES}

_ROWS = """c AS (SELECT DISTINCT ON (deal_id, no) * FROM (SELECT upper(trim(deal_id)) AS deal_id, TRY_CAST(candidate_id AS INTEGER) AS no, loaded_at, target_ticker, candidate_ticker, is_target, anon_description, acquirer_ticker FROM corpus_per_deal)
  WHERE deal_id IS NOT NULL AND no IS NOT NULL ORDER BY deal_id, no, loaded_at DESC NULLS LAST, candidate_ticker DESC NULLS LAST, anon_description DESC NULLS LAST, acquirer_ticker DESC NULLS LAST, is_target DESC, target_ticker DESC)"""


def _lex(x: str) -> str:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"lower(trim(regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')))"


_QUERY = f"""dd AS (SELECT DISTINCT ON (deal_id) upper(trim(deal_id)) AS deal_id, concat_ws(' ', left(item1_text, 400), left(mda_text, 300)) AS qt FROM deal_filing WHERE hf_match
  ORDER BY deal_id, loaded_at DESC NULLS LAST, acquirer_name DESC NULLS LAST, acquirer_ticker DESC NULLS LAST, item1_text DESC NULLS LAST, mda_text DESC NULLS LAST)"""
_BM25 = f"""
{_ROWS}, {_QUERY},
it AS (SELECT c.deal_id, c.no, c.is_target, {_lex("anon_description")} AS d, {_lex("qt")} AS q FROM c JOIN dd USING (deal_id) WHERE {_lex("qt")} <> ''),
tk AS (SELECT deal_id, no, string_split(d, ' ') AS d FROM it WHERE d <> ''),
qf AS (SELECT deal_id, t, count(*) AS qf FROM (SELECT deal_id, unnest(string_split(any_value(q), ' ')) AS t FROM it GROUP BY deal_id) GROUP BY ALL),
sz AS (SELECT deal_id, count(*) AS n, avg(len(d)) AS al FROM tk GROUP BY 1),
tf AS (SELECT deal_id, no, any_value(l) AS l, t, count(*) AS tf FROM (SELECT deal_id, no, len(d) AS l, unnest(d) AS t FROM tk) GROUP BY deal_id, no, t),
df AS (SELECT deal_id, t, any_value(n) AS n, any_value(al) AS al, count(*) AS df FROM tf JOIN sz USING (deal_id) GROUP BY deal_id, t),
i0 AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df), i1 AS (SELECT *, avg(raw) OVER (PARTITION BY deal_id) AS m FROM i0), i2 AS (SELECT *, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM i1),
sc AS (SELECT deal_id, no, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))) AS s FROM qf JOIN i2 USING (deal_id, t) JOIN tf USING (deal_id, t) GROUP BY ALL),
rk AS (SELECT it.deal_id, it.no, it.is_target, CASE WHEN d = '' THEN -1.0 ELSE round(coalesce(s, 0), 9) END AS score FROM it LEFT JOIN sc USING (deal_id, no)),
bm AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY score DESC, no) AS rank FROM rk)
"""


def _terms(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all({x}, '\\b(\\w\\w+)\\b', 1), lambda w: NOT list_contains([{stop}], w))"


_PAIRED = "list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))"
_MASKED = """qd AS (SELECT DISTINCT ON (deal_id) * FROM (SELECT deal_id, loaded_at, acquirer_name, acquirer_ticker, item1_text, mda_text FROM deal_filing WHERE hf_match) ORDER BY deal_id, loaded_at DESC NULLS LAST, acquirer_name DESC NULLS LAST, acquirer_ticker DESC NULLS LAST, item1_text DESC NULLS LAST, mda_text DESC NULLS LAST)"""
_VECTOR = lambda x: f"list_transform(list_filter(string_split_regex(lower(coalesce({x}, '')), '\\s+'), lambda w: w <> ''), lambda w: {{'i': ('0x' || substr(md5(w), 1, 2))::INT % 64, 'v': CASE WHEN ('0x' || substr(md5(w), 3, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END}})"
_SUMS = lambda m: f"list_transform(range(0, 64), lambda k: coalesce(list_sum(list_transform(list_filter({m}, lambda e: e.i = k), lambda e: e.v)), 0)::DOUBLE)"


def _dense_sql(lines: str, queries: str, group: str) -> str:
    """CTE bodies to dr: items of ``lines`` (group, no, line) ranked against ``queries`` (group, q)."""
    return f"""vq AS (SELECT {group}, {_VECTOR(_lex("q"))} AS m FROM {queries}), vq2 AS (SELECT {group}, {_SUMS("m")} AS qv FROM vq),
vd AS (SELECT {group}, no, {_VECTOR(_lex("line"))} AS m FROM {lines}), vd2 AS (SELECT {group}, no, {_SUMS("m")} AS v FROM vd),
vs AS (SELECT {group}, no, round(list_dot_product(v, qv) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)), 0), 9) AS score FROM vd2 JOIN vq2 USING ({group})),
dr AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC NULLS LAST, no) AS rank FROM vs)"""


def _ranks_sql() -> str:
    """CTE bodies to bp: place of the target under each baseline, method and condition."""
    text = "concat_ws(' ', x1, x2)"
    bm = f"""tk AS (SELECT g, no, string_split({_lex("line")}, ' ') AS d FROM bl WHERE {_lex("line")} <> ''),
qf AS (SELECT g, t, count(*) AS qf FROM (SELECT g, unnest(string_split({_lex("q")}, ' ')) AS t FROM bq) GROUP BY ALL),
sz AS (SELECT g, count(*) AS n, avg(len(d)) AS al FROM tk GROUP BY 1), tf AS (SELECT g, no, any_value(l) AS l, t, count(*) AS tf FROM (SELECT g, no, len(d) AS l, unnest(d) AS t FROM tk) GROUP BY g, no, t),
df AS (SELECT g, t, any_value(n) AS n, any_value(al) AS al, count(*) AS df FROM tf JOIN sz USING (g) GROUP BY g, t),
i0 AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df), i1 AS (SELECT *, avg(raw) OVER (PARTITION BY g) AS m FROM i0), i2 AS (SELECT *, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM i1),
sc AS (SELECT g, no, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))) AS s FROM qf JOIN i2 USING (g, t) JOIN tf USING (g, t) GROUP BY ALL),
rb AS (SELECT bl.g, bl.no, CASE WHEN {_lex("line")} = '' THEN -1.0 ELSE round(coalesce(s, 0), 9) END AS score FROM bl LEFT JOIN sc USING (g, no)), b1 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, no) AS rank FROM rb)"""
    ti = f"""u0 AS (SELECT g, no, {_terms(_lex("line"))} AS k FROM bl), u1 AS (SELECT g, no, {_PAIRED} AS d FROM u0), un AS (SELECT g, count(*) AS n FROM u1 GROUP BY 1),
ut AS (SELECT g, no, t, 1 + ln(count(*)) AS w FROM (SELECT g, no, unnest(d) AS t FROM u1) GROUP BY ALL), ud AS (SELECT g, t, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM ut JOIN un USING (g) GROUP BY g, t),
uw AS (SELECT g, no, t, w * idf AS w FROM ut JOIN ud USING (g, t)), um AS (SELECT g, no, sqrt(sum(w * w)) AS nm FROM uw GROUP BY ALL),
v0 AS (SELECT g, unnest({_PAIRED}) AS t FROM (SELECT g, {_terms(_lex("q"))} AS k FROM bq)), vw AS (SELECT g, t, (1 + ln(count(*))) * any_value(idf) AS qw FROM v0 JOIN ud USING (g, t) GROUP BY g, t), vn AS (SELECT g, sqrt(sum(qw * qw)) AS qm FROM vw GROUP BY 1),
vt AS (SELECT g, no, sum(w * qw) AS dot FROM uw JOIN vw USING (g, t) GROUP BY ALL), u2 AS (SELECT g, no, round(coalesce(dot / (nm * qm), 0), 9) AS score FROM u1 LEFT JOIN vt USING (g, no) LEFT JOIN um USING (g, no) LEFT JOIN vn USING (g)),
tz AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, no) AS rank FROM u2)"""
    place = lambda method, source: f"SELECT '{method}' AS method, left(g, 1) AS condition, substr(g, 2) AS deal_id, CASE WHEN min(rank) <= 10 THEN min(rank) ELSE 0 END AS p FROM {source} JOIN bl USING (g, no) WHERE is_target GROUP BY g"
    return f"""{_ROWS}, {_MASKED}, {sql_masked("qd", "acquirer_name", "acquirer_ticker")},
q1 AS (SELECT upper(trim(deal_id)) AS deal_id, left({sql_mask("left(item1_text, 500)")}, 400) AS x1, left({sql_mask("left(mda_text, 400)")}, 300) AS x2 FROM mk), q2 AS (SELECT deal_id, {text} AS q FROM q1 WHERE {_lex(text)} <> ''),
bl AS (SELECT 'B' || deal_id AS g, no, is_target, anon_description AS line FROM c JOIN q2 USING (deal_id) UNION ALL SELECT 'C' || deal_id, no, is_target, rtrim(split_part(anon_description, '| Description:', 1)) FROM c JOIN q2 USING (deal_id)),
bq AS (SELECT 'B' || deal_id AS g, q FROM q2 UNION ALL SELECT 'C' || deal_id, q FROM q2),
{bm}, {ti}, {_dense_sql("bl", "bq", "g")},
bp AS ({place("bm25", "b1")} UNION ALL {place("tfidf", "tz")} UNION ALL {place("dense", "dr")})"""


_POOL = f"""p AS (SELECT * FROM (SELECT DISTINCT ON (ticker) ticker, {sql_sector("sic")} AS sector, {sql_bucket("mktcap_usd_m")} AS size FROM pool WHERE ticker IS NOT NULL ORDER BY ticker, published_at DESC NULLS LAST, pool_id DESC NULLS LAST) WHERE sector <> 'SPAC')"""
_SECTORS = [s for s, _ in V.SECTORS if s != "SPAC"] + ["Other", V.UNKNOWN]
_NEAR = ", ".join(f"('{t}', '{b}')" for i, b in enumerate(V.SIZE_LABELS) for j, t in enumerate(V.SIZE_LABELS) if abs(i - j) <= 1)
_NEAR += "".join(f", ('{V.UNKNOWN}', '{b}')" for i, b in enumerate(V.SIZE_LABELS) if abs(i - 2) <= 1) + f", ('{V.UNKNOWN}', '{V.UNKNOWN}')"
_ADJ = ", ".join(f"('{k}', '{v}')" for k, vs in V.ADJACENT.items() for v in vs)
_LANES = f"""{_POOL}, ts(target_sector) AS (VALUES {", ".join(f"('{s}')" for s in _SECTORS)}), nb(target_size, size) AS (VALUES {_NEAR}), aj(target_sector, sector) AS (VALUES {_ADJ}),
ln AS (SELECT p.ticker, ts.target_sector, nb.target_size, CASE WHEN p.sector = ts.target_sector THEN 'same' WHEN aj.sector IS NOT NULL THEN 'adjacent' ELSE 'other' END AS stratum
  FROM p JOIN nb USING (size) CROSS JOIN ts LEFT JOIN aj ON aj.target_sector = ts.target_sector AND aj.sector = p.sector)"""
_INT = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
_DRAW = f"""
WITH {_LANES},
la AS (SELECT *, row_number() OVER (PARTITION BY target_sector, target_size, stratum ORDER BY md5(ticker), ticker) - 1 AS pos, count(*) OVER (PARTITION BY target_sector, target_size, stratum) AS n FROM ln),
t AS (SELECT DISTINCT ON (deal_id) deal_id, ticker AS own, sector AS target_sector, size AS target_size, announced_date FROM (SELECT deal_id, loaded_at, target_ticker AS ticker, {sql_sector("target_sic")} AS sector, {sql_bucket("target_mktcap_usd_m")} AS size, announced_date FROM deal_filing WHERE deal_id IS NOT NULL)
  ORDER BY deal_id, loaded_at DESC NULLS LAST, ticker DESC NULLS LAST, sector DESC NULLS LAST, size DESC NULLS LAST, announced_date DESC NULLS LAST),
w(stratum, quota) AS (VALUES ('same', 22), ('adjacent', 18), ('other', 9)),
a AS (SELECT t.deal_id, own, la.ticker, stratum, quota, (pos - {_INT("deal_id || '|' || stratum")} % n + n) % n AS j, n FROM t CROSS JOIN w JOIN la USING (target_sector, target_size, stratum)),
g AS (SELECT deal_id, ticker, stratum, row_number() OVER (PARTITION BY deal_id, stratum ORDER BY j) AS pick, quota FROM a WHERE j < quota + 1 AND (own IS NULL OR ticker <> own)),
got AS (SELECT deal_id, ticker, stratum, pick FROM g WHERE pick <= quota)
"""
_FILLED = f"""{_DRAW},
u AS (SELECT t.deal_id, own, 49 - count(got.ticker) AS deficit, coalesce(list(got.ticker) FILTER (got.ticker IS NOT NULL), []) AS used FROM t LEFT JOIN got USING (deal_id) GROUP BY ALL HAVING count(got.ticker) < 49),
rg AS (SELECT ticker, row_number() OVER (ORDER BY md5(ticker), ticker) - 1 AS pos, count(*) OVER () AS n FROM p),
fj AS (SELECT deal_id, own, deficit, used, ticker, n, (pos - {_INT("deal_id || '|fill'")} % n + n) % n AS j FROM u CROSS JOIN rg),
fl AS (SELECT deal_id, ticker, 'fill' AS stratum, row_number() OVER (PARTITION BY deal_id ORDER BY j) AS pick, deficit FROM fj WHERE j < least(deficit + len(used) + 1, n) AND (own IS NULL OR ticker <> own) AND NOT list_contains(used, ticker)),
qs AS (SELECT * FROM got UNION ALL SELECT deal_id, ticker, stratum, pick FROM fl WHERE pick <= deficit)
"""
ORACLE = {
    "quota_sample": _FILLED + "SELECT * FROM qs",
    "quota_report": _FILLED
    + """SELECT CASE WHEN k = 49 THEN 'ok' ELSE 'dropped_insufficient_candidates' END AS status, count(*) AS n_deals, CAST(sum(a) AS BIGINT) AS same, CAST(sum(b) AS BIGINT) AS adjacent, CAST(sum(c) AS BIGINT) AS other, CAST(sum(f) AS BIGINT) AS fill FROM
(SELECT deal_id, count(*) AS k, count(*) FILTER (stratum = 'same') AS a, count(*) FILTER (stratum = 'adjacent') AS b, count(*) FILTER (stratum = 'other') AS c, count(*) FILTER (stratum = 'fill') AS f FROM qs GROUP BY 1) GROUP BY 1""",
    "built_corpus": _FILLED
    + """, x AS (SELECT deal_id, ticker, false AS is_target FROM qs WHERE deal_id IN (SELECT deal_id FROM t WHERE own IS NOT NULL) UNION ALL SELECT deal_id, own, true FROM t WHERE own IS NOT NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY md5(deal_id || '|s|' || ticker), ticker) AS candidate_no FROM x),
v AS (SELECT y.deal_id, y.candidate_no, y.ticker, y.is_target, o.pool_id AS version_id, length(o.ciq_desc) AS description_chars, row_number() OVER (PARTITION BY y.deal_id, y.candidate_no ORDER BY o.valid_from DESC NULLS LAST, o.published_at DESC NULLS LAST, o.pool_id DESC NULLS LAST) AS r
  FROM y JOIN t USING (deal_id) LEFT JOIN pool o ON o.ticker = y.ticker AND o.published_at < CAST(t.announced_date AS TIMESTAMP) AND o.valid_from <= t.announced_date AND regexp_matches(o.ciq_desc, '[^\\s\\pZ]'))
SELECT deal_id, candidate_no, ticker, is_target, version_id, description_chars FROM v WHERE r = 1""",
    "deal_seeds": "SELECT DISTINCT deal_id, ('0x' || right(md5(deal_id), 8))::BIGINT AS seed FROM deal_filing",
    "size_windows": f"WITH {_LANES} SELECT target_sector, target_size, stratum, count(*) AS n FROM ln GROUP BY ALL",
    "wide_from_long": f"""WITH {_ROWS} SELECT deal_id, md5(l) AS list_md5, length(l) AS n_chars, n, target_position FROM (SELECT deal_id, string_agg(anon_description, chr(10) ORDER BY no) AS l, count(*) AS n,
  nullif(coalesce(list_position(list(coalesce(is_target, false) ORDER BY no), true), 0), 0) AS target_position FROM c GROUP BY 1)""",
    "corpus_invariants": f"""WITH {_ROWS},
w AS (SELECT deal_id, string_split(string_agg(anon_description, chr(10) ORDER BY no), chr(10)) AS li, list(candidate_ticker) AS ct, nullif(coalesce(list_position(list(coalesce(is_target, false) ORDER BY no), true), 0), 0) AS tp, max(target_ticker) AS tt FROM c GROUP BY 1),
v AS (SELECT *, list_transform(list_filter(li, lambda x: regexp_matches(x, '^Candidate\\s*#\\d+')), lambda x: regexp_extract(x, '^Candidate\\s*#(\\d+)', 1)::INT) AS ids, list_transform(list_filter(ct, lambda x: x IS NOT NULL AND x <> ''), lambda x: upper(x)) AS tk FROM w)
SELECT deal_id, 'line_count' AS problem FROM v WHERE len(ids) <> 50 UNION ALL SELECT deal_id, 'numbers' FROM v WHERE list_sort(ids) <> range(1, 51) UNION ALL SELECT deal_id, 'position' FROM v WHERE NOT coalesce(tp BETWEEN 1 AND 50, false)
UNION ALL SELECT deal_id, 'duplicate_tickers' FROM v WHERE len(tk) <> len(list_distinct(tk)) UNION ALL SELECT deal_id, 'target_not_once' FROM v WHERE tt IS NOT NULL AND len(list_filter(tk, lambda x: x = upper(tt))) <> 1""",
    "bm25_rank": "WITH " + _BM25 + "SELECT deal_id, no, round(score, 4) AS score, rank FROM bm",
    "tfidf_rank": f"""WITH {_ROWS}, {_QUERY},
it AS (SELECT c.deal_id, c.no, {_terms(_lex("anon_description"))} AS k, {_terms(_lex("qt"))} AS q FROM c JOIN dd USING (deal_id) WHERE {_lex("qt")} <> ''),
tk AS (SELECT deal_id, no, {_PAIRED} AS d FROM it), nn AS (SELECT deal_id, count(*) AS n FROM tk GROUP BY 1),
tf AS (SELECT deal_id, no, t, 1 + ln(count(*)) AS w FROM (SELECT deal_id, no, unnest(d) AS t FROM tk) GROUP BY ALL),
df AS (SELECT deal_id, t, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM tf JOIN nn USING (deal_id) GROUP BY deal_id, t),
dw AS (SELECT deal_id, no, t, w * idf AS w FROM tf JOIN df USING (deal_id, t)), dn AS (SELECT deal_id, no, sqrt(sum(w * w)) AS nm FROM dw GROUP BY ALL),
q0 AS (SELECT deal_id, unnest({_PAIRED}) AS t FROM (SELECT deal_id, any_value(q) AS k FROM it GROUP BY 1)),
qw AS (SELECT deal_id, t, (1 + ln(count(*))) * any_value(idf) AS qw FROM q0 JOIN df USING (deal_id, t) GROUP BY deal_id, t), qn AS (SELECT deal_id, sqrt(sum(qw * qw)) AS qm FROM qw GROUP BY 1),
dt AS (SELECT deal_id, no, sum(w * qw) AS dot FROM dw JOIN qw USING (deal_id, t) GROUP BY ALL),
s AS (SELECT deal_id, no, round(coalesce(dot / (nm * qm), 0), 9) AS score FROM tk LEFT JOIN dt USING (deal_id, no) LEFT JOIN dn USING (deal_id, no) LEFT JOIN qn USING (deal_id))
SELECT deal_id, no, round(score, 6) AS score, row_number() OVER (PARTITION BY deal_id ORDER BY score DESC, no) AS rank FROM s""",
    "dense_deal_rank": f"""WITH {_ROWS}, {_MASKED}, {sql_masked("qd", "acquirer_name", "acquirer_ticker")},
q1 AS (SELECT upper(trim(deal_id)) AS deal_id, left({sql_mask("left(item1_text, 500)")}, 400) AS x1, left({sql_mask("left(mda_text, 400)")}, 300) AS x2 FROM mk), q2 AS (SELECT deal_id, concat_ws(' ', x1, x2) AS q FROM q1 WHERE {_lex("concat_ws(' ', x1, x2)")} <> ''),
li AS (SELECT deal_id, no, anon_description AS line FROM c JOIN q2 USING (deal_id)), {_dense_sql("li", "q2", "deal_id")} SELECT deal_id, no, round(score, 6) AS score, rank FROM dr""",
    "baseline_panel": f"""WITH {_ranks_sql()}, mr AS (SELECT method, condition, deal_id, CASE WHEN p > 0 THEN 1.0 / p ELSE 0 END::DOUBLE AS mrr, p, 1 AS c FROM bp)"""
    + draws("mr", "method, condition", "mrr c", "deal_id").replace("u AS (", "dw AS (").replace("FROM u GROUP", "FROM dw GROUP").replace(", u\n", ", dw u\n").replace("\ng AS", "\ngg AS").replace("FROM g,", "FROM gg g,").replace("FROM g)", "FROM gg)")
    + """, ci AS (SELECT method, condition, quantile_cont(mrr / c, [0.025, 0.975]) AS q FROM z GROUP BY ALL),
ma AS (SELECT method, condition, count(*) AS n, round(avg(mrr), 6) AS mrr, round(avg((p = 1)::INT), 6) AS recall_1, round(avg((p BETWEEN 1 AND 5)::INT), 6) AS recall_5, round(avg((p BETWEEN 1 AND 10)::INT), 6) AS recall_10,
  round(avg(CASE WHEN p BETWEEN 1 AND 5 THEN 1 / log2(p + 1) ELSE 0 END), 6) AS ndcg_5, round(avg(CASE WHEN p BETWEEN 1 AND 10 THEN 1 / log2(p + 1) ELSE 0 END), 6) AS ndcg_10 FROM mr GROUP BY ALL)
SELECT ma.*, round(q[1], 6) AS mrr_low, round(q[2], 6) AS mrr_high FROM ma JOIN ci USING (method, condition)
UNION ALL SELECT 'chance', condition, max(n), round((SELECT sum(1.0 / i) FROM range(1, 11) t(i)) / 50, 6)::DOUBLE, 0.02::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, round((SELECT sum(1 / log2(i + 1)) FROM range(1, 6) t(i)) / 50, 6), round((SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i)) / 50, 6), NULL, NULL FROM ma GROUP BY condition""",
    "baseline_delta": BASE
    + ", "
    + _ranks_sql()
    + """, df2 AS (SELECT le.condition, method, model_key, strategy, coalesce(le.acquirer_ticker, le.deal_id) AS cluster, mrr - CASE WHEN bp.p > 0 THEN 1.0 / bp.p ELSE 0 END AS d FROM le JOIN bp ON bp.deal_id = le.deal_id AND bp.condition = le.condition),
un9 AS (SELECT condition, method, model_key, strategy, cluster, sum(d) AS s, count(*)::DOUBLE AS c FROM df2 GROUP BY ALL)"""
    + draws("un9", "condition, method, model_key, strategy", "s c", "cluster").replace("u AS (", "dw AS (").replace("FROM u GROUP", "FROM dw GROUP").replace(", u\n", ", dw u\n").replace("\ng AS", "\ngg AS").replace("FROM g,", "FROM gg g,").replace("FROM g)", "FROM gg)")
    + """, fl AS (SELECT condition, method, model_key, strategy, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_clusters, sum(s) / sum(c) AS mean FROM un9 GROUP BY ALL),
mm AS (SELECT condition, method, model_key, strategy, fl.n, fl.n_clusters, fl.mean, z.s / z.c AS m FROM z JOIN fl USING (condition, method, model_key, strategy))
SELECT condition, method, model_key, strategy, any_value(n) AS n, any_value(n_clusters) AS n_clusters, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high,
round(least(1.0, 2 * least(avg((round(m - mean, 12) >= round(mean, 12))::INT), avg((round(m - mean, 12) <= round(mean, 12))::INT))), 6) AS p_value FROM mm GROUP BY condition, method, model_key, strategy""",
    "dense_rank": """WITH s AS (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s, e.label = q.label AS same_label
  FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query, vec_id, round(s, 6) AS score, rank, same_label FROM r WHERE rank <= 10""",
    "dense_metrics": """WITH s AS (SELECT q.vec_id AS query, q.label, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s, e.label = q.label AS same
  FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM s), f AS (SELECT query, any_value(label) AS label, coalesce(min(rank) FILTER (same AND rank <= 10), 0) AS p FROM r GROUP BY 1)
SELECT label, count(*) AS n, round(avg(CASE WHEN p > 0 THEN 1.0 / p ELSE 0 END), 6) AS mrr, round(avg((p > 0)::INT), 6) AS recall_10, round(avg(CASE WHEN p > 0 THEN 1 / log2(p + 1) ELSE 0 END), 6) AS ndcg_10 FROM f GROUP BY 1""",
}

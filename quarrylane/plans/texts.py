"""Queries over names and texts: normal forms, entities, redaction, leakage, overlap, prompts, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import ranking as R
from ..functions import redaction as D
from ..functions import similarity as S
from ..functions.business import graded
from ..operators.corpus import line_number, without_description
from ..operators.entities import dictionary, fuzzy_match, rule_match
from ..operators.relational import next_in_order, pick_last
from ..operators.asof import as_known_at
from ..operators.retrieval import STOP_WORDS, terms, tokens
from ..sources.tables import table
from . import sql
from .deals import sql_normal
from .evaluation import BASE, RECALL, _recalled, answers, sql_aliases, sql_ticker


def normalize_names(spark: SparkSession, root: str) -> DataFrame:
    """The three normal forms and the display form of every company name."""
    n = table(spark, root, "filings").select(F.col("hf_company").alias("name")).unionByName(table(spark, root, "deal_filing").select(F.col("acquirer_name").alias("name"))).where("name IS NOT NULL").distinct()
    c = F.col("name")
    return n.select("name", N.normalize(c, "merge").alias("merge"), N.normalize(c, "pit").alias("pit"), N.normalize(c, "entity").alias("entity"), N.display_name(c).alias("display"))


def name_aliases(spark: SparkSession, root: str) -> DataFrame:
    """Aliases of every acquirer and whether its entity form is ambiguous."""
    n = table(spark, root, "deal_filing").select(F.col("acquirer_name").alias("name")).where("name IS NOT NULL").distinct()
    return n.select("name", F.array_join(N.aliases(F.col("name")), "|").alias("aliases"), N.is_ambiguous(N.normalize(F.col("name"), "entity")).alias("ambiguous"))


def entity_dict(spark: SparkSession, root: str) -> DataFrame:
    """Entity dictionary of the pool."""
    d = dictionary(table(spark, root, "pool"), name="company_name", ticker="ticker", order="pool_id")
    return d.select("norm", "canonical", "ticker", F.size("aliases").alias("n_aliases"), "ambiguous")


def _named(spark: SparkSession, root: str) -> DataFrame:
    a = answers(spark, root).where("condition = 'A'")
    return a.select("response_id", "model_key", "target_name", "target_ticker", F.posexplode(R.parse_names(F.col("response_text"))).alias("i", "name"))


def entity_match_rules(spark: SparkSession, root: str) -> DataFrame:
    """Recall at 1 and 5 of generated names by model, names resolved by rules."""
    m = _named(spark, root)
    hit = rule_match(F.col("name"), F.col("target_name"), F.col("target_ticker"), N.aliases(F.col("target_name")))
    one = m.groupBy("response_id", "model_key").agg(F.max((hit & (F.col("i") < 1)).cast("int")).alias("r1"), F.max(hit.cast("int")).alias("r5"))
    return one.groupBy("model_key").agg(F.count("*").alias("n"), F.sum("r1").alias("hits_1"), F.sum("r5").alias("hits_5"))


def entity_match_fuzzy(spark: SparkSession, root: str) -> DataFrame:
    """As entity_match_rules, with close spellings; scored on distinct pairs of names."""
    m = _named(spark, root)
    pairs = m.select("name", "target_name", "target_ticker").distinct()
    hit = rule_match(F.col("name"), F.col("target_name"), F.col("target_ticker"), N.aliases(F.col("target_name")))
    pairs = pairs.withColumn("by_rule", hit).withColumn("by_spelling", fuzzy_match(F.col("name"), F.col("target_name"), N.aliases(F.col("target_name"))))
    same = [m[c].eqNullSafe(pairs[c]) for c in ("name", "target_name", "target_ticker")]
    j = m.join(pairs, same[0] & same[1] & same[2]).select("response_id", "model_key", "i", (F.col("by_rule") | F.col("by_spelling")).alias("hit"))
    one = j.groupBy("response_id", "model_key").agg(F.max((F.col("hit") & (F.col("i") < 1)).cast("int")).alias("r1"), F.max(F.col("hit").cast("int")).alias("r5"))
    return one.groupBy("model_key").agg(F.count("*").alias("n"), F.sum("r1").alias("hits_1"), F.sum("r5").alias("hits_5"))


def fuzzy_ratio(spark: SparkSession, root: str) -> DataFrame:
    """Word-order and word-set similarity of each acquirer's name and its attached filer's."""
    d = table(spark, root, "deal_filing").where("hf_match AND hf_company IS NOT NULL AND acquirer_name IS NOT NULL").select("acquirer_name", "hf_company").distinct()
    a, b = N.normalize(F.col("acquirer_name"), "entity"), N.normalize(F.col("hf_company"), "entity")
    return d.select("acquirer_name", "hf_company", F.round(S.token_sort_ratio(a, b), 6).alias("sort_ratio"), F.round(S.token_set_ratio(a, b), 6).alias("set_ratio"))


def redact_descriptions(spark: SparkSession, root: str) -> DataFrame:
    """Every description of the pool, redacted as of the year it describes."""
    p = table(spark, root, "pool").select("pool_id", "company_name", "ticker", "ciq_desc", F.year("valid_from").alias("y")).distinct()
    r = p.withColumn("redacted", D.redact(F.col("ciq_desc"), N.aliases(F.col("company_name")), F.col("ticker"), F.col("y")))
    return r.select("pool_id", "redacted", D.residual(F.col("redacted"), F.col("company_name")).alias("residual"))


def description_sources(spark: SparkSession, root: str) -> DataFrame:
    """Where each candidate's description comes from: the last filing of the same name strictly before the deal was announced, else the pool's text; and how many are blanked."""
    c = corpus_lines(spark, root).where("candidate_name IS NOT NULL")
    d = deals_once(spark, root).select("deal_id", "announced_date")
    asked = c.select("deal_id", "deal_year", "candidate_ticker", "candidate_name", N.normalize(F.col("candidate_name"), "pit").alias("k")).distinct().join(d, "deal_id")
    # names and days repeat: each is looked up once, and only the version's number travels
    f = table(spark, root, "filings").select("filing_id", N.normalize(F.col("hf_company"), "pit").alias("k"), "hf_filing_date").where("k <> ''")
    known = as_known_at(asked, f, entity=("k", "k"), event_time="announced_date", available=[("hf_filing_date", True)], latest_by=["hf_filing_date", "filing_id"], take={"filing_id": "filing_id"})
    texts = table(spark, root, "filings").groupBy("filing_id").agg(F.max("item1_text").alias("item1_text"))
    pool = pick_last(table(spark, root, "pool").where("ticker IS NOT NULL").select(F.col("ticker").alias("candidate_ticker"), "published_at", "pool_id", "ciq_desc"), ["candidate_ticker"], ["published_at", "pool_id"]).select("candidate_ticker", "ciq_desc")
    one = known.groupBy("candidate_name", "candidate_ticker", "filing_id", "deal_year").agg(F.count("*").alias("n_rows"))
    one = one.join(texts, "filing_id", "left").join(pool, "candidate_ticker", "left")
    x = D.described(F.col("item1_text"), F.col("ciq_desc"), N.aliases(F.col("candidate_name")), F.col("candidate_name"), F.col("candidate_ticker"), F.col("deal_year"))
    out = one.select("n_rows", x["source"].alias("source"), x["residual"].alias("residual"), F.length(x["description"]).alias("n"))
    return out.groupBy("source", "residual").agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("n") * F.col("n_rows")).alias("chars"))


def deals_once(spark: SparkSession, root: str) -> DataFrame:
    """deal_filing with one row for each deal, the last delivered; its id trimmed and upper-cased."""
    d = table(spark, root, "deal_filing").withColumn("deal_id", F.upper(F.trim("deal_id"))).where("deal_id IS NOT NULL")
    d = d.select("deal_id", "loaded_at", "announced_date", "deal_year", "acquirer_name", "acquirer_ticker", "item1_text", "mda_text", "acquirer_revenue_ciq_000", "acquirer_ebitda_ciq_000")
    return pick_last(d, ["deal_id"], ["loaded_at", "acquirer_name", "acquirer_ticker", "item1_text", "mda_text"])


def _profiles(d: DataFrame) -> DataFrame:
    revenue = F.col("acquirer_revenue_ciq_000") / 1000
    margin = F.round(F.col("acquirer_ebitda_ciq_000") / F.nullif(F.col("acquirer_revenue_ciq_000"), F.lit(0.0)) * 100, 1)
    text = D.profile(F.col("item1_text"), F.col("mda_text"), F.col("acquirer_name"), F.col("acquirer_ticker"), F.col("deal_year"), revenue, margin)
    return d.withColumn("profile", text)


def mask_acquirers(spark: SparkSession, root: str) -> DataFrame:
    """Profiles of all deals: their masked texts by length and number of masks, and whether a word of the name still stands."""
    d = _profiles(deals_once(spark, root))
    text = F.substring_index("profile", "\nKEY FINANCIALS:", 1)
    return d.select("deal_id", F.md5(text).alias("profile_md5"), F.length(text).alias("n_chars"), F.regexp_count(text, F.lit(r"\[ACQUIRER\]")).cast("long").alias("n_masks"), D.names_in(F.col("profile"), F.col("acquirer_name")).alias("leak"))


def corpus_lines(spark: SparkSession, root: str) -> DataFrame:
    """corpus_per_deal with one row for each deal and candidate number, the last delivered, with all its names."""
    c = table(spark, root, "corpus_per_deal").withColumn("deal_id", F.upper(F.trim("deal_id"))).withColumn("no", F.col("candidate_id").try_cast("int")).where("deal_id IS NOT NULL AND no IS NOT NULL")
    c = c.select("deal_id", "no", "loaded_at", "candidate_ticker", "anon_description", "candidate_name", "target_name", "target_ticker", "deal_year", "is_target")
    return pick_last(c, ["deal_id", "no"], ["loaded_at", "candidate_ticker", "anon_description"])


def leakage_channels(spark: SparkSession, root: str) -> DataFrame:
    """The seven channels of every deal: the acquirer's name in the profile, the target's in its own line after redaction, tickers, language of done
    deals and later years in lines, tickers given twice, and whether the numbers are 1 to 50."""
    c = corpus_lines(spark, root)
    line = F.coalesce("anon_description", F.lit(""))
    # what stands behind the last mark; the whole line if there is none
    text = F.when(F.contains(line, F.lit("| Description:")), F.expr("substring(coalesce(anon_description, ''), instr(coalesce(anon_description, ''), '| Description:') + 14)")).otherwise(line)
    by_ticker = F.coalesce(F.rlike(text, F.concat(F.lit(r"(?U)(?<![\w])\Q"), F.col("candidate_ticker"), F.lit(r"\E(?![\w])"))), F.lit(False))
    target = F.coalesce("is_target", F.lit(False))
    redacted = D.redact(F.when(target, text), N.aliases(F.col("target_name")), F.col("target_ticker"))
    years = F.exists(F.regexp_extract_all(line, F.lit(r"\b(20\d{2})\b"), 1), lambda y: y.cast("int") > F.coalesce("deal_year", F.lit(0)))
    flags = c.select(
        "deal_id", line_number(line).alias("id"), F.upper(F.nullif("candidate_ticker", F.lit(""))).alias("t"), (target & D.residual(redacted, F.col("target_name"))).cast("int").alias("target"),
        by_ticker.cast("int").alias("ticker"), text.rlike(D.LATER).cast("int").alias("later"), F.coalesce(years, F.lit(False)).cast("int").alias("future"),
    )
    every = F.array_sort(F.collect_list("id")) == F.sequence(F.lit(1), F.lit(50))  # a deal has its 50 lines
    one = flags.groupBy("deal_id").agg(
        F.count("*").alias("n_candidate_lines"), (F.max("target") == 1).alias("target_leak"), F.sum("ticker").alias("candidate_id_leaks"), F.sum("later").alias("outcome_leaks"), F.sum("future").alias("future_timestamp_leaks"),
        (F.count("t") - F.count_distinct("t")).alias("duplicate_entities"), F.coalesce(every, F.lit(False)).alias("count_invariant_ok"),
    )
    leak = _profiles(deals_once(spark, root)).select("deal_id", D.names_in(F.col("profile"), F.col("acquirer_name")).alias("acquirer_leak"))
    return one.join(leak, "deal_id", "left").withColumn("acquirer_leak", F.coalesce("acquirer_leak", F.lit(False)))


#: Shares of lines up to which outcome language and candidate identity pass the gate.
MOST_OUTCOME, MOST_IDENTITY = 0.01, 0.05


def leakage_gate(spark: SparkSession, root: str) -> DataFrame:
    """Totals of the seven channels, what share of lines they are, and which breach the gate: any leak of target or acquirer, any duplicate, any wrong count; the others by share; later years are only reported."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    flag = lambda c: F.count_if(c)
    one = leakage_channels(spark, root).agg(
        s("n_candidate_lines").alias("n"), flag(F.col("target_leak")).alias("target"), flag(F.col("acquirer_leak")).alias("acquirer"), s("candidate_id_leaks").alias("ticker"), s("outcome_leaks").alias("outcome"),
        s("future_timestamp_leaks").alias("future"), s("duplicate_entities").alias("duplicates"), flag(~F.col("count_invariant_ok")).alias("count"),
    )
    share = lambda v: F.round(F.coalesce(F.col(v) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), 4)
    hard = lambda name, v: F.struct(F.lit(name).alias("channel"), F.col(v).alias("n_leaks"), share(v).alias("share"), (F.col(v) > 0).alias("breach"))
    soft = lambda name, v, most: F.struct(F.lit(name).alias("channel"), F.col(v).alias("n_leaks"), share(v).alias("share"), (share(v) > most if most is not None else F.lit(False)).alias("breach"))
    return one.select(F.inline(F.array(
        hard("target_identity", "target"), hard("acquirer_identity", "acquirer"), hard("duplicate_entities", "duplicates"), hard("candidate_count", "count"),
        soft("outcome_language", "outcome", MOST_OUTCOME), soft("candidate_identity", "ticker", MOST_IDENTITY), soft("future_years", "future", None),
    )))


def token_f1(spark: SparkSession, root: str) -> DataFrame:
    """Overlap of names: acquirer against attached filer, by deal."""
    d = table(spark, root, "deal_filing").where("hf_match").select("deal_id", "acquirer_name", "hf_company").distinct()
    f = S.f1(S.name_words(F.col("acquirer_name")), S.name_words(F.col("hf_company")))
    return d.select("deal_id", "hf_company", F.round(F.coalesce(f, F.lit(0.0)), 6).alias("f1"), (F.coalesce(f, F.lit(0.0)) > 0.3).alias("suspicious"))


def ticker_jaccard(spark: SparkSession, root: str) -> DataFrame:
    """Tickers that texts of each site mention against the tickers its documents are filed under."""
    d = table(spark, root, "documents").where("site IS NOT NULL").select("site", "ticker", S.tickers(F.col("text")).alias("t"))
    said = d.select("site", F.explode("t").alias("x")).groupBy("site").agg(F.array_sort(F.collect_set("x")).alias("said"))
    filed = d.groupBy("site").agg(F.array_sort(F.collect_set("ticker")).alias("filed"), F.count("*").alias("n_docs"))
    both = filed.join(said, "site", "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    j = S.jaccard(F.col("said"), F.col("filed"))
    return both.select("site", "n_docs", F.size("said").alias("n_said"), F.size("filed").alias("n_filed"), F.round(j, 6).alias("jaccard"), (j > 0.15).alias("suspicious"))


#: Thresholds of the three probes.
MOST_RECALL_F1, MOST_COMPLETION_F1, MOST_JACCARD = 0.30, 0.30, 0.15


def contamination_probes(spark: SparkSession, root: str) -> DataFrame:
    """Three probes of each model over all its answers under condition A: overlap with the masked acquirer's name (an echoed key in front is cut off),
    with the next deal's record (acquirer, year, target; the deals in the order of their ids), and of the tickers given with those of all targets."""
    a = answers(spark, root).where("condition = 'A' AND model_key IS NOT NULL").select("model_key", "deal_id", "acquirer_name", "acquirer_ticker", "deal_year", "target_name", "target_ticker", "response_text")
    deals = pick_last(a.where("deal_id IS NOT NULL").select("deal_id", "acquirer_name", "deal_year", "target_name"), ["deal_id"], ["acquirer_name", "deal_year", "target_name"])
    following = next_in_order(deals, "deal_id", F.concat_ws(" ", F.coalesce("acquirer_name", F.lit("")), F.coalesce(F.col("deal_year").cast("string"), F.lit("")), F.coalesce("target_name", F.lit(""))), "gold")
    text = F.trim(F.regexp_replace(F.coalesce("response_text", F.lit("")), r"^\S+::", ""))
    mute = F.upper(F.trim(F.coalesce("response_text", F.lit("")))).isin("", "UNKNOWN", "ERROR")
    f = lambda gold: F.when(mute, 0.0).otherwise(S.f1(S.name_words(text), S.name_words(gold)))
    scored = a.join(following, "deal_id", "left").select("model_key", F.coalesce(f(F.col("acquirer_name")), F.lit(0.0)).alias("p1"), F.coalesce(f(F.col("gold")), F.lit(0.0)).alias("p2"))
    two = scored.groupBy("model_key").agg(F.count("*").alias("n"), F.round(F.avg("p1"), 4).alias("p1_f1"), F.round(F.avg("p2"), 4).alias("p2_f1"))
    said = a.select("model_key", F.explode(S.tickers(F.coalesce("response_text", F.lit("")))).alias("t")).distinct()
    gold = a.where("target_ticker IS NOT NULL").select(F.upper("target_ticker").alias("t")).distinct().withColumn("g", F.lit(1))
    counts = said.join(gold, "t", "left").groupBy("model_key").agg(F.count("*").alias("p3_pred_n"), F.sum(F.coalesce("g", F.lit(0))).alias("p3_overlap_n"))
    both = two.join(counts, "model_key", "left").crossJoin(F.broadcast(gold.agg(F.count("*").alias("n_gold"))))  # one row
    union = F.coalesce("p3_pred_n", F.lit(0)) + F.col("n_gold") - F.coalesce("p3_overlap_n", F.lit(0))
    both = both.withColumn("p3_jaccard", F.round(F.when(union == 0, 1.0).otherwise(F.coalesce("p3_overlap_n", F.lit(0)) / union), 4))
    raised = (F.col("p1_f1") > MOST_RECALL_F1).cast("int") + (F.col("p2_f1") > MOST_COMPLETION_F1).cast("int") + (F.col("p3_jaccard") > MOST_JACCARD).cast("int")
    return both.select(
        "model_key", "n", "p1_f1", "p2_f1", F.coalesce("p3_pred_n", F.lit(0)).alias("p3_pred_n"), F.coalesce("p3_overlap_n", F.lit(0)).alias("p3_overlap_n"), "p3_jaccard",
        raised.alias("n_suspicious_probes"), (raised >= 2).alias("dataset_memorized_flag"), graded(raised, [(1, "HIGH"), (0, "MEDIUM")], "LOW").alias("dataset_risk"),
    )


def contamination_risk(spark: SparkSession, root: str) -> DataFrame:
    """The probes' flags beside the share of deals that each model recalled, and the quadrant of both."""
    recall = _recalled(spark, root).groupBy("model_key").agg(F.round(F.avg((F.col("label") == "SUCCESS").cast("double")), 4).alias("recall_rate"))
    p = contamination_probes(spark, root).select("model_key", "n_suspicious_probes", "dataset_memorized_flag", "dataset_risk").join(recall, "model_key", "left")
    known, flag = F.coalesce(F.col("recall_rate") > 0.1, F.lit(False)), F.col("dataset_memorized_flag")
    quadrant = F.when(known & flag, "HIGH_BOTH").when(known, "HIGH_K / LOW_D").when(flag, "LOW_K / HIGH_D").otherwise("LOW_BOTH")
    return p.select("*", quadrant.alias("quadrant"))


def lexical_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Tokens and terms of each document source."""
    d = table(spark, root, "documents").select(F.lower(F.trim("source")).alias("source"), F.size(tokens(F.col("text"))).alias("n"), F.size(F.array_distinct(tokens(F.col("text")))).alias("u"))
    return d.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.sum("u").alias("n_distinct"))


def lexical_terms(spark: SparkSession, root: str) -> DataFrame:
    """Documents of every term."""
    d = table(spark, root, "documents").select("doc_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("df"))


def named_lines(spark: SparkSession, root: str) -> DataFrame:
    """Candidate lists with real names: each line's number, name and ticker before what followed its number, in order of the numbers; digest by deal."""
    c = corpus_lines(spark, root)
    rest = F.regexp_replace(F.coalesce("anon_description", F.lit("")), r"(?s)^Candidate #\d+\s*\|\s*", "")
    line = F.concat(F.lit("Candidate #"), F.lpad(F.col("no").cast("string"), 2, "0"), F.lit(": "), F.coalesce("candidate_name", F.lit("")), F.lit(" ("), F.coalesce("candidate_ticker", F.lit("")), F.lit(") | "), rest)
    one = c.groupBy("deal_id").agg(F.array_sort(F.collect_list(F.struct("no", line.alias("l")))).alias("x"))  # a deal's 50 lines
    text = F.array_join(F.transform("x", lambda v: v["l"]), "\n")
    return one.select("deal_id", F.size("x").alias("n_lines"), F.md5(text).alias("list_md5"))


def prompt_parts(spark: SparkSession, root: str) -> DataFrame:
    """Prompts taken apart and put together again: profile and candidate lines, with and without descriptions."""
    p = table(spark, root, "prompts_raw").distinct()
    text = F.replace("prompt_user", F.lit("\r\n"), F.lit("\n"))
    lines = F.filter(F.split(text, "\n"), lambda x: line_number(x).isNotNull())
    profile = F.trim(F.split_part(F.split_part(text, F.lit("\n---\n"), F.lit(2)), F.lit("\nCANDIDATE LIST:"), F.lit(1)))
    bare = F.array_join(F.transform(lines, without_description), "\n")
    again = F.replace(F.replace(F.lit("{profile}\n---\nCANDIDATE LIST:\n{list}"), F.lit("{profile}"), profile), F.lit("{list}"), F.array_join(lines, "\n"))
    fill = F.length(again) - F.length(profile) - F.length(F.array_join(lines, "\n"))
    return p.groupBy("condition", "strategy").agg(
        F.count("*").alias("n"), F.sum(F.size(lines)).alias("n_lines"), F.sum(F.length(profile)).alias("profile_chars"), F.sum(F.length(bare)).alias("bare_chars"), F.max(fill).alias("frame_chars")
    )


def fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """Sixteen hex digits over the parts of a prompt, each ended by a zero byte, beside the stored hash."""
    p = table(spark, root, "prompts_raw").distinct()
    parts: list[Column] = [F.lit("structured-v1"), F.coalesce("prompt_system", F.lit("")), F.coalesce("prompt_user", F.lit(""))]
    body = F.concat(*[F.concat(F.encode(c, "utf-8"), F.unhex(F.lit("00"))) for c in parts])
    return p.select("user_prompt_hash", F.left(F.sha2(body, 256), F.lit(16)).alias("fingerprint"))


NAMES = """normalize_names name_aliases entity_dict entity_match_rules entity_match_fuzzy fuzzy_ratio redact_descriptions description_sources mask_acquirers leakage_channels leakage_gate
token_f1 ticker_jaccard contamination_probes contamination_risk named_lines lexical_tokens lexical_terms prompt_parts fingerprint""".split()
QUERIES = {n: globals()[n] for n in NAMES}

_STOP = "[" + ", ".join(f"'{w}'" for w in N.STOP_WORDS) + "]"
_CORE = lambda x, n=1: f"list_filter(string_split({x}, ' '), lambda w: NOT list_contains({_STOP}, w) AND length(w) >= {n})"
_DISTINCT = lambda x: f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"
_WORDS = lambda c: f"list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower({c}), '[^\\pL\\pN_\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) > 1 AND NOT list_contains([{', '.join(repr(w) for w in S.NAME_STOP)}], w)))"
_F1 = lambda a, b: f"CASE WHEN len(list_intersect({a}, {b})) > 0 THEN 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0 END"
_LATER = D.LATER.replace("(?iu)", "(?i)")
_TICKERS = (
    "list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(upper(text), '[^A-Z0-9,\\s.]', '', 'g'), '[,\\s]+'), lambda w: rtrim(w, '.')), lambda w: regexp_full_match(w, '[A-Z]{2,5}') AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in S.TICKER_STOP)
    + "], w)))"
)
_ENTITIES = "text"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '{_a}', '{_b}')"
_LEX = f"lower(trim(regexp_replace(regexp_replace({_ENTITIES}, '[^a-zA-Z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')))"
def sql_redact(source: str, text: str, name: str, ticker: str, year: str | None) -> str:
    """CTE bodies rd0 to rd: ``source`` with ``redacted``."""
    late = f" AND len(list_filter(regexp_extract_all(x, '\\b(20\\d\\d)\\b', 1), lambda v: v::INT > {year})) = 0" if year else ""
    return f"""rd0 AS (SELECT *, trim(array_to_string(list_filter(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: NOT regexp_matches(x, '{_LATER}'){late}), ' ')) AS rt0 FROM {source}),
rd1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(rt0, '{D.URL}', '[COMPANY]', 'g'), '{D.LISTED}', '[COMPANY]', 'g'), '{D.EXCHANGE}', '[COMPANY]', 'g') AS rt1, {sql_aliases(name)} AS ral FROM rd0),
rd2 AS (SELECT *, list_reduce([rt1] || list_transform(list_sort(list_transform(coalesce(ral, []), lambda a: {{'n': -length(a), 'a': a}})), lambda z: z.a), lambda x, a: regexp_replace(x, '(?i)' || regexp_escape(a), '[COMPANY]', 'g')) AS rt2 FROM rd1),
rd3 AS (SELECT *, CASE WHEN length({ticker}) >= 2 THEN regexp_replace(rt2, '(?i)\\b' || regexp_escape({ticker}) || '\\b', '[COMPANY]', 'g') ELSE rt2 END AS rt3 FROM rd2),
rd4 AS (SELECT *, regexp_replace(regexp_replace(rt3, '(?i)\\b{N.OTHER_NAME}\\b.*$', '[COMPANY]', 'g'), '{D.LOOSE_FORM}', '[COMPANY]', 'g') AS rt4 FROM rd3),
rd AS (SELECT * EXCLUDE (rt0, rt1, rt2, rt3, rt4, ral), coalesce(trim(regexp_replace(regexp_replace(regexp_replace(rt4, '(?:\\[COMPANY\\]\\s*)+', '[COMPANY] ', 'g'), '\\s+([,.;])', '\\1', 'g'), '\\s+', ' ', 'g')), '') AS redacted FROM rd4)"""


def sql_residual(text: str, name: str) -> str:
    return f"coalesce(list_has_any(string_split_regex(lower({text}), '[^\\pL\\pN_]+'), {_CORE(sql_normal(name, 'entity'), 4)}), false)"


_REDACT = f"""
WITH p AS (SELECT DISTINCT pool_id, company_name, ticker, ciq_desc, year(valid_from) AS y FROM pool), {sql_redact("p", "ciq_desc", "company_name", "ticker", "y")}
SELECT pool_id, redacted, {sql_residual("redacted", "company_name")} AS residual FROM rd"""
_LINES = """cl AS (SELECT DISTINCT ON (deal_id, no) * FROM (SELECT upper(trim(deal_id)) AS deal_id, TRY_CAST(candidate_id AS INTEGER) AS no, loaded_at, candidate_ticker, anon_description, candidate_name, target_name, target_ticker, deal_year, is_target FROM corpus_per_deal)
  WHERE deal_id IS NOT NULL AND no IS NOT NULL ORDER BY deal_id, no, loaded_at DESC NULLS LAST, candidate_ticker DESC NULLS LAST, anon_description DESC NULLS LAST, candidate_name DESC NULLS LAST, target_name DESC NULLS LAST, target_ticker DESC NULLS LAST, deal_year DESC NULLS LAST, is_target DESC NULLS LAST)"""
_DEALS = """dl AS (SELECT DISTINCT ON (deal_id) * FROM (SELECT upper(trim(deal_id)) AS deal_id, loaded_at, announced_date, deal_year, acquirer_name, acquirer_ticker, item1_text, mda_text, acquirer_revenue_ciq_000, acquirer_ebitda_ciq_000 FROM deal_filing)
  WHERE deal_id IS NOT NULL ORDER BY deal_id, loaded_at DESC NULLS LAST, acquirer_name DESC NULLS LAST, acquirer_ticker DESC NULLS LAST, item1_text DESC NULLS LAST, mda_text DESC NULLS LAST, announced_date DESC NULLS LAST, deal_year DESC NULLS LAST, acquirer_revenue_ciq_000 DESC NULLS LAST, acquirer_ebitda_ciq_000 DESC NULLS LAST)"""
_COMMON = "[" + ", ".join(f"'{w}'" for w in D.COMMON) + "]"


def sql_masked(source: str, name: str, ticker: str) -> str:
    """CTE bodies mk0 to mk: ``source`` with what is to be masked, for ``sql_mask``."""
    venues = ", ".join(f"CASE WHEN length(mk_tick) >= 2 AND instr(mk_tick, ':') = 0 THEN '{v}:' || mk_tick ELSE '' END" for v in ("NYSE", "NASDAQ", "NASDAQGS"))
    return f"""mk0 AS (SELECT *, trim(coalesce({name}, '')) AS mk_raw, trim(coalesce({ticker}, '')) AS mk_tick FROM {source}),
mk1 AS (SELECT *, instr(mk_raw, '(') > 1 AS mk_paren, CASE WHEN instr(mk_raw, '(') > 1 THEN trim(split_part(mk_raw, '(', 1)) ELSE mk_raw END AS mk_base, regexp_extract(mk_raw, '\\(([A-Z]+:[A-Z.]+)\\)', 1) AS mk_listed FROM mk0),
mk2 AS (SELECT *, trim(regexp_replace(trim(regexp_replace(mk_base, '{D.NAME_END}', '', 'g')), ',+$', '')) AS mk_bare FROM mk1),
mk3 AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(list_filter([mk_raw, CASE WHEN mk_paren THEN mk_base ELSE '' END, CASE WHEN mk_paren THEN mk_bare ELSE '' END, '(' || mk_listed || ')', mk_listed, mk_tick, {venues}], lambda v: length(v) >= 4)),
  lambda v: {{'n': -length(v), 'a': v}})), lambda z: z.a) AS mk_forms, list_filter(list_transform(string_split_regex(mk_bare, '\\s+'), lambda w: regexp_replace(w, '[''’]s?$', '')), lambda w: length(w) >= 5 AND NOT list_contains({_COMMON}, lower(w))) AS mk_words0 FROM mk2),
mk AS (SELECT *, CASE WHEN len(mk_words0) >= 2 OR length(mk_words0[1]) >= 6 THEN mk_words0 ELSE [] END AS mk_words FROM mk3)"""


def sql_mask(text: str) -> str:
    """The text with its acquirer masked, over the rows of ``sql_masked``."""
    plain = f"translate(replace(replace(replace({text}, chr(160), ' '), chr(8203), ''), chr(65279), ''), '‘’“”', chr(39) || chr(39) || chr(34) || chr(34))"
    sub = lambda start, items, word: f"list_reduce([{start}] || {items}, lambda s, v: regexp_replace(s, {word}, '[ACQUIRER]', 'gi'))"
    edge = "'\\b' || regexp_escape(v) || '\\b'"
    a = sub(plain, "list_filter(mk_forms, lambda v: contains(v, ' '))", "regexp_escape(v)")
    b = sub(a, "list_filter(mk_forms, lambda v: NOT contains(v, ' '))", edge)
    c = sub(b, "mk_words", edge)
    return f"trim(regexp_replace(regexp_replace({c}, '(?:\\[ACQUIRER\\]\\s*)+', '[ACQUIRER] ', 'g'), ' {{2,}}', ' ', 'g'))"


_PROFILES = f"""{_DEALS}, {sql_masked("dl", "acquirer_name", "acquirer_ticker")},
pf AS (SELECT *, left({sql_mask("left(coalesce(item1_text, ''), 500)")}, 400) AS x1, left({sql_mask("left(coalesce(mda_text, ''), 400)")}, 300) AS x2 FROM mk),
pr AS (SELECT *, 'ACQUIRER PROFILE -- Company A, FY' || coalesce((deal_year - 1)::VARCHAR, 'N/A') || chr(10) || 'CORE BUSINESS: ' || x1 || chr(10) || 'STATED STRATEGY: ' || x2 AS tx FROM pf),
pl AS (SELECT *, coalesce(len(list_filter({_CORE(sql_normal("trim(split_part(coalesce(acquirer_name, ''), '(', 1))", "entity"), 5)}, lambda w: contains(' ' || lower(tx || chr(10) || 'KEY FINANCIALS:') || ' ', ' ' || w || ' '))) > 0, false) AS leak FROM pr)"""
_CHANNELS = f"""WITH {_LINES}, {_PROFILES},
c0 AS (SELECT *, coalesce(anon_description, '') AS ln, CASE WHEN contains(coalesce(anon_description, ''), '| Description:') THEN substr(anon_description, instr(anon_description, '| Description:') + 14) ELSE coalesce(anon_description, '') END AS t FROM cl),
tg AS (SELECT * FROM c0 WHERE is_target), {sql_redact("tg", "t", "target_name", "target_ticker", None)},
tl AS (SELECT DISTINCT deal_id FROM rd WHERE {sql_residual("redacted", "target_name")}),
f AS (SELECT deal_id, regexp_extract(ln, '^Candidate\\s*#(\\d+)', 1) AS id, upper(nullif(candidate_ticker, '')) AS tk, coalesce(regexp_matches(t, '\\b' || regexp_escape(candidate_ticker) || '\\b'), false) AS ticker, regexp_matches(t, '{_LATER}') AS later,
  len(list_filter(regexp_extract_all(ln, '\\b(20\\d\\d)\\b', 1), lambda v: v::INT > coalesce(deal_year, 0))) > 0 AS future FROM c0),
g AS (SELECT deal_id, count(*) AS n_candidate_lines, count(*) FILTER (ticker) AS candidate_id_leaks, count(*) FILTER (later) AS outcome_leaks, count(*) FILTER (future) AS future_timestamp_leaks, count(tk) - count(DISTINCT tk) AS duplicate_entities,
  list_sort(list(TRY_CAST(id AS BIGINT)) FILTER (id <> '')) = range(1, 51) AS ok FROM f GROUP BY 1),
ch AS (SELECT g.deal_id, n_candidate_lines, tl.deal_id IS NOT NULL AS target_leak, candidate_id_leaks, outcome_leaks, future_timestamp_leaks, duplicate_entities, coalesce(ok, false) AS count_invariant_ok, coalesce(pl.leak, false) AS acquirer_leak
  FROM g LEFT JOIN tl USING (deal_id) LEFT JOIN pl USING (deal_id))
"""
_PROBES = RECALL + f""", a0 AS (SELECT * FROM r WHERE condition = 'A' AND model_key IS NOT NULL),
dn AS (SELECT DISTINCT ON (deal_id) deal_id, coalesce(acquirer_name, '') || ' ' || coalesce(deal_year::VARCHAR, '') || ' ' || coalesce(target_name, '') AS v FROM a0 WHERE deal_id IS NOT NULL ORDER BY deal_id, acquirer_name DESC NULLS LAST, deal_year DESC NULLS LAST, target_name DESC NULLS LAST),
nx AS (SELECT deal_id, lead(v) OVER (ORDER BY deal_id) AS gold FROM dn),
a1 AS (SELECT a0.*, gold, trim(regexp_replace(coalesce(response_text, ''), '^\\S+::', '')) AS tx, upper(trim(coalesce(response_text, ''))) IN ('', 'UNKNOWN', 'ERROR') AS mute FROM a0 LEFT JOIN nx USING (deal_id)),
a2 AS (SELECT model_key, mute, {_WORDS("tx")} AS w, {_WORDS("acquirer_name")} AS g1, {_WORDS("gold")} AS g2 FROM a1),
p12 AS (SELECT model_key, count(*) AS n, round(avg(CASE WHEN mute THEN 0 ELSE coalesce({_F1("w", "g1")}, 0) END), 4) AS p1_f1, round(avg(CASE WHEN mute THEN 0 ELSE coalesce({_F1("w", "g2")}, 0) END), 4) AS p2_f1 FROM a2 GROUP BY 1),
sd AS (SELECT DISTINCT model_key, unnest({_TICKERS.replace("upper(text)", "upper(coalesce(response_text, ''))")}) AS t FROM a0), gd AS (SELECT DISTINCT upper(target_ticker) AS t FROM a0 WHERE target_ticker IS NOT NULL),
p3 AS (SELECT model_key, count(*) AS p3_pred_n, count(gd.t) AS p3_overlap_n FROM sd LEFT JOIN gd ON sd.t = gd.t GROUP BY 1),
pj AS (SELECT model_key, n, p1_f1, p2_f1, coalesce(p3_pred_n, 0) AS p3_pred_n, coalesce(p3_overlap_n, 0) AS p3_overlap_n, coalesce(p3_pred_n, 0) + (SELECT count(*) FROM gd) - coalesce(p3_overlap_n, 0) AS un FROM p12 LEFT JOIN p3 USING (model_key)),
pk AS (SELECT * EXCLUDE (un), round(CASE WHEN un = 0 THEN 1.0 ELSE p3_overlap_n / un::DOUBLE END, 4) AS p3_jaccard FROM pj),
pm AS (SELECT *, (p1_f1 > 0.3)::INT + (p2_f1 > 0.3)::INT + (p3_jaccard > 0.15)::INT AS n_suspicious_probes FROM pk),
pb AS (SELECT *, n_suspicious_probes >= 2 AS dataset_memorized_flag, CASE WHEN n_suspicious_probes >= 2 THEN 'HIGH' WHEN n_suspicious_probes = 1 THEN 'MEDIUM' ELSE 'LOW' END AS dataset_risk FROM pm)
"""
_P = sql_normal("name", "entity")
_T = sql_normal("target_name", "entity")
ORACLE = {
    "normalize_names": f"""WITH n AS (SELECT hf_company AS name FROM filings UNION SELECT acquirer_name FROM deal_filing)
SELECT name, {sql_normal("name", "merge")} AS merge, {sql_normal("name", "pit")} AS pit, {_P} AS entity, CASE WHEN instr(name, '(') > 1 THEN trim(split_part(name, '(', 1)) ELSE name END AS display FROM n WHERE name IS NOT NULL""",
    "name_aliases": f"""SELECT name, array_to_string({sql_aliases("name")}, '|') AS aliases, len({_CORE(_P)}) = 0 OR length({_P}) < 4 AS ambiguous FROM (SELECT DISTINCT acquirer_name AS name FROM deal_filing WHERE acquirer_name IS NOT NULL)""",
    "entity_dict": f"""WITH a AS (SELECT company_name AS n, nullif(upper(trim(ticker)), '') AS t, pool_id AS o, {sql_normal("company_name", "entity")} AS norm, {sql_aliases("company_name")} AS al FROM pool)
SELECT norm, first(n ORDER BY o, n) AS canonical, last(t ORDER BY o, t) FILTER (t IS NOT NULL) AS ticker, len(list_distinct(flatten(list(al)))) AS n_aliases, len({_CORE("norm")}) = 0 OR length(norm) < 4 AS ambiguous FROM a WHERE norm <> '' GROUP BY norm""",
    "entity_match_rules": BASE
    + f""", q AS (SELECT response_id, model_key, target_name, target_ticker, unnest(names) AS name, unnest(range(0, len(names))) AS i FROM (SELECT nm.*, r.target_ticker FROM nm JOIN r USING (response_id))),
h AS (SELECT *, {_P} AS p, {_T} AS t, {_CORE(_T)} AS core, list_transform({sql_aliases("target_name")}, lambda a: {sql_normal("a", "entity")}) AS al FROM q),
m AS (SELECT *, coalesce(p <> '' AND t <> '' AND (p = t OR list_contains(al, p) OR (len(core) >= 2 AND contains(p, array_to_string({_DISTINCT("core")}, ' ')))
  OR {sql_ticker("name", "target_ticker")}), false) AS hit FROM h)
SELECT model_key, count(*) AS n, CAST(sum(r1) AS BIGINT) AS hits_1, CAST(sum(r5) AS BIGINT) AS hits_5 FROM (SELECT response_id, model_key, max((hit AND i < 1)::INT) AS r1, max(hit::INT) AS r5 FROM m GROUP BY ALL) GROUP BY 1""",
    "redact_descriptions": _REDACT,
    "leakage_channels": _CHANNELS + "SELECT * FROM ch",
    "leakage_gate": _CHANNELS
    + f""", o AS (SELECT sum(n_candidate_lines) AS n, count(*) FILTER (target_leak) AS a, count(*) FILTER (acquirer_leak) AS b, sum(duplicate_entities) AS c, count(*) FILTER (NOT count_invariant_ok) AS d, sum(outcome_leaks) AS e, sum(candidate_id_leaks) AS f, sum(future_timestamp_leaks) AS g FROM ch),
u AS (SELECT 'target_identity' AS channel, a AS v, n, 0.0 AS most FROM o UNION ALL SELECT 'acquirer_identity', b, n, 0.0 FROM o UNION ALL SELECT 'duplicate_entities', c, n, 0.0 FROM o UNION ALL SELECT 'candidate_count', d, n, 0.0 FROM o
  UNION ALL SELECT 'outcome_language', e, n, {MOST_OUTCOME} FROM o UNION ALL SELECT 'candidate_identity', f, n, {MOST_IDENTITY} FROM o UNION ALL SELECT 'future_years', g, n, NULL FROM o)
SELECT channel, CAST(v AS BIGINT) AS n_leaks, round(v / n, 4) AS share, CASE WHEN most IS NULL THEN false WHEN most = 0 THEN v > 0 ELSE round(v / n, 4) > most END AS breach FROM u""",
    "mask_acquirers": f"WITH {_PROFILES} SELECT deal_id, md5(tx) AS profile_md5, length(tx) AS n_chars, len(regexp_extract_all(tx, '\\[ACQUIRER\\]')) AS n_masks, leak FROM pl",
    "named_lines": f"""WITH {_LINES}, l AS (SELECT deal_id, no, 'Candidate #' || lpad(no::VARCHAR, 2, '0') || ': ' || coalesce(candidate_name, '') || ' (' || coalesce(candidate_ticker, '') || ') | ' || regexp_replace(coalesce(anon_description, ''), '^Candidate #\\d+\\s*\\|\\s*', '') AS l FROM cl)
SELECT deal_id, count(*)::INT AS n_lines, md5(string_agg(l, chr(10) ORDER BY no)) AS list_md5 FROM l GROUP BY 1""",
    "description_sources": f"""WITH {_LINES}, {_DEALS},
ak AS (SELECT DISTINCT cl.deal_id, cl.deal_year, candidate_ticker, candidate_name, {sql_normal("candidate_name", "pit")} AS k, dl.announced_date FROM cl JOIN dl USING (deal_id) WHERE candidate_name IS NOT NULL),
fl AS (SELECT filing_id, {sql_normal("hf_company", "pit")} AS k, hf_filing_date AS t FROM filings),
kn AS (SELECT * FROM (SELECT ak.*, fl.filing_id, row_number() OVER (PARTITION BY ak.deal_id, ak.deal_year, ak.candidate_ticker, ak.candidate_name, ak.announced_date ORDER BY fl.t DESC NULLS LAST, fl.filing_id DESC NULLS LAST) AS r
  FROM ak LEFT JOIN fl ON fl.k = ak.k AND fl.k <> '' AND fl.t < CAST(ak.announced_date AS TIMESTAMP)) WHERE r = 1),
ft AS (SELECT filing_id, max(item1_text) AS item1_text FROM filings GROUP BY 1), po AS (SELECT DISTINCT ON (ticker) ticker, ciq_desc FROM pool WHERE ticker IS NOT NULL ORDER BY ticker, published_at DESC NULLS LAST, pool_id DESC NULLS LAST, ciq_desc DESC NULLS LAST),
gr AS (SELECT candidate_name, candidate_ticker, filing_id, deal_year, count(*) AS n_rows FROM kn GROUP BY ALL),
rw AS (SELECT gr.*, coalesce(length(item1_text) > 60, false) AS pit, CASE WHEN length(item1_text) > 60 THEN item1_text ELSE coalesce(ciq_desc, '') END AS raw FROM gr LEFT JOIN ft USING (filing_id) LEFT JOIN po ON po.ticker = gr.candidate_ticker),
{sql_redact("rw", "raw", "candidate_name", "candidate_ticker", "deal_year")},
sh AS (SELECT *, trim(left(redacted, 250)) AS short FROM rd), re AS (SELECT *, length(short) < 40 AS gone, length(short) >= 40 AND {sql_residual("redacted", "candidate_name")} AS residual FROM sh)
SELECT CASE WHEN pit THEN 'pit' ELSE 'fallback' END || CASE WHEN gone THEN '_empty' ELSE '' END AS source, residual, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_rows * CASE WHEN gone OR residual THEN {len(D.NO_DESCRIPTION)} ELSE length(short) END) AS BIGINT) AS chars FROM re GROUP BY ALL""",
    "entity_match_fuzzy": BASE
    + f""", q AS (SELECT response_id, model_key, target_name, target_ticker, unnest(names) AS name, unnest(range(0, len(names))) AS i FROM nm),
h AS (SELECT *, {_P} AS p, {_T} AS t, {_CORE(_T)} AS core, list_transform({sql_aliases("target_name")}, lambda a: {sql_normal("a", "entity")}) AS al FROM q),
m AS (SELECT *, coalesce(p <> '' AND t <> '' AND (p = t OR list_contains(al, p) OR (len(core) >= 2 AND contains(p, array_to_string({_DISTINCT("core")}, ' '))) OR {sql_ticker("name", "target_ticker")}), false) AS hit FROM h),
pz AS (SELECT DISTINCT p, unnest([t] || al) AS z FROM m WHERE NOT hit),
pv AS (SELECT p, z, array_to_string(list_sort({sql.words("p")}), ' ') AS u, array_to_string(list_sort({sql.words("z")}), ' ') AS v FROM pz WHERE p <> '' AND z <> '' AND 200 * least(length(p), length(z)) >= 90 * (length(p) + length(z))
  AND len(list_filter(list_intersect(string_split(p, ' '), string_split(z, ' ')), lambda w: length(w) >= 4 AND NOT list_contains({_STOP}, w))) > 0),
pn AS (SELECT DISTINCT p, z FROM pv WHERE {sql.indel("u", "v")} >= 90),
mu AS (SELECT response_id, i, p, unnest([t] || al) AS z FROM m), mz AS (SELECT DISTINCT response_id, i FROM mu JOIN pn ON pn.p = mu.p AND pn.z = mu.z),
mf AS (SELECT m.*, hit OR mz.i IS NOT NULL AS any_hit FROM m LEFT JOIN mz ON mz.response_id = m.response_id AND mz.i = m.i)
SELECT model_key, count(*) AS n, CAST(sum(r1) AS BIGINT) AS hits_1, CAST(sum(r5) AS BIGINT) AS hits_5 FROM (SELECT response_id, model_key, max((any_hit AND i < 1)::INT) AS r1, max(any_hit::INT) AS r5 FROM mf GROUP BY ALL) GROUP BY 1""",
    "fuzzy_ratio": f"""WITH d AS (SELECT DISTINCT acquirer_name, hf_company FROM deal_filing WHERE hf_match AND hf_company IS NOT NULL AND acquirer_name IS NOT NULL), e AS (SELECT *, {sql_normal("acquirer_name", "entity")} AS a, {sql_normal("hf_company", "entity")} AS b FROM d),
{sql.sort_ratio("e", "a", "b")}, {sql.set_ratio("sr", "a", "b")} SELECT acquirer_name, hf_company, round(sort_ratio, 6) AS sort_ratio, round(set_ratio, 6) AS set_ratio FROM st""",
    "token_f1": f"""SELECT deal_id, hf_company, round(coalesce(f, 0), 6) AS f1, coalesce(f, 0) > 0.3 AS suspicious FROM (SELECT deal_id, hf_company, {_F1(_WORDS("acquirer_name"), _WORDS("hf_company"))} AS f FROM (SELECT DISTINCT deal_id, acquirer_name, hf_company FROM deal_filing WHERE hf_match))""",
    "ticker_jaccard": f"""WITH d AS (SELECT site, ticker, {_TICKERS} AS t FROM documents WHERE site IS NOT NULL), s AS (SELECT site, list(DISTINCT x) AS said FROM (SELECT site, unnest(t) AS x FROM d) GROUP BY 1),
f AS (SELECT site, coalesce(list(DISTINCT ticker) FILTER (ticker IS NOT NULL), []) AS filed, count(*) AS n_docs FROM d GROUP BY 1),
j AS (SELECT site, n_docs, coalesce(said, []::VARCHAR[]) AS a, filed AS b FROM f LEFT JOIN s USING (site)),
k AS (SELECT *, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE END AS v FROM j)
SELECT site, n_docs, len(a) AS n_said, len(b) AS n_filed, round(v, 6) AS jaccard, v > 0.15 AS suspicious FROM k""",
    "lexical_tokens": f"""WITH d AS (SELECT lower(trim(source)) AS source, CASE WHEN length({_LEX}) > 0 THEN string_split({_LEX}, ' ') ELSE [] END AS t FROM documents)
SELECT source, count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_tokens, CAST(sum(len(list_distinct(t))) AS BIGINT) AS n_distinct FROM d GROUP BY 1""",
    "lexical_terms": f"""WITH d AS (SELECT {_LEX} AS l FROM documents), k AS (SELECT list_filter(regexp_extract_all(l, '\\b(\\w\\w+)\\b', 1), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], w)) AS k FROM d),
t AS (SELECT unnest(list_distinct(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])))) AS term FROM k)
SELECT term, count(*) AS df FROM t GROUP BY 1""",
    "contamination_probes": _PROBES + "SELECT * FROM pb",
    "contamination_risk": _PROBES
    + """, rc AS (SELECT model_key, round(avg((label = 'SUCCESS')::INT), 4) AS recall_rate FROM lab GROUP BY 1)
SELECT model_key, n_suspicious_probes, dataset_memorized_flag, dataset_risk, recall_rate, CASE WHEN recall_rate > 0.1 AND dataset_memorized_flag THEN 'HIGH_BOTH' WHEN recall_rate > 0.1 THEN 'HIGH_K / LOW_D' WHEN dataset_memorized_flag THEN 'LOW_K / HIGH_D' ELSE 'LOW_BOTH' END AS quadrant
FROM pb LEFT JOIN rc USING (model_key)""",
    "fingerprint": "SELECT user_prompt_hash, left(sha256('structured-v1' || chr(0) || coalesce(prompt_system, '') || chr(0) || coalesce(prompt_user, '') || chr(0)), 16) AS fingerprint FROM (SELECT DISTINCT * FROM prompts_raw)",
    "prompt_parts": r"""WITH p AS (SELECT DISTINCT * FROM prompts_raw), q AS (SELECT *, replace(prompt_user, chr(13) || chr(10), chr(10)) AS t FROM p),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^Candidate\s*#\d+')) AS li, trim(split_part(split_part(t, chr(10) || '---' || chr(10), 2), chr(10) || 'CANDIDATE LIST:', 1)) AS pr FROM q)
SELECT condition, strategy, count(*) AS n, CAST(sum(len(li)) AS BIGINT) AS n_lines, CAST(sum(length(pr)) AS BIGINT) AS profile_chars, CAST(sum(length(array_to_string(list_transform(li, lambda x: rtrim(split_part(x, '| Description:', 1))), chr(10)))) AS BIGINT) AS bare_chars,
21 AS frame_chars FROM l GROUP BY ALL""",
}

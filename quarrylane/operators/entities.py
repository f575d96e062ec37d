"""Entity dictionary and conservative resolution of predicted names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.similarity import token_set_ratio, token_sort_ratio

FUZZY = 90.0


def dictionary(df: DataFrame, *, name: str, ticker: str, order: str) -> DataFrame:
    """norm, canonical (first in ``order``), ticker (last not null), aliases (sorted), ambiguous; one row for each entity form.

    ``order`` should decide; names without an entity form are left out.
    """
    rows = df.select(F.col(name).alias("n"), F.nullif(F.upper(F.trim(ticker)), F.lit("")).alias("t"), F.col(order).alias("o"), N.normalize(F.col(name), "entity").alias("norm"))
    rows = rows.where("norm <> ''").select("norm", "n", "t", "o", N.aliases(F.col("n")).alias("a"))
    # names repeat a lot: reduce to distinct (norm, name, ticker) before aliases are gathered
    one = rows.groupBy("norm", "n", "t").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.first("a").alias("a"))
    out = one.groupBy("norm").agg(
        F.min_by("n", F.struct("lo", "n")).alias("canonical"),
        F.max_by("t", F.when(F.col("t").isNotNull(), F.struct("hi", "t"))).alias("ticker"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("a")))).alias("aliases"),
    )
    return out.withColumn("ambiguous", N.is_ambiguous(F.col("norm")))


def rule_match(predicted: Column, target: Column, ticker: Column, aliases: Column) -> Column:
    """Equal entity form of target or alias, ticker as a word, or the target's distinctive words (two or more) in one piece."""
    p, t = N.normalize(predicted, "entity"), N.normalize(target, "entity")
    forms = F.transform(aliases, lambda a: N.normalize(a, "entity"))
    equal = (p == t) | F.coalesce(F.array_contains(forms, p), F.lit(False))
    core = N.distinctive(t)
    contained = (F.size(core) >= 2) & F.contains(p, F.array_join(core, " "))
    named = F.coalesce(N.has_ticker(predicted, ticker), F.lit(False))
    return F.coalesce((p != "") & (t != "") & (equal | named | contained), F.lit(False))


def fuzzy_match(predicted: Column, target: Column, aliases: Column | None = None, threshold: float = FUZZY) -> Column:
    """Sorted words of the entity forms of prediction and target (or one of its aliases) alike, with a distinctive word of four characters in common.

    Forms too unequal in length to reach the threshold are not compared.
    """
    p = N.normalize(predicted, "entity")

    def alike(t: Column) -> Column:
        shared = F.exists(F.array_except(F.array_intersect(F.split(p, " "), F.split(t, " ")), F.array(*map(F.lit, N.STOP_WORDS))), lambda w: F.length(w) >= 4)
        near = 2 * F.least(F.length(p), F.length(t)) * 100.0 >= threshold * (F.length(p) + F.length(t))
        # texts that cannot be alike are not given to Python
        score = token_sort_ratio(F.when(shared & near, p), F.when(shared & near, t))
        return F.coalesce((p != "") & (t != "") & (score >= threshold), F.lit(False))

    out = alike(N.normalize(target, "entity"))
    if aliases is not None:
        for i in range(4):  # a name has at most four surface forms
            out = out | alike(N.normalize(F.get(aliases, F.lit(i)), "entity"))
    return out


#: Score from which a response that resolves to no target still names part of one.
PARTIAL = 85.0


def recall_labels(answers: DataFrame, *, key: str, response: str, acquirer: str, year: str, name: str, ticker: str) -> DataFrame:
    """key, label, score and n_others of answers that were to name an acquisition.

    UNKNOWN: empty, the word UNKNOWN, or one that says it cannot. SUCCESS: resolves to the target or to
    another target of the same acquirer (display name in lower case) and year. PARTIAL: its words
    cover those of the target by ``PARTIAL`` or more. Else FAILURE. score: 100 for SUCCESS, 0 for UNKNOWN,
    else the coverage, which is 0 for a null name. n_others: other targets of acquirer and year. Keys
    must be unique; rows with a null acquirer or year have no others. Rows meet the other targets in a
    join, so no group is gathered.
    """
    clean = F.regexp_replace(F.coalesce(response, F.lit("")), r"(?U)^\s+|\s+$", "")
    a = answers.select(F.col(key).alias("k"), clean.alias("c"), F.lower(N.display_name(F.col(acquirer))).alias("a"), F.col(year).alias("y"), F.col(name).alias("n"), F.col(ticker).alias("t"))
    unknown = (F.col("c") == "") | (F.upper("c") == "UNKNOWN") | F.contains(F.lower("c"), F.lit("cannot"))
    targets = a.where("a IS NOT NULL AND y IS NOT NULL AND n IS NOT NULL").select("a", "y", F.col("n").alias("n2"), F.col("t").alias("t2")).distinct()
    others = a.where(F.col("n").isNotNull()).join(targets, ["a", "y"]).where("n <> n2").select("k", "c", F.col("n2").alias("n"), F.col("t2").alias("t"), F.lit(1).alias("other"))
    pairs = a.select("k", "c", "n", "t", F.lit(0).alias("other")).unionByName(others).where(F.col("n").isNotNull())
    aliases = N.aliases(F.col("n"))
    hit = rule_match(F.col("c"), F.col("n"), F.col("t"), aliases)
    pairs = pairs.withColumn("hit", hit)
    pairs = pairs.withColumn("hit", F.col("hit") | fuzzy_match(F.when(~F.col("hit"), F.col("c")), F.col("n"), aliases))
    resolved = pairs.groupBy("k").agg(F.max(F.col("hit").cast("int")).alias("hit"), F.sum("other").alias("n_others"))
    both = a.join(resolved, "k", "left").withColumn("unknown", unknown).withColumn("hit", ~F.col("unknown") & F.coalesce(F.col("hit") == 1, F.lit(False)))
    score = F.when(F.col("unknown"), 0.0).when(F.col("hit"), 100.0).otherwise(F.coalesce(token_set_ratio(F.when(~F.col("unknown") & ~F.col("hit"), F.col("c")), F.col("n")), F.lit(0.0)))
    both = both.withColumn("score", score)
    label = F.when(F.col("unknown"), "UNKNOWN").when(F.col("hit"), "SUCCESS").when(F.col("score") >= PARTIAL, "PARTIAL").otherwise("FAILURE")
    return both.select(F.col("k").alias(key), label.alias("label"), "score", F.coalesce("n_others", F.lit(0)).alias("n_others"))

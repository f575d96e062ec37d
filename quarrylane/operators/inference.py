"""Bootstrap intervals and rank correlation.

Draw i of resample b is the (i mod 4)th group of eight hex digits of ``md5(seed|b|i div 4)`` modulo the
sample size, so a result depends on the values, their order keys and the seed alone, and any SQL
engine can repeat it.

The units of a cell (records, or clusters, whose sums are formed first with map-side combine) are
written once. Cells of at most MOST_UNITS units are gathered in an array, which is sent to BLOCKS tasks
that make their part of the resamples; no drawn value is shuffled. Larger cells are never gathered:
each of their units has a Poisson(1) count in each resample (the bootstrap's limit for many units),
and only sums by resample leave a task.
"""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import write_once

RESAMPLES, LEVEL, SEED = 1000, 0.95, "42"
#: Units of a cell up to which they are drawn from an array.
MOST_UNITS = 20_000
#: Tasks among which the resamples of a cell are divided.
BLOCKS = 16


def _gathered(units: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], resamples: int, seed: str) -> DataFrame:
    unit = F.struct(F.col(order).alias("o"), F.array(*[F.col(v).cast("double") for v in values]).alias("v"))
    cells = units.groupBy(*keys).agg(F.array_sort(F.collect_list(unit)).alias("u")).select(*keys, F.transform("u", lambda x: x["v"]).alias("u"))
    spread = cells.select(*keys, "u", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    # a number given outright: few bytes make much work here, and adaptive execution would put them into one task
    parts = max(BLOCKS, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = spread.repartition(parts, *keys, "block")
    mine = F.filter(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda b: b % BLOCKS == F.col("block"))
    n = F.size("u")
    digests = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), lambda g: F.md5(F.concat_ws("|", F.lit(seed), F.col("b").cast("string"), g.cast("string"))))
    spread = spread.select(*keys, "u", F.explode(mine).alias("b")).select(*keys, "u", "b", digests.alias("d"))

    def add(s: Column, i: Column) -> Column:
        number = F.conv(F.substr(F.get("d", F.floor(i / 4).cast("int")), i % 4 * 8 + 1, F.lit(8)), 16, 10).cast("long")
        u = F.get("u", (number % n).cast("int"))
        return F.array(*[s[j] + u[j] for j in range(len(values))])

    z = F.aggregate(F.sequence(F.lit(0), n - 1), F.array(*[F.lit(0.0)] * len(values)), add)
    return spread.select(*keys, "b", z.alias("z")).select(*keys, "b", *[F.col("z")[j].alias(f"s{j}") for j in range(len(values))])


def _weighed(units: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], resamples: int, seed: str) -> DataFrame:
    """Counts come from MD5 uniforms by inversion; a unit has at most 12 in a resample, which errs for one in 10^10."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("b").cast("string"), F.col(order).cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)
    weight, p, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        weight = weight + F.when(u >= total, 1).otherwise(0)
        p /= k + 1
    rows = units.select(*keys, order, *values, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).withColumn("w", weight)
    return rows.groupBy(*keys, "b").agg(*[F.sum(F.col(v).cast("double") * F.col("w")).alias(f"s{j}") for j, v in enumerate(values)])


def _drawn(units: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], resamples: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The units, written once, and keys, b, s0, s1, ...: sums of ``values`` over the units drawn in each resample."""
    units = write_once(units.select(*keys, order, *values))
    sizes = units.groupBy(*keys).agg(F.count("*").alias("__n"))
    if not sizes.where(F.col("__n") > MOST_UNITS).limit(1).count():
        return units, _gathered(units, keys, order, values, resamples, seed)
    sized = units.join(sizes, list(keys))
    small, large = sized.where(F.col("__n") <= MOST_UNITS), sized.where(F.col("__n") > MOST_UNITS)
    return units, _gathered(small, keys, order, values, resamples, seed).unionByName(_weighed(large, keys, order, values, resamples, seed))


def _tails(level: float) -> tuple[float, float]:
    return (1 - level) / 2, 1 - (1 - level) / 2


def mean_interval(df: DataFrame, keys: Sequence[str], value: str, order: str, *, resamples: int = RESAMPLES, level: float = LEVEL, seed: str = SEED) -> DataFrame:
    """keys, n, mean, low, high of a percentile bootstrap of the mean of ``value`` in each cell.

    order: a key that orders a cell's rows without ties. Null and NaN values and null keys are left
    out; a cell without values has no row.
    """
    usable = df.na.drop(subset=[*keys, value]).withColumn("__one", F.lit(1.0))
    units, means = _drawn(usable, keys, order, [value, "__one"], resamples, seed)
    low, high = _tails(level)
    ci = means.groupBy(*keys).agg(F.percentile(F.col("s0") / F.nullif(F.col("s1"), F.lit(0.0)), F.array(F.lit(low), F.lit(high))).alias("p"))
    flat = units.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return flat.join(ci, list(keys)).select(*keys, "n", "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def paired_interval(
    df: DataFrame, keys: Sequence[str], difference: str, cluster: str, *, resamples: int = RESAMPLES, level: float = LEVEL, seed: str = SEED
) -> DataFrame:
    """keys, n, n_clusters, mean, low, high, p_value of paired differences, whole clusters being drawn.

    Clusters are reduced to (sum, count) first; p is twice the smaller tail of the bootstrap
    distribution centred on zero at the observed mean, at most 1. Null differences, keys and
    clusters are left out (give a row its own cluster with ``coalesce`` where it should stay).
    """
    usable = df.na.drop(subset=[*keys, difference, cluster])
    sums = usable.groupBy(*keys, cluster).agg(F.sum(difference).alias("__s"), F.count("*").alias("__c"))
    sums, drawn = _drawn(sums, keys, cluster, ["__s", "__c"], resamples, seed)
    drawn = drawn.withColumn("__m", F.col("s0") / F.nullif(F.col("s1"), F.lit(0.0)))
    flat = sums.groupBy(*keys).agg(F.sum("__c").alias("n"), F.count("*").alias("n_clusters"), (F.sum("__s") / F.sum("__c")).alias("mean"))
    low, high = _tails(level)
    d = F.col("mean")
    centred = F.round(F.col("__m") - d, 12)
    out = drawn.join(flat, list(keys)).groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("n_clusters").alias("n_clusters"), F.first("mean").alias("mean"),
        F.percentile("__m", F.array(F.lit(low), F.lit(high))).alias("__p"),
        F.avg((centred >= F.round(d, 12)).cast("double")).alias("__above"), F.avg((centred <= F.round(d, 12)).cast("double")).alias("__below"),
    )
    return out.select(*keys, "n", "n_clusters", "mean", F.col("__p")[0].alias("low"), F.col("__p")[1].alias("high"), F.least(F.lit(1.0), 2 * F.least("__above", "__below")).alias("p_value"))


def subset_interval(
    df: DataFrame, keys: Sequence[str], value: str, subset: str, cluster: str, *, resamples: int = RESAMPLES, level: float = LEVEL, seed: str = SEED, strict: bool = True
) -> DataFrame:
    """keys, means of the subset and of all, their difference and its interval; the same draws of clusters drive both means.

    A resample without a subset row has no difference: it raises an error, or unless ``strict`` is left
    out of the interval and counted in n_empty. A cell without a subset row then has a null interval.
    """
    usable = df.na.drop(subset=[*keys, value, cluster])
    inside = F.coalesce(F.col(subset), F.lit(False))
    sums = usable.groupBy(*keys, cluster).agg(
        F.sum(F.when(inside, F.col(value)).otherwise(0.0)).alias("__ss"), F.count_if(inside).alias("__sc"), F.sum(value).alias("__s"), F.count("*").alias("__c")
    )
    sums, drawn = _drawn(sums, keys, cluster, ["__ss", "__sc", "__s", "__c"], resamples, seed)
    none = F.raise_error(F.lit("a resample holds no row of the subset")) if strict else F.lit(None).cast("double")
    safe = F.when(F.col("s1") == 0, none).otherwise(F.col("s0") / F.col("s1"))
    low, high = _tails(level)
    ci = drawn.select(*keys, (safe - F.col("s2") / F.nullif(F.col("s3"), F.lit(0.0))).alias("__d")).groupBy(*keys).agg(F.percentile("__d", F.array(F.lit(low), F.lit(high))).alias("__p"), F.count_if(F.col("__d").isNull()).alias("n_empty"))
    flat = sums.groupBy(*keys).agg(
        F.sum("__sc").alias("n_subset"), F.sum("__c").alias("n"), (F.sum("__ss") / F.nullif(F.sum("__sc"), F.lit(0))).alias("mean_subset"), (F.sum("__s") / F.sum("__c")).alias("mean")
    )
    return flat.join(ci, list(keys)).select(*keys, "n_subset", "n", "mean_subset", "mean", (F.col("mean_subset") - F.col("mean")).alias("difference"), F.col("__p")[0].alias("low"), F.col("__p")[1].alias("high"), "n_empty")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """keys, n and rho: the correlation of tie-averaged ranks of pairs without nulls; rho is null under ``least`` pairs or without spread.

    Ranks come from counts of distinct values, so that a window sorts values, not rows.
    """
    pairs = df.na.drop(subset=[*keys, x, y])

    def ranks(v: str, name: str) -> DataFrame:
        c = pairs.groupBy(*keys, v).agg(F.count("*").alias("c"))
        before = F.sum("c").over(W.partitionBy(*keys).orderBy(v).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c")
        return c.select(*keys, v, (before + (F.col("c") + 1) / 2.0).alias(name))

    counted = pairs.groupBy(*keys, x, y).agg(F.count("*").alias("c"))
    both = counted.join(ranks(x, "rx"), [*keys, x]).join(ranks(y, "ry"), [*keys, y])
    n = F.sum("c")
    s = lambda e: F.sum(F.col("c") * e)
    a, b = F.col("rx"), F.col("ry")
    moments = both.groupBy(*keys).agg(n.alias("n"), s(a).alias("sa"), s(b).alias("sb"), s(a * b).alias("ab"), s(a * a).alias("aa"), s(b * b).alias("bb"))
    top = F.col("n") * F.col("ab") - F.col("sa") * F.col("sb")
    low = F.sqrt((F.col("n") * F.col("aa") - F.col("sa") ** 2) * (F.col("n") * F.col("bb") - F.col("sb") ** 2))
    return moments.select(*keys, "n", F.when((F.col("n") >= least) & (low > 0), top / low).alias("rho"))


def with_p_value(df: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Add the two-sided p_value of a correlation from Student's t with n - 2 degrees of freedom; null where rho is."""

    @F.pandas_udf("double")
    def p(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or b < 3 else _two_sided(float(a), int(b)) for a, b in zip(r, k, strict=True)], dtype=float)

    return df.withColumn("p_value", p(F.col(rho).cast("double"), F.col(n).cast("long")))


def _two_sided(rho: float, n: int) -> float:
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    return _incomplete_beta(df / 2.0, 0.5, 1.0 - rho * rho)  # df / (df + t^2) is 1 - rho^2


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + num * d or tiny)
        c = 1.0 + num / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-12:
            break
    return front * (f - 1.0)

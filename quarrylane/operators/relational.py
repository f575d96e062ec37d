"""Relational operators with explicit order, precedence and tie rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import write_once


def _desc(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order]


def _asc(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the least in ``order`` (nulls last).

    The row is chosen by a minimum with map-side combine, so a frequent key sends one row from each
    task instead of all its rows. ``order`` should decide; equal rows are told apart by all other
    columns, which must then be comparable. Null keys form a group of their own.
    """
    rest = [c for c in df.columns if c not in order]
    rank = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order], *[F.col(c) for c in rest if c not in keys])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), rank).alias("__b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__b.{c}").alias(c) for c in df.columns])


def pick_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the greatest in ``order`` (nulls lowest); otherwise as ``pick_first``."""
    rest = [c for c in df.columns if c not in order and c not in keys]
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), rank).alias("__b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__b.{c}").alias(c) for c in df.columns])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in ``order``; Spark limits each task to n rows a group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def with_fallbacks(left: DataFrame, right: DataFrame, *, key: str, year: str, offsets: Sequence[int], take: Sequence[str], last_by: Sequence[str]) -> DataFrame:
    """Left join on (key, year) that tries the year with each offset in turn; the first hit wins.

    Of several right rows with one (key, year) the last in ``last_by`` wins. All left rows stay;
    ``matched_year`` is the right year that hit, else null, and so are the columns ``take``. A null
    key or year hits nothing. The right side is read once: each of its rows is offered to the left
    years that it can serve, the best offer of each (key, left year) is kept, and one join follows.
    """
    best = pick_last(right.where(F.col(key).isNotNull() & F.col(year).isNotNull()).select(key, year, *take, *[c for c in last_by if c not in take]), [key, year], last_by)
    offers = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(o).alias("o")) for i, o in enumerate(offsets)])
    served = best.select(F.col(key).alias("__k"), F.col(year).alias("matched_year"), *take, F.explode(offers).alias("f"))
    served = served.select("__k", (F.col("matched_year") - F.col("f.o")).alias("__y"), F.col("f.priority").alias("p"), F.struct("matched_year", *take).alias("v"))
    served = served.groupBy("__k", "__y").agg(F.min_by("v", "p").alias("v"))
    out = left.join(served, (F.col(key) == F.col("__k")) & (F.col(year) == F.col("__y")), "left")
    return out.select(*[left[c] for c in left.columns], F.col("v.matched_year").alias("matched_year"), *[F.col(f"v.{c}").alias(c) for c in take])


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``work`` whose keys are not in ``done``; null keys are never done."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def others_of_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and the sorted distinct values of each group; what others did is this array without the own value.

    One row a group leaves the group-by and no pairs are formed: a row finds its companions by a
    join on the keys and ``array_except``.
    """
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(f"all_{value}"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_null, n_rows) in one pass; NaN counts as null."""
    types = dict(df.dtypes)
    missing = lambda c: F.col(c).isNull() | (F.isnan(c) if types[c] in ("double", "float") else F.lit(False))
    one = df.agg(F.count("*").alias("n"), *[F.count_if(missing(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_null"), F.col("n").alias("n_rows")) for i, c in enumerate(columns)])))


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null or NaN in ``columns``."""
    return df.na.drop(how="any", subset=list(columns))


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename what is there, ignore what is not."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def select_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def conform(df: DataFrame, renames: dict[str, str], defaults: dict[str, Column]) -> DataFrame:
    """Rename to canonical names and add defaults for what is missing; canonical input passes unchanged."""
    out = rename_present(df, {k: v for k, v in renames.items() if v not in df.columns})
    return out.withColumns({k: v for k, v in defaults.items() if k not in out.columns})


def all_and_any(labels: DataFrame, item: str, by: str, label: str, value: str) -> DataFrame:
    """item, and whether every / any of the values of ``by`` has ``label`` = value; a missing label does not.

    Counts distinct ``by`` instead of filling in the missing combinations.
    """
    n = labels.select(F.count_distinct(by)).first()[0]
    hit = F.count_distinct(F.when(F.col(label) == value, F.col(by)))
    return labels.groupBy(item).agg((hit == n).alias("all_of"), (hit > 0).alias("any_of"))


def next_in_order(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """key and, as ``name``, the value of the row with the next greater key; null for the last.

    Keys are unique. They are ranged over partitions by sampling; a window sees one partition, and
    the last key of each takes the first of the next, of which there is a row for each partition.
    """
    spread = write_once(rows.select(key, value.alias("__v")).repartitionByRange(key).withColumn("__p", F.spark_partition_id()))
    own = W.partitionBy("__p").orderBy(key)
    firsts = spread.groupBy("__p").agg(F.min_by("__v", key).alias("__f"))
    following = firsts.select(F.lead("__f").over(W.orderBy("__p")).alias("__n"), "__p")
    both = spread.withColumn("__w", F.lead("__v").over(own)).withColumn("__last", F.lead(key).over(own).isNull()).join(F.broadcast(following), "__p")
    return both.select(key, F.when(F.col("__last"), F.col("__n")).otherwise(F.col("__w")).alias(name))


def drop_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without those of the columns that there are."""
    return df.drop(*[c for c in columns if c in df.columns])


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in an explicit order, nulls last; equal rows are told apart by all other columns."""
    rest = [c for c in df.columns if c not in order]
    return df.orderBy(*_asc(order), *_asc(rest)).limit(n)


def mapped(df: DataFrame, column: str, names: dict[str, str], to: str) -> DataFrame:
    """Add ``to``, what ``names`` has for ``column``; rows that it has nothing for are dropped."""
    held = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(to, F.try_element_at(held, F.col(column))).where(F.col(to).isNotNull())


def looked_up(left: DataFrame, right: DataFrame, key: str, built: dict[str, Column]) -> DataFrame:
    """Left rows with the columns of ``right`` of the same key, or where there is none with those ``built`` from the left row.

    right: unique keys. ``found`` tells which. A null key finds nothing.
    """
    named = right.select(F.col(key).alias("__k"), F.struct(*[F.col(c) for c in built]).alias("__v"))
    out = left.join(named, F.col(key) == F.col("__k"), "left")
    values = [F.when(F.col("__v").isNotNull(), F.col(f"__v.{c}")).otherwise(v).alias(c) for c, v in built.items()]
    return out.select(*[left[c] for c in left.columns], *values, F.col("__v").isNotNull().alias("found"))

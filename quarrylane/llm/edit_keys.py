"""Pairs of keys that one edit sets apart, found exactly by a symmetric-delete join.

A letter missing, added, replaced or swapped with its neighbour leaves two keys that are equal once
at most one letter is taken out of each. So keys meet in their forms without one letter, and the
places and letters taken out tell a single edit from two. A form of n letters belongs to at most
n + 1 times the alphabet keys, however many keys there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread


def _forms(keys: DataFrame, name: str) -> DataFrame:
    """name, form, and the place and letter taken out; place 0 is the whole key."""
    out = F.expr("transform(sequence(1, length(key)), i -> struct(i AS at, substring(key, i, 1) AS letter, concat(left(key, i - 1), substring(key, i + 1)) AS form))")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("letter"), F.col("key").alias("form")))
    rows = keys.where("length(key) > 0").select(F.col("key").alias(name), F.explode(F.concat(whole, out)).alias("f"))
    return rows.select(name, "f.form", F.col("f.at").alias(f"{name}_at"), F.col("f.letter").alias(f"{name}_letter"))


def one_edit_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left, right) of different ``key`` values that one edit sets apart, a swap of neighbours being one edit.

    Both sides hold distinct keys; null and empty keys pair with none.
    """
    # forms are many times larger than the keys that Spark's estimate goes by: never collected on the driver for a broadcast
    met = spread(_forms(left, "left")).join(_forms(right, "right"), "form").where(F.col("left") != F.col("right"))
    whole = (F.col("left_at") == 0) | (F.col("right_at") == 0)
    replaced = F.col("left_at") == F.col("right_at")
    swapped = (F.abs(F.col("left_at") - F.col("right_at")) == 1) & (F.col("left_letter") == F.col("right_letter"))
    return met.where(whole | replaced | swapped).select("left", "right").distinct()

"""Filling containers of fixed capacity with texts (problem 6).

Bounded-space best fit: items come one by one; each goes into the open container with the least
free space that still holds it, found as the lowest set bit of a bitset whose bit f says that some
open container has f tokens free. At most OPEN containers are open: when one more is needed, the
fullest is closed first. An item larger than the capacity is cut in pieces of the capacity, and
what remains is an item again; no other item is cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage, write_once
from ..sources.tables import table
from .tokens import VOCABULARY, token_counts

OPEN = 512
#: Items of a shard, on average: bounds the memory of a packing task and the containers left part-full at its end.
SHARD_ITEMS = 40_000


def best_fit(sizes: Iterator[int], capacity: int, most_open: int = OPEN) -> Iterator[tuple[int, int, int, int]]:
    """For each piece of each item: (position of the item, container, first token, tokens)."""
    if capacity < 1 or most_open < 1:
        raise ValueError("capacity and most_open must be positive")
    free: dict[int, list[int]] = defaultdict(list)
    bits = n_open = n_containers = 0
    for at, size in enumerate(sizes):
        first = 0
        while size - first > capacity:
            yield at, n_containers, first, capacity
            n_containers += 1
            first += capacity
        need = size - first
        fits = bits >> need
        if fits:
            f = need + (fits & -fits).bit_length() - 1
            bins = free[f]
            container = bins.pop()
            if not bins:
                bits ^= 1 << f
            n_open -= 1
        else:
            if n_open == most_open:
                f = (bits & -bits).bit_length() - 1
                free[f].pop()
                if not free[f]:
                    bits ^= 1 << f
                n_open -= 1
            f, container = capacity, n_containers
            n_containers += 1
        yield at, container, first, need
        if f > need:
            free[f - need].append(container)
            bits |= 1 << (f - need)
            n_open += 1


def pack(items: DataFrame, specs: DataFrame, *, key: str = "doc_id", size: str = "n_tokens", most_open: int = OPEN, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers for ``items`` under each row (pack_name, capacity_tokens) of ``specs``.

    Result: pack_name, shard, container (number in its shard), key, first_token, n_tokens; one row
    for each piece. Items are spread over shards by a hash of key and size and packed in the order
    of the key, so the result depends on the rows alone, not on their layout. Items of size 0 go
    into the fullest open container; null sizes count as 0; null keys are packed like others and
    repeated rows are packed each time. No items or no specs give no rows. Specs without a
    positive capacity are refused.
    """
    items = items.select(F.col(key).alias("k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))
    shards = max(1, -(-items.count() // shard_items))
    spread = F.pmod(F.xxhash64("k", "n"), F.lit(shards)).alias("shard")
    wanted = [(r[0], int(r[1])) for r in specs.na.drop(subset=["pack_name", "capacity_tokens"]).select("pack_name", "capacity_tokens").distinct().collect()]  # a handful
    if any(c < 1 for _, c in wanted):
        raise ValueError("a capacity must be positive")
    sizes = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(wanted)]) if wanted else F.from_json(F.lit("[]"), "array<struct<pack_name: string, capacity: bigint>>")
    work = items.select("k", "n", spread, F.explode(sizes).alias("s")).select("k", "n", "shard", "s.pack_name", "s.capacity")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["k", "n"], kind="stable", na_position="first").reset_index(drop=True)
        capacity = group["capacity"].iloc[0]
        pieces = pd.DataFrame(best_fit(map(int, group["n"]), int(capacity), most_open), columns=["at", "container", "first_token", "n_tokens"])
        of = group.loc[pieces["at"]].reset_index(drop=True)
        return pd.concat([of[["pack_name", "shard"]], pieces[["container"]], of[["k"]], pieces[["first_token", "n_tokens"]]], axis=1)

    schema = work.select("pack_name", "shard").schema.add("container", "long")
    schema = schema.add(work.schema["k"]).add("first_token", "long").add("n_tokens", "long")
    return work.groupBy("pack_name", "shard").applyInPandas(run, schema).withColumnRenamed("k", key)


def _packed(spark: SparkSession, root: str, vocabulary: str = VOCABULARY) -> DataFrame:
    items = cut_lineage(token_counts(table(spark, root, "documents"), keep=["doc_id"], vocabulary=vocabulary))
    return pack(items, table(spark, root, "pack_specs"))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """Every document (or piece of one that alone exceeds the capacity) with its container."""
    return _packed(spark, root)


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    """For each capacity: containers, pieces, documents cut, and the share of space that is used."""
    cap = table(spark, root, "pack_specs").select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity"))
    one = _packed(spark, root).groupBy("pack_name", "shard", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"), F.count_if(F.col("first_token") > 0).alias("cuts"))
    return (
        one.join(F.broadcast(cap), "pack_name").groupBy("pack_name")
        .agg(
            F.count("*").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("cuts").alias("n_cuts"), F.sum("used").alias("n_tokens"),
            F.round(F.sum("used") / F.sum("capacity"), 6).alias("fill"), F.count_if(F.col("used") > F.col("capacity")).alias("n_over"),
        )
    )


#: What must hold of every packing, with no exception.
INVARIANTS = ("container_over_capacity", "item_cut_without_need", "item_in_two_places", "tokens_lost_or_doubled", "pieces_not_in_order")


def violations(packed: DataFrame, items: DataFrame, specs: DataFrame, *, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(pack_name, invariant, n_violations) for each spec and invariant, over the whole result; keys must be unique."""
    cap = specs.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    over = packed.groupBy("pack_name", "shard", "container").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(cap), "pack_name").groupBy("pack_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n0"))
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    wanted = items.select(F.col(key).alias("k"), n.alias("n")).crossJoin(F.broadcast(cap))  # a handful of specs
    got = packed.groupBy("pack_name", F.col(key).alias("k")).agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("sum"), F.count_distinct("first_token").alias("firsts"), F.min("first_token").alias("start"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    both = wanted.join(got, ["pack_name", "k"], "full")
    whole = F.col("n") <= F.col("capacity")
    bad = both.groupBy("pack_name").agg(
        F.count_if(whole & (F.col("firsts") > 1)).alias("n1"), F.count_if(whole & (F.col("pieces") > 1)).alias("n2"), F.count_if(~F.col("n").eqNullSafe(F.col("sum"))).alias("n3"),
        F.count_if((F.col("firsts") != F.col("pieces")) | (F.col("start") != 0) | (F.col("end") != F.col("n"))).alias("n4"),
    )
    rows = F.array(*[F.struct(F.lit(name).alias("invariant"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("n_violations")) for i, name in enumerate(INVARIANTS)])
    return cap.select("pack_name").join(over, "pack_name", "left").join(bad, "pack_name", "left").select("pack_name", F.inline(rows))


def p6_invariants(spark: SparkSession, root: str) -> DataFrame:
    """What a packing must never do, counted over all documents and containers."""
    items = write_once(token_counts(table(spark, root, "documents"), keep=["doc_id"], vocabulary=VOCABULARY))
    specs = table(spark, root, "pack_specs")
    return violations(write_once(pack(items, specs)), items, specs)


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p6_invariants": p6_invariants}
ORACLE = {"p6_invariants": "SELECT DISTINCT pack_name, invariant, 0::BIGINT AS n_violations FROM pack_specs, (VALUES " + ", ".join(f"('{x}')" for x in INVARIANTS) + ") t(invariant)"}

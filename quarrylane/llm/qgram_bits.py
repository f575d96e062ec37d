"""Names as bit vectors of q-grams, and close pairs of them by multi-index Hamming search.

A key (a word, or words written together) sets HASHES bits of 64 for each of its padded bigrams.
Two keys within RADIUS bits differ by at most RADIUS // BLOCKS bits in one of their BLOCKS blocks
of equal width. So a key is compared on all bits with the keys that have, in one block, one of the
values so few flips away. This finds every pair of keys within the radius, whatever letters they share.

The keys of each side are dealt into parts of at most PART by hash, and each part of one side meets
each of the other in one task, which holds the two parts as arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BITS, HASHES = 64, 4
BLOCKS, WIDTH = 4, 16
RADIUS = 11
#: Keys of a side that one task holds, about.
PART = 250_000
#: Pairs compared, and pairs given out, at a time.
AT_ONCE = 1 << 18


@lru_cache(maxsize=100_000)
def _mask(gram: str) -> int:
    digest = hashlib.blake2b(gram.encode(), digest_size=2 * HASHES).digest()
    mask = 0
    for i in range(HASHES):
        mask |= 1 << int.from_bytes(digest[2 * i : 2 * i + 2], "little") % BITS
    return mask


def vector(key: str) -> int:
    """The bit vector as a signed long."""
    padded, bits = f"^{key}$", 0
    for i in range(len(padded) - 1):
        bits |= _mask(padded[i : i + 2])
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def dice(a: int, b: int) -> float:
    """Dice coefficient of two bit vectors."""
    full = (1 << BITS) - 1
    a, b = a & full, b & full
    total = a.bit_count() + b.bit_count()
    return 2 * (a & b).bit_count() / total if total else 0.0


def with_vectors(keys: DataFrame, key: str) -> DataFrame:
    """Add the column ``bits``; null keys have null bits."""

    def run(batches):
        for b in batches:
            yield b.assign(bits=pd.Series([vector(k) if isinstance(k, str) else None for k in b[key]], index=b.index, dtype="Int64"))

    return keys.mapInPandas(run, StructType([*keys.schema.fields, StructField("bits", LongType())]))


def _within(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in left and in right, and distances, of all pairs of unsigned vectors within the radius, each pair once."""
    if not len(left) or not len(right):
        return
    most, full = radius // BLOCKS, np.uint64((1 << WIDTH) - 1)
    flips = np.array([sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(WIDTH), n)])
    block = lambda bits, k: (bits >> np.uint64(k * WIDTH)) & full
    for k in range(BLOCKS):
        of_right, of_left = block(right, k).astype(np.int64), block(left, k).astype(np.int64)
        by_right, by_left = np.argsort(of_right, kind="stable"), np.argsort(of_left, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(of_right, minlength=1 << WIDTH))])
        ours, theirs = left[by_left], right[by_right]
        values, first = np.unique(of_left[by_left], return_index=True)
        for value, a, b in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(left)], strict=True):
            begin, end = start[flips ^ value], start[(flips ^ value) + 1]
            n = end - begin
            total = int(n.sum())
            if not total:
                continue
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(total)
            met = theirs[at]
            step = max(1, AT_ONCE // total)
            for c in range(a, b, step):
                i, j = np.nonzero(np.bitwise_count(ours[c : min(b, c + step), None] ^ met) <= radius)
                differ = ours[c + i] ^ met[j]
                new = np.ones(len(i), dtype=bool)
                for before in range(k):  # pairs that an earlier block has given
                    new &= np.bitwise_count(block(differ, before)) > most
                if new.any():
                    yield by_left[c + i[new]], by_right[at[j[new]]], np.bitwise_count(differ[new])


def keys_within(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (left, right, distance) of ``key`` values whose ``bits`` differ in at most ``radius`` places.

    Both sides hold distinct keys, so a frequent name counts once. Keys without bits pair with none.
    """
    if radius >= 3 * BLOCKS:
        raise ValueError("a pair so far apart may share no block")
    rows = left.na.drop().select("key", "bits", F.lit(True).alias("l")).unionByName(right.na.drop().select("key", "bits", F.lit(False).alias("l")))
    n = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    across, down = (-(-n.get(x, 0) // PART) or 1 for x in (True, False))
    part = F.when(F.col("l"), F.pmod(F.xxhash64("key"), F.lit(across))).otherwise(F.pmod(F.xxhash64("key"), F.lit(down)))
    # tile i * down + j: part i of left, part j of right
    tiles = F.when(F.col("l"), F.sequence(part * down, part * down + (down - 1))).otherwise(F.sequence(part, part + F.lit((across - 1) * down), F.lit(down).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        a, b = t.filter(t["l"]), t.filter(pc.invert(t["l"]))
        numbers = lambda x: x["bits"].to_numpy().view(np.uint64)
        a_keys, b_keys = a["key"].combine_chunks(), b["key"].combine_chunks()
        found, size = [], 0

        def out() -> pa.RecordBatch:
            i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([a_keys.take(pa.array(i)), b_keys.take(pa.array(j)), pa.array(d.astype(np.int32))], ["left", "right", "distance"])

        for x in _within(numbers(a), numbers(b), radius):
            found.append(x)
            size += len(x[0])
            if size >= AT_ONCE:
                yield out()
                found, size = [], 0
        if found:
            yield out()

    rows = rows.select("key", "bits", "l", F.explode(tiles).alias("tile")).repartition(across * down, "tile")
    return rows.groupBy("tile").applyInArrow(run, "left string, right string, distance int")


def close_keys(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Those pairs of ``keys_within`` that agree in their first or last two letters, keys of up to five letters in the first or last one.

    A narrower search, for callers who want no others; the matching takes all pairs.
    """
    end = lambda n: (F.left("left", F.lit(n)) == F.left("right", F.lit(n))) | (F.right("left", F.lit(n)) == F.right("right", F.lit(n)))
    a, b = F.length("left"), F.length("right")
    return keys_within(left, right, radius).where((F.greatest(a, b) <= 5) & end(1) | (F.least(a, b) >= 5) & end(2))

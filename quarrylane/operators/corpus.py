"""Candidate corpora: stratified draws, numbering, wide form and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.business import ADJACENT, SECTORS, SIZE_LABELS, UNKNOWN
from ..runtime import write_once

N_CANDIDATES = 50
#: Strata of a draw and how many items each gives: same sector, neighbouring sectors, other sectors.
QUOTAS = {"same": 22, "adjacent": 18, "other": 9}


def md5_int(c: Column) -> Column:
    """The first 60 bits of an MD5 digest as a long."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def seed_of(key: Column) -> Column:
    """The low 32 bits of the MD5 digest of a key."""
    return F.conv(F.right(F.md5(key), F.lit(8)), 16, 10).cast("long")


def size_windows(bucket: Column) -> Column:
    """The target sizes whose window of one bucket on either side holds ``bucket``; an unknown target stands for the middle one and also takes unknown items."""
    near = {label: [s for j, s in enumerate(SIZE_LABELS) if abs(i - j) <= 1] + ([UNKNOWN] if abs(i - 2) <= 1 else []) for i, label in enumerate(SIZE_LABELS)}
    out = F.when(bucket == UNKNOWN, F.array(F.lit(UNKNOWN)))
    for label, targets in near.items():
        out = out.when(bucket == label, F.array(*map(F.lit, targets)))
    return out.otherwise(F.array().cast("array<string>"))


def sector_strata(sector: Column) -> Column:
    """For each sector of a target, the stratum that an item of ``sector`` falls into: array of (target sector, stratum)."""
    every = [s for s, _ in SECTORS if s != "SPAC"] + ["Other", UNKNOWN]

    def stratum(t: str) -> Column:
        return F.when(sector == t, "same").when(sector.isin(ADJACENT.get(t, [])), "adjacent").otherwise("other")

    return F.array(*[F.struct(F.lit(t).alias("target_sector"), stratum(t).alias("stratum")) for t in every])


def draw_candidates(targets: DataFrame, pool: DataFrame, *, quotas: dict[str, int] = QUOTAS, total: int = N_CANDIDATES - 1) -> DataFrame:
    """(deal_id, ticker, stratum, pick) without replacement: the quotas of each stratum within the size window, then any items to fill up.

    targets: deal_id, ticker, sector, size. pool: ticker (unique, not null), sector, size. The pool
    is laid out once for each (target sector, size) and stratum in the order of an MD5 digest; a
    deal reads its quota from a place given by its own digest, round the end to the beginning. So
    every item is equally likely, no deal is ever joined with the whole pool, and the draw depends
    on the rows alone. The target's own ticker is never drawn. pick counts from 1 in each stratum;
    stratum 'fill' tops up to ``total`` from all sizes. Deals with a null key give no rows.
    """
    # tables that several steps read are written once: the pool, its lanes, the targets and what they drew
    base = write_once(pool.select("ticker", "sector", "size", F.md5("ticker").alias("h")))
    placed = base.select("ticker", "h", F.explode(sector_strata(F.col("sector"))).alias("s"), size_windows(F.col("size")).alias("sizes"))
    placed = placed.select("ticker", "h", "s.target_sector", "s.stratum", F.explode("sizes").alias("target_size"))
    keys = ["target_sector", "target_size", "stratum"]
    lanes = write_once(placed.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy("h", "ticker")) - 1))
    sizes = lanes.groupBy(*keys).agg(F.max("pos").alias("last")).select(*keys, (F.col("last") + 1).alias("n"))

    t = write_once(targets.where("deal_id IS NOT NULL").select("deal_id", F.col("ticker").alias("own"), F.col("sector").alias("target_sector"), F.col("size").alias("target_size")))
    wants = F.array(*[F.struct(F.lit(k).alias("stratum"), F.lit(q).alias("quota")) for k, q in quotas.items()])
    asked = t.select("*", F.explode(wants).alias("w")).select("deal_id", "own", "target_sector", "target_size", "w.stratum", "w.quota").join(F.broadcast(sizes), keys)
    start = md5_int(F.concat_ws("|", "deal_id", "stratum"))
    # one place more than the quota, for the target itself
    steps = F.sequence(F.lit(0), F.least(F.col("quota") + 1, F.col("n")) - 1)
    asked = asked.select("deal_id", "own", *keys, "quota", "n", start.alias("start"), F.explode(steps).alias("j"))
    asked = asked.withColumn("pos", F.pmod(F.col("start") + F.col("j"), F.col("n")).cast("int"))
    got = asked.join(lanes, [*keys, "pos"]).where("own IS NULL OR ticker <> own")
    in_stratum = F.row_number().over(W.partitionBy("deal_id", "stratum").orderBy("j"))
    got = write_once(got.withColumn("pick", in_stratum).where("pick <= quota").select("deal_id", "ticker", "stratum", "pick"))

    drawn = got.groupBy("deal_id").agg(F.count("*").alias("k"), F.collect_set("ticker").alias("used"))
    short = t.join(drawn, "deal_id", "left").select("deal_id", "own", (F.lit(total) - F.coalesce("k", F.lit(0))).alias("deficit"), F.coalesce("used", F.array().cast("array<string>")).alias("used")).where("deficit > 0")
    ring = base.select("ticker", "h", F.left("h", F.lit(2)).alias("part"))  # parts follow one another in the order of the digest
    counts = ring.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.select("part", (F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c")).alias("before"))  # 256 rows
    ring = ring.withColumn("i", F.row_number().over(W.partitionBy("part").orderBy("h", "ticker")) - 1).join(F.broadcast(before), "part").select("ticker", (F.col("i") + F.col("before")).alias("pos"))
    more = short.withColumn("n", F.coalesce(counts.agg(F.sum("c")).scalar(), F.lit(0).cast("long"))).where("n > 0")
    reach = F.least(F.col("deficit") + F.size("used") + 1, F.col("n"))
    more = more.select("deal_id", "own", "deficit", "used", "n", md5_int(F.concat_ws("|", "deal_id", F.lit("fill"))).alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), reach.cast("long") - 1)).alias("j"))
    more = more.withColumn("pos", F.pmod(F.col("start") + F.col("j"), F.col("n")))
    fill = more.join(ring, "pos").where("(own IS NULL OR ticker <> own) AND NOT array_contains(used, ticker)")
    fill = fill.withColumn("pick", F.row_number().over(W.partitionBy("deal_id").orderBy("j"))).where("pick <= deficit")
    return got.unionByName(fill.select("deal_id", "ticker", F.lit("fill").alias("stratum"), "pick"))


def number_candidates(items: DataFrame) -> DataFrame:
    """Add candidate_no (from 1, in the order of a digest of deal and ticker) to the (deal_id, ticker) rows of each deal."""
    order = F.md5(F.concat_ws("|", "deal_id", F.lit("s"), "ticker"))
    return items.withColumn("candidate_no", F.row_number().over(W.partitionBy("deal_id").orderBy(order, "ticker")))


def candidate_line(no: Column, industry: Column, size: Column, revenue: Column, description: Column) -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("Candidate #"), F.lpad(no.cast("string"), 2, "0")), F.concat(F.lit("Industry: "), industry), F.concat(F.lit("Market Cap: "), size), F.concat(F.lit("Revenue: "), revenue), F.concat(F.lit("Description: "), description))


def line_number(line: Column) -> Column:
    """The candidate number of a line, null if it is no candidate line."""
    return F.nullif(F.regexp_extract(line, r"^Candidate\s*#(\d+)", 1), F.lit("")).cast("int")


def without_description(line: Column) -> Column:
    return F.rtrim(F.split_part(line, F.lit("| Description:"), F.lit(1)))


def to_wide(rows: DataFrame, key: str, order: str, line: str, ticker: str, is_target: str) -> DataFrame:
    """One row for each key: candidate_list (lines in order), candidate_tickers, target_position, n."""
    item = F.struct(F.col(order).alias("o"), F.col(line).alias("l"), F.col(ticker).alias("t"), F.col(is_target).alias("g"))
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("c"))
    place = F.array_position(F.transform("c", lambda x: F.coalesce(x["g"], F.lit(False))), F.lit(True))
    return one.select(key, F.array_join(F.transform("c", lambda x: x["l"]), "\n").alias("candidate_list"), F.transform("c", lambda x: x["t"]).alias("candidate_tickers"), F.nullif(place, F.lit(0)).cast("int").alias("target_position"), F.size("c").alias("n"))


def violations(wide: DataFrame, key: str, target: str, expected: int = N_CANDIDATES) -> DataFrame:
    """(key, problem) for each broken invariant of the wide form: line count, numbers 1..n, position in range, unique tickers, target exactly once, unique key."""
    ids = F.filter(F.transform(F.split("candidate_list", "\n"), line_number), lambda x: x.isNotNull())
    tick = F.transform(F.filter("candidate_tickers", lambda x: x.isNotNull() & (x != "")), F.upper)
    gold = F.size(F.filter(tick, lambda x: x == F.upper(target)))
    checks = {
        "line_count": F.size(ids) != expected,
        "numbers": F.array_sort(ids) != F.sequence(F.lit(1), F.lit(expected)),
        "position": ~F.coalesce(F.col("target_position").between(1, expected), F.lit(False)),
        "duplicate_tickers": F.size(tick) != F.size(F.array_distinct(tick)),
        "target_not_once": F.col(target).isNotNull() & (gold != 1),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in checks.items()]), lambda x: x.isNotNull())
    own = wide.select(key, F.explode(found).alias("problem"))
    again = wide.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate_key").alias("problem"))
    return own.unionByName(again)


class CorpusError(ValueError):
    """A corpus that breaks its invariants."""


def assert_valid(wide: DataFrame, key: str, target: str, expected: int = N_CANDIDATES, show: int = 50) -> None:
    """Raise with the first messages if any invariant is broken; only those messages come to the driver."""
    found = violations(wide, key, target, expected).orderBy(key, "problem").limit(show).collect()
    if found:
        raise CorpusError("broken invariants:\n" + "\n".join(f"  - {r[0]}: {r[1]}" for r in found))

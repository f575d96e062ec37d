"""Attributes as known at the time of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Order of rows that fall on the same instant: what is available *at* the instant, the event,
#: what is available only *after* it.
AT, EVENT, AFTER = 0, 1, 2


def available_at(column: str | Column, strict: bool) -> Column:
    """When a value may be used: from ``column`` on, or with ``strict`` only after it."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNotNull(), F.struct(c.cast("timestamp_ntz").alias("t"), F.lit(AFTER if strict else AT).alias("p")))


def as_known_at(
    events: DataFrame,
    versions: DataFrame,
    *,
    entity: tuple[str, str],
    event_time: str,
    available: list[tuple[str, bool]],
    latest_by: list[str],
    take: dict[str, str],
    segment_days: int = 366,
) -> DataFrame:
    """Add to each event the attributes of its entity that were known at the event's time.

    Events and versions are united and sorted by entity, time and tie priority, and the version
    that is greatest in ``latest_by`` among those available so far is carried forward.

    entity: its column in ``events`` and in ``versions``. available: columns of ``versions`` that
    must all have passed, each with whether the instant itself is excluded. latest_by: columns of
    ``versions``, the most significant first; the last one should be unique, else equal rows are
    told apart by the values taken. take: column of ``versions`` -> name in the result.

    The timeline of an entity is cut in segments of ``segment_days``. Events are first reduced to
    distinct (entity, time) and versions to the best one of each (entity, time), both with
    map-side combine, so a window holds at most one row per instant of a segment however hot the
    entity is; what earlier segments carry in comes from one row per segment.

    Nulls: events without entity or time keep null attributes, versions without entity or without
    one of their availability times are never used; nulls in ``latest_by`` rank lowest. Repeated
    events stay repeated, repeated versions count once. Empty inputs give no rows or null
    attributes. Columns of ``versions`` other than those named play no part, whatever their names.
    """
    left, right = entity
    clash = set(take.values()) & set(events.columns)
    if clash:
        raise ValueError(f"names already in events: {sorted(clash)}")
    since = F.greatest(*[available_at(c, strict) for c, strict in available]) if len(available) > 1 else available_at(*available[0])
    complete = F.lit(True)
    for c, _ in available:
        complete = complete & F.col(c).isNotNull()
    value = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(latest_by)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(take)])
    known = (
        versions.where(F.col(right).isNotNull() & complete)
        .select(F.col(right).alias("k"), since.alias("since"), value.alias("v"))
        .groupBy("k", F.col("since.t").alias("t"), F.col("since.p").alias("p"))
        .agg(F.max("v").alias("v"))
    )
    asked = (
        events.where(F.col(left).isNotNull() & F.col(event_time).isNotNull())
        .select(F.col(left).alias("k"), F.col(event_time).cast("timestamp_ntz").alias("t"))
        .distinct()
        .select("k", "t", F.lit(EVENT).alias("p"), F.lit(None).cast(known.schema["v"].dataType).alias("v"))
    )
    segment = F.floor(F.datediff(F.col("t").cast("date"), F.lit("1970-01-01").cast("date")) / segment_days)
    line = known.select("k", "t", "p", "v").unionByName(asked).withColumn("s", segment)
    so_far = W.partitionBy("k", "s").orderBy("t", "p").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("k").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    within = line.withColumn("w", F.max("v").over(so_far)).where(F.col("p") == EVENT).select("k", "s", "t", "w")
    carried = line.groupBy("k", "s").agg(F.max("v").alias("m")).select("k", "s", F.max("m").over(earlier).alias("c"))
    state = within.join(carried, ["k", "s"]).select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.greatest("w", "c").alias("__v"))
    state = state.where(F.col("__v").isNotNull())
    same = (F.col(left) == F.col("__k")) & (F.col(event_time).cast("timestamp_ntz") == F.col("__t"))
    out = events.join(state, same, "left")
    return out.select(*[events[c] for c in events.columns], *[F.col(f"__v.v{i}").alias(n) for i, n in enumerate(take.values())])

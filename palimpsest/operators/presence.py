"""Presence as disjoint, sorted intervals per entity; a null end is open.

Stamps are longs. An interval is present at t if first <= t < last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_FIRST, OPEN_LAST = -(1 << 63), (1 << 63) - 1


def _islands(df: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Intervals (first, last) of each key joined where they overlap or touch within the gap."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.when(before > OPEN_LAST - gap, F.lit(OPEN_LAST)).otherwise(before + gap)
    opened = df.withColumn("opens", F.when(before.isNull() | (F.col("first") > reach), 1).otherwise(0))
    numbered = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("island")


def interval_union(df: DataFrame, keys: Sequence[str], first: str = "first", last: str = "last", *, gap: int = 0, slice_width: int | None = None) -> DataFrame:
    """keys, first, last, n: the union of each key's intervals, and how many rows each one holds.

    slice_width: intervals are first joined within slices of time, so that a key with a large part of all rows is dealt
    over many tasks and reaches the last step as few intervals. An inverted interval is an error."""
    rows = df.select(*keys, F.coalesce(F.col(first), F.lit(OPEN_FIRST)).alias("first"), F.coalesce(F.col(last), F.lit(OPEN_LAST)).alias("last"), F.lit(1).alias("n"))
    rows = rows.withColumn("last", F.when(F.col("first") <= F.col("last"), F.col("last")).otherwise(F.raise_error(F.lit("inverted interval")).cast("long")))
    if slice_width:
        rows = _islands(rows.withColumn("slice", F.expr(f"first div {int(slice_width)}L")), [*keys, "slice"], gap).drop("slice")
    out = _islands(rows, list(keys), gap)
    return out.select(*keys, F.when(F.col("first") > OPEN_FIRST, F.col("first")).alias("first"), F.when(F.col("last") < OPEN_LAST, F.col("last")).alias("last"), F.col("n").cast("long").alias("n"))


def is_present(first: Column, last: Column, t: Column) -> Column:
    return (first.isNull() | (first <= t)) & (last.isNull() | (last > t))


def present_at(intervals: DataFrame, t: Column, first: str = "first", last: str = "last") -> DataFrame:
    return intervals.where(is_present(F.col(first), F.col(last), t))


def last_changes_before(intervals: DataFrame, keys: Sequence[str], t: Column, first: str = "first", last: str = "last") -> DataFrame:
    """keys, last_appeared, last_disappeared, has_appeared, has_disappeared: changes at or before t."""
    seen = [F.max(F.when(F.col(c) <= t, F.col(c))) for c in (first, last)]
    out = intervals.groupBy(*keys).agg(seen[0].alias("last_appeared"), seen[1].alias("last_disappeared"))
    return out.withColumn("has_appeared", F.col("last_appeared").isNotNull()).withColumn("has_disappeared", F.col("last_disappeared").isNotNull())


def clip_to_next(df: DataFrame, keys: Sequence[str], first: str = "first", last: str = "last", *, ties: Sequence[str] = ()) -> DataFrame:
    """Each segment ends where the next one of its key begins at the latest, and none outlives the newest one's end. Segments
    of equal ends go by the columns in ties."""
    order = Window.partitionBy(*keys).orderBy(first, last, *ties)
    newest = F.last(F.coalesce(F.col(last), F.lit(OPEN_LAST))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bound = F.least(F.coalesce(F.col(last), F.lit(OPEN_LAST)), F.coalesce(F.lead(first).over(order), F.lit(OPEN_LAST)), newest)
    return df.withColumn("clipped", F.when(bound < OPEN_LAST, bound))


def midpoint(a: Column, b: Column) -> Column:
    """Between two stamps, without overflow, rounded down."""
    half = F.shiftright(b - a, 1)
    return a + half


def estimate(observed_first: Column, observed_last: Column, first_absent: Column, first_persistent: Column, last_absent: Column, last_persistent: Column, *, identified: Column, conservative: bool = True) -> tuple[Column, Column]:
    """Presence before and after what was observed, from the evidence on either side; null is open.

    Evidence counts only outside the observation. Persistence that absence contradicts on its far side is dropped. An end is
    midway between the last persistence (or the observation) and the absence. Without absence an identified object begins at
    its first evidence and stays open; another one does either by the conservative choice."""
    before_gone, before_there = first_absent < observed_first, first_persistent < observed_first
    before_there = before_there & ~F.coalesce(before_gone & (first_absent >= first_persistent), F.lit(False))
    since = F.when(before_there, first_persistent).otherwise(observed_first)
    begin = F.when(before_gone, midpoint(first_absent, since)).when(identified | F.lit(conservative), since)
    after_gone, after_there = last_absent > observed_last, last_persistent > observed_last
    after_there = after_there & ~F.coalesce(after_gone & (last_absent <= last_persistent), F.lit(False))
    until = F.when(after_there, last_persistent).otherwise(observed_last)
    end = F.when(after_gone, midpoint(until, last_absent)).when(~(identified | F.lit(not conservative)), until)
    return begin, end


def clamp_open_ends(first: Column, last: Column, reference_first: Column, reference_last: Column) -> tuple[Column, Column]:
    """Open ends take the reference's evidence where it has any."""
    return F.coalesce(first, reference_first), F.coalesce(last, reference_last)


def consolidate(entities: DataFrame, changes: DataFrame, key: str, appeared: str = "appeared", disappeared: str = "disappeared") -> DataFrame:
    """key, appearances, disappearances: sorted distinct stamps; entities without changes are open on both sides."""
    found = changes.groupBy(key).agg(F.array_sort(F.collect_set(appeared)).alias("appearances"), F.array_sort(F.collect_set(disappeared)).alias("disappearances"))
    none = F.array().cast("array<long>")
    return entities.select(key).distinct().join(found, key, "left").select(key, F.coalesce("appearances", none).alias("appearances"), F.coalesce("disappearances", none).alias("disappearances"))

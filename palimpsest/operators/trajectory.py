"""Ordered positions of entities: merging, displacement, arc length, interpolation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import ordered_fold


def merge(rows: DataFrame, key: str, ts: str, priority: str) -> DataFrame:
    """One row per entity and stamp: the one of least priority."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key, ts).agg(F.min_by(row, priority).alias("_r")).select("_r.*")


def displacement(rows: DataFrame, key: str, ts: str, coords: Sequence[str]) -> DataFrame:
    """key, n, displacement: the farthest from the entity's first position; two aggregations, no window."""
    first = rows.groupBy(key).agg(F.min(F.struct(ts, *coords)).alias("_o"))
    d2 = sum(((F.col(c) - F.col(f"_o.{c}")) * (F.col(c) - F.col(f"_o.{c}")) for c in coords), F.lit(0.0))
    return rows.join(first, key).groupBy(key).agg(F.count("*").alias("n"), F.sqrt(F.max(d2)).alias("displacement"))


def arc_length(rows: DataFrame, key: str, ts: str, coords: Sequence[str]) -> DataFrame:
    """rows with step (from the one before) and length (from the first)."""
    order = Window.partitionBy(key).orderBy(ts)
    d2 = sum(((F.col(c) - F.lag(c).over(order)) * (F.col(c) - F.lag(c).over(order)) for c in coords), F.lit(0.0))
    stepped = rows.withColumn("step", F.coalesce(F.sqrt(d2), F.lit(0.0)))
    return stepped.withColumn("length", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def unwrapped(rows: DataFrame, key: str, ts: str, angle: Column) -> DataFrame:
    """rows with angle and yaw: the angle continued over full turns, from the first one on."""
    order = Window.partitionBy(key).orderBy(ts)
    at = rows.withColumn("angle", angle)
    turn = F.col("angle") - F.lag("angle").over(order)
    # to [-pi, pi)
    step = F.pmod(turn + math.pi, F.lit(2 * math.pi)) - math.pi
    first = F.first("angle").over(order)
    stepped = at.withColumns({"_s": F.coalesce(step, F.lit(0.0)), "_f": first})
    return stepped.withColumn("yaw", F.col("_f") + F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s", "_f")


def smoothed(rows: DataFrame, key: str, ts: str, angle: str, reach: int, sigma: float) -> DataFrame:
    """rows with smooth: the direction of the Gaussian mean of the unit vectors up to reach rows on either side."""
    order = Window.partitionBy(key).orderBy(ts)
    sums = {}
    for name, f in (("_x", F.cos), ("_y", F.sin)):
        parts = []
        for k in range(-reach, reach + 1):
            at = F.lag(angle, -k).over(order) if k < 0 else F.lead(angle, k).over(order) if k > 0 else F.col(angle)
            parts.append(F.coalesce(f(at) * math.exp(-k * k / (2 * sigma * sigma)), F.lit(0.0)))
        sums[name] = sum(parts[1:], parts[0])
    return rows.withColumns(sums).withColumn("smooth", F.atan2("_y", "_x")).drop("_x", "_y")


def resampled(rows: DataFrame, key: str, ts: str, coords: Sequence[str], spacing: float) -> DataFrame:
    """key, place, coords: points every spacing along each path, from its first one, linear in between; none at its very end.
    Lengths are sums of steps of nine decimals, which are exact: a sum of doubles may miss a place that a path ends at."""
    order = Window.partitionBy(key).orderBy(ts)
    exact = F.sum(F.col("step").try_cast("decimal(28,9)")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    at = arc_length(rows, key, ts, coords).withColumn("length", F.when(F.col("length") < float("inf"), exact))
    ahead = at.select(key, "length", *coords, F.lead("length").over(order).alias("_l"), *[F.lead(c).over(order).alias(f"_{c}") for c in coords])
    first, last = F.ceil(F.col("length") / spacing), F.ceil(F.col("_l") / spacing) - 1
    dense = ahead.where("_l > length").withColumn("place", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
    share = (F.col("place") * spacing - F.col("length")) / (F.col("_l") - F.col("length"))
    return dense.select(key, "place", *[(F.col(c) + (F.col(f"_{c}") - F.col(c)) * share).alias(c) for c in coords])


def cut_corners(rows: DataFrame, key: str, order: Sequence[str], coords: Sequence[str], rounds: int = 2, *, closed: bool = False) -> DataFrame:
    """key, place (from 0), coords: each path with its corners cut. A round puts two points on every segment, at a quarter and three quarters;
    an open path keeps its ends. Rows without a place are left out; a path of one point has it at both ends."""
    line = rows.select(key, *order, *coords).dropna(subset=list(coords))
    at = line.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long").alias("place"), *[F.col(c).cast("double") for c in coords])
    for _ in range(rounds):
        path = Window.partitionBy(key).orderBy("place")
        first = [F.first(c).over(path) for c in coords]
        ahead = [F.coalesce(F.lead(c).over(path), f) if closed else F.lead(c).over(path) for c, f in zip(coords, first, strict=True)]
        met = at.select(key, "place", *coords, *[a.alias(f"_{c}") for c, a in zip(coords, ahead, strict=True)])
        between = lambda share: [(F.col(c) * (1 - share) + F.col(f"_{c}") * share).alias(c) for c in coords]
        point = lambda place, at_: F.struct(place.alias("place"), *at_)
        own = [F.col(c).alias(c) for c in coords]
        shift, last = (0, None) if closed else (1, F.col(f"_{coords[0]}").isNull())
        pair = [point(F.col("place") * 2 + shift, between(0.25)), point(F.col("place") * 2 + shift + 1, between(0.75))]
        if closed:
            parts = F.array(*pair)
        else:
            parts = F.array_compact(F.array(F.when(F.col("place") == 0, point(F.lit(0).cast("long"), own)), *[F.when(~last, p) for p in pair], F.when(last, point(F.col("place") * 2 + 1, own))))
        at = met.select(key, F.explode(parts).alias("p")).select(key, "p.place", *[F.col(f"p.{c}").alias(c) for c in coords])
    return at


def tangent_yaw(rows: DataFrame, key: str, ts: str, x: str = "x", y: str = "y") -> DataFrame:
    """rows with yaw, the direction from the point before to the one after; at an end, from or to it. 0 for a path of one point."""
    order = Window.partitionBy(key).orderBy(ts)
    d = [F.coalesce(F.lead(c).over(order), F.col(c)) - F.coalesce(F.lag(c).over(order), F.col(c)) for c in (y, x)]
    return rows.withColumn("yaw", F.atan2(*d))


def look_at(eye: Sequence[Column], target: Sequence[Column]) -> tuple[Column, Column]:
    """yaw and pitch of the view from one place to another; null if they are the same."""
    dx, dy, dz = (t - e for e, t in zip(eye, target, strict=True))
    flat = F.sqrt(dx * dx + dy * dy)
    apart = (flat > 0) | (dz != 0)
    return F.when(apart, F.atan2(dy, dx)), F.when(apart, F.atan2(dz, flat))


def densify(rows: DataFrame, key: str, ts: str, values: Sequence[str], step: int) -> DataFrame:
    """key, ts, values at every step from each stamp up to the next, linear in between; the last row as it is."""
    order = Window.partitionBy(key).orderBy(ts)
    ahead = rows.select(key, ts, *values, F.lead(ts).over(order).alias("_t"), *[F.lead(v).over(order).alias(f"_{v}") for v in values])
    stamps = F.when(F.col("_t") > F.col(ts), F.sequence(F.col(ts), F.col("_t") - 1, F.lit(step).cast("long"))).otherwise(F.array(F.col(ts)))
    dense = ahead.withColumn("_s", F.explode(stamps))
    share = F.coalesce(F.try_divide((F.col("_s") - F.col(ts)).cast("double"), (F.col("_t") - F.col(ts)).cast("double")), F.lit(0.0))
    return dense.select(key, F.col("_s").alias(ts), *[F.coalesce(F.col(v) + (F.col(f"_{v}") - F.col(v)) * share, F.col(v)).alias(v) for v in values])


def throttle(rows: DataFrame, key: str, ts: str, spacing: int) -> DataFrame:
    """Rows at least spacing after the last one kept, from the first on: an ordered fold whose state is one stamp."""
    stamps = rows.select(key, ts).distinct()

    def step(last: int | None, row: tuple) -> tuple[int, list[tuple]]:
        return (row[1], [row]) if last is None or row[1] >= last + spacing else (last, [])

    return rows.join(ordered_fold(stamps, [key], [ts], step, lambda _: [], stamps.schema), [key, ts], "left_semi")


def slices(rows: DataFrame, map_time: str, query_time: str) -> DataFrame:
    """Of a map-time by query-time table: column slice with robot (newest map), query (first query) and online (equal)."""
    ends = rows.agg(F.max(map_time).alias("_newest"), F.min(query_time).alias("_earliest"))
    named = F.array_compact(F.array(F.when(F.col(map_time) == F.col("_newest"), "robot"), F.when(F.col(query_time) == F.col("_earliest"), "query"), F.when(F.col(map_time) == F.col(query_time), "online")))
    return rows.crossJoin(F.broadcast(ends)).withColumn("slice", F.explode(named)).drop("_newest", "_earliest")  # ends is one row


def non_increasing(rows: DataFrame, keys: Sequence[str], ts: str, tie: Column | None = None) -> DataFrame:
    """The rows whose stamp is not after the one before them in the order of tie."""
    order = Window.partitionBy(*keys).orderBy(tie if tie is not None else F.col(ts))
    return rows.withColumn("_before", F.lag(ts).over(order)).where(F.col(ts) <= F.col("_before")).drop("_before")

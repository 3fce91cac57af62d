"""Robust statistics: alignment by median residuals, plane snapping, buckets, feature means, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gridjoin import XYZ, pairs


def translation(left: DataFrame, right: DataFrame, radius: float, *, vid: str = "vid", key: str = "label", coords: Sequence[str] = XYZ, most: float, gain: float) -> DataFrame:
    """key, n, d<coord>, before, after, accepted: the median residual of nearest neighbours, per axis, no longer than most; it
    is accepted if the median distance gains at least so much."""
    near = pairs(left, right, radius, left_id=vid, right_id=vid, coords=coords, equal=[key])
    best = near.groupBy(vid, key).agg(F.min(F.struct("d2", F.col(f"right_{vid}").alias("id"))).alias("b")).select(vid, key, F.col("b.id").alias("_id"), F.sqrt("b.d2").alias("_d"))
    met = best.join(left.select(vid, *coords), vid).join(right.select(F.col(vid).alias("_id"), *[F.col(c).alias(f"_{c}") for c in coords]), "_id")
    shift = met.groupBy(key).agg(F.count("*").alias("n"), F.median("_d").alias("before"), *[F.median(F.col(f"_{c}") - F.col(c)).alias(f"m{c}") for c in coords])
    norm = F.sqrt(sum((F.col(f"m{c}") * F.col(f"m{c}") for c in coords), F.lit(0.0)))
    shift = shift.withColumn("_s", F.when(norm > most, most / norm).otherwise(F.lit(1.0)))
    shift = shift.select(key, "n", "before", *[(F.col(f"m{c}") * F.col("_s")).alias(f"d{c}") for c in coords])
    moved = met.join(shift, key)
    rest = F.sqrt(sum(((F.col(f"_{c}") - F.col(c) - F.col(f"d{c}")) * (F.col(f"_{c}") - F.col(c) - F.col(f"d{c}")) for c in coords), F.lit(0.0)))
    after = moved.groupBy(key).agg(F.median(rest).alias("after"))
    return shift.join(after, key).select(key, "n", *[f"d{c}" for c in coords], "before", "after", (F.col("before") - F.col("after") >= gain).alias("accepted"))


def snap(points: DataFrame, key: str, flat: Column, *, z: str = "z", wall: str = "x", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """points with snapped: flat classes go to the median height of their key, others to the nearer of two quantile planes."""
    planes = points.groupBy(key).agg(F.median(z).alias("_m"), F.percentile(wall, F.lit(low)).alias("_a"), F.percentile(wall, F.lit(high)).alias("_b"))
    nearer = F.when(F.abs(F.col(wall) - F.col("_a")) <= F.abs(F.col(wall) - F.col("_b")), F.col("_a")).otherwise(F.col("_b"))
    return points.join(planes, key).withColumn("snapped", F.when(flat, F.col("_m")).otherwise(nearer)).drop("_m", "_a", "_b")


def buckets(rows: DataFrame, keys: Sequence[str], value: Column, width: float, error: Column) -> DataFrame:
    """keys, bucket, n, mean, worst: errors by bins of a value."""
    return rows.groupBy(*keys, F.floor(value / width).alias("bucket")).agg(F.count("*").alias("n"), F.avg(error).alias("mean"), F.max(error).alias("worst"))


def mean_feature(rows: DataFrame, key: str, feature: str, weight: Column) -> DataFrame:
    """key, position, value, n: weighted mean of each element; rows without a feature don't count."""
    flat = rows.where(F.col(feature).isNotNull()).select(key, weight.cast("double").alias("_w"), F.posexplode(feature).alias("position", "_v"))
    return flat.groupBy(key, "position").agg((F.sum(F.col("_v").cast("double") * F.col("_w")) / F.sum("_w")).alias("value"), F.count("*").alias("n"))


def linspace(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """At most n rows of each key at even distances in the order, the first and the last among them."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumns({"_k": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(max(1, n - 1))))
    return placed.where((F.col("_n") <= n) | F.array_contains(at, F.col("_k").cast("long"))).drop("_k", "_n")


def every(rows: DataFrame, index: str, stride: int, start: int = 0) -> DataFrame:
    return rows.where((F.col(index) >= start) & ((F.col(index) - start) % stride == 0))


def newest(rows: DataFrame, keys: Sequence[str], ts: str, n: int, stride: int = 1) -> DataFrame:
    """The newest n of every stride-th row of each key, with the newest row in the last place whether it is one or not.

    Windows with a limit on the rank keep n rows per key and task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(ts)
    placed = rows.withColumn("_k", F.row_number().over(order) - 1)
    last = F.max("_k").over(Window.partitionBy(*keys))
    stored = placed.withColumn("_last", last).where((F.col("_k") % stride == 0) | (F.col("_k") == F.col("_last")))
    return stored.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc()))).where(F.col("_n") <= n).drop("_k", "_n", "_last")


def remap(rows: DataFrame, rules: DataFrame, key: str, at: str, *, value: str, low: str = "lo", high: str = "hi") -> DataFrame:
    """rows whose value is replaced by that of the rule of their key whose closed interval holds their position."""
    r = rules.select(F.col(key).alias("_k"), low, high, F.col(value).alias("_v"))
    met = rows.join(r, (F.col(key) == F.col("_k")) & F.col(at).between(F.col(low), F.col(high)), "left")
    return met.withColumn(value, F.coalesce("_v", value)).drop("_k", "_v", low, high)


def fresh_ids(rows: DataFrame, taken: DataFrame, node: str) -> DataFrame:
    """rows with new_id: a node whose id is taken gets one above all others, in the order of the ids."""
    from .mesh import renumber

    top = rows.select(node).unionByName(taken.select(node)).agg(F.max(node)).scalar()
    clash = rows.join(taken.select(node).distinct(), node, "left_semi").select(node).distinct()
    new = renumber(clash, [], vid=node).select(node, (top + 1 + F.col("target")).alias("_new"))
    return rows.join(new, node, "left").withColumn("new_id", F.coalesce("_new", node)).drop("_new")


def restored(prior: DataFrame, current: DataFrame, node: str, state: str, states: Sequence[str]) -> DataFrame:
    """node, new_id of the prior nodes in one of the states, with fresh ids where the current ones have theirs."""
    return fresh_ids(prior.where(F.col(state).isin(list(states))).select(node), current.select(node), node)


def span(rows: DataFrame, order: Sequence[str], start: int, n: int) -> DataFrame:
    """n rows from a place in the order on, from 0."""
    return rows.orderBy(*order).offset(start).limit(n)


def random_rows(rows: DataFrame, keys: Sequence[str], index: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each key, as if drawn at random; the same ones each time. The limit on the rank is pushed below the shuffle."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(index).cast("string")).cast("binary"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(draw, index))).where(F.col("_n") <= n).drop("_n")

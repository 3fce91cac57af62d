"""Quality of a reconstructed state: cardinality, confusion, detection and surface metrics. Null where a rate is undefined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gridjoin import XYZ, nearest


def segmentation(links: DataFrame, left: str, right: str) -> DataFrame:
    """n_over, mean_over, max_over, n_under, mean_under, max_under: entities with several counterparts, either way."""
    sides = []
    for name, key in (("over", right), ("under", left)):
        n = links.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        sides.append(n.agg(F.count("*").alias(f"n_{name}"), F.avg("n").alias(f"mean_{name}"), F.max("n").alias(f"max_{name}")))
    return sides[0].crossJoin(sides[1])  # one row each


def confusion(rows: DataFrame, truth: str, found: str, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn of two flags."""
    t, f = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(found), F.lit(False))
    counts = [F.count_if(x).alias(n) for n, x in (("tp", t & f), ("fp", ~t & f), ("tn", ~t & ~f), ("fn", t & ~f))]
    return rows.groupBy(*keys).agg(*counts) if keys else rows.agg(*counts)


def detection(truth: DataFrame, found: DataFrame, forward: DataFrame, backward: DataFrame, truth_id: str, found_id: str) -> DataFrame:
    """detected, missed (truth without a counterpart), hallucinated (found without one)."""
    hit = truth.select(truth_id).join(forward.select(truth_id).distinct().withColumn("_f", F.lit(1)), truth_id, "left")
    real = found.select(found_id).join(backward.select(found_id).distinct().withColumn("_b", F.lit(1)), found_id, "left")
    return hit.agg(F.count("_f").alias("detected"), (F.count("*") - F.count("_f")).alias("missed")).crossJoin(real.agg((F.count("*") - F.count("_b")).alias("hallucinated")))


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """precision, recall, f1."""
    tp, fp, fn = (c.cast("double") for c in (tp, fp, fn))
    return F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(2 * tp, 2 * tp + fp + fn)


def surface(found: DataFrame, truth: DataFrame, thresholds: Sequence[float], *, found_id: str, truth_id: str, keys: Sequence[str] = (), coords: Sequence[str] = XYZ) -> DataFrame:
    """keys, threshold, n, inliers, share, rmse, mad: distances to the nearest truth point; errors over inliers only.

    One join at the largest threshold serves all of them."""
    near = nearest(found, truth, max(thresholds), left_id=found_id, right_id=truth_id, coords=coords)
    at = found.select(found_id, *keys).join(near.select(found_id, "distance"), found_id, "left").withColumn("threshold", F.explode(F.array(*map(F.lit, map(float, thresholds)))))
    d = F.when(F.col("distance") <= F.col("threshold"), F.col("distance"))
    return at.groupBy(*keys, "threshold").agg(F.count("*").alias("n"), F.count(d).alias("inliers"), (F.count(d) / F.count("*")).alias("share"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("mad"))


def chamfer(forward: Column, backward: Column) -> Column:
    return (forward + backward) / 2


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, mean, std, low, high over values that are numbers; the population's deviation."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))


def distinct_targets(links: DataFrame, source: str, target: str, order: Sequence[str]) -> DataFrame:
    """The first link, in order, of each source and of those the first to each target: no target counts twice."""
    row = F.struct(*[F.col(c) for c in links.columns])
    first = links.groupBy(source).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")
    return first.groupBy(target).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def rates_with(tp: Column, fp: Column, fn: Column, missed: Column, hallucinated: Column) -> tuple[Column, Column, Column]:
    """precision, recall, f1 in which what was not detected at all counts too."""
    return rates(tp, fp + hallucinated, fn + missed)

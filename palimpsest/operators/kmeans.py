"""Robust k-means per group: seeded far apart, moved to means, then three times to medians, which outliers do not pull.

Rows never come together: a round deals them to centres, which are few, and takes partial sums; medians rank each centre's rows by a
spilling sort. Rounds are written tables, as many as it takes until no row changes its centre, iterations at most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import saved
from .gridjoin import XYZ
from .linkage import medians


def _d2(at: Column | None, coords: Sequence[str]) -> Column:
    parts = [(F.col(c) - (at[c] if at is not None else F.col(f"_{c}"))) ** 2 for c in coords]
    return sum(parts[1:], parts[0])


def assigned(points: DataFrame, centres: DataFrame, group: str, coords: Sequence[str] = XYZ) -> DataFrame:
    """points with cluster, the nearest centre of their group, the smaller number on a tie. centres: group, cluster, coords."""
    few = centres.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("cluster", *coords))).alias("_centres"))  # count of them
    near = F.array_min(F.transform("_centres", lambda c: F.struct(_d2(c, coords).alias("d"), c["cluster"].alias("k"))))
    return points.join(few, group).withColumn("cluster", near["k"]).drop("_centres")


def seeded(points: DataFrame, count: int, group: str, vid: str = "vid", coords: Sequence[str] = XYZ, seed: int = 104729) -> DataFrame:
    """group, cluster (0 to count - 1), coords: each next centre is a row drawn with a chance in proportion to its squared distance from
    the nearest centre so far. The draw is a race: the least of -log(u) / d2, u by a hash of the row's id and the round, which
    no partitioning changes. A group of fewer distinct places than count gets no more centres than places."""
    least: Column | None = None
    at, centres = points.select(group, vid, *coords).dropna(), None
    for k in range(count):
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(vid)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
        race = -F.log(u) if least is None else F.when(least > 0, -F.log(u) / least)
        first = at.withColumn("_race", race).where("_race is not null").groupBy(group).agg(F.min(F.struct("_race", vid, *coords)).alias("s"))
        new = saved(first.select(group, F.lit(k).cast("long").alias("cluster"), *[F.col(f"s.{c}").alias(c) for c in coords]), "seeds")
        centres = new if centres is None else centres.unionByName(new)
        if k + 1 < count:
            met = at.join(new.select(group, *[F.col(c).alias(f"_{c}") for c in coords]), group, "left")
            d2 = F.coalesce(_d2(None, coords), F.lit(float("inf"))) if "_least" not in at.columns else F.least("_least", F.coalesce(_d2(None, coords), F.col("_least")))
            at = saved(met.select(group, vid, *coords, d2.alias("_least")), "distances")
            least = F.col("_least")
    return centres


def _moved(points: DataFrame, centres: DataFrame, group: str, coords: Sequence[str], median: bool) -> DataFrame:
    """The centres at the means or medians of what is nearest to them; one that nothing is nearest to stays."""
    own = saved(assigned(points.select(group, *coords), centres, group, coords), "assigned")
    new = medians(own, [group, "cluster"], coords) if median else own.groupBy(group, "cluster").agg(*[F.avg(c).alias(c) for c in coords])
    new = new.select(group, "cluster", *[F.col(c).alias(f"_{c}") for c in coords])
    return saved(centres.join(new, [group, "cluster"], "left").select(group, "cluster", *[F.coalesce(f"_{c}", c).alias(c) for c in coords]), "centres")


def robust_kmeans(points: DataFrame, count: int, group: str, *, first: DataFrame | None = None, vid: str = "vid", coords: Sequence[str] = XYZ, iterations: int = 60, refinements: int = 3, seed: int = 104729) -> DataFrame:
    """group, cluster, coords: count centres a group. first: the centres to begin with (group, cluster, coords), else they are seeded. Rows
    without a place are left out. A group of fewer rows than count is an error."""
    own = points.select(group, vid, *coords).dropna()
    small = own.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < count).orderBy("n").limit(5).collect()
    if small:
        raise ValueError(f"{count} centres need as many rows: " + ", ".join(f"{r[0]} has {r[1]}" for r in small))
    now = first.select(group, "cluster", *[F.col(c).cast("double") for c in coords]) if first is not None else seeded(own, count, group, vid, coords, seed)
    for _ in range(iterations):
        new = _moved(own, now, group, coords, False)
        same = new.join(now.select(group, "cluster", *[F.col(c).alias(f"_{c}") for c in coords]), [group, "cluster"]).where(_d2(None, coords) > 0).isEmpty()
        now = new
        if same:
            break
    for _ in range(refinements):
        now = _moved(own, now, group, coords, True)
    return now

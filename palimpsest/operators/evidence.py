"""Change detection from evidence in time bins: present, absent or inconclusive."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ("present", "absent", "inconclusive")


@dataclass(frozen=True)
class Scan:
    """resolution: width of a bin; window: bins looked at from each; thresholds are passed only strictly."""

    resolution: int
    window: int = 1
    absence: float = 0.5
    presence: float = 0.5
    relative: bool = True
    physical: bool = False

    def __post_init__(self) -> None:
        if self.resolution <= 0 or self.window < 1:
            raise ValueError("resolution and window are positive")


def bins(evidence: DataFrame, keys: Sequence[str], ts: str, verdict: str, resolution: int) -> DataFrame:
    """keys, bin, present, absent, inconclusive: counts of each bin that has evidence; a partial aggregation per task."""
    counts = [F.count_if(F.col(verdict) == v).alias(v) for v in VERDICTS]
    return evidence.where(F.col(verdict).isin(*VERDICTS)).groupBy(*keys, F.expr(f"`{ts}` div {int(resolution)}L").alias("bin")).agg(*counts)


def scan_bins(counts: DataFrame, keys: Sequence[str], scan: Scan, *, forward: bool = True) -> DataFrame:
    """keys, closest_absent, furthest_persistent: the first bin whose window shows absence, and the last before it that
    shows presence, in the direction of the scan. Only bins with data are looked from. Null: none."""
    data = counts if scan.physical else counts.where("present + absent > 0")
    order = Window.partitionBy(*keys).orderBy("bin")
    span = order.rangeBetween(0, scan.window - 1) if forward else order.rangeBetween(1 - scan.window, 0)
    near = data.select(*keys, "bin", *[F.sum(v).over(span).alias(v) for v in VERDICTS])
    total = F.col("present") + F.col("absent") + (F.col("inconclusive") if scan.physical else F.lit(0))
    share = (lambda v: F.col(v) / total) if scan.relative else F.col
    gone, there = share("absent") > scan.absence, share("present") > scan.presence
    stop = (F.min if forward else F.max)(F.when(F.col("gone"), F.col("bin"))).over(Window.partitionBy(*keys))
    marked = near.select(*keys, "bin", gone.alias("gone"), there.alias("there")).withColumn("stop", stop)
    before = F.col("stop").isNull() | (F.col("bin") < F.col("stop") if forward else F.col("bin") > F.col("stop"))
    far = (F.max if forward else F.min)(F.when(F.col("there") & before, F.col("bin")))
    return marked.groupBy(*keys).agg((F.first("stop") * scan.resolution).alias("closest_absent"), (far * scan.resolution).alias("furthest_persistent"))


def scan(evidence: DataFrame, keys: Sequence[str], ts: str, verdict: str, scan: Scan, *, forward: bool = True) -> DataFrame:
    return scan_bins(bins(evidence, keys, ts, verdict, scan.resolution), keys, scan, forward=forward)


def object_changes(objects: DataFrame, evidence: DataFrame, key: str, ts: str, verdict: str, rule: Scan, *, first: str = "obs_first", last: str = "obs_last", margin: int = 0) -> DataFrame:
    """key, first_absent, first_persistent, last_absent, last_persistent: a backward scan of the evidence before the
    object's observation and a forward one of that after it, each at least margin away. All objects are returned."""
    met = evidence.join(objects.select(key, first, last), key)
    before = scan(met.where(F.col(ts) <= F.greatest(F.col(first) - margin, F.lit(0))), [key], ts, verdict, rule, forward=False)
    after = scan(met.where(F.col(ts) >= F.col(last) + margin), [key], ts, verdict, rule)
    before = before.select(key, F.col("closest_absent").alias("first_absent"), F.col("furthest_persistent").alias("first_persistent"))
    after = after.select(key, F.col("closest_absent").alias("last_absent"), F.col("furthest_persistent").alias("last_persistent"))
    return objects.select(key).join(before, key, "left").join(after, key, "left")


def vertex_states(vertices: DataFrame, evidence: DataFrame, key: str, ts: str, verdict: str, rule: Scan, *, last: str = "last_seen", margin: int = 0) -> DataFrame:
    """key, state: Absent, Persistent or Unobserved after each vertex was last seen."""
    met = evidence.join(vertices.select(key, last), key).where(F.col(ts) >= F.col(last) + margin)
    found = scan(met, [key], ts, verdict, rule)
    state = F.when(F.col("closest_absent").isNotNull(), "Absent").when(F.col("furthest_persistent").isNotNull(), "Persistent").otherwise("Unobserved")
    return vertices.select(key).join(found, key, "left").select(key, state.alias("state"))


def verify_current(evidence: DataFrame, keys: Sequence[str], verdict: str) -> DataFrame:
    """keys, event: any presence supports the current state; only absence contradicts it; neither gives no row."""
    seen = evidence.groupBy(*keys).agg(F.bool_or(F.col(verdict) == "present").alias("there"), F.bool_or(F.col(verdict) == "absent").alias("gone"))
    return seen.where("there or gone").select(*keys, F.when(F.col("there"), "support").otherwise("contradict").alias("event"))

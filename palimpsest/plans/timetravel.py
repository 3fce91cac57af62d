"""Time travel over snapshots and bitemporal rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.presence import is_present


def snapshot_stamp(snapshots: DataFrame, times: DataFrame, stamp: str, t: str, *, later: bool = True, most: int = 100_000) -> DataFrame:
    """t, stamp: the snapshot that answers each query time, clamped to the timeline: the first one at or after it, which
    knows most (later), or else the last one at or before it. The timeline's stamps, a few per session, meet the times as
    one sorted array in each row of a single-row side; more than most of them are an error."""
    if snapshots.select(stamp).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} snapshots")
    line = snapshots.agg(F.array_sort(F.collect_set(stamp)).alias("_line"))
    met = times.crossJoin(F.broadcast(line))  # one row: the timeline, one long per snapshot
    at = F.filter("_line", lambda s: s >= F.col(t)) if later else F.filter("_line", lambda s: s <= F.col(t))
    pick = F.get(at, F.lit(0)) if later else F.element_at(at, -1)
    clamp = F.element_at("_line", -1) if later else F.get("_line", F.lit(0))
    return met.select(t, F.coalesce(F.when(F.size(at) > 0, pick), clamp).alias(stamp))


def vertices_at(vertices: DataFrame, t: Column, first: str = "first_seen") -> DataFrame:
    return vertices.where(F.col(first) <= t)


def objects_at(objects: DataFrame, t: Column, *, effective: Column, first: str = "first", last: str = "last") -> DataFrame:
    """Objects known at t and present then."""
    return objects.where((effective <= t) & is_present(F.col(first), F.col(last), t))


def history_at(rows: DataFrame, t: Column, keys: Sequence[str], ts: str) -> DataFrame:
    """Each entity's newest row at or before t; a partial aggregation per task."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.where(F.col(ts) <= t).groupBy(*keys).agg(F.max_by(row, ts).alias("_r")).select("_r.*")


def trimmed(trajectory: Column, t: Column, ts: str = "ts") -> Column:
    """An array of structs cut to stamps at or before t."""
    return F.filter(trajectory, lambda p: p[ts] <= t)


def sample_times(first: int, last: int, period: int, stride: int = 1) -> Column:
    return F.sequence(F.lit(first), F.lit(last), F.lit(period * stride))


def append_snapshot(timeline: DataFrame, snapshot: DataFrame, stamp: str) -> DataFrame:
    """timeline with a snapshot added: an equal stamp is replaced, an earlier one is an error."""
    newest = timeline.agg(F.max(stamp)).first()[0]
    oldest = snapshot.agg(F.min(stamp)).first()[0]
    if newest is not None and oldest is not None and oldest < newest:
        raise ValueError(f"snapshot {oldest} is older than the timeline's {newest}")
    return timeline.join(snapshot.select(stamp).distinct(), stamp, "left_anti").unionByName(snapshot)

"""Tracks of identified and of moving things: association frame by frame, motion states, and what may be extracted."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import PARTS, ROWS_OF_A_TASK, saved
from .association import nearest_in_order, rounds_of_pairs
from .gridjoin import XYZ, pairs


def identified(clusters: DataFrame, frame: str, identity: str, order: str) -> DataFrame:
    """The clusters of known identity, the first of each frame and identity: further ones are duplicates."""
    row = F.struct(*[F.col(c) for c in clusters.columns])
    return clusters.where(F.col(identity).isNotNull()).groupBy(frame, identity).agg(F.min_by(row, order).alias("_r")).select("_r.*")


def motion_of(overlaps: DataFrame, frame: str, cluster: str, motion: str, score: str, *, least: float) -> DataFrame:
    """frame, cluster, motion, score: within a frame, clusters in order take the motion cluster that overlaps them most, of
    those that are free; the overlap is above 0 and at least least, and of equal ones the last counts."""
    open_ = overlaps.where((F.col(score) >= least) & (F.col(score) > 0))
    return rounds_of_pairs(open_, cluster, motion, [F.col(score).desc(), F.col(motion).desc()], [F.col(cluster).asc()], group=[frame], keep=[score])


def nearest_tracks(tracks: DataFrame, clusters: DataFrame, reach: float, *, track: str, cluster: str, frame: Sequence[str] = (), strict: bool = False, coords: Sequence[str] = XYZ, most: int = ROWS_OF_A_TASK) -> DataFrame:
    """frame, track, cluster, d2: tracks in order take the nearest cluster within reach that is free (strict: below it).

    Frames of at most most tracks and clusters are settled in tasks, from the places and without pairs: a track looks through the clusters
    that are near along the first axis. Larger ones are matched in rounds, over all their pairs within reach."""
    other = cluster if track != cluster else f"right_{cluster}"
    a = tracks.select(*frame, track, *coords).dropna(subset=[*frame, track])
    b = clusters.select(*frame, F.col(cluster).alias(other), *coords).dropna(subset=[*frame, other])
    sizes = a.select(*frame, F.lit(1).alias("_n")).unionByName(b.select(*frame, F.lit(1).alias("_n"))).groupBy(*frame).agg(F.count("*").alias("_n"))
    rows, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    small, matched = [a, b], None
    if (largest or 0) > most:
        big = saved(sizes.where(F.col("_n") > most), "frames").select(*frame)
        kept = lambda df, how: df.join(big, list(frame), how) if frame else df if how == "left_semi" else df.limit(0)
        near = pairs(kept(a, "left_semi"), kept(b, "left_semi"), reach, left_id=track, right_id=other, coords=coords, equal=frame)
        near = near.where(F.col("d2") < reach * reach) if strict else near
        matched = rounds_of_pairs(near.withColumnRenamed(f"right_{other}", other), track, other, [F.col("d2").asc(), F.col(other).asc()], [F.col(track).asc()], group=list(frame), keep=["d2"])
        small = [kept(df, "left_anti") for df in small]
    parts = max(PARTS, -(-(rows or 0) // most))

    def settle(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        groups = (lambda df: df.groupby(list(frame), sort=False).indices) if frame else (lambda df: {(): np.arange(len(df))})
        of_right, taken = groups(right), []
        at_l, at_r = (df[list(coords)].to_numpy(float) for df in (left, right))
        for key, l in groups(left).items():  # noqa: E741
            if len(r := of_right.get(key, ())):
                taken += [(l[i], r[j], d2) for i, j, d2 in nearest_in_order(left[track].to_numpy()[l], at_l[l], right[other].to_numpy()[r], at_r[r], reach, strict=strict)]
        i, j, d2 = zip(*taken, strict=True) if taken else ((), (), ())
        out = left.iloc[list(i)][[*frame, track]].reset_index(drop=True)
        return out.assign(**{other: right[other].iloc[list(j)].to_numpy(), "d2": np.array(d2, float)})

    part = F.pmod(F.xxhash64(*frame), F.lit(parts)) if frame else F.lit(0)
    # columns of their own: both may come from one table
    left, right = (df.toDF(*df.columns).withColumn("_part", part).repartition(parts, "_part").groupBy("_part") for df in small)
    fields = [*a.select(*frame, track).schema.fields, b.schema[other], T.StructField("d2", T.DoubleType())]
    settled = left.cogroup(right).applyInPandas(settle, T.StructType(fields))
    return settled if matched is None else settled.unionByName(matched)


def motion_states(observations: DataFrame, track: str, ts: str, moving: Column, settle: int) -> DataFrame:
    """observations with is_dynamic, has_history and last_motion. A track becomes dynamic when it moves, and static at the
    first sight without motion at least settle after the last one with it; that it has moved is never forgotten."""
    order = Window.partitionBy(track).orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(moving, F.col(ts))).over(order)
    out = observations.withColumn("last_motion", last).withColumn("has_history", F.col("last_motion").isNotNull())
    return out.withColumn("is_dynamic", F.coalesce((F.col(ts) == F.col("last_motion")) | (F.col(ts) < F.col("last_motion") + settle), F.lit(False)))


def extraction(tracks: DataFrame, *, displacement: Column, dynamic: Column, history: Column, identity: Column, semantic_dynamic: Column, least: float, accept_semantic: bool) -> Column:
    """What is extracted of a track: a dynamic object, a static one, or nothing. An identified track that hardly moved is static
    after all; another one is dropped, unless its class moves by itself and that is accepted."""
    low = displacement < least
    kept = semantic_dynamic if accept_semantic else F.lit(False)
    return F.when(identity.isNotNull() & (dynamic | history) & low, "static").when(~dynamic, "static").when(low & ~F.coalesce(kept, F.lit(False)), "dropped").otherwise("dynamic")


def after_motion(observations: DataFrame, ts: str, last_motion: str) -> DataFrame:
    """The observations after the last motion, all if there was none."""
    return observations.where(F.col(last_motion).isNull() | (F.col(ts) > F.col(last_motion)))


def valid(tracks: DataFrame, confidence: Column, least: float) -> DataFrame:
    """The tracks of more than the least confidence."""
    return tracks.where(confidence > least)


def spaced(rows: DataFrame, key: Sequence[str], ts: str, spacing: int) -> DataFrame:
    """The input gate: rows whose stamp is at least spacing after the last accepted one."""
    from .fold import ordered_fold

    stamps = rows.select(*key, ts).distinct()
    k = len(key)

    def step(last: int | None, row: tuple) -> tuple[int, list[tuple]]:
        return (row[k], [row]) if last is None or row[k] >= last + spacing else (last, [])

    return rows.join(ordered_fold(stamps, list(key), [ts], step, lambda _: [], stamps.schema), [*key, ts], "left_semi")


def referenced(frames: DataFrame, tracks: DataFrame, stamp: str, track: str, *, now: int, window: int) -> DataFrame:
    """The frames that a live track refers to, and those of the active window: what a buffer keeps."""
    used = tracks.select(F.col(stamp)).distinct().withColumn("_used", F.lit(True))
    return frames.join(used, stamp, "left").where(F.coalesce("_used", F.lit(False)) | (F.col(stamp) >= now - window)).drop("_used")

"""Labelled pixels: which of them count, regions, and labels that go from one view to another."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import plane_key, squared_distance
from ..plans.scratch import PARTS, saved
from .gridjoin import DENSE, LISTED, XYZ, cell, spread


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def valid_depth(depth: Column, most: float, least: float = 0.05) -> Column:
    return finite(depth) & (depth > least) & (depth < most)


def valid_measurement(distance: Column, vertex: Sequence[Column], *, sensor: tuple[float, float], detector: float = 0.0) -> Column:
    """Whether a pixel's range and vertex are finite and within the sensor's and, if there is one, the detector's range."""
    ok = finite(distance) & (distance > 0) & distance.between(*sensor)
    if detector > 0:
        ok = ok & (distance <= detector)
    for c in vertex:
        ok = ok & finite(c)
    return ok


def candidates(pixels: DataFrame, classes: DataFrame, label: str, *, promote_dynamic: bool) -> DataFrame:
    """The pixels whose class is one of objects or, if these are promoted, of what moves. classes: label, is_object, is_dynamic."""
    wanted = F.col("is_object") | F.col("is_dynamic") if promote_dynamic else F.col("is_object")
    return pixels.join(classes.where(wanted).select(label), label, "left_semi")


def background(pixels: DataFrame, classes: DataFrame, label: str, dynamic: Column) -> DataFrame:
    """The pixels that go into the background: neither of an object's or a moving thing's class, nor seen to move."""
    return pixels.where(~F.coalesce(dynamic, F.lit(False))).join(classes.where("is_object or is_dynamic").select(label), label, "left_anti")


def by_volume(bounds: DataFrame, low: Sequence[str], high: Sequence[str], least: float, most: float = 0.0) -> DataFrame:
    """bounds with volume, of clusters within the limits; most 0 means no upper one."""
    v = F.lit(1.0)
    for a, b in zip(low, high, strict=True):
        v = v * (F.col(b) - F.col(a))
    sized = bounds.withColumn("volume", v).where(F.col("volume") >= least)
    return sized.where(F.col("volume") <= most) if most > 0 else sized


def reprojected_iou(clusters: DataFrame, points: DataFrame, *, cluster: str, track: str, pixel: Sequence[str], u: Column, v: Column) -> DataFrame:
    """cluster, track, common, iou of a cluster's pixels and a track's points as they fall into the image now (u, v; null outside).
    A track counts by its points, seen or not and however many share a pixel."""
    n_points = points.groupBy(track).agg(F.count("*").alias("_np"))
    fallen = points.select(track, u.alias(pixel[0]), v.alias(pixel[1])).dropna().distinct()
    own = clusters.select(cluster, *pixel).distinct()
    n_pixels = own.groupBy(cluster).agg(F.count("*").alias("_nx"))
    common = own.join(fallen, list(pixel)).groupBy(cluster, track).agg(F.count("*").alias("common"))
    return common.join(n_points, track).join(n_pixels, cluster).select(cluster, track, "common", (F.col("common") / (F.col("_nx") + F.col("_np") - F.col("common"))).alias("iou"))


def transfer(source: DataFrame, target: DataFrame, *, pixel: Sequence[str], depth: str, label: str, tolerance: float) -> DataFrame:
    """pixel, label, error: of the source's points that fall on one pixel the nearest counts, if the target's depth there is
    valid and agrees within the tolerance."""
    front = source.groupBy(*pixel).agg(F.min(F.struct(F.col(depth).alias("z"), F.col(label).alias("l"))).alias("_f"))
    met = front.join(target.select(*pixel, F.col(depth).alias("_z")), list(pixel)).where((F.col("_z") > 0) & finite(F.col("_z")))
    return met.select(*pixel, F.col("_f.l").alias(label), F.abs(F.col("_f.z") - F.col("_z")).alias("error")).where(F.col("error") <= tolerance)


def nearest_poses(sparse: DataFrame, dense: DataFrame, reach: float, *, sparse_id: str, dense_id: str, forward: Sequence[str], run: str, turn: float = 0.25, coords: Sequence[str] = XYZ) -> DataFrame:
    """run, sparse_id, dense_id, score, monotone: the run's dense pose of least distance plus turn times the angle between the
    views, of those within reach; monotone: later than that of the run's sparse pose before. Where poses are crowded, which is measured, shorter
    reaches are tried first."""
    keys = ["cell", run]
    own = sparse.select(sparse_id, run, *coords, *forward)
    at = dense.select(F.col(dense_id).alias("d"), run, *coords, *forward)
    crowd = at.groupBy(run, cell(coords, reach)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    reaches = [(reach, crowd)]
    while turn >= 0 and reaches[0][1] > DENSE and len(reaches) < 7:
        reaches.insert(0, (reaches[0][0] / 2, reaches[0][1] // 4))

    def scored(r: float) -> Callable[[Column], Column]:
        def of(p: Column) -> Column:
            d2 = squared_distance([F.col(c) for c in coords], [p[c] for c in coords])
            dot = sum((F.col(c) * p[c] for c in forward), F.lit(0.0))
            score = F.sqrt(d2) + turn * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
            return F.when(d2 <= r * r, F.struct(score.alias("s"), p["d"].alias("d")))

        return of

    def looked_through(left: DataFrame, near: DataFrame, r: float) -> DataFrame:
        """The same of crowded poses, a cell and list in a block of numbers."""
        fields = T.StructType([*sparse.select(run, sparse_id).schema.fields, T.StructField("s", T.DoubleType()), T.StructField("d", dense.schema[dense_id].dataType)])

        def least(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return a[[run, sparse_id]].iloc[:0].assign(s=0.0, d=0)
            b = b.sort_values("d")  # the first of equal scores is the smaller one
            (p, f), (q, g) = ([df[list(c)].to_numpy(float) for c in (coords, forward)] for df in (a, b))
            s, k = np.full(len(a), np.inf), np.zeros(len(a), int)
            step = max(1, 500_000 // len(b))
            for i in range(0, len(a), step):
                own = slice(i, i + step)
                d2 = sum(((p[own, c, None] - q[:, c]) ** 2 for c in range(1, p.shape[1])), (p[own, 0, None] - q[:, 0]) ** 2)
                dot = sum(f[own, c, None] * g[:, c] for c in range(f.shape[1]))
                score = np.where(d2 <= r * r, np.sqrt(d2) + turn * np.arccos(np.fmax(-1.0, np.fmin(1.0, dot))), np.inf)
                k[own] = score.argmin(axis=1)
                s[own] = np.take_along_axis(score, k[own, None], axis=1)[:, 0]
            found = np.isfinite(s)
            return a.loc[found, [run, sparse_id]].assign(s=s[found], d=b["d"].to_numpy()[k[found]])

        # columns of their own: both may come from one table
        dealt = [df.dropna(subset=keys).toDF(*df.columns).repartition(PARTS, *keys, "_list").groupBy(*keys, "_list") for df in (left, near)]
        return dealt[0].cogroup(dealt[1]).applyInPandas(least, fields).select(run, sparse_id, F.struct("s", "d").alias("_b"))

    out = None
    for r, most in reaches:
        a = own.withColumn("cell", cell(coords, r))
        lists = max(1, -(-most * 3 ** len(coords) // LISTED))
        # the dense poses around a cell are lists there: a sparse one looks through them, pairs are not shuffled
        near = spread(at, coords, r).withColumn("_list", F.pmod(F.xxhash64("d"), F.lit(lists)))
        if len(reaches) > 1:
            met = looked_through(a.withColumn("_list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long")))), near.join(a.select(*keys).distinct(), keys, "left_semi"), r)
        else:
            listed = near.groupBy(*keys, "_list").agg(F.collect_list(F.struct("d", *coords, *forward)).alias("_near"))
            met = a.join(listed, keys).select(run, sparse_id, F.array_min(F.transform("_near", scored(r))).alias("_b")).where("_b is not null")  # null entries do not count
        best = met.groupBy(run, sparse_id).agg(F.min("_b").alias("_b"))
        found = best.select(run, sparse_id, F.col("_b.d").alias(f"right_{dense_id}"), F.col("_b.s").alias("score"))
        if r < reach:
            # whatever is farther scores more than its distance, so a score within this reach is the least
            found = saved(found.where(F.col("score") < r), "poses")
            own = own.join(found.select(run, sparse_id), [run, sparse_id], "left_anti")
        out = found if out is None else out.unionByName(found)
    before = F.lag(f"right_{dense_id}").over(Window.partitionBy(run).orderBy(sparse_id))
    return out.withColumn("monotone", F.coalesce(F.col(f"right_{dense_id}") > before, F.lit(True)))


def temporal_identity(masks: DataFrame, previous: DataFrame, *, mask: str, pixel: Sequence[str], identity: str, least: int, share: float) -> DataFrame:
    """mask, identity, overlap, ratio: the identity that most of a mask's pixels had before (the larger one on a tie), if that is
    at least least pixels and share of the mask."""
    size = masks.groupBy(mask).agg(F.count("*").alias("_n"))
    met = masks.join(previous.select(*pixel, identity), list(pixel)).groupBy(mask, identity).agg(F.count("*").alias("overlap"))
    best = met.groupBy(mask).agg(F.max(F.struct("overlap", identity)).alias("_b")).join(size, mask)
    ratio = F.col("_b.overlap") / F.col("_n")
    return best.select(mask, F.col(f"_b.{identity}").alias(identity), F.col("_b.overlap").alias("overlap"), ratio.alias("ratio")).where((F.col("overlap") >= least) & (F.col("ratio") >= share))


def chosen_identity(masks: DataFrame, temporal: DataFrame, world: DataFrame, projected: DataFrame, *, mask: str, identity: str) -> DataFrame:
    """mask, identity, how: by overlap, else by the world's centres, else by the image's; 0 and none where nothing fits."""
    met = masks.select(mask).distinct()
    for name, found in (("overlap", temporal), ("world", world), ("projection", projected)):
        met = met.join(found.select(mask, F.col(identity).alias(f"_{name}")), mask, "left")
    names = ("overlap", "world", "projection")
    how = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in names], F.lit("none"))
    return met.select(mask, F.coalesce(*[F.col(f"_{n}") for n in names], F.lit(0)).alias(identity), how.alias("how"))


def visible_poses(poses: DataFrame, *, hits: Column, samples: Column, depth: Column, least_ratio: float, near: float | None = None, far: float | None = None) -> DataFrame:
    """The poses with at least that share of hits, whose median depth is within the bounds; an unknown depth breaks a bound."""
    ok = F.coalesce(hits / samples >= least_ratio, F.lit(False))
    for bound, inside in ((near, depth >= near if near is not None else None), (far, depth <= far if far is not None else None)):
        if bound is not None:
            ok = ok & F.coalesce(inside, F.lit(False))
    return poses.where(ok)


def pixel_of(x: Column) -> Column:
    """The nearest pixel, halves away from zero."""
    return plane_key(x, 1.0)

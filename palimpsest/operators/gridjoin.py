"""Joins by distance as equi-joins on grid cells: never a nested loop over all pairs.

The right side is repeated into the 27 cells around each point and the left side looks up its own cell, so all pairs within
the cell size meet. Distances are compared as squares; limits are closed."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import pack_voxel, squared_distance, voxel

XYZ = ("x", "y", "z")


def _around(n: int = 3) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for d, a in zip(step, "ijk", strict=False)]) for step in product((-1, 0, 1), repeat=n)]))


def _packed(axes: Sequence[Column]) -> Column:
    return pack_voxel(*axes, *[F.lit(0).cast("long")] * (3 - len(axes)))


def cell(coords: Sequence[str], size: float) -> Column:
    return _packed([voxel(F.col(c), size) for c in coords])


def spread(df: DataFrame, coords: Sequence[str], size: float) -> DataFrame:
    """df once for each of the 27 cells around its points (of two coordinates 9, of one 3), in column cell."""
    return df.withColumn("_d", _around(len(coords))).withColumn("cell", _packed([voxel(F.col(c), size) + F.col(f"_d.{d}") for c, d in zip(coords, "ijk", strict=False)])).drop("_d")


def pairs(left: DataFrame, right: DataFrame, radius: float, *, left_id: str, right_id: str, coords: Sequence[str] = XYZ, equal: Sequence[str] = (), differ: str | None = None) -> DataFrame:
    """left_id, right_id (as right_<right_id>), d2 for all pairs within the radius that agree on the columns in equal and,
    if given, differ in one other."""
    more = [differ] if differ else []
    a = left.select(left_id, *equal, *more, *coords).withColumn("cell", cell(coords, radius))
    b = spread(right.select(F.col(right_id).alias(f"right_{right_id}"), *equal, *[F.col(c).alias(f"_{c}") for c in (*more, *coords)]), [f"_{c}" for c in coords], radius)
    d2 = squared_distance([F.col(c) for c in coords], [F.col(f"_{c}") for c in coords])
    met = a.join(b, ["cell", *equal])
    for c in more:
        met = met.where(F.col(c) != F.col(f"_{c}"))
    return met.withColumn("d2", d2).where(F.col("d2") <= radius * radius).select(left_id, *equal, f"right_{right_id}", *more, *[f"_{c}" for c in more], "d2")


#: Right-hand points of one cell beyond which nearest ones are looked for in finer cells first; points of one list.
DENSE, LISTED = 256, 8192


def _nearest_of_lists(own: DataFrame, places: DataFrame, radius: float, lists: int, *, left_id: str, right_id: str, coords: Sequence[str], equal: Sequence[str]) -> DataFrame:
    """left_id, best (d2, id) of the rows of own with a place within the radius. The places around a cell are lists there, so that a row
    looks through them and makes no pairs; cells without rows have none."""
    keys = ["cell", *equal]
    a = own.withColumn("cell", cell(coords, radius))
    b = spread(places.select(F.col(right_id).alias("id"), *equal, *coords), coords, radius).join(a.select(*keys).distinct(), keys, "left_semi")
    listed = b.groupBy(*keys, F.pmod(F.xxhash64("id"), F.lit(lists)).alias("_list")).agg(F.collect_list(F.struct("id", *coords)).alias("_near"))
    d2 = lambda p: squared_distance([F.col(c) for c in coords], [p[c] for c in coords])
    best = F.array_min(F.filter(F.transform("_near", lambda p: F.struct(d2(p).alias("d2"), p["id"].alias("id"))), lambda p: p["d2"] <= radius * radius))
    met = a.join(listed, keys).select(left_id, best.alias("best")).where("best is not null")
    return met.groupBy(left_id).agg(F.min("best").alias("best"))


def nearest(left: DataFrame, right: DataFrame, radius: float, *, left_id: str, right_id: str, coords: Sequence[str] = XYZ, equal: Sequence[str] = (), dense: int = DENSE) -> DataFrame:
    """left_id, right_<right_id>, distance: the nearest within the radius, the smaller id on a tie; no row without one.

    Points at one place meet as one. Where a cell has more than dense of them, which is measured, ever larger radii are tried on what is
    left: a neighbour within a radius is the nearest one if the cells are no smaller, so crowded places make few pairs."""
    to = f"right_{right_id}"
    places = right.groupBy(*equal, *coords).agg(F.min(right_id).alias(right_id))
    most = places.groupBy(*equal, cell(coords, radius)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    radii, crowds = [radius], [most]
    while most > dense and len(radii) < 7:
        most /= 4  # surfaces, not volumes, are crowded
        radii.insert(0, radii[0] / 2)
        crowds.insert(0, most)
    own = left.select(left_id, *equal, *coords).where(" and ".join(f"`{c}` is not null" for c in coords))
    out = None
    for r, crowd in zip(radii, crowds, strict=True):
        best = _nearest_of_lists(own, places, r, max(1, math.ceil(crowd * 3 ** len(coords) / LISTED)), left_id=left_id, right_id=right_id, coords=coords, equal=equal)
        found = best.select(left_id, F.col("best.id").alias(to), F.sqrt("best.d2").alias("distance"))
        if len(radii) > 1:
            from ..plans.scratch import saved

            found = saved(found, "near")
            own = own.join(found.select(left_id), left_id, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def within(left: DataFrame, right: DataFrame, radius: float, *, left_id: str, right_id: str, coords: Sequence[str] = XYZ, anti: bool = False) -> DataFrame:
    """The rows of left that have (anti: don't have) a row of right within the radius."""
    a = left.select(left_id, *coords).withColumn("cell", cell(coords, radius))
    b = spread(right.select(*[F.col(c).alias(f"_{c}") for c in coords]), [f"_{c}" for c in coords], radius)
    d2 = squared_distance([F.col(c) for c in coords], [F.col(f"_{c}") for c in coords])
    # a row's search ends at the first one that is near
    ids = a.join(b, (a["cell"] == b["cell"]) & (d2 <= radius * radius), "left_semi").select(left_id)
    return left.join(ids, left_id, "left_anti" if anti else "left_semi")


def fraction_within(left: DataFrame, right: DataFrame, radius: float, *, left_id: str, right_id: str, keys: Sequence[str] = (), coords: Sequence[str] = XYZ) -> DataFrame:
    """keys, fraction of left's rows with a row of right within the radius: 0 if there is none on the right."""
    near = pairs(left, right, radius, left_id=left_id, right_id=right_id, coords=coords).select(left_id).distinct().withColumn("_near", F.lit(1))
    flagged = left.join(near, left_id, "left")
    share = F.sum(F.coalesce("_near", F.lit(0))) / F.count("*")
    if keys:
        return flagged.groupBy(*keys).agg(share.alias("fraction"))
    return flagged.agg(F.coalesce(F.try_divide(F.sum(F.coalesce("_near", F.lit(0))), F.count("*")), F.lit(1.0)).alias("fraction"))


def voxel_coverage(left: DataFrame, right: DataFrame, size: float, *, keys: Sequence[str] = (), coords: Sequence[str] = XYZ) -> DataFrame:
    """keys, covered: the share of left's voxels that are occupied, or have an occupied neighbour, on the right; voxels are
    distinct before they are compared. Null without voxels."""
    query = left.select(*keys, cell(coords, size).alias("cell")).distinct()
    reference = spread(right.select(*coords), coords, size).select("cell").distinct().withColumn("_hit", F.lit(1))
    share = F.try_divide(F.sum(F.coalesce("_hit", F.lit(0))).cast("double"), F.count("*"))
    return query.join(reference, "cell", "left").groupBy(*keys).agg(share.alias("covered"))


def voxel_overlap(left: DataFrame, right: DataFrame, size: float, *, left_key: str, right_key: str, coords: Sequence[str] = XYZ) -> DataFrame:
    """left_key, right_<right_key>, common, iou for all pairs of keys that share a voxel."""
    a = left.select(left_key, cell(coords, size).alias("cell")).distinct()
    b = right.select(F.col(right_key).alias(f"right_{right_key}"), cell(coords, size).alias("cell")).distinct()
    na, nb = a.groupBy(left_key).agg(F.count("*").alias("_na")), b.groupBy(f"right_{right_key}").agg(F.count("*").alias("_nb"))
    common = a.join(b, "cell").groupBy(left_key, f"right_{right_key}").agg(F.count("*").alias("common"))
    iou = F.col("common") / (F.col("_na") + F.col("_nb") - F.col("common"))
    return common.join(na, left_key).join(nb, f"right_{right_key}").select(left_key, f"right_{right_key}", "common", iou.alias("iou"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, *, point_id: str, box_id: str, margin: float = 0.0, coords: Sequence[str] = XYZ) -> DataFrame:
    """point_id, box_id for points inside boxes (columns x0..z0 and x1..z1) grown by the margin; each box goes to the cells it
    touches, each point to its own."""
    low, high = [[f"{c}{k}" for c in coords] for k in (0, 1)]
    ranges = [F.sequence(voxel(F.col(a) - margin, size), voxel(F.col(b) + margin, size)) for a, b in zip(low, high, strict=True)]
    dealt = boxes.select(box_id, *low, *high)
    for n, r in zip(("_i", "_j", "_k"), ranges, strict=True):
        dealt = dealt.withColumn(n, F.explode(r))
    dealt = dealt.withColumn("cell", pack_voxel(F.col("_i"), F.col("_j"), F.col("_k"))).drop("_i", "_j", "_k")
    from ..functions.geometry import inside

    met = points.select(point_id, *coords).withColumn("cell", cell(coords, size)).join(dealt, "cell")
    return met.where(inside([F.col(c) for c in coords], [F.col(c) for c in low], [F.col(c) for c in high], margin)).select(point_id, box_id)

"""Signed distances and normals of point surfaces, by cells and neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import pack_voxel, voxel
from ..plans.scratch import PARTS, ROWS_OF_A_TASK
from .gridjoin import XYZ, cell, spread

#: Points of one list, of which a task holds the moments.
HELD = ROWS_OF_A_TASK


def signed_cells(points: DataFrame, size: float, truncation: float, *, normal: Sequence[Column], least: int = 1, coords: Sequence[str] = XYZ) -> DataFrame:
    """cell, sdf, support: of the points whose band reaches a cell's centre, the signed distance along their normal that is
    nearest to zero, within the truncation, and how many points there are; cells of less than least are left out."""
    n = math.ceil(truncation / size)
    at = points
    for c, k in zip(coords, "ijk", strict=True):
        at = at.withColumn(f"_{k}", F.explode(F.sequence(voxel(F.col(c), size) - n, voxel(F.col(c), size) + n)))
    away = [(F.col(f"_{k}") + 0.5) * size - F.col(c) for c, k in zip(coords, "ijk", strict=True)]
    sdf = sum((a * m for a, m in zip(away, normal, strict=True)), F.lit(0.0))
    reach = sum((a * a for a in away), F.lit(0.0))
    band = at.withColumn("_s", sdf).where(reach <= truncation * truncation)
    best = F.min(F.struct(F.abs("_s").alias("d"), F.col("_s").alias("s")))
    out = band.groupBy(pack_voxel(*[F.col(f"_{k}") for k in "ijk"]).alias("cell")).agg(best.alias("_b"), F.count("*").alias("support"))
    return out.where(F.col("support") >= least).select("cell", F.col("_b.s").alias("sdf"), "support")


def neighbourhoods(points: DataFrame, radius: float, *, vid: str = "vid", coords: Sequence[str] = XYZ) -> DataFrame:
    """vid, n, and the six covariances (xx, xy, ..) of the points within the radius, the point itself among them.

    The points around a cell come to it in lists, where the moments of those that are near are summed about the cell's middle: a point
    is returned once a list and pairs are not made."""
    two = [(a, b) for k, a in enumerate(range(len(coords))) for b in range(len(coords))[k:]]
    own = points.select(F.col(vid).alias("_v"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(coords)])
    axes = [f"_{k}" for k in range(len(coords))]
    own = own.dropna(subset=["_v", *axes])
    crowd = own.groupBy(cell(axes, radius)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    lists = max(1, -(-crowd * 3 ** len(coords) // HELD))
    own = own.withColumn("cell", cell(axes, radius))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long")))
    around = spread(own.drop("cell"), axes, radius).withColumn("_list", F.pmod(F.xxhash64("_v"), F.lit(lists)))
    sums = ["_n", *[f"_s{k}" for k in range(len(coords))], *[f"_m{k}" for k in range(len(two))]]

    def moments(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left[["_v", *axes]].iloc[:0].assign(**{c: 0.0 for c in sums})
        p, q = left[axes].to_numpy(float), right[axes].to_numpy(float)
        middle = (np.floor(p[0] / radius) + 0.5) * radius  # the same in each list of the cell
        away = q - middle
        held = np.column_stack([np.ones(len(q)), away, *[away[:, a] * away[:, b] for a, b in two]])
        out, step = np.empty((len(p), held.shape[1])), max(1, 500_000 // len(q))
        for i in range(0, len(p), step):
            d2 = (p[i : i + step, 0, None] - q[:, 0]) ** 2
            for c in range(1, p.shape[1]):
                d2 += (p[i : i + step, c, None] - q[:, c]) ** 2
            out[i : i + step] = (d2 <= radius * radius).astype(float) @ held
        return left[["_v", *axes]].assign(**dict(zip(sums, out.T, strict=True)))

    fields = T.StructType([*own.select("_v", *axes).schema.fields, *[T.StructField(c, T.DoubleType()) for c in sums]])
    # columns of their own: both sides are of one table
    a, b = (df.toDF(*df.columns).repartition(PARTS, "cell", "_list").groupBy("cell", "_list") for df in (own.withColumn("_list", every), around))
    met = a.cogroup(b).applyInPandas(moments, fields)
    total = met.groupBy("_v", *axes).agg(*[F.sum(c).alias(c) for c in sums])
    n = F.col("_n")
    covariances = [((F.col(f"_m{k}") - F.col(f"_s{a}") * F.col(f"_s{b}") / n) / n).alias(f"{coords[a]}{coords[b]}") for k, (a, b) in enumerate(two)]
    return total.select(F.col("_v").alias(vid), n.cast("long").alias("n"), *covariances)


def normals(spread: DataFrame, keys: Sequence[str], coords: Sequence[str] = XYZ) -> DataFrame:
    """keys, spread, normal: of rows with six covariances, the least eigenvalue in closed form, and the unit vector that has it as
    struct<x, y, z>, its largest part positive: the longest of the cross products of the rows of the matrix less that
    eigenvalue. Null where these vanish."""
    names = [f"{a}{b}" for k, a in enumerate(coords) for b in coords[k:]]
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in names)
    q = (xx + yy + zz) / 3
    at = spread.select(*keys, *names, q.alias("_q"))
    a, b, c = (v - F.col("_q") for v in (xx, yy, zz))
    at = at.withColumn("_p", F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6))
    half = (a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / (2 * F.pow("_p", F.lit(3)))
    at = at.withColumn("_h", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half)))
    at = at.withColumn("_e", F.when(F.col("_p") <= 0, F.col("_q")).otherwise(F.col("_q") + 2 * F.col("_p") * F.cos(F.acos("_h") / 3 + 2 * math.pi / 3)))
    e = F.col("_e")
    rows = [(xx - e, xy, xz), (xy, yy - e, yz), (xz, yz, zz - e)]

    def cross(u: Sequence[Column], v: Sequence[Column]) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip((u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]), "xyz", strict=True)])

    at = at.withColumn("_w", F.array(cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])))
    longest = F.array_max(F.transform("_w", lambda w: F.struct((w["x"] * w["x"] + w["y"] * w["y"] + w["z"] * w["z"]).alias("n"), w.alias("w"))))
    at = at.withColumn("_b", longest)
    w = [F.col(f"_b.w.{c}") for c in "xyz"]
    top = F.greatest(*map(F.abs, w))
    sign = F.when(F.abs(w[0]) == top, F.signum(w[0])).when(F.abs(w[1]) == top, F.signum(w[1])).otherwise(F.signum(w[2]))
    unit = F.struct(*[(c / F.sqrt("_b.n") * sign).alias(n) for c, n in zip(w, "xyz", strict=True)])
    return at.select(*keys, e.alias("spread"), F.when(F.col("_b.n") > 1e-30, unit).alias("normal"))


def linear_index(cell: Sequence[Column], low: Sequence[Column], extent: Sequence[Column]) -> Column:
    """Place of a cell in a box of extent cells from low on, x first; null outside."""
    at = [c - a for c, a in zip(cell, low, strict=True)]
    inside = F.lit(True)
    for k, n in zip(at, extent, strict=True):
        inside = inside & (k >= 0) & (k < n)
    return F.when(inside, at[0] + extent[0] * (at[1] + extent[1] * at[2])).cast("long")

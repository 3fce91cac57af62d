"""Points, voxels and axis-aligned boxes as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of one axis of a packed voxel key.
AXIS_BITS = 21


def voxel(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def pack_voxel(vx: Column, vy: Column, vz: Column) -> Column:
    """One long per voxel; coordinates outside 21 bits are an error, never a wrong cell."""
    bias = 1 << (AXIS_BITS - 1)
    fits = (vx.between(-bias, bias - 1)) & (vy.between(-bias, bias - 1)) & (vz.between(-bias, bias - 1))
    key = F.shiftleft(vx + bias, 2 * AXIS_BITS).bitwiseOR(F.shiftleft(vy + bias, AXIS_BITS)).bitwiseOR(vz + bias)
    return F.when(fits, key).when(vx.isNotNull() & vy.isNotNull() & vz.isNotNull(), F.raise_error(F.lit("voxel outside the packed range")).cast("long"))


def plane_key(z: Column, size: float) -> Column:
    """The nearest plane, halves away from zero."""
    return (F.signum(z) * F.floor(F.abs(z) / F.lit(float(size)) + 0.5)).cast("long")


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = None
    for x, y in zip(a, b, strict=True):
        d = (x - y) * (x - y)
        total = d if total is None else total + d
    return total


def inside(p: Sequence[Column], low: Sequence[Column], high: Sequence[Column], margin: float = 0.0) -> Column:
    """Closed on all sides, after the box has grown by the margin."""
    ok = F.lit(True)
    for x, a, b in zip(p, low, high, strict=True):
        ok = ok & (x >= a - margin) & (x <= b + margin)
    return ok


def volume(low: Sequence[Column], high: Sequence[Column]) -> Column:
    v = F.lit(1.0)
    for a, b in zip(low, high, strict=True):
        v = v * F.greatest(b - a, F.lit(0.0))
    return v


def box_iou(low_a: Sequence[Column], high_a: Sequence[Column], low_b: Sequence[Column], high_b: Sequence[Column]) -> Column:
    """Intersection over union; 0 for boxes without volume."""
    common = volume([F.greatest(a, b) for a, b in zip(low_a, low_b, strict=True)], [F.least(a, b) for a, b in zip(high_a, high_b, strict=True)])
    union = volume(low_a, high_a) + volume(low_b, high_b) - common
    return F.coalesce(F.try_divide(common, union), F.lit(0.0))


def box_points(low: Sequence[Column], high: Sequence[Column]) -> Column:
    """Centre, face centres and corners: 15 points as array<struct<x, y, z>>."""
    middle = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
    sides = list(zip(low, high, strict=True))
    points = [middle]
    for axis in range(3):
        for end in sides[axis]:
            points.append([end if k == axis else middle[k] for k in range(3)])
    points += [[sides[k][bits >> k & 1] for k in range(3)] for bits in range(8)]
    return F.array(*[F.struct(*[c.cast("double").alias(n) for c, n in zip(p, "xyz", strict=True)]) for p in points])


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null if lengths differ, one is null or has no length."""

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def back_project(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """A pixel with depth as a point before the camera."""
    return [(u - cx) * depth / fx, (v - cy) * depth / fy, depth]


def transform(pose: Column, p: Sequence[Column]) -> list[Column]:
    """A point under a pose, 16 numbers by rows."""
    return [pose[4 * r] * p[0] + pose[4 * r + 1] * p[1] + pose[4 * r + 2] * p[2] + pose[4 * r + 3] for r in range(3)]


def project(p: Sequence[Column], fx: Column, fy: Column, cx: Column, cy: Column, near: float = 0.05) -> list[Column]:
    """Pixel of a point before the camera; null at or behind the near plane."""
    return [F.when(p[2] > near, f * x / p[2] + c) for f, x, c in ((fx, p[0], cx), (fy, p[1], cy))]


def rigid(pose: Column, tolerance: float = 1e-3) -> Column:
    """Whether 16 numbers are a finite rigid transform."""
    r = [[pose[4 * i + j] for j in range(3)] for i in range(3)]
    det = r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])
    last = (pose[12] == 0) & (pose[13] == 0) & (pose[14] == 0) & (pose[15] == 1)
    finite = F.forall(pose, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(pose) == 16) & finite & last & (F.abs(det - 1) < tolerance), F.lit(False))

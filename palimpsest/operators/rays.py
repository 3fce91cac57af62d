"""Visibility evidence from rays: candidates meet on grid cells along each ray, then exact geometry decides."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import pack_voxel, squared_distance, voxel

SOURCE, TARGET, POINT = ("sx", "sy", "sz"), ("tx", "ty", "tz"), ("x", "y", "z")
#: Rays of one cell that are joined in one place; cells with more are dealt over several.
RAYS_A_CELL = 50_000


def _along(block: float, grow: float) -> Column:
    """Positions on a ray, as fractions from source to target and grow beyond it, a quarter block apart or less."""
    length = F.sqrt(squared_distance([F.col(c) for c in SOURCE], [F.col(c) for c in TARGET])) + grow
    steps = F.greatest(F.ceil(length / F.lit(block / 4)), F.lit(1)).cast("int")
    reach = F.coalesce(F.try_divide(length, length - grow), F.lit(1.0))
    return F.transform(F.sequence(F.lit(0), steps), lambda k: k / steps * reach)


def ray_blocks(rays: DataFrame, ray_id: str, block: float, *, grow: float = 0.0) -> DataFrame:
    """ray_id, cell: the distinct cells that each ray passes."""
    at = rays.withColumn("_f", F.explode(_along(block, grow)))
    keys = [voxel(F.col(s) + (F.col(t) - F.col(s)) * F.col("_f"), block) for s, t in zip(SOURCE, TARGET, strict=True)]
    return at.select(ray_id, pack_voxel(*keys).alias("cell")).distinct()


def _cross2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    x, y, z = a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]
    return x * x + y * y + z * z


def point_cells(points: DataFrame, point_id: str, block: float, radial: float) -> DataFrame:
    """point_id, cell: the cells in which rays that pass a point within the tolerance are sampled."""
    near, at = math.hypot(radial, block / 8) + 1e-9, points.select(point_id, *POINT)
    for c, n in zip(POINT, "ijk", strict=True):
        at = at.withColumn(f"_{n}", F.explode(F.sequence(voxel(F.col(c) - near, block), voxel(F.col(c) + near, block))))
    return at.select(point_id, pack_voxel(F.col("_i"), F.col("_j"), F.col("_k")).alias("cell"))


def salts_of(cells: DataFrame) -> int:
    """Over how many places the rays of a cell are dealt: next to a sensor a cell has all its rays."""
    heavy = cells.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return max(1, -(-heavy // RAYS_A_CELL))


def judged(met: DataFrame, radial: float, depth: float) -> DataFrame:
    """Rows of a point and a ray whose distance is within the radial tolerance, with what the ray says of the point (verdict)."""
    to_point = [F.col(p) - F.col(s) for p, s in zip(POINT, SOURCE, strict=True)]
    to_target = [F.col(t) - F.col(s) for t, s in zip(TARGET, SOURCE, strict=True)]
    distance = F.sqrt(sum((c * c for c in to_point), F.lit(0.0)))
    aside = F.try_divide(F.sqrt(_cross2(to_point, to_target)), distance)
    reach = F.try_divide(sum((a * b for a, b in zip(to_point, to_target, strict=True)), F.lit(0.0)), distance)
    verdict = F.when(F.col("_d") - F.col("_r") > depth, "occluded").when(F.col("_r") - F.col("_d") > depth, "absent").otherwise("present")
    measured = met.withColumns({"_d": distance, "_r": reach, "_a": aside}).where(F.col("_a") <= radial)
    return measured.withColumn("verdict", verdict)


def cells_beside(rays: DataFrame, block: float, radial: float, depth: float) -> DataFrame:
    """rays once for each cell, in column cell, that holds places within the tolerance of its samples."""
    near = math.hypot(radial, block / 8) + 1e-9

    def around(f: Column) -> Column:
        at = [F.col(s) + (F.col(t) - F.col(s)) * f for s, t in zip(SOURCE, TARGET, strict=True)]
        i, j, k = (F.sequence(voxel(c - near, block), voxel(c + near, block)) for c in at)
        return F.flatten(F.flatten(F.transform(i, lambda u: F.transform(j, lambda v: F.transform(k, lambda w: pack_voxel(u, v, w))))))

    return rays.withColumn("cell", F.explode(F.array_distinct(F.flatten(F.transform(_along(block, depth), around)))))


def verify(
    points: DataFrame, rays: DataFrame, *, point_id: str, ray_id: str, ts: str = "ts", block: float, radial: float, depth: float, earliest: Column | None = None, latest: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """point_id, ray_id, ts, verdict, keep for rays that pass a point within the radial tolerance: a ray that goes on behind the
    point by more than the depth tolerance shows its absence, one that ends at it its presence; one that ends before it
    shows nothing and is "occluded". earliest and latest bound ts and may name columns of the points; keep names more columns of either side.

    A ray's samples are at most a quarter block apart, so it goes to all cells within the tolerance and half of that, once each; a point
    is in its own cell alone. So a pair meets once and is judged where it meets: pairs are not shuffled, and counts of them are begun there."""
    of_points, of_rays = [c for c in keep if c in points.columns], [c for c in keep if c in rays.columns]
    cells = cells_beside(rays.select(ray_id, ts, *SOURCE, *TARGET, *of_rays), block, radial, depth)
    salts = salts_of(cells)
    cells = cells.withColumn("_salt", F.pmod(F.xxhash64(ray_id), F.lit(salts)))
    asked = points.withColumn("cell", pack_voxel(*[voxel(F.col(c), block) for c in POINT])).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = cells.join(asked, ["cell", "_salt"])  # the side that is held for each row of the other is the points
    if earliest is not None:
        met = met.where(F.col(ts) >= earliest)
    if latest is not None:
        met = met.where(F.col(ts) <= latest)
    return judged(met, radial, depth).select(point_id, ray_id, ts, "verdict", *of_points, *of_rays)


def physical_verdict(verdict: Column, own_id: Column, endpoint: Column, endpoint_id: Column) -> tuple[Column, Column]:
    """Verdict and reason for identified objects, from geometry and what the ray ends on (object, unidentified,
    background, invalid; null: not recorded)."""
    same = (endpoint == "object") & (endpoint_id == own_id)
    reason = (
        F.when(verdict == "occluded", "geometric_occlusion")
        .when(endpoint.isNull(), "unavailable")
        .when(endpoint == "invalid", "invalid")
        .when(same, "same_id")
        .when(endpoint == "object", "different_id")
        .when(endpoint == "unidentified", "unidentified_object")
        .when(verdict == "absent", "free_space")
        .otherwise("background_replacement")
    )
    out = F.when(verdict == "occluded", "occluded").when(same, "present").when(endpoint == "background", "absent").when(endpoint.isNull() & (verdict == "absent"), "absent").otherwise("inconclusive")
    return out, reason


def classify_endpoints(hits: DataFrame, runs: DataFrame, *, frame: str, pixel: str, start: str = "run_start", end: str = "run_end") -> DataFrame:
    """hits with the class of the run that holds their pixel: an equi-join on the frame with a range inside it. A pixel
    outside all runs keeps a null class."""
    return hits.join(runs, (hits[frame] == runs[frame]) & (hits[pixel] >= runs[start]) & (hits[pixel] < runs[end]), "left").drop(runs[frame]).drop(start, end)


POLICIES = ("first", "last", "first_and_last", "middle", "all")


def sources(windows: DataFrame, poses: DataFrame, policy: str, *, key: str, group: str, first: str = "first", last: str = "last", ts: str = "ts") -> DataFrame:
    """key, ts: the poses of the same group that see each observation window, closed on both sides, by the policy. middle is
    the nearest to the window's centre, the earlier on a tie. A window without a pose gives no row.

    One pose a window is an as-of join, which makes no pairs; all of them are joined by slices of time as wide as the
    average window."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    own = windows.select(key, group, F.col(first).alias("_lo"), F.col(last).alias("_hi")).where("_lo <= _hi")
    line = poses.select(group, F.col(ts).alias("_ts")).distinct()
    if policy == "all":
        width = own.agg(F.greatest(F.avg(F.col("_hi") - F.col("_lo")), F.lit(1.0)).cast("long")).first()[0] or 1
        cut = lambda c: F.expr(f"{c} div {int(width)}L")
        dealt = own.withColumn("_at", F.explode(F.sequence(cut("_lo"), cut("_hi"))))
        return dealt.join(line.withColumn("_at", cut("_ts")), [group, "_at"]).where("_ts between _lo and _hi").select(key, F.col("_ts").alias(ts))
    near = lambda at, **k: as_of(own.withColumn("_at", at), line, by=[group], at="_at", ts="_ts", **k)
    if policy == "middle":
        centre = F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo")) / 2)
        both = near(centre).unionByName(near(centre, forward=True)).where("_ts between _lo and _hi")
        off = F.abs(2 * F.col("_ts") - F.col("_lo") - F.col("_hi"))
        return both.groupBy(key).agg(F.min(F.struct(off.alias("off"), F.col("_ts").alias("ts"))).alias("m")).select(key, F.col("m.ts").alias(ts))
    ends = []
    if policy != "last":
        ends.append(near(F.col("_lo"), forward=True).where("_ts <= _hi"))
    if policy != "first":
        ends.append(near(F.col("_hi")).where("_ts >= _lo"))
    met = [e.select(key, F.col("_ts").alias(ts)) for e in ends]
    return met[0] if len(met) == 1 else met[0].unionByName(met[1]).distinct()


#: Rows of a group that one slice of an as-of join has on average, at most.
SLICE = 200_000


def as_of(left: DataFrame, right: DataFrame, *, by: Sequence[str], at: str, ts: str, value: str | None = None, forward: bool = False, rows: int = SLICE) -> DataFrame:
    """left with the stamp, or the value, of the latest right row at or before column at (forward: the earliest at or after it)
    within by, null if there is none. right has one row a stamp.

    One sort of both sides, no pairs. Where the largest group has more than rows rows it is cut into slices of time, sorted
    apart; each slice begins with what the ones before it (after it) end with, a row a slice."""
    value, kept = value or ts, left.columns
    span = right.groupBy(*by).agg(F.count("*").alias("n"), (F.max(ts).cast("long") - F.min(ts).cast("long")).alias("w")).agg(F.max("n"), F.max(F.col("w") * rows / F.col("n"))).first()
    width = max(1, int(span[1] or 1)) if (span[0] or 0) > rows else None
    cut = (lambda c: F.floor(F.col(c).cast("long") / width)) if width else (lambda c: F.lit(0))
    a = left.withColumns({"_t": F.col(at), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*by, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_s", cut("_t").cast("long"))
    side = F.col("_side")
    order = Window.partitionBy(*by, "_s").orderBy(*([F.col("_t").desc(), side] if forward else ["_t", side])).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last(F.when(side == 0, F.struct(F.col("_v").alias("v"))), ignorenulls=True).over(order)).where("_side = 1")
    best = F.col("_f.v")
    if width:
        pick = F.min_by if forward else F.max_by
        ends = b.groupBy(*by, cut("_t").cast("long").alias("_s")).agg(pick("_v", "_t").alias("_e"))
        # slices without right rows take over as well: they are asked for too
        asked = found.select(*by, "_s").distinct().join(ends, [*by, "_s"], "full_outer")
        over = Window.partitionBy(*by).orderBy(F.col("_s").desc() if forward else F.col("_s")).rowsBetween(Window.unboundedPreceding, -1)
        carried = asked.withColumn("_c", F.last("_e", ignorenulls=True).over(over)).select(*by, "_s", "_c")
        found, best = found.join(carried, [*by, "_s"], "left"), F.coalesce(best, F.col("_c"))
    names = [c for c in kept if c != value]
    return found.select(*names, best.alias(value))


def nearest_before(left: DataFrame, right: DataFrame, *, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """left with the value of the latest right row at or before its ts within by."""
    return as_of(left, right.select(*by, F.col(ts).alias("_right_ts"), value), by=by, at=ts, ts="_right_ts", value=value)

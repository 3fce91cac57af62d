"""Tables of vertices and faces: welding, removal, re-indexing, voxel reduction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gridjoin import XYZ, cell, nearest


def first_per_voxel(points: DataFrame, order: str, size: float, *, least: int = 1, coords: Sequence[str] = XYZ) -> DataFrame:
    """The first row of each voxel, by order, of those with at least so many rows. A partial aggregation, no sort."""
    row = F.struct(*[F.col(c) for c in points.columns])
    best = points.groupBy(cell(coords, size).alias("_cell")).agg(F.min_by(row, order).alias("r"), F.count("*").alias("_n"))
    return best.where(F.col("_n") >= least).select("r.*")


def newest_per_voxel(vertices: DataFrame, ts: str, size: float, slack: int = 0, *, coords: Sequence[str] = XYZ) -> DataFrame:
    """The vertices not older than the newest of their voxel, less the slack."""
    keyed = vertices.withColumn("_cell", cell(coords, size))
    newest = keyed.groupBy("_cell").agg(F.max(ts).alias("_newest"))
    return keyed.join(newest, "_cell").where(F.col("_newest") <= F.col(ts) + slack).drop("_cell", "_newest")


def weld(base: DataFrame, added: DataFrame, radius: float, *, vid: str = "vid", coords: Sequence[str] = XYZ) -> DataFrame:
    """vid, target: each added vertex goes to the nearest existing one within the radius, else to itself; one whose own id an
    existing vertex has gets an id above all others."""
    near = nearest(added, base, radius, left_id=vid, right_id=vid, coords=coords)
    placed = added.select(vid).join(near.select(vid, F.col(f"right_{vid}").alias("_to")), vid, "left")
    from .alignment import fresh_ids

    fresh = fresh_ids(placed.where("_to is null").select(vid), base.select(vid), vid)
    return placed.where("_to is not null").select(vid, F.col("_to").alias("target")).unionByName(fresh.select(vid, F.col("new_id").alias("target")))


def append(base: DataFrame, added: DataFrame, radius: float, *, vid: str = "vid", supported: bool = False, coords: Sequence[str] = XYZ) -> DataFrame:
    """base with the added vertices that have no existing one within the radius (supported: only those that have)."""
    near = nearest(added, base, radius, left_id=vid, right_id=vid, coords=coords).select(vid)
    return base.unionByName(added.join(near, vid, "left_semi" if supported else "left_anti"), allowMissingColumns=True)


def faces_of(faces: DataFrame, vertices: DataFrame, *, vid: str = "vid", corners: Sequence[str] = ("a", "b", "c")) -> DataFrame:
    """The faces all of whose corners are among the vertices."""
    for c in corners:
        faces = faces.join(vertices.select(F.col(vid).alias(c)), c, "left_semi")
    return faces


def reindex(faces: DataFrame, mapping: DataFrame, *, vid: str = "vid", target: str = "target", corners: Sequence[str] = ("a", "b", "c")) -> DataFrame:
    """Faces with each corner mapped; those whose corners are not all mapped, or not all different, go."""
    for c in corners:
        faces = faces.join(mapping.select(F.col(vid).alias(c), F.col(target).alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    a, b, c = corners
    return faces.where((F.col(a) != F.col(b)) & (F.col(b) != F.col(c)) & (F.col(a) != F.col(c)))


def renumber(vertices: DataFrame, order: Sequence[str], *, vid: str = "vid") -> DataFrame:
    """vid, target: positions in a global order, from 0. Ranges are sorted apart and their sizes, one row a range, are added."""
    placed = vertices.select(vid, *order).repartitionByRange(*order, vid).sortWithinPartitions(*order, vid)
    from ..plans.scratch import saved

    kept = saved(placed.select(vid, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranges")
    sizes = kept.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return kept.join(before, "part").select(vid, (F.col("before") + F.col("at")).alias("target"))


def majority(votes: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """key, label, n: the label with most rows; the smaller one on a tie."""
    counts = votes.where(F.col(label).isNotNull()).groupBy(*key, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("label"))).alias("b"))
    return best.select(*key, F.col("b.label").alias(label), (-F.col("b.m")).alias("n"))


def bounds(points: DataFrame, keys: Sequence[str], coords: Sequence[str] = XYZ) -> DataFrame:
    """keys, n, centroid (cx..), low (x0..) and high (x1..) corners."""
    stats = [f(c).alias(n) for c in coords for f, n in ((F.avg, f"c{c}"), (F.min, f"{c}0"), (F.max, f"{c}1"))]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *stats)


def dominant_plane(points: DataFrame, keys: Sequence[str], z: Column, size: float) -> DataFrame:
    """keys, plane, n: the best supported height bin, rounded half away from zero; the lower one on a tie."""
    from ..functions.geometry import plane_key

    counts = points.groupBy(*keys, plane_key(z, size).alias("plane")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "plane")).alias("b"))
    return best.select(*keys, F.col("b.plane").alias("plane"), (-F.col("b.m")).alias("n"))


def dominant_planes(points: DataFrame, keys: Sequence[str], z: Column, size: float) -> DataFrame:
    """keys, lower, upper: the best supported height bins of the lower and of the upper half of each key's bins; the lower half
    ends at the middle of the lowest and the highest bin. Of equal ones the lower bin counts."""
    from ..functions.geometry import plane_key

    counts = points.groupBy(*keys, plane_key(z, size).alias("plane")).agg(F.count("*").alias("n"))
    ends = counts.groupBy(*keys).agg(((F.min("plane") + F.max("plane")) / 2).alias("_mid"))
    best = lambda side: F.min(F.when(side, F.struct((-F.col("n")).alias("m"), F.col("plane").alias("p"))))["p"]
    return counts.join(ends, list(keys)).groupBy(*keys).agg(best(F.col("plane") <= F.col("_mid")).alias("lower"), best(F.col("plane") > F.col("_mid")).alias("upper"))


def voxel_components(points: DataFrame, label: str, size: float, *, diagonal: bool = True, coords: Sequence[str] = XYZ) -> DataFrame:
    """label, cell, component (its smallest cell): occupied voxels of one label that touch, by 26 or 6 neighbours."""
    from ..functions.geometry import pack_voxel, voxel
    from .components import connected_components

    axes = [voxel(F.col(c), size) for c in coords]
    cells = points.select(F.col(label).alias("label"), *[a.alias(n) for a, n in zip(axes, "ijk", strict=True)]).distinct().withColumn("cell", pack_voxel(F.col("i"), F.col("j"), F.col("k")))
    # half of the neighbours: the others are found from the other side
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0) and (diagonal or abs(i) + abs(j) + abs(k) == 1)]
    near = cells.withColumn("d", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, "ijk", strict=True)]) for s in steps])))
    near = near.select("label", F.col("cell").alias("u"), pack_voxel(*[F.col(n) + F.col(f"d.{n}") for n in "ijk"]).alias("v"))
    edges = near.join(cells.select("label", F.col("cell").alias("v")), ["label", "v"]).select(F.struct("label", "u").alias("u"), F.struct("label", F.col("v").alias("u")).alias("v"))
    found = connected_components(edges)
    whole = cells.select(F.struct("label", F.col("cell").alias("u")).alias("node")).join(found, "node", "left")
    return whole.select(F.col("node.label").alias(label), F.col("node.u").alias("cell"), F.coalesce("component.u", "node.u").alias("component"))

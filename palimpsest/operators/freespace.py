"""Free space and signed distance along rays, by voxel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import pack_voxel, squared_distance, voxel

SOURCE, TARGET, POINT = ("sx", "sy", "sz"), ("tx", "ty", "tz"), ("x", "y", "z")


def _samples(rays: DataFrame, ray_id: str, step: float, start: float, short: float) -> DataFrame:
    """Points on each ray: every step from start up to short before its end, with their distance in column at."""
    length = F.sqrt(squared_distance([F.col(c) for c in SOURCE], [F.col(c) for c in TARGET]))
    n = F.floor((F.col("_len") - start - short) / step).cast("int")
    at = rays.withColumn("_len", length).withColumn("_k", F.explode(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))))
    at = at.withColumn("at", start + F.col("_k") * step)
    return at.select(ray_id, "at", (F.col("_len") - F.col("at")).alias("sdf"), *[(F.col(s) + (F.col(t) - F.col(s)) * F.col("at") / F.col("_len")).alias(p) for s, t, p in zip(SOURCE, TARGET, POINT, strict=True)])


def _crossed(rays: DataFrame, ray_id: str, size: float, start: float, short: float) -> DataFrame:
    """ray_id, cell: the cells that each ray passes from start up to short before its end, cut where it meets a cell's wall."""
    length = F.sqrt(squared_distance([F.col(c) for c in SOURCE], [F.col(c) for c in TARGET]))
    end = F.col("_len") - short

    def walls(s: str, t: str):
        way = (F.col(t) - F.col(s)) / F.col("_len")
        a, b = (F.floor((F.col(s) + way * at) / size) for at in (F.lit(float(start)), end))
        met = F.transform(F.sequence(F.least(a, b) + 1, F.greatest(a, b)), lambda k: (k * F.lit(float(size)) - F.col(s)) / way)
        return F.when(a == b, F.array().cast("array<double>")).otherwise(met)

    inner = F.filter(F.concat(*[walls(s, t) for s, t in zip(SOURCE, TARGET, strict=True)]), lambda at: (at > start) & (at < end))
    cuts = F.array_sort(F.concat(F.array(F.lit(float(start)), end), inner))
    pieces = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda a, b: F.struct(((a + b) / 2).alias("at"), (b - a).alias("long")))
    run = rays.withColumn("_len", length).where((F.col("_len") > 0) & (end > start))
    at = run.withColumn("_p", F.explode(F.filter(pieces, lambda p: p["long"] > size * 1e-9)))
    return at.select(ray_id, *[(F.col(s) + (F.col(t) - F.col(s)) * F.col("_p.at") / F.col("_len")).alias(p) for s, t, p in zip(SOURCE, TARGET, POINT, strict=True)]).select(ray_id, _cell(size).alias("cell"))


def _cell(size: float):
    return pack_voxel(*[voxel(F.col(c), size) for c in POINT])


def free_counts(rays: DataFrame, *, ray_id: str, size: float, start: float = 0.0, short: float = 0.0, step: float | None = None) -> DataFrame:
    """cell, n: how many rays pass each cell; a ray counts once in a cell. Without a step the cells are those that a ray truly
    crosses, else those of samples a step apart, which may miss some."""
    met = _samples(rays, ray_id, step, start, short).select(ray_id, _cell(size).alias("cell")) if step else _crossed(rays, ray_id, size, start, short)
    return met.distinct().groupBy("cell").agg(F.count("*").alias("n"))


def free_fraction(points: DataFrame, counts: DataFrame, *, size: float, keys: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """keys, n, fraction: the share of points whose cell at least that many rays pass."""
    met = points.withColumn("cell", _cell(size)).join(counts.select("cell", F.col("n").alias("_n")), "cell", "left")
    return met.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.coalesce("_n", F.lit(0)) >= least).cast("int")).alias("fraction"))


def consistent(points: DataFrame, counts: DataFrame, *, size: float, least: int = 1) -> DataFrame:
    """The points whose cell fewer rays pass."""
    gone = counts.where(F.col("n") >= least).select("cell")
    return points.withColumn("cell", _cell(size)).join(gone, "cell", "left_anti").drop("cell")


def ray_tsdf(rays: DataFrame, *, ray_id: str, size: float, truncation: float, step: float | None = None) -> DataFrame:
    """cell, sdf: of the samples within the truncation before and behind each ray's end, the one nearest to the surface."""
    step = step or size / 2
    length = F.sqrt(squared_distance([F.col(c) for c in SOURCE], [F.col(c) for c in TARGET]))
    k = F.explode(F.sequence(F.lit(-int(truncation / step)), F.lit(int(truncation / step))))
    at = rays.withColumn("_len", length).withColumn("_k", k).where("_len > 0").withColumn("sdf", F.col("_k") * F.lit(-step))
    at = at.where(F.col("sdf") <= F.col("_len"))
    placed = at.select("sdf", *[(F.col(t) - (F.col(t) - F.col(s)) * F.col("sdf") / F.col("_len")).alias(p) for s, t, p in zip(SOURCE, TARGET, POINT, strict=True)])
    best = placed.groupBy(_cell(size).alias("cell")).agg(F.min(F.struct(F.abs("sdf").alias("d"), F.col("sdf").alias("sdf"))).alias("m"))
    return best.select("cell", F.col("m.sdf").alias("sdf"))


def tsdf_change(before: DataFrame, after: DataFrame, weight: float = 1.0) -> DataFrame:
    """overlap, change: the mean difference over the cells that both have, times the weight; null without any."""
    met = before.join(after.select("cell", F.col("sdf").alias("_sdf")), "cell")
    return met.agg(F.count("*").alias("overlap"), (F.avg(F.abs(F.col("_sdf") - F.col("sdf"))) * weight).alias("change"))

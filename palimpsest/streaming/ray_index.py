"""Visibility evidence as rays and points arrive: an index by grid cell, of which an epoch reads what its own rows touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import AXIS_BITS
from ..operators import rays as r
from .runs import Run, Runs, bucket, buckets_of

#: Cells of a region's edge, as bits: a region's cells share a bucket, so that neighbouring rays touch few buckets.
REGION_BITS = 3


class RayIndex:
    """Cells to points and cells to rays, each with its geometry, as tables of epochs in a folder of the shared store.

    update() meets an epoch's rays with all points and its points with all earlier rays, so each pair once; of the earlier
    tables only the buckets of the regions that the epoch's own cells lie in are read. After any number of epochs the evidence is that of
    rays.verify over all points and rays. An epoch that is there already is left as it is. Every fan epochs become one (and so on).

    Points have columns point_id, x, y, z, rays ray_id, ts and their ends; ids are never given twice. A point or ray with a null coordinate meets
    nothing. When points have moved, evidence from before is void: begin a new folder with the moved points and all rays."""

    def __init__(self, folder: str, *, point_id: str, ray_id: str, ts: str = "ts", block: float, radial: float, depth: float, buckets: int = 32, fan: int = 8) -> None:
        self.point_id, self.ray_id, self.ts = point_id, ray_id, ts
        self.block, self.radial, self.depth, self.buckets = block, radial, depth, buckets
        self.runs = Runs(folder, fan)

    def _dealt(self, cells: DataFrame) -> DataFrame:
        low = (1 << REGION_BITS) - 1
        region = F.col("cell").bitwiseAND(F.lit(~(low | low << AXIS_BITS | low << 2 * AXIS_BITS)))
        return cells.select("*", bucket([region], self.buckets))

    def _point_cells(self, points: DataFrame) -> DataFrame:
        whole = points.select(self.point_id, *r.POINT).dropna()
        cells = r.point_cells(whole, self.point_id, self.block, self.radial)
        return self._dealt(cells.join(whole, self.point_id))

    def _ray_cells(self, rays: DataFrame) -> DataFrame:
        whole = rays.select(self.ray_id, self.ts, *r.SOURCE, *r.TARGET).dropna(subset=[*r.SOURCE, *r.TARGET])
        return self._dealt(r.ray_blocks(whole, self.ray_id, self.block, grow=self.depth).join(whole, self.ray_id))

    def _met(self, points: DataFrame, rays: DataFrame) -> DataFrame:
        salts = r.salts_of(rays)
        dealt = rays.withColumn("_salt", F.pmod(F.xxhash64(self.ray_id), F.lit(salts)))
        asked = points.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        seen = r.judged(asked.join(dealt.drop("bucket"), ["cell", "_salt"]), self.radial, self.depth)
        # a pair that passes meets in several cells; few pass
        return seen.select(self.point_id, self.ray_id, self.ts, "verdict").dropDuplicates([self.point_id, self.ray_id])

    def update(self, spark: SparkSession, epoch: int, points: DataFrame, rays: DataFrame) -> DataFrame:
        """The epoch's evidence: point_id, ray_id, ts, verdict."""
        if epoch <= self.runs.newest(spark):
            return self._of(spark, epoch)
        stage = self.runs.stage(spark, Run(epoch, epoch, 1))
        new_points = stage.write("points", self._point_cells(points))
        new_rays = stage.write("rays", self._ray_cells(rays))
        old_points = self.runs.read(spark, "points", buckets_of(new_rays, self.buckets))
        old_rays = self.runs.read(spark, "rays", buckets_of(new_points, self.buckets))
        seen = self._met(new_points if old_points is None else new_points.unionByName(old_points), new_rays)
        if old_rays is not None:
            seen = seen.unionByName(self._met(new_points, old_rays))
        stage.write("evidence", seen.select("*", F.lit(epoch).cast("long").alias("epoch"), bucket([self.point_id], self.buckets)))
        stage.commit()
        same = lambda rows: rows
        self.runs.compact(spark, {"points": same, "rays": same, "evidence": same})
        return self._of(spark, epoch)

    def _of(self, spark: SparkSession, epoch: int) -> DataFrame:
        return self.runs.read(spark, "evidence", since=epoch).where(F.col("epoch") == epoch).drop("epoch", "bucket")

    def evidence(self, spark: SparkSession) -> DataFrame:
        """All evidence, with the epoch that gave it."""
        return self.runs.read(spark, "evidence").drop("bucket")

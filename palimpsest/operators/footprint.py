"""Filling a horizontal plane from what supports it: cells between the support of their row and of their column, where nothing is yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gridjoin import within


def footprint(support: DataFrame, existing: DataFrame, planes: DataFrame, size: float, *, plane: str = "plane", vid: str = "vid") -> DataFrame:
    """plane, ix, iy, x, y, z, faces: the cells of each plane that lie between the first and last supported cell both of their row and of their
    column, and are farther than size from every existing point. faces: 2 where the cells beside, above and diagonally above are filled
    too, else 0. support: plane, x, y. existing: vid, x, y, z. planes: plane, z, a row each. A plane whose support lies in one row or
    column is not filled. Rows without a place are left out. Work is by cell; a plane may have any number."""
    cells = support.select(plane, F.round(F.col("x") / size).cast("long").alias("ix"), F.round(F.col("y") / size).cast("long").alias("iy")).dropna().distinct()
    rows = cells.groupBy(plane, "iy").agg(F.min("ix").alias("_l"), F.max("ix").alias("_h"))
    columns = cells.groupBy(plane, "ix").agg(F.min("iy").alias("_b"), F.max("iy").alias("_t"))
    wide = cells.groupBy(plane).agg((F.max("ix") > F.min("ix")).alias("_w"), (F.max("iy") > F.min("iy")).alias("_v")).where("_w and _v").select(plane)
    hull = rows.join(wide, plane).select(plane, "iy", F.explode(F.sequence("_l", "_h")).alias("ix")).join(columns, [plane, "ix"]).where("iy between _b and _t")
    placed = hull.join(planes.select(plane, "z"), plane).select(plane, "ix", "iy", (F.col("ix") * size).alias("x"), (F.col("iy") * size).alias("y"), F.col("z").cast("double").alias("z"))
    keyed = placed.withColumn("_cell", F.struct(plane, "ix", "iy"))
    free = within(keyed, existing.select(vid, *"xyz").dropna(), size, left_id="_cell", right_id=vid, anti=True).drop("_cell")
    at = lambda dx, dy: free.select(plane, (F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.lit(1).alias(f"_{dx}{dy}"))
    out = free
    for dx, dy in ((1, 0), (0, 1), (1, 1)):
        out = out.join(at(dx, dy), [plane, "ix", "iy"], "left")
    filled = F.col("_10").isNotNull() & F.col("_01").isNotNull() & F.col("_11").isNotNull()
    return out.select(plane, "ix", "iy", "x", "y", "z", F.when(filled, 2).otherwise(0).alias("faces"))

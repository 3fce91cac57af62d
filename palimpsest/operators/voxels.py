"""Life cycle of observed voxels, and clusters of what appears in space that was free."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .gridjoin import pairs

IJK = ("i", "j", "k")


def steps(connectivity: int) -> list[tuple[int, int, int]]:
    """The 6, 18 or 26 neighbours of a cell."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if 0 < abs(i) + abs(j) + abs(k) <= most]


def around(cells: DataFrame, connectivity: int, keep: Sequence[str] = ()) -> DataFrame:
    """Each cell's neighbours: i, j, k, and the cell they are of as oi, oj, ok, with the columns in keep."""
    near = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, IJK, strict=True)]) for s in steps(connectivity)]))
    return cells.withColumn("_s", near).select(*[(F.col(n) + F.col(f"_s.{n}")).alias(n) for n in IJK], *[F.col(n).alias(f"o{n}") for n in IJK], *keep)


def tracked(observations: DataFrame, now: Column, ts: str, occupied: Column) -> DataFrame:
    """i, j, k, last_observed, last_occupied of the cells seen up to now."""
    seen = observations.where(F.col(ts) <= now)
    return seen.groupBy(*IJK).agg(F.max(ts).alias("last_observed"), F.max(F.when(occupied, F.col(ts))).alias("last_occupied"))


def is_free(now: Column, buffer: int) -> Column:
    """Observed, and not occupied within the buffer."""
    return F.col("last_observed").isNotNull() & (F.coalesce("last_occupied", F.lit(0)) < now - buffer)


def ever_free(cells: DataFrame, free: Column, before: DataFrame | None = None, connectivity: int = 26) -> DataFrame:
    """i, j, k: the cells ever free after an update: those before it, and free ones whose neighbours all are observed and
    free, or ever free before. One join over neighbours, no order among cells."""
    known = cells.select(*IJK, free.alias("_free"))
    if before is not None:
        known = known.join(before.select(*IJK, F.lit(True).alias("_ever")), list(IJK), "left")
    else:
        known = known.withColumn("_ever", F.lit(None).cast("boolean"))
    clear = known.where(F.col("_free") | F.col("_ever")).select(*IJK)
    asked = around(known.where("_free and _ever is null").select(*IJK), connectivity)
    passed = asked.join(clear, list(IJK)).groupBy("oi", "oj", "ok").agg(F.count("*").alias("n")).where(F.col("n") == len(steps(connectivity)))
    new = passed.select(*[F.col(f"o{n}").alias(n) for n in IJK])
    return new if before is None else before.select(*IJK).unionByName(new)


def block(n: str, side: int) -> Column:
    return F.floor(F.col(n) / side).cast("long").alias(f"b{n}")


def block_states(cells: DataFrame, now: Column, window: int, side: int) -> DataFrame:
    """bi, bj, bk, cells, active, evicted: a block goes when none of its cells was observed within the window."""
    active = F.count_if(F.col("last_observed") >= now - window)
    return cells.groupBy(*[block(n, side) for n in IJK]).agg(F.count("*").alias("cells"), active.alias("active"), (active == 0).alias("evicted"))


def seeded_clusters(occupied: DataFrame, seeds: DataFrame, cid: str, connectivity: int = 26) -> DataFrame:
    """cid, i, j, k, cluster (its smallest seed's cid): occupied cells that were ever free grow into clusters; occupied neighbours
    that were not join the cluster of smallest id but don't spread."""
    own = occupied.join(seeds.select(*IJK).distinct(), list(IJK), "left_semi")
    rest = occupied.join(seeds.select(*IJK).distinct(), list(IJK), "left_anti")
    near = around(own, connectivity, [F.col(cid).alias("_of")])
    links = near.join(own.select(*IJK, cid), list(IJK)).select(F.col("_of").alias("u"), F.col(cid).alias("v"))
    found = connected_components(links)
    named = own.join(found, own[cid] == found["node"], "left").select(cid, *IJK, F.coalesce("component", cid).alias("cluster"))
    rim = around(named, connectivity, ["cluster"]).join(rest.select(*IJK, cid), list(IJK)).groupBy(cid, *IJK).agg(F.min("cluster").alias("cluster"))
    return named.unionByName(rim)


def join_close(clusters: DataFrame, cid: str, separation: float) -> DataFrame:
    """cid, i, j, k, cluster after those with cells less than separation apart have become one, transitively."""
    at = clusters.select(cid, "cluster", *[F.col(n).cast("double").alias(n) for n in IJK])
    near = pairs(at, at, separation, left_id=cid, right_id=cid, coords=IJK, differ="cluster").where(F.col("d2") < separation * separation)
    found = connected_components(near.select(F.col("cluster").alias("u"), F.col("_cluster").alias("v")).distinct())
    named = clusters.join(found, clusters["cluster"] == found["node"], "left")
    return named.select(cid, *IJK, F.coalesce("component", "cluster").alias("cluster"))

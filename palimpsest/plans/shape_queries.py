"""Registered queries on robust centres, filled planes, smoothed paths and commits, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import footprint, kmeans, trajectory
from ..sources.commits import Commits
from .inputs import POINTS, micros, points, table
from .scratch import scratch

CENTRES, MEANS, MEDIANS = 3, 2, 3
CELL = 0.1
ROUNDS = 2


def kmeans_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three centres a label from its first three points, after two rounds of means and three of medians."""
    p = points(spark, sf_dir)
    first = p.join(p.groupBy("label").agg(F.min("vid").alias("_0")), "label").join(_next(p, 1), "label").join(_next(p, 2), "label")
    first = first.withColumn("cluster", F.when(F.col("vid") == F.col("_0"), 0).when(F.col("vid") == F.col("_1"), 1).when(F.col("vid") == F.col("_2"), 2).cast("long"))
    out = kmeans.robust_kmeans(p, CENTRES, "label", first=first.where("cluster is not null"), iterations=MEANS, refinements=MEDIANS)
    return out.select("label", "cluster", *[F.round(c, 9).alias(c) for c in "xyz"])


def _next(p: DataFrame, k: int) -> DataFrame:
    """label, the k-th id after its first."""
    ids = p.groupBy("label").agg(F.min("vid").alias("_m"))
    for _ in range(k):
        ids = p.join(ids, "label").where("vid > _m").groupBy("label").agg(F.min("vid").alias("_m"))
    return ids.withColumnRenamed("_m", f"_{k}")


def kmeans_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three centres a label, seeded far apart, with as many rounds as it takes."""
    return kmeans.robust_kmeans(points(spark, sf_dir), CENTRES, "label").select("label", "cluster", *"xyz")


def footprint_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane a label at the height of its lowest support, filled where the other session has nothing."""
    a, b = (points(spark, sf_dir, k).withColumnRenamed("label", "plane") for k in (0, 1))
    out = footprint.footprint(a, b, a.groupBy("plane").agg(F.min("z").alias("z")), CELL)
    return out.select("plane", "ix", "iy", "faces")


def path_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' paths over value and time, with their corners cut twice, and the direction at each point."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), micros("ts").alias("t"), "event_id", F.col("value").alias("x"), (micros("ts") / 3.6e9).alias("y"))
    cut = trajectory.cut_corners(e, "entity", ["t", "event_id"], ["x", "y"], ROUNDS)
    return trajectory.tangent_yaw(cut, "entity", "place").select("entity", "place", *[F.round(c, 6).alias(c) for c in ("x", "y", "yaw")])


def commit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits of points and labels, the second with the points of both sessions; and whether their files are as told."""
    store = Commits(spark, scratch(spark, "commits"))
    for k, p in enumerate((points(spark, sf_dir, 0), points(spark, sf_dir))):
        store.commit({"points": p, "labels": p.groupBy("label").agg(F.count("*").alias("n"))}, {"points": ["label"], "labels": ["label"]}, owner=f"session {k}")
    faults = [(v, name) for v in (1, 2) for name in store.faults(v)]
    return store.history().withColumn("sound", F.lit(not faults))


QUERIES = {f.__name__: f for f in (kmeans_refined, kmeans_robust, footprint_fill, path_corners, commit_history)}


def _kmeans_sql() -> str:
    """A pair of tables a round: points dealt to centres, and where these move."""
    parts = [POINTS, "c0 AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vid) - 1 AS cluster, x, y, z FROM p QUALIFY cluster < 3)"]
    for k in range(MEANS + MEDIANS):
        f = "avg" if k < MEANS else "median"
        parts.append(f"d{k} AS (SELECT vid, p.label, p.x, p.y, p.z, cluster FROM p JOIN c{k} c ON p.label = c.label QUALIFY row_number() OVER (PARTITION BY vid ORDER BY (p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2, cluster) = 1)")
        parts.append(f"m{k} AS (SELECT label, cluster, {f}(x) AS x, {f}(y) AS y, {f}(z) AS z FROM d{k} GROUP BY ALL), c{k + 1} AS (SELECT label, cluster, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y, coalesce(m.z, c.z) AS z FROM c{k} c LEFT JOIN m{k} m USING (label, cluster))")
    return f"WITH {', '.join(parts)} SELECT label, cluster, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM c{MEANS + MEDIANS}"


def _corner_sql() -> str:
    parts = ["k0 AS (SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS place, value AS x, epoch_us(ts) / 3.6e9 AS y FROM events)"]
    for k in range(ROUNDS):
        w = "OVER (PARTITION BY entity ORDER BY place)"
        parts.append(f"n{k} AS (SELECT *, lead(x) {w} AS u, lead(y) {w} AS v FROM k{k})")
        parts.append(
            f"k{k + 1} AS (SELECT entity, 0 AS place, x, y FROM n{k} WHERE place = 0 UNION ALL SELECT entity, place * 2 + 1, x * 0.75 + u * 0.25, y * 0.75 + v * 0.25 FROM n{k} WHERE u IS NOT NULL"
            f" UNION ALL SELECT entity, place * 2 + 2, x * 0.25 + u * 0.75, y * 0.25 + v * 0.75 FROM n{k} WHERE u IS NOT NULL UNION ALL SELECT entity, place * 2 + 1, x, y FROM n{k} WHERE u IS NULL)"
        )
    w = "OVER (PARTITION BY entity ORDER BY place)"
    d = [f"coalesce(lead({c}) {w}, {c}) - coalesce(lag({c}) {w}, {c})" for c in "yx"]
    return f"WITH {', '.join(parts)} SELECT entity, place, round(x, 6) AS x, round(y, 6) AS y, round(atan2({d[0]}, {d[1]}), 6) AS yaw FROM k{ROUNDS}"


ORACLES = {
    "kmeans_refined": _kmeans_sql(),
    "footprint_fill": f"""WITH {POINTS}, c AS (SELECT DISTINCT label AS plane, round(x / {CELL})::BIGINT AS ix, round(y / {CELL})::BIGINT AS iy FROM a), h AS (SELECT label AS plane, min(z) AS z FROM a GROUP BY 1),
        r AS (SELECT plane, iy, min(ix) AS l, max(ix) AS h FROM c GROUP BY 1, 2), s AS (SELECT plane, ix, min(iy) AS b, max(iy) AS t FROM c GROUP BY 1, 2), w AS (SELECT plane FROM c GROUP BY 1 HAVING max(ix) > min(ix) AND max(iy) > min(iy)),
        k AS (SELECT plane, iy, unnest(range(l, h + 1)) AS ix FROM r JOIN w USING (plane)), f AS (SELECT plane, ix, iy, ix * {CELL} AS x, iy * {CELL} AS y, z FROM k JOIN s USING (plane, ix) JOIN h USING (plane) WHERE iy BETWEEN b AND t),
        g AS (SELECT plane, ix, iy FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE (b.x - f.x) ** 2 + (b.y - f.y) ** 2 + (b.z - f.z) ** 2 <= {CELL} * {CELL}))
        SELECT plane, ix, iy, CASE WHEN (plane, ix + 1, iy) IN (SELECT (plane, ix, iy) FROM g) AND (plane, ix, iy + 1) IN (SELECT (plane, ix, iy) FROM g) AND (plane, ix + 1, iy + 1) IN (SELECT (plane, ix, iy) FROM g) THEN 2 ELSE 0 END AS faces FROM g""",
    "path_corners": _corner_sql(),
    "commit_history": f"""WITH {POINTS}, v AS (SELECT 1 AS version, * FROM a UNION ALL SELECT 2, * FROM p)
        SELECT version, version - 1 AS parent, 'session ' || (version - 1) AS owner, 'points' AS name, count(*) AS n, count(DISTINCT label) AS n_keys, true AS sound FROM v GROUP BY version
        UNION ALL SELECT version, version - 1, 'session ' || (version - 1), 'labels', count(DISTINCT label), count(DISTINCT label), true FROM v GROUP BY version""",
}

"""Registered queries on pixels, labels, projections and surfaces, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import belief, geometry
from ..operators import alignment, clusters, gridjoin, masks, mesh, surfaces, trajectory
from .inputs import points, table
from .space_queries import _AB, _D2, XYZ, _cell
from .track_queries import _E, _events

UV = ("u", "v")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images: line numbers are frames, parts and suppliers the axes; a pixel has the least tax as its label."""
    li = table(spark, sf_dir, "lineitem")
    key = [F.col("l_linenumber").cast("long").alias("frame"), F.expr("l_partkey div 40").alias("u"), F.col("l_suppkey").alias("v")]
    return li.groupBy(*key).agg(F.min(F.round(F.col("l_tax") * 100).cast("long")).alias("label"), F.min("l_quantity").alias("depth"), F.max(F.col("l_returnflag") == "R").alias("moving"))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("label"), (F.col("n_regionkey") < 3).alias("is_object"), (F.col("n_regionkey") == 3).alias("is_dynamic"))


def valid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    good = masks.valid_measurement(F.col("depth"), [F.col("u").cast("double"), F.col("v").cast("double"), F.col("depth")], sensor=(2.0, 45.0), detector=30.0)
    return p.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(masks.valid_depth(F.col("depth"), 40.0)).alias("depths"), F.count_if(good).alias("measured"))


def candidate_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.candidates(_pixels(spark, sf_dir), _classes(spark, sf_dir), "label", promote_dynamic=True).groupBy("frame", "label").agg(F.count("*").alias("n"))


def background_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.background(_pixels(spark, sf_dir), _classes(spark, sf_dir), "label", F.col("moving")).groupBy("frame", "label").agg(F.count("*").alias("n"))


def cluster_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("cluster", F.floor(F.col("vid") / 5))
    got = masks.by_volume(mesh.bounds(p, ["cluster"]), ["x0", "y0", "z0"], ["x1", "y1", "z1"], 0.01, 0.06)
    return got.select("cluster", "n", F.round("volume", 9).alias("volume"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir).select((F.col("frame") * 100 + F.col("label")).alias("mask"), *UV, F.lit(0).alias("w"))
    own = mesh.voxel_components(p, "mask", 1.0, diagonal=False, coords=("u", "v", "w"))
    at = p.select("mask", *UV, gridjoin.cell(("u", "v", "w"), 1.0).alias("cell"))
    return own.join(at, ["mask", "cell"])


def image_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of equal labels; those of fewer than three pixels are none (0)."""
    r = _regions(spark, sf_dir)
    n = r.groupBy("mask", "component").agg(F.count("*").alias("n"))
    return r.join(n, ["mask", "component"]).select("mask", *UV, F.when(F.col("n") >= 3, F.col("component")).otherwise(0).alias("region"))


def image_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _regions(spark, sf_dir).groupBy("mask", "component").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{k}") for c in UV for k, f in ((0, F.min), (1, F.max))])
    return clusters.islands_by_gap(c, "mask", "component", ["u0", "v0"], ["u1", "v1"], least=3, gap=10)


def small_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strip of faces on the points of either session; labels of fewer than three in a row give way."""
    p = points(spark, sf_dir)
    faces = p.select(F.col("vid").alias("fid"), F.col("vid").alias("a"), (F.col("vid") + 2).alias("b"), (F.col("vid") + 4).alias("c"))
    labels = p.select(F.col("vid").alias("fid"), F.expr("label div 4").cast("long").alias("label"))
    return clusters.without_small(labels, clusters.face_neighbours(faces), "fid", "label", 3)


def _camera(f: float) -> list:
    return [masks.pixel_of(c) for c in geometry.project([F.col("x"), F.col("y"), F.col("z") + 1.0], *map(F.lit, (f, f, 50.0, 50.0)))]


def reprojected_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = _camera(30.0)
    own = points(spark, sf_dir, 1).select(F.col("label").alias("cluster"), u.alias("u"), v.alias("v"))
    got = masks.reprojected_iou(own, points(spark, sf_dir, 0).withColumnRenamed("label", "track"), cluster="cluster", track="track", pixel=UV, u=u, v=v)
    return got.select("cluster", "track", "common", F.round("iou", 6).alias("iou"))


def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = geometry.project([F.col("x"), F.col("y"), F.col("z") + 0.1], *map(F.lit, (100.0, 90.0, 50.0, 40.0)))
    return points(spark, sf_dir).select("vid", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


def back_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with depth as points of the world, under a pose that turns by a right angle and moves."""
    pose = F.array(*[F.lit(float(x)) for x in (0, -1, 0, 1.5, 1, 0, 0, -2, 0, 0, 1, 0.5, 0, 0, 0, 1)])
    at = geometry.transform(pose, geometry.back_project(F.col("u"), F.col("v"), F.col("depth"), *map(F.lit, (100.0, 80.0, 25.0, 50.0))))
    return _pixels(spark, sf_dir).select("frame", *UV, *[F.round(c, 6).alias(n) for c, n in zip(at, XYZ, strict=True)])


def label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = _camera(20.0)
    source = points(spark, sf_dir, 0).select(u.alias("u"), v.alias("v"), (F.col("z") + 1.0).alias("z"), "label")
    target = points(spark, sf_dir, 1).groupBy(u.alias("u"), v.alias("v")).agg(F.min(F.col("z") + 1.0).alias("z"))
    return masks.transfer(source, target, pixel=UV, depth="z", label="label", tolerance=0.15).select(*UV, "label", F.round("error", 6).alias("error"))


def pose_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label, the even view nearest to each odd one by place and direction."""
    e = table(spark, sf_dir, "embeddings")
    at = [F.col("embedding")[k].cast("double") for k in range(6)]
    norm = F.sqrt(at[3] * at[3] + at[4] * at[4] + at[5] * at[5])
    views = e.select(F.col("vec_id").alias("vid"), "label", *[c.alias(n) for c, n in zip(at, XYZ, strict=False)], *[(c / norm).alias(n) for c, n in zip(at[3:], ("fx", "fy", "fz"), strict=True)])
    got = masks.nearest_poses(views.where("vid % 2 = 1"), views.where("vid % 2 = 0"), 0.3, sparse_id="vid", dense_id="vid", forward=["fx", "fy", "fz"], run="label")
    return got.select("label", "vid", "right_vid", F.round("score", 6).alias("score"), "monotone")


def _masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _pixels(spark, sf_dir)
    return p.select((F.col("frame") * 100 + F.col("label")).alias("mask"), "frame", *UV), p.select((F.col("frame") + 1).alias("frame"), *UV, (F.col("label") + 1).alias("identity"))


def temporal_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = _masks(spark, sf_dir)
    got = masks.temporal_identity(now, before, mask="mask", pixel=["frame", *UV], identity="identity", least=3, share=0.05)
    return got.select("mask", "identity", "overlap", F.round("ratio", 6).alias("ratio"))


def chosen_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By overlap with the frame before, else large masks by the frame, else those of early labels by the label."""
    now, before = _masks(spark, sf_dir)
    overlap = masks.temporal_identity(now, before, mask="mask", pixel=["frame", *UV], identity="identity", least=3, share=0.05)
    n = now.groupBy("mask").agg(F.count("*").alias("n"))
    world = n.where("n >= 400").select("mask", F.expr("mask div 100").alias("identity"))
    image = n.where("mask % 100 < 4").select("mask", (F.col("mask") % 100 + 1).alias("identity"))
    return masks.chosen_identity(now, overlap, world, image, mask="mask", identity="identity")


def visible_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as poses: lines that were returned are hits, quantities depths."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count("*").alias("samples"), F.median("l_quantity").alias("depth"))
    return masks.visible_poses(li, hits=F.col("hits"), samples=F.col("samples"), depth=F.col("depth"), least_ratio=0.3, near=15.0, far=35.0)


def cloud_sdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = [F.lit(0.0), F.lit(0.6), F.lit(0.8)]
    got = surfaces.signed_cells(points(spark, sf_dir), 0.1, 0.15, normal=normal, least=2)
    return got.select("cell", F.round("sdf", 6).alias("sdf"), "support")


def surface_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions up to rounding, for points with enough neighbours that are not all on one line."""
    n = surfaces.neighbourhoods(points(spark, sf_dir), 0.15).where("n >= 8")
    got = surfaces.normals(n, ["vid", "n"])
    return got.select("vid", "n", F.round("spread", 6).alias("spread"), *[F.round(f"normal.{c}", 3).alias(f"n{c}") for c in XYZ])


def linear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = [geometry.voxel(F.col(c), 0.1) for c in XYZ]
    return points(spark, sf_dir).select("vid", surfaces.linear_index(cell, [F.lit(-2)] * 3, [F.lit(4), F.lit(5), F.lit(3)]).alias("place"))


def box_evidence_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = mesh.bounds(points(spark, sf_dir), ["label"])
    at = geometry.box_points([F.col(f"{c}0") for c in XYZ], [F.col(f"{c}1") for c in XYZ])
    return b.select("label", F.posexplode(at).alias("k", "p")).select("label", "k", *[F.round(f"p.{c}", 6).alias(c) for c in XYZ])


def rebased_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the frame of the box that joins those of both sessions' points of their label."""
    p = points(spark, sf_dir)
    a, b = (mesh.bounds(points(spark, sf_dir, k), ["label"]) for k in (0, 1))
    union = a.join(b.select("label", *[F.col(f"{c}{k}").alias(f"o{c}{k}") for c in XYZ for k in (0, 1)]), "label")
    middle = union.select("label", *[((F.least(f"{c}0", f"o{c}0") + F.greatest(f"{c}1", f"o{c}1")) / 2).alias(f"m{c}") for c in XYZ])
    return p.join(middle, "label").select("vid", *[F.round(F.col(c) - F.col(f"m{c}"), 6).alias(c) for c in XYZ])


def combined_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("a"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0)).alias("b"))
    return li.select("l_suppkey", F.round(belief.combined_weight(F.col("a"), F.col("b"), 5200.0), 6).alias("weight"))


def yaw_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as angles in degrees, one a stamp."""
    e = trajectory.merge(_events(spark, sf_dir), "entity", "t", "event_id")
    return trajectory.unwrapped(e, "entity", "t", F.col("value") / 57.3).select("event_id", F.round("yaw", 5).alias("yaw"))


def yaw_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trajectory.merge(_events(spark, sf_dir), "entity", "t", "event_id").withColumn("angle", F.col("value") / 100)
    return trajectory.smoothed(e, "entity", "t", "angle", 2, 1.0).select("event_id", F.round("smooth", 5).alias("smooth"))


def path_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trajectory.merge(_events(spark, sf_dir), "entity", "t", "event_id")
    got = trajectory.resampled(e, "entity", "t", ["value"], 250.0)
    return got.select("entity", "place", F.round("value", 4).alias("value"))


def plane_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.dominant_planes(points(spark, sf_dir), ["label"], F.col("z"), 0.05)


def error_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to the other session by bins of each axis and of both level ones."""
    near = gridjoin.nearest(points(spark, sf_dir, 0), points(spark, sf_dir, 1), 0.08, left_id="vid", right_id="vid").join(points(spark, sf_dir, 0), "vid")
    bins = F.array(*[F.struct(F.lit(c).alias("axis"), F.floor(F.col(c) / 0.2).cast("string").alias("bin")) for c in XYZ], F.struct(F.lit("xy").alias("axis"), F.concat_ws(",", *[F.floor(F.col(c) / 0.2).cast("string") for c in "xy"]).alias("bin")))
    wide = near.withColumn("b", F.explode(bins)).select("b.axis", "b.bin", "distance")
    return wide.groupBy("axis", "bin").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("mean"), F.round(F.max("distance"), 6).alias("worst"))


QUERIES = {
    f.__name__: f
    for f in (
        valid_pixels, candidate_pixels, background_pixels, cluster_volumes, image_regions, image_islands, small_faces, reprojected_overlap, projected_points, back_projected, label_transfer, pose_match,
        temporal_identity, chosen_identity, visible_poses, cloud_sdf, surface_normals, linear_index, box_evidence_points, rebased_points, combined_weights, yaw_unwrapped, yaw_smoothed, path_resampled,
        plane_halves, error_axes,
    )
}

_PX = """px AS (SELECT l_linenumber::BIGINT AS frame, l_partkey // 40 AS u, l_suppkey AS v, min(round(l_tax * 100)::BIGINT) AS label, min(l_quantity) AS depth, bool_or(l_returnflag = 'R') AS moving FROM lineitem GROUP BY 1, 2, 3),
    cls AS (SELECT n_nationkey::BIGINT AS label, n_regionkey < 3 AS is_object, n_regionkey = 3 AS is_dynamic FROM nation)"""
_REGIONS = f"""WITH RECURSIVE {_PX}, q AS (SELECT frame * 100 + label AS mask, u, v, {_cell(1, 'u', 'v', '0')} AS cell FROM px),
    nb AS (SELECT s.mask, s.cell AS a, t.cell AS b FROM q s JOIN q t ON s.mask = t.mask AND t.u = s.u AND t.v = s.v + 1 UNION ALL SELECT s.mask, s.cell, t.cell FROM q s JOIN q t ON s.mask = t.mask AND t.u = s.u + 1 AND t.v = s.v),
    n2 AS (SELECT mask, a, b FROM nb UNION ALL SELECT mask, b, a FROM nb), g AS (SELECT mask, cell, cell AS root FROM q UNION SELECT g.mask, n2.b, g.root FROM g JOIN n2 ON n2.mask = g.mask AND n2.a = g.cell),
    c AS (SELECT mask, cell, min(root) AS component FROM g GROUP BY 1, 2), r AS (SELECT q.*, component FROM q JOIN c USING (mask, cell)), z AS (SELECT mask, component, count(*) AS n, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM r GROUP BY 1, 2)"""
_PIX = lambda f: ", ".join(f"(sign({f} * {c} / (z + 1.0) + 50) * floor(abs({f} * {c} / (z + 1.0) + 50) + 0.5))::BIGINT AS {n}" for c, n in (("x", "u"), ("y", "v")))
_TEMPORAL = f"""WITH {_PX}, m AS (SELECT frame * 100 + label AS mask, frame, u, v FROM px), pv AS (SELECT frame + 1 AS frame, u, v, label + 1 AS identity FROM px), sz AS (SELECT mask, count(*) AS n FROM m GROUP BY 1),
    ol AS (SELECT mask, identity, count(*) AS overlap FROM m JOIN pv USING (frame, u, v) GROUP BY 1, 2), tp AS (SELECT mask, identity, overlap, overlap / n AS ratio FROM (SELECT * FROM ol QUALIFY row_number() OVER (PARTITION BY mask ORDER BY overlap DESC, identity DESC) = 1) JOIN sz USING (mask) WHERE overlap >= 3 AND overlap / n >= 0.05)"""
_ONCE = f"WITH {_E}, u AS (SELECT entity, t, arg_min(value, event_id) AS value, min(event_id) AS event_id FROM e GROUP BY 1, 2)"
_GAUSS = lambda f: " + ".join([f"{f}(value / 100)", *[f"coalesce({f}({g}(value / 100, {k}) OVER w) * exp(-{k * k} / 2.0), 0)" for g in ("lag", "lead") for k in (1, 2)]])


def _spread() -> str:
    """Smallest eigenvalues as those of the covariances, by the same closed form."""
    return f"""nb AS (SELECT a.vid, b.x, b.y, b.z FROM p a JOIN p b ON {_D2} <= 0.15 * 0.15), cv AS (SELECT vid, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM nb GROUP BY 1 HAVING count(*) >= 8),
    s1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cv), s2 AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS pp FROM s1),
    s3 AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * pp ** 3) AS h FROM s2), s4 AS (SELECT *, q + 2 * pp * cos(acos(greatest(-1, least(1, h))) / 3 + 2 * pi() / 3) AS e FROM s3),
    cr AS (SELECT vid, n, e, unnest([{{'x': xy * yz - xz * (yy - e), 'y': xz * xy - (xx - e) * yz, 'z': (xx - e) * (yy - e) - xy * xy}}, {{'x': xy * (zz - e) - xz * yz, 'y': xz * xz - (xx - e) * (zz - e), 'z': (xx - e) * yz - xy * xz}}, {{'x': (yy - e) * (zz - e) - yz * yz, 'y': yz * xz - xy * (zz - e), 'z': xy * yz - (yy - e) * xz}}]) AS w FROM s4),
    bs AS (SELECT *, sqrt(w.x ** 2 + w.y ** 2 + w.z ** 2) AS l FROM cr QUALIFY row_number() OVER (PARTITION BY vid ORDER BY w.x ** 2 + w.y ** 2 + w.z ** 2 DESC) = 1),
    sg AS (SELECT *, CASE WHEN abs(w.x) >= abs(w.y) AND abs(w.x) >= abs(w.z) THEN sign(w.x) WHEN abs(w.y) >= abs(w.z) THEN sign(w.y) ELSE sign(w.z) END AS s FROM bs)"""


_BOX15 = ", ".join(
    "{" + f"'x': {x}, 'y': {y}, 'z': {z}" + "}"
    for x, y, z in [
        ("(x0 + x1) / 2", "(y0 + y1) / 2", "(z0 + z1) / 2"),
        *[(f"x{e}", "(y0 + y1) / 2", "(z0 + z1) / 2") for e in (0, 1)], *[("(x0 + x1) / 2", f"y{e}", "(z0 + z1) / 2") for e in (0, 1)], *[("(x0 + x1) / 2", "(y0 + y1) / 2", f"z{e}") for e in (0, 1)],
        *[(f"x{b & 1}", f"y{b >> 1 & 1}", f"z{b >> 2 & 1}") for b in range(8)],
    ]
)

ORACLES = {
    "valid_pixels": f"WITH {_PX} SELECT frame, count(*) AS n, count(*) FILTER (depth > 0.05 AND depth < 40) AS depths, count(*) FILTER (depth BETWEEN 2 AND 30) AS measured FROM px GROUP BY 1",
    "candidate_pixels": f"WITH {_PX} SELECT frame, label, count(*) AS n FROM px WHERE label IN (SELECT label FROM cls WHERE is_object OR is_dynamic) GROUP BY 1, 2",
    "background_pixels": f"WITH {_PX} SELECT frame, label, count(*) AS n FROM px WHERE NOT moving AND label NOT IN (SELECT label FROM cls WHERE is_object OR is_dynamic) GROUP BY 1, 2",
    "cluster_volumes": f"{_AB}, v AS (SELECT vid // 5 AS cluster, count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS volume FROM p GROUP BY 1) SELECT cluster, n, round(volume, 9) AS volume FROM v WHERE volume BETWEEN 0.01 AND 0.06",
    "image_regions": f"{_REGIONS} SELECT r.mask, u, v, CASE WHEN n >= 3 THEN component ELSE 0 END AS region FROM r JOIN z USING (mask, component)",
    "image_islands": f"""{_REGIONS}, t AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY mask ORDER BY n DESC, component) = 1)
        SELECT z.mask, z.component, z.n, z.component = t.component OR (z.n >= 3 AND greatest(z.u0 - t.u1, t.u0 - z.u1) <= 10 AND greatest(z.v0 - t.v1, t.v0 - z.v1) <= 10) AS kept FROM z JOIN t USING (mask)""",
    "small_faces": f"""WITH RECURSIVE p AS (SELECT vec_id AS fid, (label // 4)::BIGINT AS label FROM embeddings), ed AS (SELECT fid, unnest([(fid, fid + 2), (fid + 2, fid + 4), (fid, fid + 4)]) AS e FROM p), nb AS (SELECT DISTINCT s.fid AS u, t.fid AS v FROM ed s JOIN ed t ON s.e = t.e AND s.fid <> t.fid),
        m AS (SELECT u, v, a.label AS lu, b.label AS lv FROM nb JOIN p a ON a.fid = u JOIN p b ON b.fid = v), g AS (SELECT fid, fid AS root FROM p UNION SELECT m.v, g.root FROM g JOIN m ON m.u = g.fid AND lu = lv AND lu <> 0), c AS (SELECT fid, min(root) AS c FROM g GROUP BY 1),
        k AS (SELECT p.*, c FROM p JOIN c USING (fid)), sm AS (SELECT c FROM k WHERE label <> 0 GROUP BY 1 HAVING count(*) < 3), vo AS (SELECT c, lv, count(*) AS n FROM m JOIN k ON k.fid = u WHERE lu <> lv AND lv <> 0 AND c IN (SELECT c FROM sm) GROUP BY 1, 2),
        be AS (SELECT c, lv FROM vo QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, lv) = 1) SELECT fid, CASE WHEN label <> 0 AND c IN (SELECT c FROM sm) THEN coalesce(lv, 0) ELSE label END AS label FROM k LEFT JOIN be USING (c)""",
    "reprojected_overlap": f"""{_AB}, x AS (SELECT DISTINCT label AS cluster, {_PIX(30.0)} FROM b), y AS (SELECT DISTINCT label AS track, {_PIX(30.0)} FROM a), cm AS (SELECT cluster, track, count(*) AS common FROM x JOIN y USING (u, v) GROUP BY 1, 2)
        SELECT cluster, track, common, round(common / ((SELECT count(*) FROM x WHERE x.cluster = cm.cluster) + (SELECT count(*) FROM a WHERE a.label = cm.track) - common), 6) AS iou FROM cm""",
    "projected_points": f"{_AB} SELECT vid, CASE WHEN z + 0.1 > 0.05 THEN round(100.0 * x / (z + 0.1) + 50, 6) END AS u, CASE WHEN z + 0.1 > 0.05 THEN round(90.0 * y / (z + 0.1) + 40, 6) END AS v FROM p",
    "back_projected": f"WITH {_PX} SELECT frame, u, v, round(1.5 - (v - 50) * depth / 80, 6) AS x, round((u - 25) * depth / 100 - 2, 6) AS y, round(depth + 0.5, 6) AS z FROM px",
    "label_transfer": f"""{_AB}, s AS (SELECT {_PIX(20.0)}, z + 1.0 AS z, label FROM a), f AS (SELECT u, v, label, z FROM s QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY z, label) = 1), t AS (SELECT u, v, min(z) AS z FROM (SELECT {_PIX(20.0)}, z + 1.0 AS z FROM b) GROUP BY 1, 2)
        SELECT u, v, label, round(abs(f.z - t.z), 6) AS error FROM f JOIN t USING (u, v) WHERE abs(f.z - t.z) <= 0.15""",
    "pose_match": f"""WITH v0 AS (SELECT vec_id AS vid, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS f, embedding[5]::DOUBLE AS g, embedding[6]::DOUBLE AS h FROM embeddings), w AS (SELECT *, sqrt(f * f + g * g + h * h) AS l FROM v0),
        m AS (SELECT a.label, a.vid, b.vid AS right_vid, sqrt({_D2}) + 0.25 * acos(greatest(-1, least(1, a.f / a.l * (b.f / b.l) + a.g / a.l * (b.g / b.l) + a.h / a.l * (b.h / b.l)))) AS score FROM w a JOIN w b ON a.label = b.label AND a.vid % 2 = 1 AND b.vid % 2 = 0 AND {_D2} <= 0.09 QUALIFY row_number() OVER (PARTITION BY a.vid ORDER BY score, b.vid) = 1)
        SELECT label, vid, right_vid, round(score, 6) AS score, coalesce(right_vid > lag(right_vid) OVER (PARTITION BY label ORDER BY vid), true) AS monotone FROM m""",
    "temporal_identity": f"{_TEMPORAL} SELECT mask, identity, overlap, round(ratio, 6) AS ratio FROM tp",
    "chosen_identity": f"""{_TEMPORAL} SELECT mask, coalesce(identity, CASE WHEN n >= 400 THEN mask // 100 END, CASE WHEN mask % 100 < 4 THEN mask % 100 + 1 END, 0) AS identity, CASE WHEN identity IS NOT NULL THEN 'overlap' WHEN n >= 400 THEN 'world' WHEN mask % 100 < 4 THEN 'projection' ELSE 'none' END AS how FROM sz LEFT JOIN tp USING (mask)""",
    "visible_poses": "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS samples, median(l_quantity) AS depth FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') / count(*) >= 0.3 AND median(l_quantity) BETWEEN 15 AND 35",
    "cloud_sdf": f"""{_AB}, o AS (SELECT *, unnest(range(-2, 3)) AS di FROM p), o2 AS (SELECT *, unnest(range(-2, 3)) AS dj FROM o), o3 AS (SELECT *, unnest(range(-2, 3)) AS dk FROM o2),
        q AS (SELECT floor(x / 0.1)::BIGINT + di AS i, floor(y / 0.1)::BIGINT + dj AS j, floor(z / 0.1)::BIGINT + dk AS k, x, y, z FROM o3), d AS (SELECT ((i + 1048576) << 42) | ((j + 1048576) << 21) | (k + 1048576) AS cell, (i + 0.5) * 0.1 - x AS a, (j + 0.5) * 0.1 - y AS b, (k + 0.5) * 0.1 - z AS c FROM q),
        s AS (SELECT cell, a * 0.0 + b * 0.6 + c * 0.8 AS s FROM d WHERE a * a + b * b + c * c <= 0.15 * 0.15) SELECT cell, round(arg_min(s, (abs(s), s)), 6) AS sdf, count(*) AS support FROM s GROUP BY 1 HAVING count(*) >= 2""",
    "surface_normals": f"{_AB}, {_spread()} SELECT vid, n, round(e, 6) AS spread, round(w.x / l * s, 3) AS nx, round(w.y / l * s, 3) AS ny, round(w.z / l * s, 3) AS nz FROM sg",
    "linear_index": f"{_AB}, c AS (SELECT vid, floor(x / 0.1)::BIGINT + 2 AS i, floor(y / 0.1)::BIGINT + 2 AS j, floor(z / 0.1)::BIGINT + 2 AS k FROM p) SELECT vid, CASE WHEN i BETWEEN 0 AND 3 AND j BETWEEN 0 AND 4 AND k BETWEEN 0 AND 2 THEN i + 4 * (j + 5 * k) END AS place FROM c",
    "box_evidence_points": f"""{_AB}, b15 AS (SELECT label, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM p GROUP BY 1), l AS (SELECT label, unnest([{_BOX15}]) AS q, generate_subscripts([{_BOX15}], 1) - 1 AS k FROM b15)
        SELECT label, k::INT AS k, round(q.x, 6) AS x, round(q.y, 6) AS y, round(q.z, 6) AS z FROM l""",
    "rebased_points": f"{_AB}, m AS (SELECT label, {', '.join(f'(min({c}) + max({c})) / 2 AS m{c}' for c in XYZ)} FROM p GROUP BY 1) SELECT vid, {', '.join(f'round({c} - m{c}, 6) AS {c}' for c in XYZ)} FROM p JOIN m USING (label)",
    "combined_weights": """WITH w AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS b FROM lineitem GROUP BY 1)
        SELECT l_suppkey, round(CASE WHEN a <= 0 OR b <= 0 THEN 0 ELSE sqrt(least(a / 5200, 1) * least(b / 5200, 1)) END, 6) AS weight FROM w""",
    "yaw_unwrapped": f"""{_ONCE}, d AS (SELECT *, value / 57.3 AS a, value / 57.3 - lag(value / 57.3) OVER w AS d, first_value(value / 57.3) OVER w AS f FROM u WINDOW w AS (PARTITION BY entity ORDER BY t)),
        s AS (SELECT *, coalesce(d - 2 * pi() * floor((d + pi()) / (2 * pi())), 0) AS s FROM d) SELECT event_id, round(f + sum(s) OVER (PARTITION BY entity ORDER BY t), 5) AS yaw FROM s""",
    "yaw_smoothed": f"{_ONCE} SELECT event_id, round(atan2({_GAUSS('sin')}, {_GAUSS('cos')}), 5) AS smooth FROM u WINDOW w AS (PARTITION BY entity ORDER BY t)",
    "path_resampled": f"""{_ONCE}, d AS (SELECT *, coalesce(abs(value - lag(value) OVER w), 0) AS s, lead(value) OVER w AS nv FROM u WINDOW w AS (PARTITION BY entity ORDER BY t)), l AS (SELECT *, sum(s) OVER w AS len FROM d WINDOW w AS (PARTITION BY entity ORDER BY t)), n AS (SELECT *, lead(len) OVER (PARTITION BY entity ORDER BY t) AS nl FROM l),
        k AS (SELECT *, unnest(range(ceil(len / 250)::BIGINT, ceil(nl / 250)::BIGINT)) AS place FROM n WHERE nl > len) SELECT entity, place, round(value + (nv - value) * (place * 250 - len) / (nl - len), 4) AS value FROM k""",
    "plane_halves": f"""{_AB}, c AS (SELECT label, (sign(z) * floor(abs(z) / 0.05 + 0.5))::BIGINT AS plane, count(*) AS n FROM p GROUP BY 1, 2), m AS (SELECT *, (min(plane) OVER w + max(plane) OVER w) / 2 AS mid FROM c WINDOW w AS (PARTITION BY label))
        SELECT label, arg_min(plane, (-n, plane)) FILTER (plane <= mid) AS lower, arg_min(plane, (-n, plane)) FILTER (plane > mid) AS upper FROM m GROUP BY 1""",
    "error_axes": f"""{_AB}, nn AS (SELECT a.vid, a.x, a.y, a.z, min(sqrt({_D2})) AS d FROM a JOIN b ON {_D2} <= 0.08 * 0.08 GROUP BY ALL), w AS (SELECT 'x' AS axis, floor(x / 0.2)::BIGINT::VARCHAR AS bin, d FROM nn UNION ALL SELECT 'y', floor(y / 0.2)::BIGINT::VARCHAR, d FROM nn UNION ALL SELECT 'z', floor(z / 0.2)::BIGINT::VARCHAR, d FROM nn
        UNION ALL SELECT 'xy', floor(x / 0.2)::BIGINT || ',' || floor(y / 0.2)::BIGINT, d FROM nn) SELECT axis, bin, count(*) AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS worst FROM w GROUP BY 1, 2""",
}

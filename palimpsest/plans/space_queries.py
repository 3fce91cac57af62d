"""Registered queries on geometry, rays, meshes, associations and memory, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, labels
from ..operators import association, freespace, gridjoin, memory, mesh, metrics, objects, rays
from .inputs import HOUR, OBSERVATIONS, POINTS, observations, points, stays, table

SIZE, RADIUS = 0.1, 0.08
XYZ = ("x", "y", "z")


def label_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = labels.pack(F.col("l_partkey") % 40000, F.col("l_suppkey") % 65536)
    rows = table(spark, sf_dir, "lineitem").select(packed.alias("p"))
    return rows.groupBy(labels.semantic(F.col("p")).cast("long").alias("semantic"), labels.instance(F.col("p")).cast("long").alias("instance")).agg(F.count("*").alias("n"))


def voxel_pack_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("vid", gridjoin.cell(XYZ, SIZE).alias("cell"))


def voxel_downsample_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.first_per_voxel(points(spark, sf_dir), "vid", SIZE).select("vid", "label")


def voxel_min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.first_per_voxel(points(spark, sf_dir), "vid", SIZE, least=3).select("vid", "label")


def aabb_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = mesh.bounds(points(spark, sf_dir), ["label"])
    return b.select("label", "n", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "x0", "y0", "z0", "x1", "y1", "z1")])


def _boxes(spark: SparkSession, sf_dir: str, session: int) -> DataFrame:
    return mesh.bounds(points(spark, sf_dir, session), ["label"])


def aabb_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = association.by_box_iou(_boxes(spark, sf_dir, 0), _boxes(spark, sf_dir, 1), left_id="label", right_id="label", size=0.25, least=0.1)
    return got.select("label", "right_label", F.round("iou", 6).alias("iou"))


def points_in_box_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir, 0).select(F.col("label").alias("box"), *[f"{c}{k}" for k in (0, 1) for c in XYZ])
    p = points(spark, sf_dir)
    met = gridjoin.points_in_boxes(p, boxes, 0.25, point_id="vid", box_id="box", margin=0.02).join(p.select("vid", "label"), "vid")
    return met.groupBy("box").agg(F.count("*").alias("inside"), F.count_if(F.col("label") == F.col("box")).alias("own"))


def nn_join_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gridjoin.nearest(points(spark, sf_dir, 0), points(spark, sf_dir, 1), RADIUS, left_id="vid", right_id="vid")
    return got.select("vid", "right_vid", F.round("distance", 6).alias("distance"))


def fraction_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gridjoin.fraction_within(points(spark, sf_dir, 0), points(spark, sf_dir, 1), RADIUS, left_id="vid", right_id="vid", keys=["label"])
    return got.select("label", F.round("fraction", 6).alias("fraction"))


def voxel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gridjoin.voxel_coverage(points(spark, sf_dir, 0), points(spark, sf_dir, 1), 0.05, keys=["label"])
    return got.select("label", F.round("covered", 6).alias("covered"))


def voxel_set_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gridjoin.voxel_overlap(points(spark, sf_dir, 0), points(spark, sf_dir, 1), SIZE, left_key="label", right_key="label")
    return got.select("label", "right_label", "common", F.round("iou", 6).alias("iou"))


def mesh_accuracy_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = points(spark, sf_dir, 0), points(spark, sf_dir, 1)
    sides = [metrics.surface(x, y, [0.05, 0.08, 0.12], found_id="vid", truth_id="vid").withColumn("side", F.lit(s)) for s, x, y in (("accuracy", a, b), ("completeness", b, a))]
    return sides[0].unionByName(sides[1]).select("side", "threshold", "n", "inliers", *[F.round(c, 6).alias(c) for c in ("share", "rmse", "mad")])


def assoc_surface_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (points(spark, sf_dir, k).withColumn("entity", F.col("label") * 10 + F.col("vid") % 5) for k in (0, 1))
    return association.by_votes(a, b, RADIUS, left_id="vid", right_id="vid", left_key="entity", right_key="entity", label="label")


def assoc_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (mesh.bounds(points(spark, sf_dir, k), ["label"]).select("label", *[F.col(f"c{c}").alias(c) for c in XYZ]) for k in (0, 1))
    return association.by_centroid(a, b, 0.05, left_id="label", right_id="label").select("label", "right_label", F.round("distance", 6).alias("distance"))


def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.segmentation(assoc_surface_vote(spark, sf_dir), "entity", "right_entity")
    return got.select(*[F.round(c, 6).alias(c) if c.startswith("mean") else F.col(c) for c in got.columns])


def change_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").alias("truth"), (F.col("l_quantity") > 25).alias("found"))
    c = metrics.confusion(li, "truth", "found", ["l_linestatus"])
    rates = metrics.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("l_linestatus", "tp", "fp", "tn", "fn", *[F.round(r, 6).alias(n) for r, n in zip(rates, ("precision", "recall", "f1"), strict=True)])


def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (points(spark, sf_dir, k).select("vid") for k in (0, 1))
    near = gridjoin.nearest(points(spark, sf_dir, 0), points(spark, sf_dir, 1), RADIUS, left_id="vid", right_id="vid")
    back = near.select(F.col("right_vid").alias("vid"))
    return metrics.detection(a, b, near, back, "vid", "vid")


def cosine_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding against its label's first one."""
    e = table(spark, sf_dir, "embeddings")
    lead = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("lead"))
    return e.join(lead, "label").select("vec_id", F.round(geometry.cosine(F.col("embedding"), F.col("lead")), 5).alias("similarity"))


def _rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a sensor on one side to every odd point; stamps are ids."""
    p = points(spark, sf_dir, 1)
    return p.select(F.col("vid").alias("ray"), F.col("vid").alias("ts"), F.lit(-0.6).alias("sx"), F.lit(0.013).alias("sy"), F.lit(0.007).alias("sz"), *[F.col(c).alias(f"t{c}") for c in XYZ])


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rays.verify(points(spark, sf_dir, 0), _rays(spark, sf_dir), point_id="vid", ray_id="ray", block=0.1, radial=0.02, depth=0.03)


def ray_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).where("verdict <> 'occluded'").groupBy("vid").agg(F.count_if(F.col("verdict") == "present").alias("present"), F.count_if(F.col("verdict") == "absent").alias("absent"))


def _policy(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = observations(spark, sf_dir)
        windows = o.select(F.col("event_id").alias("vid"), "entity", (F.col("t") - 48 * HOUR).alias("first"), (F.col("t") + 24 * HOUR).alias("last"))
        poses = o.where("verdict = 'present'").select("entity", F.col("t").alias("ts")).distinct()
        return rays.sources(windows, poses, name, key="vid", group="entity")

    run.__name__ = f"ray_policy_{name}"
    return run


def endpoint_classify_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs: an order's lines by number, one class each; hits: pixels of each frame."""
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") * 10).alias("run_start"), (F.col("l_linenumber") * 10 + 7).alias("run_end"), F.col("l_returnflag").alias("class"))
    hits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_custkey") % 60).cast("int").alias("pixel"))
    own = labels.semantic(F.lit(0))
    met = rays.classify_endpoints(hits, runs, frame="frame", pixel="pixel")
    return met.groupBy(F.coalesce("class", F.lit("none")).alias("class")).agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max(own).cast("long").alias("own"))


def latest_value_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    left = o.where("verdict = 'absent'").select("event_id", "entity", "t")
    right = o.where("verdict = 'present'").groupBy("entity", "t").agg(F.max("event_id").alias("seen"))
    return rays.nearest_before(left, right, by=["entity"], ts="t", value="seen").select("event_id", "seen")


def free_space_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freespace.free_counts(_rays(spark, sf_dir), ray_id="ray", size=0.15, short=0.05)


def free_space_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = freespace.free_fraction(points(spark, sf_dir, 0), free_space_counts(spark, sf_dir), size=0.15, keys=("label",), least=2)
    return got.select("label", "n", F.round("fraction", 6).alias("fraction"))


def free_space_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freespace.consistent(points(spark, sf_dir, 0), free_space_counts(spark, sf_dir), size=0.15, least=2).select("vid", "label")


def tsdf_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rays(spark, sf_dir)
    fields = [freespace.ray_tsdf(r.where(f"ray % 4 = {k}"), ray_id="ray", size=0.1, truncation=0.1) for k in (1, 3)]
    return freespace.tsdf_change(*fields).select("overlap", F.round("change", 6).alias("change"))


def semantic_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.majority(table(spark, sf_dir, "documents"), ["source"], "lang")


def dominant_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.dominant_plane(points(spark, sf_dir), ["label"], F.col("z"), 0.05)


def connected_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.voxel_components(points(spark, sf_dir), "label", 0.2, diagonal=False)


def merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that are merged into a smaller one: a third of their keys, rounded down."""
    merges = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 1 and c_custkey > 0").select(F.col("c_custkey").alias("from_node"), F.expr("c_custkey div 3").alias("to_node"))
    return objects.merged_into(merges)


def merge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_node"), F.col("l_suppkey").alias("to_node"), (F.col("l_quantity") > 20).alias("is_valid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"))
    return association.merge_targets(p, order="n")


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = gridjoin.pairs(points(spark, sf_dir, 0), points(spark, sf_dir, 1), RADIUS, left_id="vid", right_id="vid")
    return association.first_match(near, "vid", "right_vid", F.col("d2") < 0.004)


def weld_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.weld(points(spark, sf_dir, 0), points(spark, sf_dir, 1), RADIUS)


def mesh_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.append(points(spark, sf_dir, 0), points(spark, sf_dir, 1), RADIUS).select("vid", "label")


def absent_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even points that no ray shows absent, and the faces that keep their corners."""
    gone = _seen(spark, sf_dir).where("verdict = 'absent'").select("vid").distinct()
    left = points(spark, sf_dir, 0).join(gone, "vid", "left_anti")
    faces = points(spark, sf_dir, 0).select(F.col("vid").alias("fid"), F.col("vid").alias("a"), (F.col("vid") + 2).alias("b"), (F.col("vid") + 4).alias("c"))
    return mesh.faces_of(faces, left).select("fid", "a", "b", "c")


def overwrite_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.newest_per_voxel(points(spark, sf_dir), "vid", 0.15, slack=100).select("vid", "label")


def vertex_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.renumber(points(spark, sf_dir), ["label"]).select("vid", F.col("target").cast("long").alias("target"))


def prior_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = memory.match_prior(points(spark, sf_dir, 0), points(spark, sf_dir, 1), 0.12, prior_id="vid", current_id="vid", label="label")
    return got.select("vid", "right_vid", F.round("d2", 9).alias("d2"))


def memory_update_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (points(spark, sf_dir, k).withColumn("label", F.col("label") * 20 + F.pmod(F.col("vid") * 7, F.lit(23 + 6 * k))) for k in (0, 1))
    counts = freespace.free_counts(_rays(spark, sf_dir), ray_id="ray", size=0.15, short=0.05)
    free = freespace.free_fraction(a, counts, size=0.15, keys=("label",)).select("label", F.col("fraction").alias("free"))
    before = mesh.bounds(a, ["label"]).join(free, "label").select("label", "cx", "free")
    after = mesh.bounds(b, ["label"]).select("label", "cx")
    return memory.session_update(before, after, "label", free_share="free", least_free=0.5, delta=F.abs(F.col("a_cx") - F.col("b_cx")), tolerance=0.1).groupBy("decision").agg(F.count("*").alias("n"))


def panoptic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of order pairs: each line is a sample of its customer nation and supplier nation."""
    li = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    samples = li.join(s, "l_suppkey").select("b", F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("w"), "l_discount", "l_tax")
    got = memory.conflict(samples, ["a", "b"], weight=F.col("w"), conflicting=F.col("l_discount") > 0.06, matching=F.col("l_tax") < 0.04, rejection=F.col("n") * 10.0, acceptance=F.col("n") * 12.0)
    state = memory.pair_state(F.col("conflicts"), F.col("a") == F.col("b"), F.col("matches"), F.lit("unobserved"))
    return got.select("a", "b", "n", F.round("conflict_weight", 3).alias("conflict_weight"), F.round("match_weight", 3).alias("match_weight"), state.alias("state"))


def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.summary(table(spark, sf_dir, "events"), ["event_type"], "value")
    return got.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")])


def co_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each day's bin that a later bin of the same entity follows directly."""
    days = stays(spark, sf_dir).select("entity", F.expr(f"first div {24 * HOUR * 30}L").alias("bin")).distinct()
    after = days.select("entity", (F.col("bin") - 1).alias("bin"))
    return days.join(after, ["entity", "bin"]).groupBy("bin").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        label_unpack, voxel_pack_key, voxel_downsample_first, voxel_min_support, aabb_by_label, aabb_iou_pairs, points_in_box_audit, nn_join_ab, fraction_within, voxel_coverage, voxel_set_iou,
        mesh_accuracy_completeness, assoc_surface_vote, assoc_centroid, segmentation_metrics, change_confusion, detection_counts, cosine_match, ray_verify, *map(_policy, rays.POLICIES), endpoint_classify_rle,
        latest_value_before, free_space_counts, free_space_fraction, free_space_filter, tsdf_change, semantic_majority, dominant_plane, connected_voxels, merge_chains, merge_lookup, first_match, weld_append,
        mesh_append, absent_removal, overwrite_recent, vertex_renumber, prior_match_greedy, memory_update_full_outer, panoptic_pairs, timing_stats, co_presence,
    )
}


def _cell(size: float, x: str = "x", y: str = "y", z: str = "z") -> str:
    return f"(((floor({x} / {size})::BIGINT + 1048576) << 42) | ((floor({y} / {size})::BIGINT + 1048576) << 21) | (floor({z} / {size})::BIGINT + 1048576))"


_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_NEAR = f"nn AS (SELECT vid, right_vid, d2 FROM (SELECT a.vid, b.vid AS right_vid, {_D2} AS d2, row_number() OVER (PARTITION BY a.vid ORDER BY {_D2}, b.vid) AS k FROM a JOIN b ON {_D2} <= {RADIUS} * {RADIUS}) WHERE k = 1)"
_BOX = "min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1"
_RAYS = "r AS (SELECT vid AS ray, vid AS ts, -0.6::DOUBLE AS sx, 0.013::DOUBLE AS sy, 0.007::DOUBLE AS sz, x AS tx, y AS ty, z AS tz FROM b)"
_SEEN = f"""q AS (SELECT a.vid, r.ray, a.x - sx AS px, a.y - sy AS py, a.z - sz AS pz, tx - sx AS qx, ty - sy AS qy, tz - sz AS qz FROM a CROSS JOIN r),
    h AS (SELECT vid, ray, sqrt(px * px + py * py + pz * pz) AS d, (px * qx + py * qy + pz * qz) / sqrt(px * px + py * py + pz * pz) AS reach,
          sqrt((py * qz - pz * qy) ** 2 + (pz * qx - px * qz) ** 2 + (px * qy - py * qx) ** 2) / sqrt(px * px + py * py + pz * pz) AS aside FROM q)"""
_AB = f"WITH {POINTS}"


def _policy_sql(pick: str) -> str:
    return f"""WITH {OBSERVATIONS}, w AS (SELECT event_id AS vid, entity, t - {48 * HOUR} AS first, t + {24 * HOUR} AS last FROM o),
        p AS (SELECT DISTINCT entity, t AS ts FROM o WHERE verdict = 'present'), m AS (SELECT vid, ts, first, last FROM w JOIN p USING (entity) WHERE ts BETWEEN first AND last) {pick}"""


_VOTES = f"""{_AB}, ea AS (SELECT *, label * 10 + vid % 5 AS entity FROM a), eb AS (SELECT *, label * 10 + vid % 5 AS entity FROM b),
    near AS (SELECT a.entity, b.entity AS t, row_number() OVER (PARTITION BY a.vid ORDER BY {_D2}, b.vid) AS k FROM ea a JOIN eb b ON a.label = b.label AND {_D2} <= {RADIUS} * {RADIUS}),
    v AS (SELECT entity, t AS right_entity, count(*) AS votes FROM near WHERE k = 1 GROUP BY 1, 2),
    best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY entity ORDER BY votes DESC, right_entity) = 1)"""


def _free_sql(size: float, short: float) -> str:
    """Cells that rays cross: each ray is cut where it meets a cell's wall, and a piece lies in the cell of its middle."""
    walls = [f"list_transform(range(least(floor(s{c} / {size}), floor((s{c} + (t{c} - s{c}) / len * e) / {size}))::BIGINT + 1, greatest(floor(s{c} / {size}), floor((s{c} + (t{c} - s{c}) / len * e) / {size}))::BIGINT + 1), lambda k: (k * {size}::DOUBLE - s{c}) / ((t{c} - s{c}) / len))" for c in XYZ]
    at = [f"(s{c} + (t{c} - s{c}) * m / len)" for c in XYZ]
    return f"""len AS (SELECT *, sqrt((tx - sx) ** 2 + (ty - sy) ** 2 + (tz - sz) ** 2) AS len FROM r), en AS (SELECT *, len - {short} AS e FROM len WHERE len > {short}),
    cu AS (SELECT *, list_sort(list_concat([0.0::DOUBLE, e], list_filter(list_concat(list_concat({walls[0]}, {walls[1]}), {walls[2]}), lambda w: w > 0 AND w < e))) AS cuts FROM en),
    pc AS (SELECT *, unnest(range(1, len(cuts))) AS i FROM cu), md AS (SELECT *, (cuts[i] + cuts[i + 1]) / 2 AS m FROM pc WHERE cuts[i + 1] - cuts[i] > {size} * 1e-9),
    fc AS (SELECT cell, count(*) AS n FROM (SELECT DISTINCT ray, {_cell(size, *at)} AS cell FROM md) GROUP BY 1)"""


_FREE = _free_sql(0.15, 0.05)

ORACLES = {
    "label_unpack": "SELECT l_partkey % 40000 AS semantic, l_suppkey % 65536 AS instance, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "voxel_pack_key": f"{_AB} SELECT vid, {_cell(SIZE)} AS cell FROM p",
    "voxel_downsample_first": f"{_AB} SELECT min(vid) AS vid, arg_min(label, vid) AS label FROM p GROUP BY {_cell(SIZE)}",
    "voxel_min_support": f"{_AB} SELECT min(vid) AS vid, arg_min(label, vid) AS label FROM p GROUP BY {_cell(SIZE)} HAVING count(*) >= 3",
    "aabb_by_label": f"{_AB} SELECT label, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(min(z), 6) AS z0, round(max(x), 6) AS x1, round(max(y), 6) AS y1, round(max(z), 6) AS z1 FROM p GROUP BY label",
    "aabb_iou_pairs": f"""{_AB}, ba AS (SELECT label, {_BOX} FROM a GROUP BY 1), bb AS (SELECT label, {_BOX} FROM b GROUP BY 1),
        v AS (SELECT a.label, b.label AS right_label, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) * greatest(least(a.z1, b.z1) - greatest(a.z0, b.z0), 0) AS c,
              (a.x1 - a.x0) * (a.y1 - a.y0) * (a.z1 - a.z0) AS va, (b.x1 - b.x0) * (b.y1 - b.y0) * (b.z1 - b.z0) AS vb FROM ba a CROSS JOIN bb b)
        SELECT label, right_label, round(c / (va + vb - c), 6) AS iou FROM v WHERE c > 0 AND c / (va + vb - c) >= 0.1""",
    "points_in_box_audit": f"""{_AB}, bx AS (SELECT label AS box, {_BOX} FROM a GROUP BY 1)
        SELECT box, count(*) AS inside, count(*) FILTER (label = box) AS own FROM p JOIN bx ON x BETWEEN x0 - 0.02 AND x1 + 0.02 AND y BETWEEN y0 - 0.02 AND y1 + 0.02 AND z BETWEEN z0 - 0.02 AND z1 + 0.02 GROUP BY box""",
    "nn_join_ab": f"{_AB}, {_NEAR} SELECT vid, right_vid, round(sqrt(d2), 6) AS distance FROM nn",
    "fraction_within": f"{_AB}, {_NEAR} SELECT label, round(count(nn.vid) / count(*), 6) AS fraction FROM a LEFT JOIN nn USING (vid) GROUP BY label",
    "voxel_coverage": f"""{_AB}, va AS (SELECT DISTINCT label, floor(x / 0.05)::BIGINT AS i, floor(y / 0.05)::BIGINT AS j, floor(z / 0.05)::BIGINT AS k FROM a), vb AS (SELECT DISTINCT floor(x / 0.05)::BIGINT AS i, floor(y / 0.05)::BIGINT AS j, floor(z / 0.05)::BIGINT AS k FROM b)
        SELECT label, round(count(*) FILTER (EXISTS (SELECT 1 FROM vb WHERE abs(vb.i - va.i) <= 1 AND abs(vb.j - va.j) <= 1 AND abs(vb.k - va.k) <= 1)) / count(*), 6) AS covered FROM va GROUP BY label""",
    "voxel_set_iou": f"""{_AB}, va AS (SELECT DISTINCT label, {_cell(SIZE)} AS c FROM a), vb AS (SELECT DISTINCT label, {_cell(SIZE)} AS c FROM b)
        SELECT va.label, vb.label AS right_label, count(*) AS common, round(count(*) / ((SELECT count(*) FROM va v WHERE v.label = va.label) + (SELECT count(*) FROM vb v WHERE v.label = vb.label) - count(*)), 6) AS iou FROM va JOIN vb USING (c) GROUP BY 1, 2""",
    "mesh_accuracy_completeness": f"""{_AB}, m AS (SELECT 'accuracy' AS side, a.vid, min(sqrt({_D2})) AS d FROM a CROSS JOIN b GROUP BY a.vid UNION ALL SELECT 'completeness', b.vid, min(sqrt({_D2})) FROM a CROSS JOIN b GROUP BY b.vid)
        SELECT side, threshold, count(*) AS n, count(*) FILTER (d <= threshold) AS inliers, round(count(*) FILTER (d <= threshold) / count(*), 6) AS share, round(sqrt(avg(d * d) FILTER (d <= threshold)), 6) AS rmse, round(avg(d) FILTER (d <= threshold), 6) AS mad
        FROM m CROSS JOIN (SELECT unnest([0.05, 0.08, 0.12])::DOUBLE AS threshold) GROUP BY side, threshold""",
    "assoc_surface_vote": f"{_VOTES} SELECT entity, right_entity, votes FROM best",
    "assoc_centroid": f"""{_AB}, ca AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM a GROUP BY 1), cb AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM b GROUP BY 1),
        m AS (SELECT a.label, b.label AS right_label, sqrt({_D2}) AS d FROM ca a JOIN cb b ON {_D2} <= 0.0025 QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY {_D2}, b.label) = 1)
        SELECT ca.label, right_label, round(d, 6) AS distance FROM ca LEFT JOIN m USING (label)""",
    "segmentation_metrics": f"""{_VOTES}, ov AS (SELECT count(*) AS n FROM best GROUP BY right_entity HAVING count(*) > 1), un AS (SELECT count(*) AS n FROM best GROUP BY entity HAVING count(*) > 1)
        SELECT (SELECT count(*) FROM ov) AS n_over, (SELECT round(avg(n), 6) FROM ov) AS mean_over, (SELECT max(n) FROM ov) AS max_over, (SELECT count(*) FROM un) AS n_under, (SELECT round(avg(n), 6) FROM un) AS mean_under, (SELECT max(n) FROM un) AS max_under""",
    "change_confusion": """WITH c AS (SELECT l_linestatus, count(*) FILTER (t AND f) AS tp, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (NOT t AND NOT f) AS tn, count(*) FILTER (t AND NOT f) AS fn FROM (SELECT l_linestatus, l_returnflag = 'R' AS t, l_quantity > 25 AS f FROM lineitem) GROUP BY 1)
        SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
    "detection_counts": f"{_AB}, {_NEAR} SELECT (SELECT count(*) FROM nn) AS detected, (SELECT count(*) FROM a WHERE vid NOT IN (SELECT vid FROM nn)) AS missed, (SELECT count(*) FROM b WHERE vid NOT IN (SELECT right_vid FROM nn)) AS hallucinated",
    "cosine_match": "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], l.lead::DOUBLE[]), 5) AS similarity FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS lead FROM embeddings GROUP BY 1) l USING (label)",
    "ray_verify": f"{_AB}, {_RAYS}, {_SEEN} SELECT vid, count(*) FILTER (abs(reach - d) <= 0.03) AS present, count(*) FILTER (reach - d > 0.03) AS absent FROM h WHERE aside <= 0.02 AND d - reach <= 0.03 GROUP BY vid",
    "ray_policy_first": _policy_sql("SELECT vid, min(ts) AS ts FROM m GROUP BY vid"),
    "ray_policy_last": _policy_sql("SELECT vid, max(ts) AS ts FROM m GROUP BY vid"),
    "ray_policy_first_and_last": _policy_sql("SELECT vid, min(ts) AS ts FROM m GROUP BY vid UNION SELECT vid, max(ts) FROM m GROUP BY vid"),
    "ray_policy_middle": _policy_sql("SELECT vid, ts FROM m QUALIFY row_number() OVER (PARTITION BY vid ORDER BY abs(2 * ts - first - last), ts) = 1"),
    "ray_policy_all": _policy_sql("SELECT vid, ts FROM m"),
    "endpoint_classify_rle": """SELECT coalesce(l_returnflag, 'none') AS class, count(*) AS n, min(o_orderkey) AS first_frame, 0::BIGINT AS own FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND o_custkey % 60 >= l_linenumber * 10 AND o_custkey % 60 < l_linenumber * 10 + 7 GROUP BY 1""",
    "latest_value_before": f"""WITH {OBSERVATIONS}, r AS (SELECT entity, t, max(event_id) AS seen FROM o WHERE verdict = 'present' GROUP BY 1, 2)
        SELECT l.event_id, r.seen FROM (SELECT * FROM o WHERE verdict = 'absent') l ASOF LEFT JOIN r ON l.entity = r.entity AND l.t >= r.t""",
    "free_space_counts": f"{_AB}, {_RAYS}, {_FREE} SELECT cell, n FROM fc",
    "free_space_fraction": f"{_AB}, {_RAYS}, {_FREE} SELECT label, count(*) AS n, round(avg(CASE WHEN coalesce(fc.n, 0) >= 2 THEN 1 ELSE 0 END), 6) AS fraction FROM (SELECT *, {_cell(0.15)} AS cell FROM a) LEFT JOIN fc USING (cell) GROUP BY label",
    "free_space_filter": f"{_AB}, {_RAYS}, {_FREE} SELECT vid, label FROM a WHERE {_cell(0.15)} NOT IN (SELECT cell FROM fc WHERE n >= 2)",
    "tsdf_change": f"""{_AB}, {_RAYS}, len AS (SELECT *, sqrt((tx - sx) ** 2 + (ty - sy) ** 2 + (tz - sz) ** 2) AS len FROM r), k AS (SELECT *, unnest(range(-2, 3)) * -0.05::DOUBLE AS sdf FROM len),
        c AS (SELECT ray % 4 AS s, {_cell(0.1, "(tx - (tx - sx) * sdf / len)", "(ty - (ty - sy) * sdf / len)", "(tz - (tz - sz) * sdf / len)")} AS cell, sdf FROM k WHERE sdf <= len),
        f AS (SELECT s, cell, sdf FROM c QUALIFY row_number() OVER (PARTITION BY s, cell ORDER BY abs(sdf), sdf) = 1)
        SELECT count(*) AS overlap, round(avg(abs(u.sdf - v.sdf)), 6) AS change FROM (SELECT * FROM f WHERE s = 1) u JOIN (SELECT * FROM f WHERE s = 3) v USING (cell)""",
    "semantic_majority": "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1",
    "dominant_plane": f"{_AB} SELECT label, plane, n FROM (SELECT label, (sign(z) * floor(abs(z) / 0.05 + 0.5))::BIGINT AS plane, count(*) AS n FROM p GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, plane) = 1",
    "connected_voxels": f"""WITH RECURSIVE {POINTS}, v AS (SELECT DISTINCT label, floor(x / 0.2)::BIGINT AS i, floor(y / 0.2)::BIGINT AS j, floor(z / 0.2)::BIGINT AS k, {_cell(0.2)} AS cell FROM p),
        e AS (SELECT s.label, s.cell AS u, t.cell AS w FROM v s JOIN v t ON s.label = t.label AND abs(s.i - t.i) + abs(s.j - t.j) + abs(s.k - t.k) = 1),
        c AS (SELECT label, cell, cell AS root FROM v UNION SELECT c.label, e.w, c.root FROM c JOIN e ON c.label = e.label AND c.cell = e.u)
        SELECT label, cell, min(root) AS component FROM c GROUP BY 1, 2""",
    "merge_chains": """WITH RECURSIVE m AS (SELECT c_custkey AS f, c_custkey // 3 AS t FROM customer WHERE c_custkey % 4 <> 1 AND c_custkey > 0), n AS (SELECT f AS node FROM m UNION SELECT t FROM m),
        c AS (SELECT node, node AS final FROM n UNION ALL SELECT c.node, m.t FROM c JOIN m ON c.final = m.f) SELECT node, min(final) AS final FROM c GROUP BY node""",
    "merge_lookup": "SELECT from_node, to_node FROM (SELECT l_partkey AS from_node, l_suppkey AS to_node, l_quantity > 20 AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) = 1) WHERE v",
    "first_match": f"{_AB} SELECT a.vid, min(b.vid) AS right_vid FROM a JOIN b ON {_D2} < 0.004 GROUP BY a.vid",
    "weld_append": f"{_AB}, n2 AS (SELECT b.vid, a.vid AS target FROM a JOIN b ON {_D2} <= {RADIUS} * {RADIUS} QUALIFY row_number() OVER (PARTITION BY b.vid ORDER BY {_D2}, a.vid) = 1) SELECT b.vid, coalesce(target, b.vid) AS target FROM b LEFT JOIN n2 USING (vid)",
    "mesh_append": f"{_AB} SELECT vid, label FROM a UNION ALL SELECT vid, label FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {_D2} <= {RADIUS} * {RADIUS})",
    "absent_removal": f"""{_AB}, {_RAYS}, {_SEEN}, l AS (SELECT vid FROM a WHERE vid NOT IN (SELECT vid FROM h WHERE aside <= 0.02 AND reach - d > 0.03))
        SELECT vid AS fid, vid AS a, vid + 2 AS b, vid + 4 AS c FROM l WHERE vid + 2 IN (SELECT vid FROM l) AND vid + 4 IN (SELECT vid FROM l)""",
    "overwrite_recent": f"{_AB} SELECT vid, label FROM p QUALIFY max(vid) OVER (PARTITION BY {_cell(0.15)}) <= vid + 100",
    "vertex_renumber": f"{_AB} SELECT vid, row_number() OVER (ORDER BY label, vid) - 1 AS target FROM p",
    "prior_match_greedy": f"""WITH RECURSIVE {POINTS}, c AS (SELECT a.vid, b.vid AS r, {_D2} AS d2, row_number() OVER (ORDER BY {_D2}, a.vid, b.vid) AS k FROM a JOIN b ON a.label = b.label AND {_D2} <= 0.12 * 0.12),
        f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS l, []::BIGINT[] AS r UNION ALL
              SELECT c.k, CASE WHEN list_contains(f.l, c.vid) OR list_contains(f.r, c.r) THEN f.l ELSE list_append(f.l, c.vid) END, CASE WHEN list_contains(f.l, c.vid) OR list_contains(f.r, c.r) THEN f.r ELSE list_append(f.r, c.r) END FROM f JOIN c ON c.k = f.k + 1),
        m AS (SELECT unnest(l) AS vid, unnest(r) AS right_vid FROM (SELECT l, r FROM f ORDER BY k DESC LIMIT 1))
        SELECT a.vid, right_vid, round(d2, 9) AS d2 FROM a LEFT JOIN m USING (vid) LEFT JOIN c ON c.vid = a.vid AND c.r = right_vid""",
    "memory_update_full_outer": f"""{_AB}, {_RAYS}, {_FREE}, la AS (SELECT *, label * 20 + (vid * 7) % 23 AS l FROM a), lb AS (SELECT *, label * 20 + (vid * 7) % 29 AS l FROM b),
        f AS (SELECT l, avg(x) AS cx, avg(CASE WHEN fc.n IS NOT NULL THEN 1 ELSE 0 END) AS free FROM (SELECT *, {_cell(0.15)} AS cell FROM la) LEFT JOIN fc USING (cell) GROUP BY 1), g AS (SELECT l, avg(x) AS cx FROM lb GROUP BY 1)
        SELECT CASE WHEN f.l IS NULL THEN 'new' WHEN g.l IS NULL AND free >= 0.5 THEN 'absent' WHEN g.l IS NULL THEN 'unobserved' WHEN abs(g.cx - f.cx) <= 0.1 THEN 'persistent' ELSE 'changed' END AS decision, count(*) AS n FROM f FULL JOIN g ON f.l = g.l GROUP BY 1""",
    "panoptic_pairs": """WITH c AS (SELECT l_linenumber AS a, s_nationkey AS b, count(*) AS n, sum(CASE WHEN l_discount > 0.06 THEN l_quantity ELSE 0 END) AS cw, sum(CASE WHEN l_tax < 0.04 THEN l_quantity ELSE 0 END) AS mw FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
        SELECT a, b, n, round(cw, 3) AS conflict_weight, round(mw, 3) AS match_weight, CASE WHEN cw > n * 10.0 THEN 'absent' WHEN a = b AND mw > n * 12.0 THEN 'persistent' ELSE 'unobserved' END AS state FROM c""",
    "timing_stats": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1",
    "co_presence": f"""WITH d AS (SELECT DISTINCT o_custkey AS e, epoch_us(o_orderdate) // {24 * HOUR * 30} AS bin FROM orders) SELECT x.bin, count(*) AS n FROM d x JOIN d y ON x.e = y.e AND y.bin = x.bin + 1 GROUP BY 1""",
}

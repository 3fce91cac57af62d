"""Registered queries on clusters, alignment, samples and scene composition, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import belief, geometry
from ..operators import alignment, association, clusters, freespace, gridjoin, mesh, metrics, presence, quality, rays
from .inputs import HOUR, OBSERVATIONS, POINTS, STAYS, observations, points, stays, table
from .presence_queries import DAY, ORDER_DAY
from .space_queries import _AB, _D2, _NEAR, _RAYS, _SEEN, RADIUS, XYZ, _cell, _free_sql, _rays, _seen


def cluster_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("label", gridjoin.cell(XYZ, 0.2).alias("cell"))
    return clusters.sized(p, ["label", "cell"], 2, 6)


def background_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    prompts = e.where("vec_id < 5").select(F.col("embedding").alias("prompt"))
    return clusters.rejected(e, prompts, "embedding", "prompt", 0.75).select("vec_id", "label")


def dynamic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clusters.flagged_share(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "R", 0.33)
    return got.select("l_suppkey", "n", F.round("share", 6).alias("share"))


def euclidean_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.euclidean(points(spark, sf_dir), 0.12)


def island_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.islands(clusters.euclidean(points(spark, sf_dir), 0.12), "label", "cluster", least=2, share=0.2)


def attach_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = clusters.euclidean(points(spark, sf_dir), 0.1)
    n = own.groupBy("cluster").agg(F.count("*").alias("n"))
    at = points(spark, sf_dir).join(n, F.col("vid") == F.col("cluster")).select("cluster", "label", "n", *XYZ)
    return clusters.attach(at, F.col("n") >= 3, 0.3, cid="cluster", label="label")


def stable_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.stable_voxels(points(spark, sf_dir).withColumn("frame", F.col("vid") % 20), "frame", 0.2, 3)


def merge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("node", F.floor(F.col("vid") / 10))
    b = mesh.bounds(p, ["node"]).withColumns({"label": F.col("node") % 3, "first": F.col("node") * 5, "last": F.col("node") * 5 + 12})
    got = clusters.proposals(b.select("node", "label", "first", "last", *[f"{c}{k}" for k in (0, 1) for c in XYZ]), node="node", label="label", size=0.5, least=0.3)
    return got.select("from_node", "to_node", F.round("iou", 6).alias("iou"))


def pixel_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), F.col("l_linenumber").alias("a"), (F.col("l_quantity") / 10).cast("int").alias("b"))
    got = clusters.pixel_iou(li, li, ["u", "v"], "a", "b")
    return got.select("a", "b", "common", F.round("iou", 6).alias("iou"))


def frontier_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = points(spark, sf_dir).select(*[geometry.voxel(F.col(c), 0.2).alias(c) for c in XYZ]).distinct()
    a, b = cells.select(*[F.col(c).alias(f"a{c}") for c in XYZ]), cells.select(*[F.col(c).alias(f"b{c}") for c in XYZ])
    steps = [s for s in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    near = a.withColumn("s", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, XYZ, strict=True)]) for s in steps])))
    met = near.join(b, [(F.col(f"a{c}") + F.col(f"s.{c}")) == F.col(f"b{c}") for c in XYZ])
    key = lambda p: F.concat_ws(",", *[F.col(f"{p}{c}").cast("string") for c in XYZ])
    edges = met.select(key("a").alias("u"), key("b").alias("v"))
    seeds = cells.where("x = 0 and y = 0 and z = 0").select(F.concat_ws(",", *[F.col(c).cast("string") for c in XYZ]).alias("cell"))
    return clusters.hops(edges, seeds, "cell", 30)


def translation_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = points(spark, sf_dir, 0), points(spark, sf_dir, 1)
    got = alignment.translation(a, b.withColumn("x", F.col("x") + 0.03), 0.2, most=0.05, gain=0.005)
    return got.select("label", "n", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "dz", "before", "after")], "accepted")


def plane_snapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.snap(points(spark, sf_dir), "label", F.col("vid") % 2 == 0).select("vid", F.round("snapped", 6).alias("snapped"))


def error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = gridjoin.nearest(points(spark, sf_dir, 0), points(spark, sf_dir, 1), RADIUS, left_id="vid", right_id="vid").join(points(spark, sf_dir, 0), "vid")
    got = alignment.buckets(near, ["label"], F.col("x"), 0.1, F.col("distance"))
    return got.select("label", "bucket", "n", F.round("mean", 6).alias("mean"), F.round("worst", 6).alias("worst"))


def feature_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = alignment.mean_feature(table(spark, sf_dir, "embeddings"), "label", "embedding", F.col("vec_id") % 3 + 1)
    return got.select("label", "position", F.round("value", 6).alias("value"), "n")


def sample_linspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linspace(points(spark, sf_dir), ["label"], ["vid"], 7).select("vid", "label")


def sample_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.every(observations(spark, sf_dir), "event_id", 7, 3).select("event_id", "entity")


def buffer_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.newest(observations(spark, sf_dir), ["entity"], "event_id", 5, 3).select("entity", "event_id")


def interval_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed corrections: some suppliers' lines in a range of orders get another number."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0")
    rules = s.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") * 20).alias("lo"), (F.col("s_suppkey") * 20 + 9000).alias("hi"), (F.col("s_nationkey") + 100).alias("l_linenumber"))
    got = alignment.remap(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), rules, "l_suppkey", "l_orderkey", value="l_linenumber")
    return got.groupBy("l_linenumber").agg(F.count("*").alias("n"))


def restore_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    current = observations(spark, sf_dir).select(F.col("entity").alias("node")).distinct()
    return alignment.fresh_ids(prior, current, "node")


def prune_unobserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects any of whose points is near an observed one."""
    a = points(spark, sf_dir, 0).withColumn("object", F.floor(F.col("vid") / 6))
    near = gridjoin.within(a, points(spark, sf_dir, 1), 0.05, left_id="vid", right_id="vid")
    return near.groupBy("object").agg(F.count("*").alias("n_seen"))


def merge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Background vertices that are neither shown absent nor near an object's mesh."""
    gone = _seen(spark, sf_dir).where("verdict = 'absent'").select("vid").distinct()
    left = points(spark, sf_dir, 0).join(gone, "vid", "left_anti")
    own = points(spark, sf_dir, 1).where("label < 3")
    return gridjoin.within(left, own, RADIUS, left_id="vid", right_id="vid", anti=True).select("vid", "label")


def compose_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The background and the points of the objects that are present, with their owner. Orders and points are dealt to as many
    places as the fewer of them have, so each order has points and each point an owner; where orders are more, they share points."""
    background = points(spark, sf_dir, 0).select("vid", F.lit(None).cast("long").alias("owner"))
    place, orders = F.expr("vid div 2"), table(spark, sf_dir, "orders")
    places = F.least(points(spark, sf_dir, 1).agg(F.max(place) + 1).scalar(), orders.agg(F.max("o_orderkey") + 1).scalar())
    present = presence.present_at(stays(spark, sf_dir), F.lit(ORDER_DAY)).select(F.col("order_id").alias("owner"), (F.col("order_id") % places).alias("place"))
    own = points(spark, sf_dir, 1).select("vid", (place % places).alias("place")).join(present, "place")
    return background.unionByName(own.select("vid", "owner"))


def prior_vertex_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior vertices: persistent where a current one is near, else absent or unobserved by rays."""
    prior = points(spark, sf_dir, 0)
    near = gridjoin.nearest(prior, points(spark, sf_dir, 1), 0.06, left_id="vid", right_id="vid").select("vid", F.lit(True).alias("near"))
    seen = _seen(spark, sf_dir).groupBy("vid").agg(F.count_if(F.col("verdict") == "absent").alias("absent"), F.count_if(F.col("verdict") == "present").alias("present"))
    met = prior.select("vid").join(near, "vid", "left").join(seen, "vid", "left")
    gone = belief.cull("no_present", F.coalesce("absent", F.lit(0)), F.coalesce("present", F.lit(0)))
    return met.select("vid", F.when(F.col("near"), "persistent").when(gone, "absent").otherwise("unobserved").alias("state"))


def published_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_linenumber = 2")
    done = orders.join(li.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("done", F.lit(1)), "o_orderkey", "left")
    return done.groupBy("o_orderpriority").agg(F.count("*").alias("published"), F.count("done").alias("processed"), F.round(F.count("done") / F.count("*"), 6).alias("ratio"))


def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stays(spark, sf_dir)
    return s.groupBy("entity").agg(F.count("*").alias("nodes"), F.count_if(F.col("last").isNull()).alias("open"), F.min("first").alias("earliest"), F.max("last").alias("latest"), F.array_join(F.slice(F.array_sort(F.collect_set(F.col("order_id").cast("string"))), 1, 3), ",").alias("some"))


def step_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import trajectory

    steps = trajectory.arc_length(trajectory.merge(observations(spark, sf_dir), "entity", "t", "event_id"), "entity", "t", ["value"])
    return steps.groupBy("entity").agg(F.round(F.median("step"), 6).alias("median"), F.round(F.percentile("step", F.lit(0.95)), 6).alias("p95"), F.round(F.max("step"), 6).alias("top"))


def kpi_still_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old geometry that is still current: the voxels of session A that session B covers, and the share within reach."""
    a, b = points(spark, sf_dir, 0), points(spark, sf_dir, 1)
    cover = gridjoin.voxel_coverage(a, b, 0.04, keys=["label"])
    near = gridjoin.fraction_within(a, b, 0.04, left_id="vid", right_id="vid", keys=["label"])
    return cover.join(near, "label").select("label", F.round("covered", 6).alias("covered"), F.round("fraction", 6).alias("fraction"))


def evaluate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every map (month of an order) at every query time (one a year, over all years of the table): each pair once, with what is present."""
    s = stays(spark, sf_dir).select("entity", "first", "last")
    year = lambda stamp: (stamp - ORDER_DAY) / (365 * DAY)
    ends = s.agg(F.ceil(year(F.min("first"))).alias("low"), F.floor(year(F.max(F.greatest("first", "last")))).alias("high")).where("low <= high")
    times = ends.select(F.explode(F.sequence("low", "high")).alias("k")).select((ORDER_DAY + F.col("k") * 365 * DAY).alias("t"))
    met = s.crossJoin(F.broadcast(times)).where(presence.is_present(F.col("first"), F.col("last"), F.col("t")))  # a row a year
    return met.groupBy("entity", "t").agg(F.count("*").alias("n"))


def co_registered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremal evidence of the changes of all orders of a customer."""
    from ..operators import objects

    s = stays(spark, sf_dir).select("entity", F.col("first").alias("first_absent"), (F.col("first") + DAY).alias("first_persistent"), F.col("last").alias("last_persistent"), (F.col("last") + DAY).alias("last_absent"))
    return objects.combine_changes(s, "entity")


def memory_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object summaries with their class table: two scans joined on ids, all summaries kept."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    got = c.join(n, "c_nationkey", "left").groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return got


def stationary_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    mover = belief.stationary_class(F.concat_ws(" ", F.col("p_name"), F.when(F.col("p_size") > 40, "Robot arm")))
    return p.groupBy(mover.alias("stationary")).agg(F.count("*").alias("n"))


def window_sensor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at least a day after the one before them."""
    from ..streaming import activity

    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return activity.spaced(e, "user_id", "ts", 86400.0).select("event_id", "user_id")


def low_support_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = freespace.free_counts(_rays(spark, sf_dir), ray_id="ray", size=0.2)
    return counts.groupBy("n").agg(F.count("*").alias("cells"))


def trajectory_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each hour, each low value's nearest high one within reach."""
    o = observations(spark, sf_dir).withColumn("h", F.expr(f"t div {HOUR}L")).withColumn("x", F.col("value") / 100)
    a, b = o.where("entity % 2 = 0").select(F.col("event_id").alias("vid"), "h", "x"), o.where("entity % 2 = 1").select(F.col("event_id").alias("vid"), "h", "x")
    got = association.by_centroid(a, b, 0.1, left_id="vid", right_id="vid", equal=["h"], coords=["x"])
    return got.select("vid", "right_vid", F.round("distance", 6).alias("distance"))


def quality_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stays(spark, sf_dir)
    return quality.gates(s, {"has an end": F.col("last").isNotNull(), "ends after its start": F.col("last") > F.col("first")}, severity="soft")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.surface(points(spark, sf_dir, 0), points(spark, sf_dir, 1), [0.03, 0.06, 0.09], found_id="vid", truth_id="vid", keys=["label"])
    return got.select("label", "threshold", "n", "inliers", F.round("share", 6).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (
        cluster_filter, background_rejection, dynamic_overlap, euclidean_clusters, island_removal, attach_small, stable_voxels, merge_proposals, pixel_iou, frontier_hops, translation_alignment, plane_snapping,
        error_buckets, feature_mean, sample_linspace, sample_stride, buffer_newest, interval_remap, restore_ids, prune_unobserved, merge_changes, compose_scene, prior_vertex_states, published_audit,
        state_summary, step_statistics, kpi_still_current, evaluate_all, co_registered_merge, memory_join, stationary_classes, window_sensor_gate, low_support_cells, trajectory_association, quality_soft,
        threshold_sweep,
    )
}

_CLUSTERS = """e AS (SELECT s.vid AS u, t.vid AS w FROM p s JOIN p t ON s.label = t.label AND s.vid <> t.vid AND (s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2 <= {r} * {r}),
    g AS (SELECT vid, vid AS root FROM p UNION SELECT e.w, g.root FROM g JOIN e ON g.vid = e.u), c AS (SELECT vid, min(root) AS cluster FROM g GROUP BY vid), k AS (SELECT vid, label, cluster FROM p JOIN c USING (vid))"""
_E12 = f"WITH RECURSIVE {POINTS}, {_CLUSTERS.format(r=0.12)}"
_ABSENT = "(SELECT vid FROM h WHERE aside <= 0.02 AND reach - d > 0.03)"
_ONCE = "u AS (SELECT entity, t, arg_min(value, event_id) AS value FROM o GROUP BY 1, 2)"

ORACLES = {
    "cluster_filter": f"{_AB} SELECT label, {_cell(0.2)} AS cell, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 6",
    "background_rejection": "SELECT vec_id, label FROM embeddings e WHERE (SELECT max(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) FROM embeddings q WHERE q.vec_id < 5) <= 0.75",
    "dynamic_overlap": "SELECT l_suppkey, count(*) AS n, round(avg((l_returnflag = 'R')::INT), 6) AS share FROM lineitem GROUP BY 1 HAVING avg((l_returnflag = 'R')::INT) < 0.33",
    "euclidean_clusters": f"{_E12} SELECT vid, label, cluster FROM k",
    "island_removal": f"{_E12}, z AS (SELECT label, cluster, count(*) AS n FROM k GROUP BY 1, 2) SELECT label, cluster, n, n >= 2 AND n >= 0.2 * max(n) OVER (PARTITION BY label) AS kept FROM z",
    "attach_small": f"""WITH RECURSIVE {POINTS}, {_CLUSTERS.format(r=0.1)}, z AS (SELECT cluster, count(*) AS n FROM k GROUP BY 1), w AS (SELECT z.cluster, label, n, x, y, z.z AS zz FROM (SELECT z.cluster, z.n, p.label, p.x, p.y, p.z FROM z JOIN p ON p.vid = z.cluster) z),
        m AS (SELECT s.cluster, l.cluster AS t FROM w s JOIN w l ON s.n < 3 AND l.n >= 3 AND s.label = l.label AND (s.x - l.x) ** 2 + (s.y - l.y) ** 2 + (s.zz - l.zz) ** 2 <= 0.09
              QUALIFY row_number() OVER (PARTITION BY s.cluster ORDER BY (s.x - l.x) ** 2 + (s.y - l.y) ** 2 + (s.zz - l.zz) ** 2, l.cluster) = 1)
        SELECT w.cluster, CASE WHEN n >= 3 THEN w.cluster ELSE t END AS target FROM w LEFT JOIN m USING (cluster)""",
    "stable_voxels": f"{_AB} SELECT {_cell(0.2)} AS cell, count(DISTINCT vid % 20) AS frames FROM p GROUP BY 1 HAVING count(DISTINCT vid % 20) >= 3",
    "merge_proposals": f"""{_AB}, n AS (SELECT vid // 10 AS node, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM p GROUP BY 1),
        v AS (SELECT s.node AS s, t.node AS t, greatest(least(s.x1, t.x1) - greatest(s.x0, t.x0), 0) * greatest(least(s.y1, t.y1) - greatest(s.y0, t.y0), 0) * greatest(least(s.z1, t.z1) - greatest(s.z0, t.z0), 0) AS c,
              (s.x1 - s.x0) * (s.y1 - s.y0) * (s.z1 - s.z0) + (t.x1 - t.x0) * (t.y1 - t.y0) * (t.z1 - t.z0) AS w FROM n s JOIN n t ON s.node < t.node AND s.node % 3 = t.node % 3 AND s.node * 5 + 12 < t.node * 5)
        SELECT t AS from_node, s AS to_node, round(c / (w - c), 6) AS iou FROM v WHERE c > 0 AND c / (w - c) >= 0.3""",
    "pixel_iou": """WITH x AS (SELECT DISTINCT l_partkey AS u, l_suppkey AS v, l_linenumber AS a FROM lineitem), y AS (SELECT DISTINCT l_partkey AS u, l_suppkey AS v, trunc(l_quantity / 10)::INT AS b FROM lineitem),
        c AS (SELECT a, b, count(*) AS common FROM x JOIN y USING (u, v) GROUP BY 1, 2)
        SELECT a, b, common, round(common / ((SELECT count(*) FROM x WHERE x.a = c.a) + (SELECT count(*) FROM y WHERE y.b = c.b) - common), 6) AS iou FROM c""",
    "frontier_hops": f"""WITH RECURSIVE {POINTS}, v AS (SELECT DISTINCT floor(x / 0.2)::BIGINT AS i, floor(y / 0.2)::BIGINT AS j, floor(z / 0.2)::BIGINT AS k FROM p),
        f AS (SELECT i, j, k, 0 AS d FROM v WHERE i = 0 AND j = 0 AND k = 0 UNION SELECT v.i, v.j, v.k, f.d + 1 FROM f JOIN v ON abs(v.i - f.i) + abs(v.j - f.j) + abs(v.k - f.k) = 1 WHERE f.d < 30)
        SELECT i || ',' || j || ',' || k AS node, min(d) AS distance FROM f GROUP BY 1""",
    "translation_alignment": f"""{_AB}, b2 AS (SELECT vid, label, x + 0.03 AS x, y, z FROM b), m AS (SELECT a.vid, a.label, b.x - a.x AS rx, b.y - a.y AS ry, b.z - a.z AS rz, sqrt({_D2}) AS d FROM a JOIN b2 b ON a.label = b.label AND {_D2} <= 0.04 QUALIFY row_number() OVER (PARTITION BY a.vid ORDER BY {_D2}, b.vid) = 1),
        s AS (SELECT label, count(*) AS n, median(d) AS before, median(rx) AS mx, median(ry) AS my, median(rz) AS mz FROM m GROUP BY 1), q AS (SELECT *, CASE WHEN sqrt(mx * mx + my * my + mz * mz) > 0.05 THEN 0.05 / sqrt(mx * mx + my * my + mz * mz) ELSE 1 END AS f FROM s),
        r AS (SELECT m.label, median(sqrt((rx - mx * f) ** 2 + (ry - my * f) ** 2 + (rz - mz * f) ** 2)) AS after FROM m JOIN q USING (label) GROUP BY 1)
        SELECT label, n, round(mx * f, 6) AS dx, round(my * f, 6) AS dy, round(mz * f, 6) AS dz, round(before, 6) AS before, round(after, 6) AS after, before - after >= 0.005 AS accepted FROM q JOIN r USING (label)""",
    "plane_snapping": f"""{_AB}, q AS (SELECT label, median(z) AS m, quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi FROM p GROUP BY 1)
        SELECT vid, round(CASE WHEN vid % 2 = 0 THEN m WHEN abs(x - lo) <= abs(x - hi) THEN lo ELSE hi END, 6) AS snapped FROM p JOIN q USING (label)""",
    "error_buckets": f"{_AB}, {_NEAR} SELECT label, floor(x / 0.1)::BIGINT AS bucket, count(*) AS n, round(avg(sqrt(d2)), 6) AS mean, round(max(sqrt(d2)), 6) AS worst FROM nn JOIN a USING (vid) GROUP BY 1, 2",
    "feature_mean": "SELECT label, position - 1 AS position, round(sum(v * w) / sum(w), 6) AS value, count(*) AS n FROM (SELECT label, vec_id % 3 + 1 AS w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1)::INT AS position FROM embeddings) GROUP BY 1, 2",
    "sample_linspace": f"""{_AB}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vid) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM p)
        SELECT vid, label FROM k WHERE n <= 7 OR k IN (SELECT floor(i * (n - 1) / 6)::BIGINT FROM range(0, 7) r(i))""",
    "sample_stride": "SELECT event_id, user_id AS entity FROM events WHERE event_id >= 3 AND (event_id - 3) % 7 = 0",
    "buffer_newest": f"""WITH {OBSERVATIONS}, k AS (SELECT entity, event_id, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY entity) AS n FROM o WINDOW w AS (PARTITION BY entity ORDER BY event_id))
        SELECT entity, event_id FROM k WHERE k % 3 = 0 OR k = n - 1 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY event_id DESC) <= 5""",
    "interval_remap": """SELECT coalesce(s_nationkey + 100, l_linenumber) AS l_linenumber, count(*) AS n FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 4 = 0 AND l_orderkey BETWEEN s_suppkey * 20 AND s_suppkey * 20 + 9000 GROUP BY 1""",
    "restore_ids": """WITH t AS (SELECT DISTINCT user_id AS u FROM events), c AS (SELECT c_custkey AS node, row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE c_custkey IN (SELECT u FROM t))
        SELECT c_custkey AS node, coalesce(k + greatest((SELECT max(u) FROM t), (SELECT max(c_custkey) FROM customer)), c_custkey) AS new_id FROM customer LEFT JOIN c ON node = c_custkey""",
    "prune_unobserved": f"{_AB} SELECT vid // 6 AS object, count(*) AS n_seen FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_D2} <= 0.0025) GROUP BY 1",
    "merge_changes": f"{_AB}, {_RAYS}, {_SEEN} SELECT vid, label FROM a WHERE vid NOT IN {_ABSENT} AND NOT EXISTS (SELECT 1 FROM b WHERE b.label < 3 AND {_D2} <= {RADIUS} * {RADIUS})",
    "compose_scene": f"""WITH {POINTS}, {STAYS}, k AS (SELECT least((SELECT max(vid // 2) + 1 FROM b), (SELECT max(o_orderkey) + 1 FROM orders)) AS k),
        o AS (SELECT order_id AS owner, order_id % k AS place FROM s, k WHERE first <= {ORDER_DAY} AND (last IS NULL OR last > {ORDER_DAY}))
        SELECT vid, NULL::BIGINT AS owner FROM a UNION ALL SELECT vid, owner FROM (SELECT vid, (vid // 2) % k AS place FROM b, k) JOIN o USING (place)""",
    "prior_vertex_states": f"""{_AB}, {_RAYS}, {_SEEN}, s AS (SELECT vid, count(*) FILTER (reach - d > 0.03) AS ab, count(*) FILTER (abs(reach - d) <= 0.03) AS pr FROM h WHERE aside <= 0.02 GROUP BY 1)
        SELECT vid, CASE WHEN EXISTS (SELECT 1 FROM b WHERE {_D2} <= 0.06 * 0.06) THEN 'persistent' WHEN ab >= 1 AND pr <= 0 THEN 'absent' ELSE 'unobserved' END AS state FROM a LEFT JOIN s USING (vid)""",
    "published_audit": "SELECT o_orderpriority, count(*) AS published, count(l.k) AS processed, round(count(l.k) / count(*), 6) AS ratio FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 2) l ON k = o_orderkey GROUP BY 1",
    "state_summary": f"WITH {STAYS} SELECT entity, count(*) AS nodes, count(*) FILTER (last IS NULL) AS open, min(first) AS earliest, max(last) AS latest, array_to_string(list_sort(list(DISTINCT order_id::VARCHAR))[1:3], ',') AS some FROM s GROUP BY entity",
    "step_statistics": f"""WITH {OBSERVATIONS}, {_ONCE}, d AS (SELECT entity, coalesce(abs(value - lag(value) OVER (PARTITION BY entity ORDER BY t)), 0) AS s FROM u)
        SELECT entity, round(median(s), 6) AS median, round(quantile_cont(s, 0.95), 6) AS p95, round(max(s), 6) AS top FROM d GROUP BY entity""",
    "kpi_still_current": f"""{_AB}, va AS (SELECT DISTINCT label, floor(x / 0.04)::BIGINT AS i, floor(y / 0.04)::BIGINT AS j, floor(z / 0.04)::BIGINT AS k FROM a), vb AS (SELECT DISTINCT floor(x / 0.04)::BIGINT AS i, floor(y / 0.04)::BIGINT AS j, floor(z / 0.04)::BIGINT AS k FROM b),
        c AS (SELECT label, round(avg((EXISTS (SELECT 1 FROM vb WHERE abs(vb.i - va.i) <= 1 AND abs(vb.j - va.j) <= 1 AND abs(vb.k - va.k) <= 1))::INT), 6) AS covered FROM va GROUP BY 1)
        SELECT label, covered, fraction FROM c JOIN (SELECT label, round(avg((EXISTS (SELECT 1 FROM b WHERE {_D2} <= 0.04 * 0.04))::INT), 6) AS fraction FROM a GROUP BY 1) USING (label)""",
    "evaluate_all": f"""WITH {STAYS}, e AS (SELECT ceil((min(first) - {ORDER_DAY}) / {365 * DAY})::BIGINT AS low, floor((max(greatest(first, last)) - {ORDER_DAY}) / {365 * DAY})::BIGINT AS high FROM s),
        q AS (SELECT {ORDER_DAY} + unnest(range(low, high + 1)) * {365 * DAY} AS t FROM e) SELECT entity, t, count(*) AS n FROM s JOIN q ON first <= t AND (last IS NULL OR last > t) GROUP BY 1, 2""",
    "co_registered_merge": f"WITH {STAYS} SELECT entity, max(first) AS first_absent, min(first) + {DAY} AS first_persistent, min(last) + {DAY} AS last_absent, max(last) AS last_persistent FROM s GROUP BY entity",
    "memory_join": "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 3 > 0 GROUP BY 1",
    "stationary_classes": "SELECT CASE WHEN regexp_matches(lower(p_name || CASE WHEN p_size > 40 THEN ' Robot arm' ELSE '' END), 'person|human|robot|cart|trolley|vehicle|animal') THEN 0 ELSE 1 END AS stationary, count(*) AS n FROM part GROUP BY 1",
    "window_sensor_gate": f"WITH {OBSERVATIONS} SELECT event_id, entity AS user_id FROM o QUALIFY coalesce(t - lag(t) OVER (PARTITION BY entity ORDER BY t) >= 86400000000, true)",
    "low_support_cells": f"{_AB}, {_RAYS}, {_free_sql(0.2, 0.0)} SELECT n, count(*) AS cells FROM fc GROUP BY 1",
    "trajectory_association": f"""WITH {OBSERVATIONS}, q AS (SELECT event_id AS vid, entity, t // {HOUR} AS h, value / 100 AS x FROM o), m AS (SELECT s.vid, t.vid AS right_vid, abs(s.x - t.x) AS d FROM q s JOIN q t ON s.h = t.h AND s.entity % 2 = 0 AND t.entity % 2 = 1 AND (s.x - t.x) * (s.x - t.x) <= 0.1 * 0.1
        QUALIFY row_number() OVER (PARTITION BY s.vid ORDER BY (s.x - t.x) * (s.x - t.x), t.vid) = 1) SELECT q.vid, right_vid, round(d, 6) AS distance FROM q LEFT JOIN m USING (vid) WHERE entity % 2 = 0""",
    "quality_soft": f"""WITH {STAYS} SELECT rule, 'soft' AS severity, n, failed, failed = 0 AS passed FROM (SELECT 'has an end' AS rule, count(*) AS n, count(*) FILTER (last IS NULL) AS failed FROM s
        UNION ALL SELECT 'ends after its start', count(*), count(*) FILTER (NOT coalesce(last > first, false)) FROM s)""",
    "threshold_sweep": f"""{_AB}, m AS (SELECT a.vid, a.label, min(sqrt({_D2})) AS d FROM a CROSS JOIN b GROUP BY 1, 2) SELECT label, threshold, count(*) AS n, count(*) FILTER (d <= threshold) AS inliers, round(count(*) FILTER (d <= threshold) / count(*), 6) AS share
        FROM m CROSS JOIN (SELECT unnest([0.03, 0.06, 0.09])::DOUBLE AS threshold) GROUP BY 1, 2""",
}

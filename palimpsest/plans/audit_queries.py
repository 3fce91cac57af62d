"""Registered queries on audits, reconciliation, contracts and saved states, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import alignment, clusters, freespace, gridjoin, mesh, metrics, quality, reconcile, trajectory
from ..sources import sinks, tables
from . import timetravel
from .inputs import HOUR, OBSERVATIONS, POINTS, STAYS, micros, observations, points, stays, table
from .presence_queries import DAY, EVENT_DAY, ORDER_DAY
from .scratch import scratch
from .space_queries import _AB, _BOX, _D2, _NEAR, _RAYS, _SEEN, RADIUS, XYZ, _free_sql, _rays, _seen
from .state_store import StateStore
from .track_queries import _E, _events


def distinct_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's first supplier, and each supplier's first such part."""
    links = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("seen"))
    return metrics.distinct_targets(links, "l_partkey", "l_suppkey", ["seen", "l_partkey", "l_suppkey"])


def change_metrics_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of returned lines by quantity, with shipments that truth lacks and orders without lines."""
    li = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").alias("truth"), (F.col("l_quantity") > 25).alias("found"), "l_tax", "l_discount")
    c = metrics.confusion(li, "truth", "found", ["l_linestatus"])
    more = li.groupBy("l_linestatus").agg(F.count_if(F.col("l_tax") > 0.07).alias("missed"), F.count_if(F.col("l_discount") > 0.09).alias("hallucinated"))
    names = ("precision", "recall", "f1")
    plain, wide = metrics.rates(F.col("tp"), F.col("fp"), F.col("fn")), metrics.rates_with(*[F.col(n) for n in ("tp", "fp", "fn", "missed", "hallucinated")])
    return c.join(more, "l_linestatus").select("l_linestatus", "tp", "fp", "tn", "fn", "missed", "hallucinated", *[F.round(r, 6).alias(n) for r, n in zip(plain, names, strict=True)], *[F.round(r, 6).alias(f"{n}_with") for r, n in zip(wide, names, strict=True)])


def object_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label's box: points inside, of its label, inside it swept along x, close in time, and near odd points."""
    p = points(spark, sf_dir)
    boxes = mesh.bounds(points(spark, sf_dir, 0), ["label"]).select(F.col("label").alias("box"), *[f"{c}{k}" for k in (0, 1) for c in XYZ])
    swept = boxes.withColumn("x1", F.col("x1") + 0.1)
    near = gridjoin.within(p, points(spark, sf_dir, 1), 0.05, left_id="vid", right_id="vid").select("vid", F.lit(True).alias("near"))
    met = gridjoin.points_in_boxes(p, swept, 0.25, point_id="vid", box_id="box", margin=0.02).join(p, "vid").join(boxes, "box").join(near, "vid", "left")
    inside = geometry.inside([F.col(c) for c in XYZ], [F.col(f"{c}0") for c in XYZ], [F.col(f"{c}1") for c in XYZ], 0.02)
    return met.groupBy("box").agg(F.count_if(inside).alias("inside"), F.count_if(inside & (F.col("label") == F.col("box"))).alias("own"), F.count("*").alias("swept"), F.count_if(inside & F.col("vid").between(F.col("box") * 20, F.col("box") * 20 + 200)).alias("in_time"), F.count_if(inside & F.coalesce("near", F.lit(False))).alias("near"))


def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.count("*").alias("nodes"), F.count_distinct("p_type").alias("classes"), F.sum("p_size").alias("vertices"), (F.count("*") > F.count_distinct("p_name")).alias("duplicates"))


def object_change_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes, urgent ones identified; each could merge into its customer's first order; its lines are evidence."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")).alias("identity"), F.col("o_custkey").alias("c"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), "l_returnflag", micros("l_shipdate").alias("t"))
    n = li.groupBy("node").agg(F.count("*").alias("size"))
    nodes = s.join(n, "node", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    merges = s.join(s.groupBy("c").agg(F.min("node").alias("merged_id")), "c").where("node <> merged_id").select("node", "merged_id")
    evidence = li.groupBy("node").agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("t"))).alias("first_absent"), F.max(F.when(F.col("l_returnflag") != "R", F.col("t"))).alias("last_persistent"))
    return reconcile.object_changes(nodes.select("node", "identity", "size"), merges, evidence, "node", "identity", size="size")


def refresh_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes known before a day, refreshed for who was seen from then on: equal to counting anew."""
    o = observations(spark, sf_dir)
    count = lambda df: df.groupBy("entity").agg(F.count_if(F.col("verdict") == "absent").alias("absent"), F.max("t").alias("last"))
    return reconcile.refresh(count(o.where(F.col("t") < EVENT_DAY)), count(o), o.where(F.col("t") >= EVENT_DAY), ["entity"])


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).groupBy("vid").agg(F.count_if(F.col("verdict") == "absent").alias("absent"), F.count_if(F.col("verdict") == "present").alias("present"))


def residue_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even points near odd ones, as if these had moved; two labels are protected."""
    left = gridjoin.within(points(spark, sf_dir, 0), points(spark, sf_dir, 1), 0.12, left_id="vid", right_id="vid")
    return reconcile.residue(left, _evidence(spark, sf_dir), "vid", protected=reconcile.protects(F.col("label"), [1, 2], F.col("z") * 3), quarantine=True)


def object_guided_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir, 0).withColumn("object", F.floor(F.col("vid") / 10))
    return reconcile.object_modes(p, _evidence(spark, sf_dir), "vid", "object", least_observed=0.2, absent_share=0.6, seen_share=0.5)


def forced_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that remain when the objects of four labels are known to be gone, and their faces."""
    p = points(spark, sf_dir)
    boxes = mesh.bounds(points(spark, sf_dir, 0).where("label < 4"), ["label"]).select(F.col("label").alias("box"), F.col("label").alias("box_label"), *[f"{c}{k}" for k in (0, 1) for c in XYZ])
    inside = gridjoin.points_in_boxes(p, boxes, 0.25, point_id="vid", box_id="box")
    left = reconcile.without_absent(p, inside, boxes, vid="vid", box="box", label="label", box_label="box_label")
    faces = p.select(F.col("vid").alias("fid"), F.col("vid").alias("a"), (F.col("vid") + 1).alias("b"), (F.col("vid") + 2).alias("c"))
    return mesh.faces_of(faces, left).select("fid", "a", "b", "c")


def session_mesh_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each point of both sessions ends: prior ones by their state, current ones welded to these where close."""
    prior, now = points(spark, sf_dir, 0), points(spark, sf_dir, 1)
    near = gridjoin.nearest(prior, now, 0.06, left_id="vid", right_id="vid").select("vid", F.lit(True).alias("near"))
    met = prior.select("vid").join(near, "vid", "left").join(_evidence(spark, sf_dir), "vid", "left")
    state = F.when(F.col("near"), "persistent").when((F.coalesce("absent", F.lit(0)) > 0) & (F.coalesce("present", F.lit(0)) == 0), "absent").otherwise("unobserved")
    old = met.select("vid", state.alias("state"), F.col("vid").alias("target"))
    kept = prior.join(old.where("state <> 'absent'").select("vid"), "vid", "left_semi")
    return old.unionByName(mesh.weld(kept, now, 0.03).select("vid", F.lit("current").alias("state"), "target"))


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as audited objects, joined by key with what is believed of them and what is summarised."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.element_at(F.array(*map(F.lit, ("removed", "new", "moved"))), (F.col("s_nationkey") % 3 + 1).cast("int")).alias("change"), F.col("s_acctbal").alias("balance"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"), reconcile.exact_mean("l_discount").alias("d"))
    words = F.array(*map(F.lit, reconcile.DECISIONS))
    belief = li.select("key", F.concat(F.element_at(words, (F.col("r") % len(reconcile.DECISIONS) + 1).cast("int")), F.lit("_rule")).alias("decision"), "n", "d")
    summary = li.where("n % 5 < 3").select("key", F.lit(True).alias("summarised"))
    met = s.join(belief, "key", "left").join(summary, "key", "left")
    known, shown = F.col("decision").isNotNull(), F.coalesce("summarised", F.lit(False))
    state = reconcile.logical_state(F.col("change"), F.coalesce("decision", F.lit("")), known, shown)
    status = reconcile.audit_status(F.col("change"), state, truth_points=F.coalesce("n", F.lit(0)), known=known, support=F.col("balance") / 8000, agrees=F.col("balance") / 8000, free_conflict=F.col("d") * 4)
    return met.select("key", "change", state.alias("state"), status.alias("status"))


def vertices_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices first seen by half time, and how many of their faces survive."""
    p = points(spark, sf_dir).withColumn("first_seen", F.pmod(F.col("vid") * 37, F.lit(500)))
    return timetravel.vertices_at(p, F.lit(250)).select("vid", "first_seen")


def trimmed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's path of orders, cut at a day: the stamps that are left, and the last of them."""
    path = F.array_sort(F.collect_list(F.struct(F.col("first").alias("ts"), "order_id")))
    s = stays(spark, sf_dir).groupBy("entity").agg(path.alias("path"))  # one customer's orders
    cut = timetravel.trimmed(F.col("path"), F.lit(ORDER_DAY))
    return s.select("entity", F.size(cut).alias("n"), F.try_element_at(cut, F.lit(-1))["order_id"].alias("newest"))


def effective_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects known and present at a day; those without an own time have that of their first line."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.min(micros("l_shipdate")).alias("mesh"))
    s = stays(spark, sf_dir).join(li, "order_id", "left")
    own = F.when(F.col("entity") % 2 == 0, F.col("first") + 5 * DAY)
    return timetravel.objects_at(s, F.lit(ORDER_DAY), effective=F.coalesce(own, F.col("mesh"), F.col("first"))).select("order_id")


def saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshots, at a fifth, two fifths and four fifths of the ids, asked for at five times: how many vertices and objects each has."""
    store = StateStore(spark, scratch(spark, "state"))
    p = points(spark, sf_dir).withColumn("first_seen", F.col("vid"))
    n = p.agg(F.max("vid")).first()[0] or 0
    for k, stamp in enumerate((n // 5, n * 2 // 5, n * 4 // 5)):
        objects = p.where(F.col("vid") <= stamp).groupBy("label").agg(F.min("vid").alias("effective"), F.min("vid").alias("first"), *([F.max("vid").alias("last")] if k else []))
        store.append(stamp, p.where(F.col("vid") <= stamp).select("vid", "first_seen"), objects, 2 if k else 1)
    out = None
    for t in (n // 10, n * 3 // 10, n * 2 // 5, n * 3 // 5, n * 2):
        v, m = store.mesh_at(t).agg(F.count("*").alias("vertices")), store.objects_at(t).agg(F.count("*").alias("objects"))
        row = v.crossJoin(m).select(F.lit(t).alias("t"), F.lit(store.answering(t)).alias("stamp"), "vertices", "objects", F.lit(store.num_time_steps).alias("steps"))  # a row each
        out = row if out is None else out.unionByName(row)
    return out


def ledger_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind as ledgers of frames: repeated images, repeated stamps, stamps that don't increase."""
    e = _events(spark, sf_dir).select(F.col("entity").cast("string").alias("ImageID"), (F.col("t") / 60_000_000).cast("long").alias("TimeStamp"), "event_id")
    return tables.ledger_faults(e, order="event_id")


def missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames, return flags as kinds of input."""
    frames = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("kind"))
    return tables.missing_inputs(frames, files, "frame", "kind", ["A", "N", "R", "X"])


def unambiguous_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.concat_ws(".", "l_linenumber", "l_returnflag").alias("path"))
    return tables.unambiguous(files, "frame", "path")


def catalog_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 40).cast("int").alias("physical_instance_id"), F.col("l_suppkey").cast("int").alias("semantic_id"))
    return tables.catalog_faults(c)


def hard_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounting of a run: every frame processed, none twice, final stamp reached, stamps increase, the mesh isn't empty."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    frames = o.select(F.col("o_orderkey").alias("frame"), micros("o_orderdate").alias("stamp"))
    done = li.select(F.col("l_orderkey").alias("frame"), micros("l_shipdate").alias("stamp"))
    return quality.run_gates(frames, done, points(spark, sf_dir), seed=stays(spark, sf_dir).select("order_id"), written=o.select(F.col("o_orderkey").alias("order_id")))


def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of valid depths, poses that are rigid, and distances of what comes back from the image."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("depth"))
    c, s = F.cos(F.col("x")), F.sin(F.col("x"))
    turn = F.array(c, -s, F.lit(0.0), F.col("y"), s, c, F.lit(0.0), F.col("z"), F.lit(0.0), F.lit(0.0), F.when(F.col("label") == 9, 2.0).otherwise(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    poses = points(spark, sf_dir).select(turn.alias("pose"))
    near = gridjoin.nearest(points(spark, sf_dir, 0), points(spark, sf_dir, 1), RADIUS, left_id="vid", right_id="vid")
    return quality.dataset_checks(li, F.col("depth").between(3, 45), poses, "pose", near, "distance", least_valid=0.8, most_mean=0.06).select("rule", F.round("value", 6).alias("value"), "passed")


def frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.span(observations(spark, sf_dir), ["event_id"], 500, 1000).select("event_id", "entity")


def random_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reproducible random poses of each entity."""
    return alignment.random_rows(observations(spark, sf_dir), ["entity"], "event_id", 3, seed=7).select("entity", "event_id")


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an entity older than one that came before them."""
    return trajectory.non_increasing(_events(spark, sf_dir), ["entity"], "t", F.col("event_id")).select("event_id")


def merge_proposals_unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge proposals between boxes of which neither has an identity."""
    p = points(spark, sf_dir).withColumn("node", F.floor(F.col("vid") / 10))
    b = mesh.bounds(p, ["node"]).withColumns({"label": F.col("node") % 3, "first": F.col("node") * 5, "last": F.col("node") * 5 + 12, "identity": F.when(F.col("node") % 5 == 0, F.col("node"))})
    got = clusters.proposals(b.where("identity is null").select("node", "label", "first", "last", *[f"{c}{k}" for k in (0, 1) for c in XYZ]), node="node", label="label", size=0.5, least=0.2)
    return got.select("from_node", "to_node", F.round("iou", 6).alias("iou"))


def restored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior nodes whose state was not observed come back, with new ids where theirs are taken."""
    prior = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_acctbal") < 0, "absent").when(F.col("c_acctbal") < 5000, "unobserved").otherwise("matched").alias("state"))
    current = observations(spark, sf_dir).select(F.col("entity").alias("node")).distinct()
    return alignment.restored(prior, current, "node", "state", ["unobserved"])


def mesh_append_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of points added to a mesh, of those outside the low eighth of a label's box and not close to what is there, by their new
    places."""
    base, added = points(spark, sf_dir, 0), points(spark, sf_dir, 1)
    boxes = mesh.bounds(base.where("label < 1"), ["label"]).select(F.col("label").alias("box"), *[f"{c}0" for c in XYZ], *[F.col(f"c{c}").alias(f"{c}1") for c in XYZ])
    hit = gridjoin.points_in_boxes(added, boxes, 0.25, point_id="vid", box_id="box").select("vid").distinct()
    kept = gridjoin.within(added.join(hit, "vid", "left_anti"), base, 0.02, left_id="vid", right_id="vid", anti=True)
    faces = added.select(F.col("vid").alias("fid"), F.col("vid").alias("a"), (F.col("vid") + 2).alias("b"), (F.col("vid") + 4).alias("c"))
    return mesh.reindex(faces, mesh.renumber(kept, [], vid="vid")).select("fid", *[F.col(c).cast("long").alias(c) for c in "abc"])


def memory_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a later session per label from its own free space, distance fields and background."""
    from ..operators import memory

    a, b = points(spark, sf_dir, 0), points(spark, sf_dir, 1)
    counts = freespace.free_counts(_rays(spark, sf_dir), ray_id="ray", size=0.15, short=0.05)
    free = freespace.free_fraction(a, counts, size=0.15, keys=("label",)).select("label", "fraction")
    support = gridjoin.fraction_within(a, b, RADIUS, left_id="vid", right_id="vid", keys=["label"]).withColumnRenamed("fraction", "support")
    known = free.join(support, "label").where("label < 8")
    now = b.where("label > 1").groupBy("label").agg(F.count("*").alias("n"))
    return memory.decide(known, now, "label", free="fraction", support="support", least_free=0.5, supported=0.55, background=[4]).select("label", "decision")


def published_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state published with its audit tables: rows that each of them has when it is read again."""
    path = scratch(spark, "published")
    p = points(spark, sf_dir, 0)
    sinks.write_audits({"vertices": p.drop("label"), "objects": mesh.bounds(p, ["label"]).select("label", "n")}, path)
    out = [sinks.read_audit(spark, path, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("vertices", "objects")]
    return out[0].unionByName(out[1])


QUERIES = {
    f.__name__: f
    for f in (
        distinct_targets, change_metrics_full, object_audit_counts, label_histogram, object_change_records, refresh_changes, residue_cleanup, object_guided_modes, forced_absent, session_mesh_init, audit_rows,
        vertices_at, trimmed_paths, effective_objects, saved_state, ledger_faults, missing_inputs, unambiguous_files, catalog_faults, hard_gates, dataset_checks, frame_range, random_sources, late_rows,
        merge_proposals_unnamed, restored_nodes, mesh_append_guarded, memory_decisions, published_manifest,
    )
}

_EV = f"{_RAYS}, {_SEEN}, ev AS (SELECT vid, count(*) FILTER (reach - d > 0.03) AS ab, count(*) FILTER (abs(reach - d) <= 0.03) AS pr FROM h WHERE aside <= 0.02 GROUP BY 1)"
_IN = "x BETWEEN x0 - {m} AND x1 + {e} AND y BETWEEN y0 - {m} AND y1 + {m} AND z BETWEEN z0 - {m} AND z1 + {m}"
_RATE = lambda tp, fp, fn, s: f"round({tp} / nullif({tp} + {fp}, 0), 6) AS precision{s}, round({tp} / nullif({tp} + {fn}, 0), 6) AS recall{s}, round(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 6) AS f1{s}"

ORACLES = {
    "distinct_targets": """WITH l AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS seen FROM lineitem GROUP BY 1, 2), f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY seen, l_suppkey) = 1)
        SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY seen, l_partkey) = 1""",
    "change_metrics_full": f"""WITH c AS (SELECT l_linestatus, count(*) FILTER (t AND f) AS tp, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (NOT t AND NOT f) AS tn, count(*) FILTER (t AND NOT f) AS fn, count(*) FILTER (l_tax > 0.07) AS missed, count(*) FILTER (l_discount > 0.09) AS hallucinated
        FROM (SELECT *, l_returnflag = 'R' AS t, l_quantity > 25 AS f FROM lineitem) GROUP BY 1) SELECT *, {_RATE('tp', 'fp', 'fn', '')}, {_RATE('tp', '(fp + hallucinated)', '(fn + missed)', '_with')} FROM c""",
    "object_audit_counts": f"""{_AB}, bx AS (SELECT label AS box, {_BOX} FROM a GROUP BY 1), m AS (SELECT p.*, bx.*, {_IN.format(m=0.02, e=0.02)} AS i, EXISTS (SELECT 1 FROM b WHERE (b.x - p.x) ** 2 + (b.y - p.y) ** 2 + (b.z - p.z) ** 2 <= 0.0025) AS nr FROM p JOIN bx ON {_IN.format(m=0.02, e=0.12)})
        SELECT box, count(*) FILTER (i) AS inside, count(*) FILTER (i AND label = box) AS own, count(*) AS swept, count(*) FILTER (i AND vid BETWEEN box * 20 AND box * 20 + 200) AS in_time, count(*) FILTER (i AND nr) AS near FROM m GROUP BY 1""",
    "label_histogram": "SELECT p_brand, count(*) AS nodes, count(DISTINCT p_type) AS classes, sum(p_size)::BIGINT AS vertices, count(*) > count(DISTINCT p_name) AS duplicates FROM part GROUP BY 1",
    "object_change_records": """WITH n AS (SELECT l_orderkey AS node, min(epoch_us(l_shipdate)) FILTER (l_returnflag = 'R') AS fa, max(epoch_us(l_shipdate)) FILTER (l_returnflag <> 'R') AS lp FROM lineitem GROUP BY 1), m AS (SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders GROUP BY 1)
        SELECT o_orderkey AS node, CASE WHEN o_orderpriority <> '1-URGENT' AND k <> o_orderkey THEN k END AS merged_id, fa AS first_absent, lp AS last_persistent FROM orders JOIN m ON c = o_custkey LEFT JOIN n ON node = o_orderkey""",
    "refresh_changes": f"WITH {OBSERVATIONS} SELECT entity, count(*) FILTER (verdict = 'absent') AS absent, max(t) AS last FROM o GROUP BY 1",
    "residue_cleanup": f"""{_AB}, {_EV} SELECT a.vid, CASE WHEN label IN (1, 2) OR abs(z * 3) >= 0.85 THEN 'protected' WHEN pr > 0 THEN 'rejected' WHEN ab > 0 THEN 'confirmed' ELSE 'quarantined' END AS decision
        FROM a LEFT JOIN ev ON ev.vid = a.vid WHERE EXISTS (SELECT 1 FROM b WHERE {_D2} <= 0.12 * 0.12)""",
    "object_guided_modes": f"""{_AB}, {_EV}, g AS (SELECT vid // 10 AS object, count(*) AS n, count(*) FILTER (coalesce(ab, 0) > 0 OR coalesce(pr, 0) > 0) AS observed, count(*) FILTER (ab > 0 AND pr = 0) AS absent, count(*) FILTER (pr > 0) AS p FROM a LEFT JOIN ev USING (vid) GROUP BY 1)
        SELECT object, n, observed, absent, CASE WHEN observed < 0.2 * n THEN 'unobserved' WHEN absent >= 0.6 * observed THEN 'cleanup' WHEN p >= 0.5 * observed THEN 'reobserved' ELSE 'injection' END AS mode FROM g""",
    "forced_absent": f"""{_AB}, bx AS (SELECT label AS box, {_BOX} FROM a WHERE label < 4 GROUP BY 1), l AS (SELECT vid FROM p WHERE vid NOT IN (SELECT vid FROM p JOIN bx ON label = box AND {_IN.format(m=0, e=0)}))
        SELECT vid AS fid, vid AS a, vid + 1 AS b, vid + 2 AS c FROM l WHERE vid + 1 IN (SELECT vid FROM l) AND vid + 2 IN (SELECT vid FROM l)""",
    "session_mesh_init": f"""{_AB}, {_EV}, st AS (SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM b WHERE {_D2} <= 0.06 * 0.06) THEN 'persistent' WHEN ab > 0 AND pr = 0 THEN 'absent' ELSE 'unobserved' END AS state FROM a LEFT JOIN ev ON ev.vid = a.vid),
        w AS (SELECT b.vid, a.vid AS target FROM st a JOIN b ON a.state <> 'absent' AND {_D2} <= 0.03 * 0.03 QUALIFY row_number() OVER (PARTITION BY b.vid ORDER BY {_D2}, a.vid) = 1)
        SELECT vid, state, vid AS target FROM st UNION ALL SELECT b.vid, 'current', coalesce(w.target, b.vid) FROM b LEFT JOIN w ON w.vid = b.vid""",
    "audit_rows": """WITH l AS (SELECT l_suppkey AS key, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS n, avg(l_discount) AS d FROM lineitem GROUP BY 1),
        m AS (SELECT s_suppkey AS key, ['removed', 'new', 'moved'][s_nationkey % 3 + 1] AS change, coalesce(s_acctbal / 8000, 0) AS su, coalesce(['absent', 'unobserved', 'new_current', 'support_filter', 'supported_prior', 'current_only', 'persistent_union'][r % 7 + 1] || '_rule', '') AS w, l.key IS NOT NULL AS known, coalesce(n % 5 < 3, false) AS sh, coalesce(n, 0) AS n, coalesce(d * 4, 0) AS fc FROM supplier LEFT JOIN l ON l.key = s_suppkey),
        s AS (SELECT *, CASE WHEN NOT known THEN 'Missing' WHEN change = 'removed' THEN CASE WHEN NOT sh AND contains(w, 'absent') THEN 'Absent' WHEN NOT sh AND contains(w, 'unobserved') THEN 'Unobserved' ELSE 'Leaked' END
            WHEN change = 'new' THEN CASE WHEN sh AND contains(w, 'new_current') THEN 'New' ELSE 'MissingOrMisclassified' END
            ELSE CASE WHEN NOT sh THEN 'MissingCurrent' WHEN contains(w, 'support_filter') OR contains(w, 'supported_prior') OR contains(w, 'current_only') THEN 'MovedCurrent' WHEN contains(w, 'persistent_union') THEN 'RiskyUnion' ELSE 'Persistent' END END AS state FROM m)
        SELECT key, change, state, CASE WHEN n = 0 AND NOT known THEN 'ignore_no_gt_geometry' WHEN change = 'removed' THEN CASE WHEN state = 'Absent' THEN 'ok' ELSE 'error_removed_leaked' END WHEN change = 'new' THEN CASE WHEN state = 'New' THEN 'ok' ELSE 'error_new_missing' END
            WHEN su >= 0.98 THEN 'ok_stable_overlap' WHEN state = 'MovedCurrent' THEN 'ok_moved_filtered' WHEN state = 'RiskyUnion' AND fc < 0.2 THEN 'warn_union_low_conflict' ELSE 'error_moved_stale_risk' END AS status FROM s""",
    "vertices_at": "SELECT vec_id AS vid, vec_id * 37 % 500 AS first_seen FROM embeddings WHERE vec_id * 37 % 500 <= 250",
    "trimmed_paths": f"WITH {STAYS} SELECT entity, count(*) FILTER (first <= {ORDER_DAY})::INT AS n, arg_max(order_id, (first, order_id)) FILTER (first <= {ORDER_DAY}) AS newest FROM s GROUP BY 1",
    "effective_objects": f"""WITH {STAYS}, l AS (SELECT l_orderkey AS k, min(epoch_us(l_shipdate)) AS m FROM lineitem GROUP BY 1) SELECT order_id FROM s LEFT JOIN l ON k = order_id
        WHERE coalesce(CASE WHEN entity % 2 = 0 THEN first + {5 * DAY} END, m, first) <= {ORDER_DAY} AND first <= {ORDER_DAY} AND (last IS NULL OR last > {ORDER_DAY})""",
    "saved_state": f"""WITH {POINTS}, n AS (SELECT max(vid) AS n FROM p), q AS (SELECT unnest([n // 10, n * 3 // 10, n * 2 // 5, n * 3 // 5, n * 2]) AS t, unnest([n // 5, n * 2 // 5, n * 2 // 5, n * 4 // 5, n * 4 // 5]) AS stamp, n // 5 AS one FROM n)
        SELECT t, stamp, (SELECT count(*) FROM p WHERE vid <= stamp AND vid <= t) AS vertices, (SELECT count(*) FROM (SELECT label, min(vid) AS f, max(vid) AS l FROM p WHERE vid <= stamp GROUP BY 1) WHERE f <= t AND (stamp = one OR l > t)) AS objects, 3 AS steps FROM q""",
    "ledger_faults": f"""WITH {_E}, l AS (SELECT entity::VARCHAR AS i, trunc(t / 60000000)::BIGINT AS s, event_id FROM e) SELECT 'repeated image' AS fault, count(*) AS n FROM (SELECT i FROM l GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated stamp', count(*) FROM (SELECT s FROM l GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'not increasing', count(*) FROM (SELECT s, lag(s) OVER (ORDER BY event_id) AS b FROM l) WHERE s <= b""",
    "missing_inputs": "SELECT kind, count(*) AS n FROM (SELECT o_orderkey AS frame, unnest(['A', 'N', 'R', 'X']) AS kind FROM orders) ANTI JOIN (SELECT l_orderkey AS frame, l_returnflag AS kind FROM lineitem) USING (frame, kind) GROUP BY 1",
    "unambiguous_files": "SELECT l_orderkey AS frame, min(l_linenumber || '.' || l_returnflag) AS path FROM lineitem GROUP BY 1 HAVING count(*) = 1",
    "catalog_faults": "WITH c AS (SELECT (l_partkey * 40)::INT AS p, l_suppkey::INT AS s FROM lineitem) SELECT 'repeated id' AS fault, count(*) AS n FROM (SELECT p FROM c GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'id out of range', count(*) FROM c WHERE p NOT BETWEEN 1 AND 65535 UNION ALL SELECT 'class out of range', count(*) FROM c WHERE s NOT BETWEEN 0 AND 65535",
    "hard_gates": f"""WITH {STAYS}, f AS (SELECT o_orderkey AS frame, epoch_us(o_orderdate) AS stamp FROM orders), d AS (SELECT l_orderkey AS frame, epoch_us(l_shipdate) AS stamp FROM lineitem)
        SELECT 'frames accounted for' AS rule, (SELECT count(*) FROM f ANTI JOIN d USING (frame)) AS failed UNION ALL SELECT 'frames processed once', (SELECT count(*) FROM (SELECT frame FROM d GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'no unknown frame', (SELECT count(*) FROM d ANTI JOIN f USING (frame))
        UNION ALL SELECT 'final stamp reached', CASE WHEN (SELECT max(stamp) FROM d) >= (SELECT max(stamp) FROM f) THEN 0 ELSE 1 END UNION ALL SELECT 'mesh is not empty', CASE WHEN (SELECT count(*) FROM embeddings) > 0 THEN 0 ELSE 1 END
        UNION ALL SELECT 'seed equals what was written', (SELECT count(*) FROM s FULL JOIN orders ON order_id = o_orderkey WHERE order_id IS NULL OR o_orderkey IS NULL)""",
    "dataset_checks": f"""{_AB}, {_NEAR}, v AS (SELECT 'valid depths' AS rule, avg((l_quantity BETWEEN 3 AND 45)::INT) AS value FROM lineitem UNION ALL SELECT 'rigid poses', avg((label <> 9)::INT) FROM p UNION ALL SELECT 'mean distance', avg(sqrt(d2)) FROM nn)
        SELECT rule, round(value, 6) AS value, CASE rule WHEN 'valid depths' THEN value >= 0.8 WHEN 'rigid poses' THEN value >= 1 ELSE value <= 0.06 END AS passed FROM v""",
    "frame_range": "SELECT event_id, user_id AS entity FROM events ORDER BY event_id LIMIT 1000 OFFSET 500",
    "random_sources": "SELECT user_id AS entity, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('7:' || event_id), event_id) <= 3",
    "late_rows": f"WITH {_E} SELECT event_id FROM (SELECT event_id, t, lag(t) OVER (PARTITION BY entity ORDER BY event_id) AS b FROM e) WHERE t <= b",
    "merge_proposals_unnamed": f"""{_AB}, n AS (SELECT vid // 10 AS node, {_BOX} FROM p GROUP BY 1),
        v AS (SELECT s.node AS s, t.node AS t, greatest(least(s.x1, t.x1) - greatest(s.x0, t.x0), 0) * greatest(least(s.y1, t.y1) - greatest(s.y0, t.y0), 0) * greatest(least(s.z1, t.z1) - greatest(s.z0, t.z0), 0) AS c,
              (s.x1 - s.x0) * (s.y1 - s.y0) * (s.z1 - s.z0) + (t.x1 - t.x0) * (t.y1 - t.y0) * (t.z1 - t.z0) AS w FROM n s JOIN n t ON s.node < t.node AND s.node % 3 = t.node % 3 AND s.node * 5 + 12 < t.node * 5 AND s.node % 5 <> 0 AND t.node % 5 <> 0)
        SELECT t AS from_node, s AS to_node, round(c / (w - c), 6) AS iou FROM v WHERE c > 0 AND c / (w - c) >= 0.2""",
    "restored_nodes": """WITH r AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 5000), t AS (SELECT DISTINCT user_id AS u FROM events), c AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM r WHERE node IN (SELECT u FROM t))
        SELECT r.node, coalesce(k + greatest((SELECT max(u) FROM t), (SELECT max(node) FROM r)), r.node) AS new_id FROM r LEFT JOIN c USING (node)""",
    "mesh_append_guarded": f"""{_AB}, bx AS (SELECT label AS box, min(x) AS x0, min(y) AS y0, min(z) AS z0, avg(x) AS x1, avg(y) AS y1, avg(z) AS z1 FROM a WHERE label < 1 GROUP BY 1), k AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS t FROM b WHERE NOT EXISTS (SELECT 1 FROM bx WHERE {_IN.format(m=0, e=0)}) AND NOT EXISTS (SELECT 1 FROM a WHERE {_D2} <= 0.0004))
        SELECT x.vid AS fid, x.t AS a, y.t AS b, z.t AS c FROM k x JOIN k y ON y.vid = x.vid + 2 JOIN k z ON z.vid = x.vid + 4""",
    "memory_decisions": f"""{_AB}, {_RAYS}, {_free_sql(0.15, 0.05)}, {_NEAR}, k AS (SELECT label, avg((fc.n IS NOT NULL)::INT) AS f, avg((nn.vid IS NOT NULL)::INT) AS s FROM (SELECT *, ((floor(x / 0.15)::BIGINT + 1048576) << 42) | ((floor(y / 0.15)::BIGINT + 1048576) << 21) | (floor(z / 0.15)::BIGINT + 1048576) AS cell FROM a) q LEFT JOIN fc USING (cell) LEFT JOIN nn ON nn.vid = q.vid WHERE label < 8 GROUP BY 1),
        g AS (SELECT label, count(*) AS n FROM b WHERE label > 1 GROUP BY 1)
        SELECT coalesce(k.label, g.label) AS label, CASE WHEN coalesce(k.label, g.label) = 4 THEN 'background_union' WHEN k.label IS NULL THEN 'new_current' WHEN g.label IS NULL AND f >= 0.5 THEN 'absent' WHEN g.label IS NULL THEN 'unobserved' WHEN s >= 0.55 THEN 'persistent_union' WHEN f >= 0.5 THEN 'current_only' ELSE 'supported_prior' END AS decision FROM k FULL JOIN g ON k.label = g.label""",
    "published_manifest": f"{_AB} SELECT 'vertices' AS name, count(*) AS n FROM a UNION ALL SELECT 'objects', count(DISTINCT label) FROM a",
}

"""Registered queries on tracks, voxel life cycles and object histories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import belief
from ..operators import association, gridjoin, linkage, mesh, objects, rays, tracks, trajectory, voxels
from .inputs import HOUR, OBSERVATIONS, STAYS, micros, observations, points, stays, table
from .presence_queries import DAY
from .scratch import ROWS_OF_A_TASK, dealt_by_rows
from .space_queries import _AB, _D2, _RAYS, _SEEN, XYZ, _cell, _rays

GAIN = 40.0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity"), micros("ts").alias("t"), "event_type", "value")


def _state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_events(table(spark, sf_dir, "events"))


def state_events(events: DataFrame) -> DataFrame:
    """Views and purchases are sights of a surface, a cell by value; purchases come with motion. Clicks support what is held,
    errors contradict it."""
    kind = F.when(F.col("event_type").isin("view", "purchase"), objects.OBSERVED).when(F.col("event_type") == "click", objects.SUPPORTED).when(F.col("event_type") == "error", objects.CONTRADICTED)
    e = events.select("event_id", F.col("user_id").alias("entity"), micros("ts").alias("t"), "event_type", "value").withColumn("kind", kind).where("kind is not null")
    return e.select("entity", "kind", F.col("t").alias("first"), F.col("t").alias("last"), F.col("event_id").alias("order"), F.array(F.floor(F.col("value") / GAIN)).alias("cells"), (F.col("event_type") == "purchase").alias("moved"))


def object_persistent_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.persistent_states(_state_events(spark, sf_dir), "entity").select("entity", "fragment", "birth", "last_support", "death", "cells", "status")


def session_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a later session begins with: the states that hold, without their history, under new names."""
    held = objects.persistent_states(_state_events(spark, sf_dir), "entity").where("status = 'current'")
    return objects.session_seeds(held, "entity").select("node", "entity", "first", "last")


def verified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support and contradiction of each entity's day: any sight supports, else any absence contradicts."""
    o = observations(spark, sf_dir).withColumn("day", F.expr(f"t div {DAY}L"))
    return objects.verdict_events(o, ["entity", "day"], "verdict", "t").select("entity", "day", "kind", "stamp")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sights of a customer's thing: its box by price, motion if urgent, support by the number of lines."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.count("*").alias("n"))
    x = F.col("o_totalprice") / 100000
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("entity"), micros("o_orderdate").alias("first"), x.alias("x0"), (x + 0.4).alias("x1"), (F.col("o_orderpriority") == "1-URGENT").alias("moved"))
    return o.join(n, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def geometry_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.geometry_holder(_segments(spark, sf_dir), "entity", "node", ["first", "node"], x0=["x0"], x1=["x1"], motion="moved", support="n", size="n", move=1.0)


def merge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order merges into its customer's next one."""
    return _merged(spark, sf_dir, True)


def merge_attributes_larger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, False)


def _merged(spark: SparkSession, sf_dir: str, union: bool) -> DataFrame:
    from pyspark.sql import Window

    s = _segments(spark, sf_dir).withColumn("owner", F.when(F.col("moved"), F.col("entity")))
    m = s.select(F.col("node").alias("from_node"), F.lead("node").over(Window.partitionBy("entity").orderBy("first", "node")).alias("to_node")).where("to_node is not null")
    got = objects.merge_geometry(m, s, "node", low=["x0"], high=["x1"], last="first", size="n", identity="owner", union=union)
    return got.select("from_node", "to_node", "rule", "x0", "x1", "n", "owner")


def canonical_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.canonical(stays(spark, sf_dir), "entity", "order_id")


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers merge forward in steps of seven until a key that leaves 1 when divided by four: a chain ends above its start."""
    return table(spark, sf_dir, "customer").where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("from_node"), (F.col("c_custkey") + 7).alias("to_node"))


def merge_chain_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.merged_into(_forward(spark, sf_dir))


def merge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _forward(spark, sf_dir)
    nodes = m.select(F.col("from_node").alias("node")).unionByName(m.select(F.col("to_node").alias("node"))).distinct()
    return objects.merge_status(nodes, m, "node")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a frame (an order), each line is a cluster and a motion cluster; they overlap by their quantities."""
    lines = table(spark, sf_dir, "lineitem")
    li = dealt_by_rows(lines.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("cluster"), "l_quantity"), lines.count(), "frame")
    other = li.select("frame", F.col("cluster").alias("motion"), F.col("l_quantity").alias("q"))
    return li.join(other, "frame").where("cluster <> motion").groupBy("frame", "cluster", "motion").agg(F.max(F.round(1 - F.abs(F.col("l_quantity") - F.col("q")) / 50, 6)).alias("score"))


def identity_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters in order take the motion cluster that overlaps them most and is free."""
    return tracks.motion_of(_overlaps(spark, sf_dir), "frame", "cluster", "motion", "score", least=0.3)


def track_assign_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.ordered_greedy(_overlaps(spark, sf_dir), "frame", "cluster", "motion", "score", least=0.5)


def identity_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a day's events of a user the first is its sight; others are duplicates."""
    e = _events(spark, sf_dir).withColumn("frame", F.expr(f"t div {DAY}L"))
    return tracks.identified(e, "frame", "entity", "event_id").select("frame", "entity", "event_id")


def dynamic_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tracks.nearest_tracks(points(spark, sf_dir, 0), points(spark, sf_dir, 1).withColumnRenamed("vid", "cluster"), 0.12, track="vid", cluster="cluster", frame=["label"])
    return got.select("label", "vid", "cluster", F.round("d2", 9).alias("d2"))


def optimal_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = gridjoin.pairs(points(spark, sf_dir, 0), points(spark, sf_dir, 1), 0.12, left_id="vid", right_id="vid", equal=["label"])
    got = association.optimal(near.withColumn("cost", F.sqrt("d2")), "label", "vid", "right_vid", "cost", missing=0.12)
    return got.select("label", "vid", "right_vid", F.round("cost", 6).alias("cost"))


def track_motion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tracks.motion_states(_events(spark, sf_dir), "entity", "t", F.col("event_type") == "click", 36 * HOUR)
    return got.select("event_id", "is_dynamic", "has_history", "last_motion")


def track_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By track: how it is extracted, from its displacement and its newest state; customers that exist are identified."""
    e = _events(spark, sf_dir)
    far = trajectory.displacement(e, "entity", "t", ["value"]).select("entity", "displacement")
    states = tracks.motion_states(e, "entity", "t", F.col("event_type") == "click", 36 * HOUR)
    now = states.groupBy("entity").agg(F.max_by("is_dynamic", F.struct("t", "event_id")).alias("dynamic"), F.max("has_history").alias("history"), F.max(F.col("event_type") == "error").alias("mover"))
    known = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("entity"), F.col("c_custkey").alias("identity"))
    met = now.join(far, "entity").join(known, "entity", "left")
    kind = tracks.extraction(met, displacement=F.col("displacement"), dynamic=F.col("dynamic"), history=F.col("history"), identity=F.col("identity"), semantic_dynamic=F.col("mover"), least=120.0, accept_semantic=True)
    return met.select("entity", kind.alias("kind"))


def after_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sights after the entity's last motion."""
    e = _events(spark, sf_dir)
    last = e.where("event_type = 'click'").groupBy("entity").agg(F.max("t").alias("last_motion"))
    return tracks.after_motion(e.join(last, "entity", "left"), "t", "last_motion").select("event_id")


def valid_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _events(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n"))
    return tracks.valid(n, belief.track_confidence(F.col("n"), 50), 0.65)


def input_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of event those at least an hour after the last accepted one."""
    return tracks.spaced(_events(spark, sf_dir), ["event_type"], "t", HOUR).select("event_type", "t", "event_id")


def buffer_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that a live track refers to: one of the last sights of an entity."""
    e = _events(spark, sf_dir).withColumn("hour", F.expr(f"t div {HOUR}L"))
    last = e.groupBy("entity").agg(F.max("hour").alias("hour"))
    frames = e.groupBy("hour").agg(F.count("*").alias("n"))
    return tracks.referenced(frames, last, "hour", "entity", now=frames.agg(F.max("hour")).scalar(), window=24)


def _cells(spark: SparkSession, sf_dir: str, size: float = 0.2, session: int | None = None) -> DataFrame:
    p = points(spark, sf_dir, session)
    return p.select("vid", "label", *[F.floor(F.col(c) / size).cast("long").alias(n) for c, n in zip(XYZ, voxels.IJK, strict=True)])


def _now(spark: SparkSession, sf_dir: str, share: float = 1.0):
    return F.floor(points(spark, sf_dir).agg(F.max("vid")).scalar() * share)


def free_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells observed but not occupied for a fifth of the time; labels below three occupy."""
    now = _now(spark, sf_dir)
    seen = voxels.tracked(_cells(spark, sf_dir), now, "vid", F.col("label") < 3)
    return seen.select(*voxels.IJK, voxels.is_free(now, 0).alias("free"), (F.coalesce("last_occupied", F.lit(0)) < now * 0.8).alias("free_for_long"))


def ever_free_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates, at half time and at the end."""
    ever = None
    for share in (0.5, 1.0):
        now = _now(spark, sf_dir, share)
        seen = voxels.tracked(_cells(spark, sf_dir, 0.15), now, "vid", F.col("label") < 1)
        ever = voxels.ever_free(seen, F.coalesce("last_occupied", F.lit(0)) < now * 0.95, ever, 6)
    return ever


def block_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _now(spark, sf_dir)
    return voxels.block_states(voxels.tracked(_cells(spark, sf_dir, 0.1), now, "vid", F.lit(False)), now, 60, 2)


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid = gridjoin.cell(XYZ, 0.1)
    a = points(spark, sf_dir, 0).select(cid.alias("cid"), *[F.floor(F.col(c) / 0.1).cast("long").alias(n) for c, n in zip(XYZ, voxels.IJK, strict=True)]).distinct()
    return voxels.seeded_clusters(a, _cells(spark, sf_dir, 0.1, 1), "cid", 6)


def seeded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir).select("cid", "cluster")


def joined_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.join_close(_seeded(spark, sf_dir), "cid", 1.5).select("cid", "cluster")


def physical_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rays say of identified points, by what they end on: objects, unnamed ones, background, or nothing known."""
    ends = points(spark, sf_dir, 1).select(F.col("vid").alias("ray"), F.when(F.col("label") < 6, "object").when(F.col("label") == 6, "unidentified").when(F.col("label") == 7, "background").when(F.col("label") == 8, "invalid").alias("endpoint"), F.col("label").alias("endpoint_id"))
    met = rays.verify(points(spark, sf_dir, 0), _rays(spark, sf_dir).join(ends, "ray"), point_id="vid", ray_id="ray", block=0.1, radial=0.02, depth=0.03, keep=["label", "endpoint", "endpoint_id"])
    verdict, reason = rays.physical_verdict(F.col("verdict"), F.col("label"), F.col("endpoint"), F.col("endpoint_id"))
    return met.where("verdict <> 'occluded'").groupBy(verdict.alias("state"), reason.alias("reason")).agg(F.count("*").alias("n"))


def ray_verify_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of rays whose stamp is within a hundred of the point's."""
    seen = rays.verify(points(spark, sf_dir, 0), _rays(spark, sf_dir), point_id="vid", ray_id="ray", block=0.1, radial=0.02, depth=0.03, earliest=F.col("vid") - 100, latest=F.col("vid") + 100)
    return seen.where("verdict <> 'occluded'").groupBy("vid").agg(F.count("*").alias("n"))


def segment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.renumber(stays(spark, sf_dir).select("order_id", "first", F.coalesce("last", F.lit((1 << 63) - 1)).alias("last")), ["first", "last"], vid="order_id").select("order_id", F.col("target").cast("long").alias("place"))


def complete_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.complete(points(spark, sf_dir), 0.12, whole_labels=ROWS_OF_A_TASK)


def canonical_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten points in a row are one track; label nine is one thing."""
    p = points(spark, sf_dir).withColumn("track", F.expr("vid div 10"))
    centres = linkage.centres(p, 0.12, 4, singles=[9], whole_labels=ROWS_OF_A_TASK)
    return linkage.identities(p, centres, 0.06, track="track")


QUERIES = {
    f.__name__: f
    for f in (
        complete_linkage, canonical_tracks, object_persistent_states, session_seed, verified_events, geometry_holder, merge_attributes, merge_attributes_larger, canonical_objects, merge_chain_ends, merge_status, identity_motion,
        track_assign_greedy, identity_first, dynamic_nearest, optimal_assignment, track_motion_states, track_extraction, after_motion, valid_tracks, input_gate, buffer_referenced, free_voxels, ever_free_voxels,
        block_eviction, seeded_clusters, joined_clusters, physical_verdicts, ray_verify_window, segment_order,
    )
}

_E = "e AS (SELECT event_id, user_id AS entity, epoch_us(ts) AS t, event_type, value FROM events)"
_S = """g AS (SELECT o_orderkey AS node, o_custkey AS entity, epoch_us(o_orderdate) AS first, o_totalprice / 100000 AS x0, o_totalprice / 100000 + 0.4 AS x1, o_orderpriority = '1-URGENT' AS moved, coalesce(l.n, 0) AS n
    FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON k = o_orderkey)"""
#: One event a step: the cells, birth and support of the current fragment, candidates of one cell each, and what the step closed.
_STATES = f"""WITH RECURSIVE {_E},
    v AS (SELECT entity, t, event_type AS kind, floor(value / {GAIN})::BIGINT AS c, row_number() OVER (PARTITION BY entity ORDER BY t, CASE WHEN event_type IN ('view', 'purchase') THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END, event_id) AS k,
          row_number() OVER (PARTITION BY entity, t, event_type IN ('view', 'purchase') ORDER BY event_id) AS nth FROM e WHERE event_type IN ('view', 'purchase', 'click', 'error')),
    s AS (SELECT DISTINCT entity, 0::BIGINT AS k, -1::BIGINT AS f, NULL::BIGINT[] AS cells, NULL::BIGINT AS birth, NULL::BIGINT AS sup, []::STRUCT(c BIGINT, b BIGINT, s BIGINT)[] AS open, NULL::STRUCT(f BIGINT, birth BIGINT, sup BIGINT, death BIGINT, n BIGINT) AS gone FROM v
      UNION ALL
      SELECT entity, k, CASE WHEN act IN ('begin', 'move') OR (act = 'end' AND len(open) > 0) THEN f + 1 ELSE f END,
        CASE act WHEN 'begin' THEN [c] WHEN 'move' THEN [c] WHEN 'same' THEN list_distinct(list_append(cells, c)) WHEN 'support' THEN list_distinct(list_concat(cells, list_transform(taken, lambda o: o.c))) WHEN 'end' THEN CASE WHEN len(open) > 0 THEN [newest.c] END ELSE cells END,
        CASE act WHEN 'begin' THEN t WHEN 'move' THEN t WHEN 'end' THEN newest.b WHEN 'same' THEN least(birth, list_min(list_transform(taken, lambda o: o.b))) WHEN 'support' THEN least(birth, list_min(list_transform(taken, lambda o: o.b))) ELSE birth END,
        CASE act WHEN 'begin' THEN t WHEN 'move' THEN t WHEN 'end' THEN newest.s WHEN 'same' THEN greatest(sup, t, list_max(list_transform(taken, lambda o: o.s))) WHEN 'support' THEN greatest(sup, t, list_max(list_transform(taken, lambda o: o.s))) ELSE sup END,
        CASE act WHEN 'same' THEN list_filter(open, lambda o: NOT list_contains(cells, o.c) AND o.c <> c) WHEN 'support' THEN list_filter(open, lambda o: o.b > t) WHEN 'end' THEN list_filter(open, lambda o: o.c <> newest.c)
          WHEN 'join' THEN list_transform(open, lambda o: {{'c': o.c, 'b': o.b, 's': CASE WHEN o.c = c THEN greatest(o.s, t) ELSE o.s END}}) WHEN 'wait' THEN list_append(open, {{'c': c, 'b': t, 's': t}}) ELSE open END,
        CASE WHEN act IN ('move', 'end') THEN {{'f': f, 'birth': birth, 'sup': sup, 'death': greatest(t, sup), 'n': len(cells)}} END
      FROM (SELECT *, CASE act WHEN 'same' THEN list_filter(open, lambda o: list_contains(cells, o.c) OR o.c = c) WHEN 'support' THEN list_filter(open, lambda o: o.b <= t) ELSE [] END AS taken,
              list_filter(open, lambda o: o.s = list_max(list_transform(open, lambda x: x.s)))[1] AS newest
        FROM (SELECT s.entity, v.k, s.f, s.cells, s.birth, s.sup, s.open, v.t, v.c,
                CASE WHEN v.kind IN ('view', 'purchase') THEN CASE WHEN v.nth > 1 THEN 'skip' WHEN s.cells IS NULL THEN 'begin' WHEN list_contains(s.cells, v.c) OR s.sup >= v.t THEN 'same' WHEN v.kind = 'purchase' THEN 'move'
                    WHEN len(list_filter(s.open, lambda o: o.c = v.c)) > 0 THEN 'join' ELSE 'wait' END
                  WHEN s.cells IS NULL THEN 'skip' WHEN v.kind = 'click' THEN 'support' ELSE 'end' END AS act
              FROM s JOIN v ON v.entity = s.entity AND v.k = s.k + 1))),
    z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY entity ORDER BY k DESC) = 1)"""
_CURRENT = "SELECT entity, f AS fragment, birth, sup AS last_support, NULL::BIGINT AS death, len(cells) AS cells, 'current' AS status FROM z WHERE cells IS NOT NULL"
_OVER = """ov AS (SELECT a.l_orderkey AS frame, a.l_linenumber::BIGINT AS cluster, b.l_linenumber::BIGINT AS motion, max(round(1 - abs(a.l_quantity - b.l_quantity) / 50, 6)) AS score FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY 1, 2, 3)"""


def _serial(group: str, left: str, right: str, source: str, order: str) -> str:
    """Left ends in order choose the first free one of their preferences: columns group, left, pick."""
    return f"""pf AS (SELECT {group}, {left}, list({right} ORDER BY {order}) AS prefs, row_number() OVER (PARTITION BY {group} ORDER BY {left}) AS k FROM {source} GROUP BY 1, 2),
    se AS (SELECT DISTINCT {group}, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS {left}, NULL::BIGINT AS pick FROM pf
      UNION ALL SELECT {group}, k, list_append(used, pick), {left}, pick FROM (SELECT pf.{group}, pf.k, se.used, pf.{left}, list_filter(pf.prefs, lambda x: NOT list_contains(se.used, x))[1] AS pick FROM se JOIN pf ON pf.{group} = se.{group} AND pf.k = se.k + 1))"""


_MOTION = f"""{_E}, m AS (SELECT *, max(t) FILTER (event_type = 'click') OVER (PARTITION BY entity ORDER BY t RANGE UNBOUNDED PRECEDING) AS last_motion FROM e),
    st AS (SELECT *, last_motion IS NOT NULL AS has_history, coalesce(t = last_motion OR t < last_motion + {36 * HOUR}, false) AS is_dynamic FROM m)"""
_IJK = lambda size: ", ".join(f"floor({c} / {size})::BIGINT AS {n}" for c, n in zip(XYZ, "ijk", strict=True))


def _tracked(name: str, size: float, now: str, occupied: str) -> str:
    return f"{name} AS (SELECT {_IJK(size)}, max(vid) AS last_observed, max(vid) FILTER ({occupied}) AS last_occupied FROM p WHERE vid <= {now} GROUP BY 1, 2, 3)"


_LAST = "(SELECT max(vid) FROM p)"
_STEP = "abs(n.i - q.i) + abs(n.j - q.j) + abs(n.k - q.k) = 1"
_SEEDED = f"""WITH RECURSIVE p AS (SELECT vec_id AS vid, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), o AS (SELECT DISTINCT {_cell(0.1)} AS cid, {_IJK(0.1)} FROM p WHERE vid % 2 = 0),
    sd AS (SELECT DISTINCT {_IJK(0.1)} FROM p WHERE vid % 2 = 1), w AS (SELECT o.* FROM o JOIN sd USING (i, j, k)), r0 AS (SELECT o.* FROM o ANTI JOIN sd USING (i, j, k)),
    g AS (SELECT cid, cid AS root FROM w UNION SELECT n.cid, g.root FROM g JOIN w q ON q.cid = g.cid JOIN w n ON {_STEP}),
    c1 AS (SELECT cid, min(root) AS cluster FROM g GROUP BY 1), cl AS (SELECT cid, cluster FROM c1 UNION ALL SELECT n.cid, min(c1.cluster) FROM r0 n JOIN w q ON {_STEP} JOIN c1 ON c1.cid = q.cid GROUP BY 1)"""

ORACLES = {
    "object_persistent_states": f"""{_STATES} SELECT entity, gone.f AS fragment, gone.birth AS birth, gone.sup AS last_support, gone.death AS death, gone.n AS cells, 'closed' AS status FROM s WHERE gone IS NOT NULL
        UNION ALL {_CURRENT} UNION ALL SELECT entity, NULL, o.b, o.s, NULL, 1, 'unresolved' FROM (SELECT entity, unnest(open) AS o FROM z)""",
    "session_seed": f"{_STATES} SELECT 'M' || entity AS node, entity, birth AS first, last_support AS last FROM ({_CURRENT})",
    "verified_events": f"""WITH {OBSERVATIONS} SELECT entity, t // {DAY} AS day, CASE WHEN bool_or(verdict = 'present') THEN '2 supported' ELSE '3 contradicted' END AS kind,
        CASE WHEN bool_or(verdict = 'present') THEN max(t) FILTER (verdict = 'present') ELSE max(t) FILTER (verdict = 'absent') END AS stamp FROM o GROUP BY 1, 2 HAVING bool_or(verdict IN ('present', 'absent'))""",
    "geometry_holder": f"""WITH RECURSIVE {_S}, q AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY first, node) AS k FROM g WHERE n > 0),
        h AS (SELECT entity, k, node, x0, x1, n FROM q WHERE k = 1 UNION ALL SELECT entity, k, CASE WHEN take THEN qn ELSE node END, CASE WHEN take THEN q0 ELSE x0 END, CASE WHEN take THEN q1 ELSE x1 END, CASE WHEN take THEN qs ELSE n END
          FROM (SELECT h.*, q.k AS nk, q.node AS qn, q.x0 AS q0, q.x1 AS q1, q.n AS qs, q.moved OR q.n >= h.n OR ((h.x1 < q.x0 OR q.x1 < h.x0) AND abs(h.x0 + h.x1 - q.x0 - q.x1) / 2 >= 1.0) AS take FROM h JOIN q ON q.entity = h.entity AND q.k = h.k + 1) t(entity, k_old, node, x0, x1, n, k, qn, q0, q1, qs, take))
        SELECT entity, node FROM h QUALIFY row_number() OVER (PARTITION BY entity ORDER BY k DESC) = 1""",
    **{
        name: f"""WITH {_S}, f AS (SELECT *, lead(node) OVER w AS to_node FROM g WINDOW w AS (PARTITION BY entity ORDER BY first, node)),
        r AS (SELECT f.node AS from_node, f.to_node, f.x0 AS a0, f.x1 AS a1, f.n AS an, i.x0 AS b0, i.x1 AS b1, i.n AS bn, CASE WHEN f.moved AND i.moved AND (f.x1 < i.x0 OR i.x1 < f.x0) THEN CASE WHEN f.first >= i.first THEN 'moved_newer' ELSE 'moved_kept' END ELSE {still} END AS rule,
              CASE WHEN f.moved OR i.moved THEN f.entity END AS owner FROM f JOIN g i ON i.node = f.to_node)
        SELECT from_node, to_node, rule, CASE WHEN rule = 'union' THEN least(a0, b0) WHEN rule IN ('moved_newer', 'larger') THEN a0 ELSE b0 END AS x0, CASE WHEN rule = 'union' THEN greatest(a1, b1) WHEN rule IN ('moved_newer', 'larger') THEN a1 ELSE b1 END AS x1,
               CASE WHEN rule = 'union' THEN an + bn WHEN rule IN ('moved_newer', 'larger') THEN an ELSE bn END AS n, owner FROM r"""
        for name, still in (("merge_attributes", "'union'"), ("merge_attributes_larger", "CASE WHEN f.n > i.n THEN 'larger' ELSE 'kept' END"))
    },
    "canonical_objects": f"""WITH {STAYS}, w AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY first, order_id) AS a, row_number() OVER (PARTITION BY entity ORDER BY coalesce(last, 9223372036854775807) DESC, first DESC, order_id DESC) AS z, count(*) OVER (PARTITION BY entity) AS n FROM s)
        SELECT x.entity, x.order_id AS target, y.order_id AS newest, x.n, y.first, y.last FROM (SELECT * FROM w WHERE a = 1) x JOIN (SELECT * FROM w WHERE z = 1) y USING (entity) WHERE x.n > 1""",
    "merge_chain_ends": """WITH RECURSIVE m AS (SELECT c_custkey AS f, c_custkey + 7 AS t FROM customer WHERE c_custkey % 4 <> 1), n AS (SELECT f AS node FROM m UNION SELECT t FROM m),
        c AS (SELECT node, node AS final FROM n UNION ALL SELECT c.node, m.t FROM c JOIN m ON c.final = m.f) SELECT node, max(final) AS final FROM c GROUP BY node""",
    "merge_status": """WITH m AS (SELECT c_custkey AS f, c_custkey + 7 AS t FROM customer WHERE c_custkey % 4 <> 1), n AS (SELECT f AS node FROM m UNION SELECT t FROM m)
        SELECT node, CASE WHEN node IN (SELECT f FROM m) THEN 'merged_away' ELSE 'final_merged' END AS status FROM n""",
    "identity_motion": f"WITH RECURSIVE {_OVER}, oo AS (SELECT * FROM ov WHERE score >= 0.3), {_serial('frame', 'cluster', 'motion', 'oo', 'score DESC, motion DESC')} SELECT frame, cluster, motion, score FROM se JOIN oo USING (frame, cluster) WHERE motion = pick",
    "track_assign_greedy": f"WITH RECURSIVE {_OVER}, oo AS (SELECT * FROM ov WHERE score > 0.5), {_serial('frame', 'cluster', 'motion', 'oo', 'score DESC, motion')} SELECT frame, cluster, motion, score FROM se JOIN oo USING (frame, cluster) WHERE motion = pick",
    "identity_first": f"WITH {_E} SELECT t // {DAY} AS frame, entity, min(event_id) AS event_id FROM e GROUP BY 1, 2",
    "dynamic_nearest": f"{_AB.replace('WITH', 'WITH RECURSIVE', 1)}, d AS (SELECT a.label, a.vid, b.vid AS cluster, {_D2} AS d2 FROM a JOIN b ON a.label = b.label AND {_D2} <= 0.12 * 0.12), {_serial('label', 'vid', 'cluster', 'd', 'd2, cluster')} SELECT label, vid, cluster, round(d2, 9) AS d2 FROM se JOIN d USING (label, vid) WHERE cluster = pick",
    "track_motion_states": f"WITH {_MOTION} SELECT event_id, is_dynamic, has_history, last_motion FROM st",
    "track_extraction": f"""WITH {_MOTION}, n AS (SELECT entity, arg_max(is_dynamic, (t, event_id)) AS dynamic, max(has_history) AS history, max(event_type = 'error') AS mover FROM st GROUP BY 1),
        f AS (SELECT entity, max(abs(value - v0)) AS d FROM (SELECT *, first_value(value) OVER (PARTITION BY entity ORDER BY t, value) AS v0 FROM e) GROUP BY 1)
        SELECT entity, CASE WHEN c_custkey IS NOT NULL AND (dynamic OR history) AND d < 120 THEN 'static' WHEN NOT dynamic THEN 'static' WHEN d < 120 AND NOT mover THEN 'dropped' ELSE 'dynamic' END AS kind FROM n JOIN f USING (entity) LEFT JOIN customer ON c_custkey = entity AND c_acctbal > 5000""",
    "after_motion": f"WITH {_E} SELECT event_id FROM e LEFT JOIN (SELECT entity, max(t) AS m FROM e WHERE event_type = 'click' GROUP BY 1) USING (entity) WHERE m IS NULL OR t > m",
    "valid_tracks": f"WITH {_E} SELECT entity, count(*) AS n FROM e GROUP BY 1 HAVING least(count(*) / 100.0, 1) > 0.65",
    "input_gate": f"""WITH RECURSIVE {_E}, l AS (SELECT event_type, list_sort(list(DISTINCT t)) AS ts FROM e GROUP BY 1),
        a AS (SELECT event_type, ts, ts[1] AS t FROM l UNION ALL SELECT event_type, ts, list_filter(ts, lambda x: x >= t + {HOUR})[1] FROM a WHERE list_filter(ts, lambda x: x >= t + {HOUR})[1] IS NOT NULL) SELECT event_type, t, event_id FROM a JOIN e USING (event_type, t)""",
    "buffer_referenced": f"WITH {_E}, h AS (SELECT *, t // {HOUR} AS hour FROM e), l AS (SELECT entity, max(hour) AS hour FROM h GROUP BY 1) SELECT hour, count(*) AS n FROM h WHERE hour IN (SELECT hour FROM l) OR hour >= (SELECT max(hour) FROM h) - 24 GROUP BY 1",
    "free_voxels": f"{_AB}, {_tracked('v', 0.2, _LAST, 'label < 3')} SELECT i, j, k, coalesce(last_occupied, 0) < {_LAST} AS free, coalesce(last_occupied, 0) < {_LAST} * 0.8 AS free_for_long FROM v",
    "ever_free_voxels": f"""{_AB}, {_tracked('v', 0.15, f"floor({_LAST} * 0.5)", 'label < 1')}, {_tracked('u', 0.15, _LAST, 'label < 1')}, f1 AS (SELECT i, j, k FROM v WHERE coalesce(last_occupied, 0) < floor({_LAST} * 0.5) * 0.95), f2 AS (SELECT i, j, k FROM u WHERE coalesce(last_occupied, 0) < {_LAST} * 0.95),
        e1 AS (SELECT * FROM f1 q WHERE (SELECT count(*) FROM f1 n WHERE {_STEP}) = 6), c2 AS (SELECT * FROM f2 UNION SELECT * FROM e1), e2 AS (SELECT * FROM f2 q WHERE (SELECT count(*) FROM c2 n WHERE {_STEP}) = 6) SELECT * FROM e1 UNION SELECT * FROM e2""",
    "block_eviction": f"{_AB}, {_tracked('v', 0.1, _LAST, 'false')} SELECT floor(i / 2)::BIGINT AS bi, floor(j / 2)::BIGINT AS bj, floor(k / 2)::BIGINT AS bk, count(*) AS cells, count(*) FILTER (last_observed >= {_LAST} - 60) AS active, count(*) FILTER (last_observed >= {_LAST} - 60) = 0 AS evicted FROM v GROUP BY 1, 2, 3",
    "seeded_clusters": f"{_SEEDED} SELECT cid, cluster FROM cl",
    "joined_clusters": f"""{_SEEDED}, x AS (SELECT cid, cluster, i, j, k FROM cl JOIN o USING (cid)), l AS (SELECT DISTINCT q.cluster AS u, n.cluster AS v FROM x q JOIN x n ON q.cluster <> n.cluster AND (q.i - n.i) ** 2 + (q.j - n.j) ** 2 + (q.k - n.k) ** 2 < 1.5 * 1.5),
        h AS (SELECT cluster, cluster AS root FROM (SELECT DISTINCT cluster FROM x) UNION SELECT l.v, h.root FROM h JOIN l ON l.u = h.cluster) SELECT cid, min(root) AS cluster FROM x JOIN h USING (cluster) GROUP BY 1""",
    "physical_verdicts": f"""{_AB}, {_RAYS}, {_SEEN}, y AS (SELECT h.vid, a.label AS own, b.label AS el, CASE WHEN d - reach > 0.03 THEN 'occluded' WHEN reach - d > 0.03 THEN 'absent' ELSE 'present' END AS v FROM h JOIN a ON a.vid = h.vid JOIN b ON b.vid = h.ray WHERE aside <= 0.02 AND d - reach <= 0.03)
        SELECT CASE WHEN v = 'occluded' THEN 'occluded' WHEN el < 6 AND el = own THEN 'present' WHEN el = 7 THEN 'absent' WHEN el > 8 AND v = 'absent' THEN 'absent' ELSE 'inconclusive' END AS state,
          CASE WHEN v = 'occluded' THEN 'geometric_occlusion' WHEN el > 8 THEN 'unavailable' WHEN el = 8 THEN 'invalid' WHEN el < 6 AND el = own THEN 'same_id' WHEN el < 6 THEN 'different_id' WHEN el = 6 THEN 'unidentified_object' WHEN v = 'absent' THEN 'free_space' ELSE 'background_replacement' END AS reason, count(*) AS n FROM y GROUP BY 1, 2""",
    "ray_verify_window": f"{_AB}, {_RAYS}, {_SEEN} SELECT vid, count(*) AS n FROM h WHERE aside <= 0.02 AND d - reach <= 0.03 AND abs(ray - vid) <= 100 GROUP BY vid",
    "segment_order": f"WITH {STAYS} SELECT order_id, row_number() OVER (ORDER BY first, coalesce(last, 9223372036854775807), order_id) - 1 AS place FROM s",
}

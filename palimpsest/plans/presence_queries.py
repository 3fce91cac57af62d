"""Registered queries on presence, evidence, beliefs and time travel, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import belief
from ..operators import evidence, objects, presence, quality, trajectory
from ..streaming import activity
from . import timetravel
from .inputs import HOUR, OBSERVATIONS, STAYS, observations, stays, table

GAP = 6 * HOUR
#: A day in the middle of the orders' and of the events' range.
ORDER_DAY, EVENT_DAY = 803_347_200_000_000, 1_705_276_800_000_000
DAY = 24 * HOUR
RULE = evidence.Scan(resolution=DAY, window=3, absence=0.3, presence=0.5)
PHYSICAL = evidence.Scan(resolution=DAY, window=3, absence=0.2, presence=0.4, physical=True)


def presence_union_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observations(spark, sf_dir).select("entity", F.col("t").alias("first"), (F.col("t") + GAP).alias("last"))
    return presence.interval_union(seen, ["entity"], slice_width=7 * DAY)


def present_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.present_at(stays(spark, sf_dir), F.lit(ORDER_DAY)).groupBy("entity").agg(F.count("*").alias("n"))


def appeared_disappeared_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.last_changes_before(stays(spark, sf_dir), ["entity"], F.lit(ORDER_DAY))


def presence_clip_next_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.clip_to_next(stays(spark, sf_dir).select("entity", "order_id", "first", "last"), ["entity"], ties=["order_id"]).select("entity", "order_id", "first", "last", "clipped")


def evidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.bins(observations(spark, sf_dir), ["entity"], "t", "verdict", DAY)


def change_scan_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.scan(observations(spark, sf_dir), ["entity"], "t", "verdict", RULE)


def change_scan_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.scan(observations(spark, sf_dir), ["entity"], "t", "verdict", RULE, forward=False)


def change_scan_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.scan(observations(spark, sf_dir), ["entity"], "t", "verdict", PHYSICAL)


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.col("t").between(EVENT_DAY - 3 * DAY, EVENT_DAY + 3 * DAY) & (F.col("verdict") == "present")
    return observations(spark, sf_dir).where(near).groupBy("entity").agg(F.min("t").alias("obs_first"), F.max("t").alias("obs_last"))


def object_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.object_changes(_watched(spark, sf_dir), observations(spark, sf_dir), "entity", "t", "verdict", RULE, margin=HOUR)


def vertex_change_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _watched(spark, sf_dir).select("entity", F.col("obs_last").alias("last_seen"))
    return evidence.vertex_states(seen, observations(spark, sf_dir), "entity", "t", "verdict", RULE, margin=HOUR)


def verify_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.verify_current(observations(spark, sf_dir).where(F.col("t") >= EVENT_DAY), ["entity"], "verdict")


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last stamps of absence and presence of each entity: absent early and late, present in the middle."""
    v, t = F.col("verdict"), F.col("t")
    return observations(spark, sf_dir).groupBy("entity").agg(
        F.max(F.when((v == "absent") & (t < EVENT_DAY), t)).alias("first_absent"),
        F.min(F.when((v == "present") & (t < EVENT_DAY), t)).alias("first_persistent"),
        F.max(F.when((v == "present") & (t > EVENT_DAY), t)).alias("last_persistent"),
        F.min(F.when((v == "absent") & (t > EVENT_DAY + 5 * DAY), t)).alias("last_absent"),
    )


def presence_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.lit(EVENT_DAY - DAY), F.lit(EVENT_DAY + DAY)
    begin, end = presence.estimate(first, last, *[F.col(c) for c in ("first_absent", "first_persistent", "last_absent", "last_persistent")], identified=F.col("entity") % 2 == 0)
    return _stamps(spark, sf_dir).select("entity", begin.alias("first"), end.alias("last"))


def clamp_overestimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = presence.clamp_open_ends(F.when(F.col("entity") % 3 > 0, F.col("first")), F.col("last"), F.lit(ORDER_DAY), F.lit(ORDER_DAY + DAY))
    return stays(spark, sf_dir).select("order_id", first.alias("first"), last.alias("last"))


def move_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = [F.col(c) for c in ("first_absent", "last_absent", "first_persistent", "last_persistent")]
    p = belief.move_probability(*[s * 1000 for s in stamps], scale_s=86400.0)
    rows = _stamps(spark, sf_dir).withColumn("p", p)
    decided = [belief.moved(k, F.col("p"), F.col("last_absent"), F.col("last_persistent"), threshold=0.4, missing_cost=0.7).alias(k) for k in ("hard", "probability", "expected_utility")]
    return rows.select("entity", F.round("p", 6).alias("move_probability"), *decided)


def pocd_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    still = F.when(F.col("verdict") == "absent", 0).otherwise(1)
    delta = (F.col("value") % 1.0) - 0.5
    k = belief.stationarity_weight(still, delta, 0.1, F.col("verdict") == "inconclusive")
    after = belief.posterior(F.lit(0.0), F.lit(0.2), F.lit(2.0), F.lit(1.0), delta, still, k, tau=0.1, delta_max=1.0)
    return o.select("event_id", *[F.round(c, 6).alias(n) for n, c in (("mu", after.mu), ("sigma", after.sigma), ("alpha", after.alpha), ("beta", after.beta), ("inlier_weight", after.inlier_weight))])


def memory_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = observations(spark, sf_dir).groupBy("entity").agg(F.count_if(F.col("verdict") == "absent").alias("absent"), F.count_if(F.col("verdict") == "present").alias("present"))
    share = (F.lit(2.0) + F.col("present"), F.lit(1.0) + 3 * F.col("absent"))
    return votes.select("entity", "absent", "present", belief.memory_state(F.col("absent"), F.col("present"), *share).alias("state"), belief.cull("absence_majority", F.col("absent") * 3, F.col("present")).alias("culled"), F.round(belief.track_confidence(F.col("present"), 20), 6).alias("confidence"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = activity.sessions(e, "user_id", "ts", "2 hours")
    return out.select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last_end").alias("last_end"), "n")


def as_of_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer, the newest order at a day and whether it was open then."""
    open_ = presence.is_present(F.col("first"), F.col("last"), F.lit(ORDER_DAY))
    # orders of one stamp are one row before the newest is taken
    stamps = stays(spark, sf_dir).groupBy("entity", "first").agg(F.max("order_id").alias("order_id"), F.bool_or(open_).alias("open"))
    return timetravel.history_at(stamps, F.lit(ORDER_DAY), ["entity"], "first")


def snapshot_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day of sampling, the monthly snapshot that answers it."""
    months = table(spark, sf_dir, "orders").select(F.date_trunc("month", F.col("o_orderdate").cast("timestamp_ntz")).alias("m")).distinct()
    stamps = months.select(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', m)").alias("stamp"))
    times = spark.range(1).select(F.explode(timetravel.sample_times(ORDER_DAY - 3000 * DAY, ORDER_DAY + 3000 * DAY, 100 * DAY)).alias("t"))
    return timetravel.snapshot_stamp(stamps, times, "stamp", "t")


def max_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trajectory.displacement(trajectory.merge(observations(spark, sf_dir), "entity", "t", "event_id"), "entity", "t", ["value"])
    return out.select("entity", "n", F.round("displacement", 6).alias("displacement"))


def trajectory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = observations(spark, sf_dir).withColumn("hour", F.expr(f"t div {HOUR}L"))
    return trajectory.merge(hourly, "entity", "hour", "event_id").select("entity", "hour", "event_id")


def arc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = trajectory.arc_length(trajectory.merge(observations(spark, sf_dir), "entity", "t", "event_id"), "entity", "t", ["value"])
    return whole.groupBy("entity").agg(F.round(F.max("length"), 4).alias("length"), F.round(F.max("step"), 4).alias("longest_step"))


def interpolate_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = observations(spark, sf_dir).groupBy("entity", F.expr(f"t div {DAY}L").alias("t")).agg(F.max("value").alias("value"))
    return trajectory.densify(daily, "entity", "t", ["value"], 1).select("entity", "t", F.round("value", 6).alias("value"))


def throttled_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.throttle(observations(spark, sf_dir), "entity", "t", 3 * DAY).select("entity", "t", "event_id")


def slice_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map time: month of the order; query time: month of the shipment."""
    month = lambda c: (F.year(c) * 12 + F.month(c)).cast("long")
    o = table(spark, sf_dir, "orders").select("o_orderkey", month(F.col("o_orderdate")).alias("map_time"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", month(F.col("l_shipdate")).alias("query_time"))
    matrix = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("map_time", "query_time").agg(F.count("*").alias("n"))
    return trajectory.slices(matrix, "map_time", "query_time").select("slice", "map_time", "query_time", "n")


def gt_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = stays(spark, sf_dir).where(F.col("entity") % 5 > 0)
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    out = presence.consolidate(people, changes, "entity", "first", "last")
    return out.select("entity", F.size("appearances").cast("long").alias("n_appearances"), F.size("disappearances").cast("long").alias("n_disappearances"), F.get("appearances", F.lit(0)).alias("first"), F.try_element_at("disappearances", F.lit(-1)).alias("last"))


def strictly_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.non_increasing(observations(spark, sf_dir), ["entity"], "t", F.col("event_id")).groupBy("entity").agg(F.count("*").alias("n"))


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rules = {"quantity is positive": F.col("l_quantity") > 0, "discount is below 5 %": F.col("l_discount") < 0.05, "flag is known": F.col("l_returnflag").isin("A", "N", "R"), "ships after 1993": F.col("l_shipdate") >= F.lit("1993-01-01").cast("date")}
    return quality.gates(li, rules)


def catalog_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation_id"), F.lit(-1).alias("region_id"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_regionkey").cast("int").alias("region_id"))
    return quality.override(c, nations, "nation_id", "region_id").groupBy("region_id").agg(F.count("*").alias("n"))


def missing_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    users = observations(spark, sf_dir).select("entity")
    return quality.missing(people, users, ["entity"])


def object_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.fragments(observations(spark, sf_dir), "entity", "t", ["value"], 60.0)


def segment_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = observations(spark, sf_dir).groupBy("entity", F.expr(f"t div {7 * DAY}L").alias("week")).agg(F.count("*").alias("support"), F.bool_or(F.col("value") > 190).alias("moved"))
    return objects.geometry_owner(days, "entity", ["week"], moved=F.col("moved"), support=F.col("support"))


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 5 > 0").select("p_partkey", F.col("p_retailprice").alias("depth"))
    b = p.where("p_partkey % 7 > 0").select("p_partkey", (F.col("p_retailprice") + F.col("p_size") - 25).alias("depth"))
    return quality.compare_runs(a, b, ["p_partkey"], "depth", [5.0, 15.0])


QUERIES = {
    f.__name__: f
    for f in (
        presence_union_users, present_at_time, appeared_disappeared_at, presence_clip_next_segment, evidence_bins, change_scan_forward, change_scan_backward, change_scan_physical,
        object_changes, vertex_change_state, verify_current, presence_estimate, clamp_overestimation, move_decision, pocd_posterior, memory_state, session_windows, as_of_snapshot, snapshot_choice,
        max_displacement, trajectory_merge, arc_length, interpolate_dense, throttled_output, slice_4d, gt_consolidate, strictly_increasing, quality_gates, catalog_override, missing_entities,
        object_state_fold, segment_owner, compare_runs,
    )
}


def _scan_sql(source: str, forward: bool, absence: float, there: float, physical: bool, window: int = 3) -> str:
    """SQL of a scan over a relation with entity, t, verdict."""
    span = f"BETWEEN CURRENT ROW AND {window - 1} FOLLOWING" if forward else f"BETWEEN {window - 1} PRECEDING AND CURRENT ROW"
    total = "wp + wa" + (" + wi" if physical else "")
    before, stop, far = ("<", "min", "max") if forward else (">", "max", "min")
    return f"""
        SELECT entity, any_value(stop) * {DAY} AS closest_absent, {far}(bin) FILTER (wp / ({total}) > {there} AND (stop IS NULL OR bin {before} stop)) * {DAY} AS furthest_persistent
        FROM (SELECT *, {stop}(CASE WHEN wa / ({total}) > {absence} THEN bin END) OVER (PARTITION BY entity) AS stop
              FROM (SELECT entity, bin, sum(p) OVER w AS wp, sum(a) OVER w AS wa, sum(i) OVER w AS wi
                    FROM (SELECT entity, t // {DAY} AS bin, count(*) FILTER (verdict = 'present') AS p, count(*) FILTER (verdict = 'absent') AS a, count(*) FILTER (verdict = 'inconclusive') AS i
                          FROM {source} GROUP BY 1, 2 {"" if physical else "HAVING p + a > 0"})
                    WINDOW w AS (PARTITION BY entity ORDER BY bin RANGE {span}))) GROUP BY entity"""


_WATCHED = f"w AS (SELECT entity, min(t) AS obs_first, max(t) AS obs_last FROM o WHERE t BETWEEN {EVENT_DAY - 3 * DAY} AND {EVENT_DAY + 3 * DAY} AND verdict = 'present' GROUP BY 1)"
_STAMPS = f"""st AS (SELECT entity, max(t) FILTER (verdict = 'absent' AND t < {EVENT_DAY}) AS fa, min(t) FILTER (verdict = 'present' AND t < {EVENT_DAY}) AS fp,
    max(t) FILTER (verdict = 'present' AND t > {EVENT_DAY}) AS lp, min(t) FILTER (verdict = 'absent' AND t > {EVENT_DAY + 5 * DAY}) AS la FROM o GROUP BY 1)"""
_ONCE = "u AS (SELECT entity, t, arg_min(value, event_id) AS value, min(event_id) AS event_id FROM o GROUP BY 1, 2)"
_P = "1 / (1 + exp(-logit))"

ORACLES = {
    "presence_union_users": f"""WITH {OBSERVATIONS}, g AS (SELECT entity, t, t > max(t) OVER (PARTITION BY entity ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {GAP} AS opens FROM o),
        i AS (SELECT entity, t, count(*) FILTER (opens) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM g)
        SELECT entity, min(t) AS first, max(t) + {GAP} AS last, count(*) AS n FROM i GROUP BY entity, island""",
    "present_at_time": f"WITH {STAYS} SELECT entity, count(*) AS n FROM s WHERE first <= {ORDER_DAY} AND (last IS NULL OR last > {ORDER_DAY}) GROUP BY entity",
    "appeared_disappeared_at": f"""WITH {STAYS} SELECT entity, max(first) FILTER (first <= {ORDER_DAY}) AS last_appeared, max(last) FILTER (last <= {ORDER_DAY}) AS last_disappeared,
        count(*) FILTER (first <= {ORDER_DAY}) > 0 AS has_appeared, count(*) FILTER (last <= {ORDER_DAY}) > 0 AS has_disappeared FROM s GROUP BY entity""",
    "presence_clip_next_segment": f"""WITH {STAYS}, c AS (SELECT *, coalesce(last, 9223372036854775807) AS l FROM s)
        SELECT entity, order_id, first, last, nullif(least(l, coalesce(lead(first) OVER w, 9223372036854775807), last_value(l) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 9223372036854775807) AS clipped
        FROM c WINDOW w AS (PARTITION BY entity ORDER BY first, last NULLS FIRST)""",
    "evidence_bins": f"""WITH {OBSERVATIONS} SELECT entity, t // {DAY} AS bin, count(*) FILTER (verdict = 'present') AS present, count(*) FILTER (verdict = 'absent') AS absent,
        count(*) FILTER (verdict = 'inconclusive') AS inconclusive FROM o GROUP BY 1, 2""",
    "change_scan_forward": f"WITH {OBSERVATIONS} {_scan_sql('o', True, 0.3, 0.5, False)}",
    "change_scan_backward": f"WITH {OBSERVATIONS} {_scan_sql('o', False, 0.3, 0.5, False)}",
    "change_scan_physical": f"WITH {OBSERVATIONS} {_scan_sql('o', True, 0.2, 0.4, True)}",
    "object_changes": f"""WITH {OBSERVATIONS}, {_WATCHED}, ob AS (SELECT o.* FROM o JOIN w USING (entity) WHERE t <= greatest(obs_first - {HOUR}, 0)), oa AS (SELECT o.* FROM o JOIN w USING (entity) WHERE t >= obs_last + {HOUR}),
        x AS ({_scan_sql('ob', False, 0.3, 0.5, False)}), y AS ({_scan_sql('oa', True, 0.3, 0.5, False)})
        SELECT w.entity, x.closest_absent AS first_absent, x.furthest_persistent AS first_persistent, y.closest_absent AS last_absent, y.furthest_persistent AS last_persistent
        FROM w LEFT JOIN x USING (entity) LEFT JOIN y USING (entity)""",
    "vertex_change_state": f"""WITH {OBSERVATIONS}, {_WATCHED}, oa AS (SELECT o.* FROM o JOIN w USING (entity) WHERE t >= obs_last + {HOUR}), y AS ({_scan_sql('oa', True, 0.3, 0.5, False)})
        SELECT w.entity, CASE WHEN closest_absent IS NOT NULL THEN 'Absent' WHEN furthest_persistent IS NOT NULL THEN 'Persistent' ELSE 'Unobserved' END AS state FROM w LEFT JOIN y USING (entity)""",
    "verify_current": f"""WITH {OBSERVATIONS} SELECT entity, CASE WHEN bool_or(verdict = 'present') THEN 'support' ELSE 'contradict' END AS event FROM o
        WHERE t >= {EVENT_DAY} AND verdict <> 'inconclusive' GROUP BY entity""",
    "presence_estimate": f"""WITH {OBSERVATIONS}, {_STAMPS}, k AS (SELECT entity, {EVENT_DAY - DAY} AS f, {EVENT_DAY + DAY} AS l, CASE WHEN fa < {EVENT_DAY - DAY} THEN fa END AS fa, CASE WHEN fp < {EVENT_DAY - DAY} THEN fp END AS fp,
            CASE WHEN la > {EVENT_DAY + DAY} THEN la END AS la, CASE WHEN lp > {EVENT_DAY + DAY} THEN lp END AS lp FROM st),
        e AS (SELECT entity, fa, la, CASE WHEN fp IS NOT NULL AND (fa IS NULL OR fa < fp) THEN fp ELSE f END AS since, CASE WHEN lp IS NOT NULL AND (la IS NULL OR la > lp) THEN lp ELSE l END AS until FROM k)
        SELECT entity, CASE WHEN fa IS NOT NULL THEN fa + (since - fa) // 2 ELSE since END AS first,
               CASE WHEN la IS NOT NULL THEN until + (la - until) // 2 WHEN entity % 2 <> 0 THEN until END AS last FROM e""",
    "clamp_overestimation": f"WITH {STAYS} SELECT order_id, CASE WHEN entity % 3 > 0 THEN first ELSE {ORDER_DAY} END AS first, coalesce(last, {ORDER_DAY + DAY}) AS last FROM s",
    "move_decision": f"""WITH {OBSERVATIONS}, {_STAMPS}, g AS (SELECT *, -2.0 + CASE WHEN coalesce(la, fa) IS NOT NULL AND coalesce(lp, fp) IS NOT NULL THEN 3 * greatest(-2.0, least(2.0, (coalesce(la, fa)::DOUBLE - coalesce(lp, fp)) / 1e6 / 86400))
            WHEN coalesce(la, fa) IS NOT NULL THEN 4.0 WHEN coalesce(lp, fp) IS NOT NULL THEN -2.0 ELSE 0.0 END + CASE WHEN coalesce(la, 0) > coalesce(lp, 0) THEN 1.0 WHEN lp IS NOT NULL THEN -1.0 ELSE 0.0 END AS logit FROM st)
        SELECT entity, round({_P}, 6) AS move_probability, coalesce(la, 0) > coalesce(lp, 0) AS hard, {_P} >= 0.4 AS probability, {_P} > (1 - {_P}) * 0.7 AS expected_utility FROM g""",
    "pocd_posterior": f"""WITH {OBSERVATIONS}, d AS (SELECT event_id, (value % 1.0) - 0.5 AS d, CASE WHEN verdict = 'absent' THEN 0 ELSE 1 END AS s, verdict FROM o),
        k AS (SELECT *, CASE WHEN verdict = 'inconclusive' THEN 0.0 WHEN s = 0 THEN 1.0 WHEN abs(d) <= 0.1 THEN 1.0 WHEN abs(d) <= 0.2 THEN 0.5 ELSE 0.0 END AS k FROM d),
        m AS (SELECT event_id, d, 2.0 + k * s AS a, 1.0 + k * (1 - s) AS b, 1 / (1 / 0.04 + 1 / 0.01) AS g FROM k),
        r AS (SELECT *, g * d / 0.01 AS mi, exp(-d * d / 0.1) / sqrt(2 * pi() * 0.05) * a AS n, b / 2 AS f FROM m),
        q AS (SELECT *, n / (n + f) AS i, f / (n + f) AS u, a + b + 1 AS c FROM r),
        v AS (SELECT *, i * mi AS mu, (i * (a + 1) + u * a) / c AS me, (i * (a + 1) * (a + 2) + u * a * (a + 1)) / (c * (c + 1)) AS sq FROM q)
        SELECT event_id, round(mu, 6) AS mu, round(sqrt(greatest(1e-8, i * (g + mi * mi) + u * 0.04 - mu * mu)), 6) AS sigma,
               round(me * (me * (1 - me) / (sq - me * me) - 1), 6) AS alpha, round((1 - me) * (me * (1 - me) / (sq - me * me) - 1), 6) AS beta, round(i, 6) AS inlier_weight FROM v""",
    "memory_state": f"""WITH {OBSERVATIONS}, v AS (SELECT entity, count(*) FILTER (verdict = 'absent') AS absent, count(*) FILTER (verdict = 'present') AS present FROM o GROUP BY 1)
        SELECT entity, absent, present, CASE WHEN absent > 0 AND (2.0 + present) / (3.0 + present + 3 * absent) < 0.4 THEN 'absent' WHEN present > 0 THEN 'supported' ELSE 'unobserved' END AS state,
               3 * absent >= 1 AND 3 * absent > present AS culled, round(least(present / 40.0, 1.0)::DOUBLE, 6) AS confidence FROM v""",
    "session_windows": f"""WITH {OBSERVATIONS}, g AS (SELECT entity, t, t >= lag(t) OVER (PARTITION BY entity ORDER BY t) + {2 * HOUR} AS opens FROM o),
        i AS (SELECT entity, t, count(*) FILTER (opens) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT entity AS user_id, min(t) AS first, max(t) + {2 * HOUR} AS last_end, count(*) AS n FROM i GROUP BY entity, k""",
    "as_of_snapshot": f"""WITH {STAYS}, n AS (SELECT entity, max(first) AS first FROM s WHERE first <= {ORDER_DAY} GROUP BY 1)
        SELECT entity, first, max(order_id) AS order_id, bool_or(last IS NULL OR last > {ORDER_DAY}) AS open FROM s JOIN n USING (entity, first) GROUP BY 1, 2""",
    "snapshot_choice": f"""WITH m AS (SELECT DISTINCT epoch_us(date_trunc('month', o_orderdate)::TIMESTAMP) AS stamp FROM orders), t AS (SELECT {ORDER_DAY - 3000 * DAY} + i * {100 * DAY} AS t FROM range(0, 61) r(i))
        SELECT t, coalesce(min(stamp) FILTER (stamp >= t), max(stamp)) AS stamp FROM t CROSS JOIN m GROUP BY t""",
    "max_displacement": f"""WITH {OBSERVATIONS}, {_ONCE} SELECT entity, count(*) AS n, round(max(abs(value - f)), 6) AS displacement FROM (SELECT *, first_value(value) OVER (PARTITION BY entity ORDER BY t) AS f FROM u) GROUP BY entity""",
    "trajectory_merge": f"WITH {OBSERVATIONS} SELECT entity, t // {HOUR} AS hour, min(event_id) AS event_id FROM o GROUP BY 1, 2",
    "arc_length": f"""WITH {OBSERVATIONS}, {_ONCE} SELECT entity, round(sum(coalesce(d, 0)), 4) AS length, round(max(coalesce(d, 0)), 4) AS longest_step
        FROM (SELECT entity, abs(value - lag(value) OVER (PARTITION BY entity ORDER BY t)) AS d FROM u) GROUP BY entity""",
    "interpolate_dense": f"""WITH {OBSERVATIONS}, d AS (SELECT entity, t // {DAY} AS t, max(value) AS value FROM o GROUP BY 1, 2), l AS (SELECT *, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM d WINDOW w AS (PARTITION BY entity ORDER BY t)),
        e AS (SELECT *, unnest(range(t, coalesce(t2, t + 1))) AS s FROM l)
        SELECT entity, s AS t, round(CASE WHEN t2 IS NULL THEN value ELSE value + (v2 - value) * ((s - t)::DOUBLE / (t2 - t)) END, 6) AS value FROM e""",
    "throttled_output": f"""WITH RECURSIVE {OBSERVATIONS}, r AS (SELECT entity, min(t) AS t FROM o GROUP BY entity UNION ALL SELECT r.entity, (SELECT min(o.t) FROM o WHERE o.entity = r.entity AND o.t >= r.t + {3 * DAY}) AS t FROM r WHERE r.t IS NOT NULL)
        SELECT o.entity, o.t, o.event_id FROM o JOIN r ON o.entity = r.entity AND o.t = r.t""",
    "slice_4d": """WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS map_time, year(l_shipdate) * 12 + month(l_shipdate) AS query_time, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
        SELECT 'robot' AS slice, * FROM m WHERE map_time = (SELECT max(map_time) FROM m) UNION ALL SELECT 'query', * FROM m WHERE query_time = (SELECT min(query_time) FROM m)
        UNION ALL SELECT 'online', * FROM m WHERE map_time = query_time""",
    "gt_consolidate": f"""WITH {STAYS} SELECT c_custkey AS entity, count(DISTINCT first) AS n_appearances, count(DISTINCT last) AS n_disappearances, min(first) AS first, max(last) AS last
        FROM customer LEFT JOIN s ON s.entity = c_custkey AND s.entity % 5 > 0 GROUP BY 1""",
    "strictly_increasing": f"WITH {OBSERVATIONS} SELECT entity, count(*) AS n FROM (SELECT *, lag(t) OVER (PARTITION BY entity ORDER BY event_id) AS b FROM o) WHERE t <= b GROUP BY entity",
    "quality_gates": """WITH f AS (SELECT count(*) AS n, count(*) FILTER (NOT l_quantity > 0) AS a, count(*) FILTER (NOT l_discount < 0.05) AS b, count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) AS c, count(*) FILTER (l_shipdate < DATE '1993-01-01') AS d FROM lineitem)
        SELECT rule, 'hard' AS severity, n, failed, failed = 0 AS passed FROM (SELECT 'quantity is positive' AS rule, n, a AS failed FROM f UNION ALL SELECT 'discount is below 5 %', n, b FROM f UNION ALL SELECT 'flag is known', n, c FROM f UNION ALL SELECT 'ships after 1993', n, d FROM f)""",
    "catalog_override": "SELECT CASE WHEN c_nationkey = 0 THEN -1 ELSE n_regionkey END AS region_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "missing_entities": """SELECT c_custkey AS entity, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
        UNION ALL SELECT DISTINCT user_id, 'unexpected' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""",
    "object_state_fold": f"""WITH RECURSIVE {OBSERVATIONS}, u AS (SELECT entity, t, min(value) AS value, row_number() OVER (PARTITION BY entity ORDER BY t) AS k FROM o GROUP BY 1, 2),
        f AS (SELECT entity, k, t, 0::BIGINT AS fragment, value AS anchor FROM u WHERE k = 1 UNION ALL
              SELECT u.entity, u.k, u.t, CASE WHEN abs(u.value - f.anchor) > 60 THEN f.fragment + 1 ELSE f.fragment END, CASE WHEN abs(u.value - f.anchor) > 60 THEN u.value ELSE f.anchor END FROM f JOIN u ON u.entity = f.entity AND u.k = f.k + 1),
        g AS (SELECT entity, fragment, min(t) AS birth, max(t) AS last_support, count(*) AS n FROM f GROUP BY 1, 2), d AS (SELECT *, lead(birth) OVER (PARTITION BY entity ORDER BY fragment) AS death FROM g)
        SELECT entity, fragment, birth, last_support, death, n, CASE WHEN death IS NULL THEN 'current' ELSE 'closed' END AS status FROM d""",
    "segment_owner": f"""WITH {OBSERVATIONS}, d AS (SELECT entity, t // {7 * DAY} AS week, count(*) AS support, bool_or(value > 190) AS moved FROM o GROUP BY 1, 2)
        SELECT entity, week, support, moved FROM d QUALIFY row_number() OVER (PARTITION BY entity ORDER BY moved DESC, CASE WHEN moved THEN 0 ELSE support END DESC, week DESC) = 1""",
    "compare_runs": """WITH m AS (SELECT a.d AS a, b.d AS b FROM (SELECT p_partkey AS k, p_retailprice AS d FROM part WHERE p_partkey % 5 > 0) a FULL JOIN (SELECT p_partkey AS k, p_retailprice + p_size - 25 AS d FROM part WHERE p_partkey % 7 > 0) b USING (k))
        SELECT threshold, count(*) AS n, count(b - a) AS both, count(*) FILTER (a IS NULL) AS appeared, count(*) FILTER (b IS NULL) AS disappeared, count(*) FILTER (abs(b - a) > threshold) AS changed,
               count(*) FILTER (b - a < -threshold) AS closer, count(*) FILTER (b - a > threshold) AS farther FROM m CROSS JOIN (SELECT unnest([5.0, 15.0])::DOUBLE AS threshold) GROUP BY threshold""",
}

"""Registered queries on small tables against brute force: no row is left out by its id."""

import datetime
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import freespace
from palimpsest.plans import entity_queries, space_queries, stream_queries
from palimpsest.plans.inputs import HOUR
from palimpsest.plans.presence_queries import DAY, ORDER_DAY
from palimpsest.streaming import activity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with events and embeddings, and their rows."""
    r = random.Random(3)
    base = str(tmp_path_factory.mktemp("tables"))
    start = datetime.datetime(2024, 1, 1)
    kinds = ("view", "click", "error", "scroll")
    events = [(k, start + datetime.timedelta(seconds=r.randrange(20 * 86400)), r.randrange(4), r.choice(kinds), r.random()) for k in range(101)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{base}/events.parquet")
    cloud = [(k, [round(r.uniform(-0.4, 0.4), 3) for _ in range(3)], r.randrange(3)) for k in range(90)]
    spark.createDataFrame(cloud, "vec_id long, embedding array<double>, label int").write.parquet(f"{base}/embeddings.parquet")
    return base, events, cloud


def stamp(ts):
    return round((ts - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))


def test_every_event_has_a_window(spark, tables):
    base, events, _ = tables
    seen = {(e[2], stamp(e[1])) for e in events if e[3] in ("view", "click")}
    want = {e[0]: sorted(t for u, t in seen if u == e[2] and stamp(e[1]) - 48 * HOUR <= t <= stamp(e[1]) + 24 * HOUR) for e in events}
    want = {k: v for k, v in want.items() if v}
    assert any(k % 10 for k in want)

    def got(name):
        return sorted(map(tuple, space_queries.QUERIES[f"ray_policy_{name}"](spark, base).collect()))

    mid = {e[0]: 2 * stamp(e[1]) - 24 * HOUR for e in events}
    assert got("all") == sorted((k, t) for k, v in want.items() for t in v)
    assert got("first") == sorted((k, v[0]) for k, v in want.items())
    assert got("last") == sorted((k, v[-1]) for k, v in want.items())
    assert got("first_and_last") == sorted({(k, t) for k, v in want.items() for t in (v[0], v[-1])})
    assert got("middle") == sorted((k, min(v, key=lambda t: (abs(2 * t - mid[k]), t))) for k, v in want.items())


def box(cloud, label, session):
    own = [p for k, p, at in cloud if at == label and k % 2 == session]
    return [(min(c), max(c)) for c in zip(*own, strict=True)]


def test_boxes_hold_all_points_of_a_label(spark, tables):
    base, _, cloud = tables
    boxes = {k: box(cloud, k, 0) for k in range(3)}
    want = {}
    for k, b in boxes.items():
        met = [at for _, p, at in cloud if all(lo - 0.02 <= c <= hi + 0.02 for c, (lo, hi) in zip(p, b, strict=True))]
        want[k] = (len(met), met.count(k))
    assert {x.box: (x.inside, x.own) for x in space_queries.points_in_box_audit(spark, base).collect()} == want

    def volume(b):
        return b[0] * b[1] * b[2]

    pairs = {}
    for j, a in boxes.items():
        for k in range(3):
            b = box(cloud, k, 1)
            both = volume([max(min(s[1], t[1]) - max(s[0], t[0]), 0) for s, t in zip(a, b, strict=True)])
            pairs[j, k] = both / (volume([h - lo for lo, h in a]) + volume([h - lo for lo, h in b]) - both)
    got = {(x.label, x.right_label): x.iou for x in space_queries.aabb_iou_pairs(spark, base).collect()}
    assert got == pytest.approx({k: v for k, v in pairs.items() if v >= 0.1}, abs=1e-6)


@pytest.fixture(scope="module", params=[30, 700])
def shop(spark, tables, tmp_path_factory, request):
    """A folder with orders (fewer than points, or more), lineitem and embeddings; each order's entity, first and last."""
    r = random.Random(4)
    base = str(tmp_path_factory.mktemp("shop"))
    start = datetime.datetime(1994, 3, 1)
    orders = [(k, r.randrange(25), start + datetime.timedelta(days=r.randrange(9 * 365))) for k in range(request.param)]
    lines = [(k, day + datetime.timedelta(days=r.randrange(900))) for k, _, day in orders if k % 3]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{base}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_shipdate timestamp_ntz").write.parquet(f"{base}/lineitem.parquet")
    spark.read.parquet(f"{tables[0]}/embeddings.parquet").write.parquet(f"{base}/embeddings.parquet")
    ends = dict(lines)
    return base, [(k, c, stamp(day), stamp(ends[k]) if k in ends else None) for k, c, day in orders], tables[2]


def present(stays, t):
    return [s for s in stays if s[2] <= t and (s[3] is None or s[3] > t)]


def test_all_entities_at_all_years(spark, shop):
    base, stays, _ = shop
    low, high = min(s[2] for s in stays), max(s[3] or s[2] for s in stays)
    times = [t for t in (ORDER_DAY + k * 365 * DAY for k in range(-30, 30)) if low <= t <= high]
    assert len(times) > 5
    want = {}
    for t in times:
        for s in present(stays, t):
            want[s[1], t] = want.get((s[1], t), 0) + 1
    assert {(x.entity, x.t): x.n for x in entity_queries.evaluate_all(spark, base).collect()} == want


def test_all_orders_are_composed(spark, shop):
    base, stays, cloud = shop
    ids = [k for k, *_ in cloud if k % 2]
    n = min(len(ids), len(stays))
    here = [s[0] for s in present(stays, ORDER_DAY)]
    want = [(k, None) for k, *_ in cloud if k % 2 == 0] + [(v, o) for v in ids for o in here if v // 2 % n == o % n]
    assert {o for _, o in want if o is not None} == set(here)
    got = [tuple(x) for x in entity_queries.compose_scene(spark, base).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_free_space_counts_every_cell_crossed(spark):
    r = random.Random(6)
    rays = [(k, *(r.uniform(-1, 1) for _ in range(6))) for k in range(30)] + [(30, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05), (31, 0.95, 0.05, 0.05, -0.95, 0.05, 0.05)]
    frame = spark.createDataFrame(rays, "ray long, sx double, sy double, sz double, tx double, ty double, tz double")

    def crossed(ray, size, short):
        """Cells whose box the segment enters, by slabs."""
        s, t = ray[1:4], ray[4:7]
        length = math.dist(s, t)
        if length <= short:
            return set()
        end = [a + (b - a) * (length - short) / length for a, b in zip(s, t, strict=True)]
        spans = [range(math.floor(min(a, b) / size), math.floor(max(a, b) / size) + 1) for a, b in zip(s, end, strict=True)]
        found = set()
        for cell in ((i, j, k) for i in spans[0] for j in spans[1] for k in spans[2]):
            low, high = 0.0, 1.0
            for a, b, c in zip(s, end, cell, strict=True):
                if a == b:
                    if not c * size <= a < (c + 1) * size:
                        low, high = 1.0, 0.0
                else:
                    u, v = sorted(((c * size - a) / (b - a), ((c + 1) * size - a) / (b - a)))
                    low, high = max(low, u), min(high, v)
            if high - low > 1e-9:
                found.add(cell)
        return found

    want = Counter(c for ray in rays for c in crossed(ray, 0.15, 0.05))
    got = freespace.free_counts(frame, ray_id="ray", size=0.15, short=0.05)
    assert Counter(x.n for x in got.collect()) == Counter(want.values())
    coarse = freespace.free_counts(frame, ray_id="ray", size=0.15, short=0.05, step=0.15)
    assert coarse.join(got.withColumnRenamed("n", "m"), "cell").where("n > m").count() == 0
    assert coarse.count() < got.count()


def test_sessions_do_not_depend_on_the_files(spark, tables, tmp_path):
    """Twelve files in shuffled order, the newest among the first: three triggers of four would drop rows."""
    events = sorted(tables[1], key=lambda e: e[1])
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    for k in (11, 7, 4, 9, 2, 10, 6, 8, 0, 3, 5, 1):
        part = spark.createDataFrame(events[k * 9 : (k + 1) * 9], schema).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(0.05)
    batch = spark.read.parquet(f"{tmp_path}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    whole = activity.sessions(batch, "user_id", "ts", "2 hours").select("user_id", F.unix_micros("first"), F.unix_micros("last_end"), "n")
    want = sorted(tuple(x) for x in whole.collect() if x[2] <= stamp(events[-1][1]))
    assert sorted(map(tuple, stream_queries.stream_tracker_activity(spark, str(tmp_path)).collect())) == want

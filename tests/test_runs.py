import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evidence, rays
from palimpsest.operators.evidence import Scan
from palimpsest.streaming.incremental import ChangeState
from palimpsest.streaming.ray_index import RayIndex
from palimpsest.streaming.runs import Run, Runs, buckets_of

TOLERANCE = {"block": 0.25, "radial": 0.06, "depth": 0.05}
POINTS, RAYS = "vid long, x double, y double, z double", "ray long, ts long, sx double, sy double, sz double, tx double, ty double, tz double"


def _index(folder, **more):
    return RayIndex(folder, point_id="vid", ray_id="ray", **TOLERANCE, **more)


def _scene(r, ids, at=0.0):
    pts = [(k, at + r.uniform(0.1, 1), r.uniform(-0.2, 0.2), r.uniform(-0.2, 0.2)) for k in ids]
    shots = [(k, 10 * k, at, 0.0, 0.0, at + r.uniform(0.3, 1.5), r.uniform(-0.3, 0.3), r.uniform(-0.3, 0.3)) for k in ids]
    return pts, shots


def _set(df):
    rows = [tuple(x) for x in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_ray_epochs_equal_a_fresh_run(spark, tmp_path):
    r, folder = random.Random(4), f"file://{tmp_path}/rays"
    pts, shots = [], []
    given = set()
    for epoch in range(5):
        p, s = _scene(r, range(epoch * 25, epoch * 25 + 25))
        if epoch == 1:
            p = []  # rays alone
        if epoch == 2:
            s = []  # points alone meet the rays before them
        if epoch == 3:
            p, s = [*p, (900, None, 0.0, 0.0)], [*s, (901, 1, 0.0, 0.0, 0.0, None, 0.0, 0.0)]
        pts, shots = pts + p, shots + s
        # another process each time
        own = _set(_index(folder, fan=2, buckets=8).update(spark, epoch, spark.createDataFrame(p, POINTS), spark.createDataFrame(s, RAYS)).select("vid", "ray", "ts", "verdict"))
        assert not own & given
        given |= own
        fresh = rays.verify(spark.createDataFrame(pts, POINTS), spark.createDataFrame(shots, RAYS), point_id="vid", ray_id="ray", **TOLERANCE)
        assert given == _set(fresh)
    assert {v[3] for v in given} == {"present", "absent", "occluded"}
    index = _index(folder, fan=2)
    assert [(x.low, x.high) for x in index.runs.live(spark)] == [(0, 3), (4, 4)]  # pairs, then pairs of pairs
    again = index.update(spark, 4, spark.createDataFrame(pts, POINTS), spark.createDataFrame(shots, RAYS))  # a replay
    assert _set(again.select("vid", "ray", "ts", "verdict")) == own and _set(index.evidence(spark).drop("epoch").select("vid", "ray", "ts", "verdict")) == given


def test_an_epoch_reads_the_regions_it_touches(spark, tmp_path, monkeypatch):
    r, index = random.Random(8), _index(f"file://{tmp_path}/rays", buckets=1024)
    read, whole = [], Runs.read

    def noted(self, spark, table, buckets=None, **k):
        rows = whole(self, spark, table, buckets, **k)
        if buckets is not None and rows is not None:
            read.append((table, rows.count(), whole(self, spark, table).count()))
            scan = rows._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [bucket" in scan or "PartitionFilters: [isnotnull(bucket" in scan
        return rows

    monkeypatch.setattr(Runs, "read", noted)
    for epoch, at in enumerate((0.0, 40.0, 80.0, 120.0)):  # places far apart
        p, s = _scene(r, range(epoch * 20, epoch * 20 + 20), at)
        index.update(spark, epoch, spark.createDataFrame(p, POINTS), spark.createDataFrame(s, RAYS))
    assert len(read) == 6 and all(n < of / 4 for _, n, of in read)
    p, s = _scene(r, range(200, 210), 40.0)
    index.update(spark, 4, spark.createDataFrame(p, POINTS), spark.createDataFrame(s, RAYS))
    assert all(0 < n < of / 2 for _, n, of in read[6:])


def test_empty_epochs(spark, tmp_path):
    index = _index(f"file://{tmp_path}/rays", fan=2, buckets=4)
    none = spark.createDataFrame([], POINTS), spark.createDataFrame([], RAYS)
    assert index.update(spark, 0, *none).collect() == [] and index.update(spark, 1, *none).collect() == []
    p, s = _scene(random.Random(1), range(30))
    got = index.update(spark, 2, spark.createDataFrame(p, POINTS), spark.createDataFrame(s, RAYS))
    assert got.count() == rays.verify(spark.createDataFrame(p, POINTS), spark.createDataFrame(s, RAYS), point_id="vid", ray_id="ray", **TOLERANCE).count() > 0


def test_runs_merge_by_classes_and_survive_crashes(spark, tmp_path):
    runs = Runs(f"file://{tmp_path}/t", fan=3)
    frame = lambda k: spark.range(k * 10, k * 10 + 10).select("id", (F.col("id") % 4).cast("int").alias("bucket"))
    assert runs.read(spark, "t") is None and runs.newest(spark) == -1
    before = None
    for k in range(10):
        stage = runs.stage(spark, Run(k, k, 1))
        stage.write("t", frame(k))
        if k == 5:
            runs.stage(spark, Run(k, k, 1)).write("t", frame(k))  # cut off before its commit
        stage.commit()
        if k == 2:
            before = runs.read(spark, "t")
        assert runs.compact(spark, {"t": lambda rows: rows}) == (2 if k == 8 else int(k % 3 == 2))
        if k == 2:
            assert before.count() == 30  # what it reads is merged, and still there
    assert [tuple(x) for x in runs.live(spark)] == [(0, 8, 9), (9, 9, 1)]
    assert sorted(x.id for x in runs.read(spark, "t").collect()) == list(range(100))
    assert {x.id % 4 for x in runs.read(spark, "t", [1, 3]).collect()} == {1, 3} and runs.read(spark, "t", []).count() == 0
    assert sorted(x.id for x in runs.read(spark, "t", since=9).collect()) == list(range(90, 100))
    assert sorted(buckets_of(runs.read(spark, "t"), 4)) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        Runs("x", 1)


def test_change_states_are_compacted(spark, tmp_path):
    rule, folder = Scan(20, 2, 0.4, 0.5), f"file://{tmp_path}/changes"
    r = random.Random(6)
    data = [(r.randint(0, 5), r.randint(0, 300), r.choice(["present", "absent"])) for _ in range(120)]
    frame = lambda rows: spark.createDataFrame(rows, "k long, t long, v string")
    for epoch in range(6):
        state = ChangeState(["k"], "t", "v", rule, folder, buckets=4, fan=3)
        state.update(frame(data[epoch * 20 : epoch * 20 + 20]), epoch)
        assert _set(state.result) == _set(evidence.scan(frame(data[: epoch * 20 + 20]), ["k"], "t", "v", rule))
    assert [(x.low, x.high) for x in state.runs.live(spark)] == [(0, 2), (3, 5)]
    merged = state.runs.read(spark, "results", since=3)
    assert merged.count() == merged.select("k").distinct().count() == 6
    counts = state.runs.read(spark, "counts", since=3)
    assert counts.count() == counts.select("k", "bin").distinct().count()

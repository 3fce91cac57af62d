"""Robust centres, filled planes and smoothed paths against loops over small tables; commits of several tables and crashes between them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import footprint, kmeans, trajectory
from palimpsest.plans.state_store import StateStore
from palimpsest.sources import sinks
from palimpsest.sources.commits import Commits, Locked, Rejected

POINT = "vid long, label int, x double, y double, z double"


def _clouds(seed, n=40):
    r = random.Random(seed)
    out = []
    for label in (1, 2):
        for k in range(n):
            c = r.choice([(0, 0, 0), (9, 1, 0), (4, 8, 2)])
            far = 60.0 if k % 17 == 0 else 0.0  # outliers pull means, not medians
            out.append((len(out), label, *[v + r.gauss(0, 0.5) + far for v in c]))
    return out


def _by_hand(points, centres, iterations, refinements=3):
    p, c = np.array(points), np.array(centres, float)
    near = lambda: np.array([min(range(len(c)), key=lambda k: (((q - c[k]) ** 2).sum(), k)) for q in p])
    for step in range(iterations + refinements):
        own, f = near(), np.mean if step < iterations else np.median
        new = np.array([f(p[own == k], axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c = new
    return c


@pytest.mark.parametrize("iterations", [0, 2, 60])
def test_centres_equal_a_loop_from_the_same_first(spark, iterations):
    rows = _clouds(3)
    first = [(lb, k, *rows[[i for i, r in enumerate(rows) if r[1] == lb][k]][2:]) for lb in (1, 2) for k in range(3)] + [(1, 3, 500.0, 500.0, 500.0)]  # nothing is near
    df = spark.createDataFrame([*rows, (999, 1, None, 0.0, 0.0)], POINT)
    got = kmeans.robust_kmeans(df, 3, "label", first=spark.createDataFrame(first, "label int, cluster long, x double, y double, z double"), iterations=iterations)
    found = {(r.label, r.cluster): (r.x, r.y, r.z) for r in got.collect()}
    for lb in (1, 2):
        want = _by_hand([r[2:] for r in rows if r[1] == lb], [f[2:] for f in first if f[0] == lb], iterations)
        assert np.allclose([found[lb, k] for k in range(len(want))], want)


def test_seeds_are_far_apart_and_do_not_depend_on_partitions(spark):
    rows = [(k, 1, float(k % 4 * 100), 0.0, 0.0) for k in range(80)] + [(100 + k, 2, 5.0, 5.0, 5.0) for k in range(4)]
    a, b = (sorted(tuple(r) for r in kmeans.seeded(spark.createDataFrame(rows, POINT).repartition(n), 4, "label").collect()) for n in (1, 7))
    assert a == b and {r[2] for r in a if r[0] == 1} == {0.0, 100.0, 200.0, 300.0}
    assert sum(r[0] == 2 for r in a) == 1  # a single place
    three = {(round(r.x), round(r.y)) for r in kmeans.robust_kmeans(spark.createDataFrame(_clouds(5, 120), POINT).where("x < 30"), 3, "label").where("label = 1").collect()}
    assert three == {(0, 0), (9, 1), (4, 8)}
    with pytest.raises(ValueError, match="2 has 4"):
        kmeans.robust_kmeans(spark.createDataFrame(rows, POINT), 5, "label")
    assert kmeans.robust_kmeans(spark.createDataFrame([], POINT), 3, "label").count() == 0


def _fill_by_hand(support, existing, z, size):
    up = lambda v: math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)
    cells = {(up(x / size), up(y / size)) for x, y in support}
    xs, ys = {i for i, _ in cells}, {j for _, j in cells}
    if len(range(min(xs), max(xs))) < 1 or len(range(min(ys), max(ys))) < 1:
        return {}
    free = set()
    for i in range(min(xs), max(xs) + 1):
        for j in range(min(ys), max(ys) + 1):
            row, column = [a for a, b in cells if b == j], [b for a, b in cells if a == i]
            if row and column and min(row) <= i <= max(row) and min(column) <= j <= max(column):
                if all((i * size - x) ** 2 + (j * size - y) ** 2 + (z - w) ** 2 > size * size for x, y, w in existing):
                    free.add((i, j))
    return {(i, j): 2 * all((i + a, j + b) in free for a, b in ((1, 0), (0, 1), (1, 1))) for i, j in free}


def test_planes_are_filled_between_their_support(spark):
    r = random.Random(6)
    support = [(p, r.uniform(-3, 3), r.uniform(-2, 4)) for p in (1, 2) for _ in range(80)] + [(3, k * 0.5, 1.0) for k in range(6)]  # 3: one row
    existing = [(k, r.uniform(-3, 3), r.uniform(-2, 4), r.choice([0.0, 0.3, 5.0])) for k in range(5)] + [(99, None, 0.0, 0.0)]
    got = footprint.footprint(spark.createDataFrame([*support, (1, None, 2.0)], "plane int, x double, y double"), spark.createDataFrame(existing, "vid long, x double, y double, z double"), spark.createDataFrame([(1, 0.0), (2, 0.25), (3, 0.0)], "plane int, z double"), 0.5)
    rows = got.collect()
    for p, z in ((1, 0.0), (2, 0.25), (3, 0.0)):
        want = _fill_by_hand([s[1:] for s in support if s[0] == p], [e[1:] for e in existing if e[1] is not None], z, 0.5)
        assert {(q.ix, q.iy): q.faces for q in rows if q.plane == p} == want
    assert sum(q.faces for q in rows) > 20 and not [q for q in rows if q.plane == 3]


@pytest.mark.parametrize("closed", [False, True])
def test_corners_are_cut(spark, closed):
    r = random.Random(7)
    paths = {1: [(r.random(), r.random()) for _ in range(9)], 2: [(0.0, 0.0), (4.0, 8.0)], 3: [(1.0, 2.0)]}
    df = spark.createDataFrame([(k, t, *p) for k, path in paths.items() for t, p in enumerate(path)], "k long, t long, x double, y double")
    got = {}
    for q in trajectory.cut_corners(df, "k", ["t"], ["x", "y"], 3, closed=closed).orderBy("k", "place").collect():
        got.setdefault(q.k, []).append((q.place, q.x, q.y))
    for k, path in paths.items():
        now = np.array(path)
        for _ in range(3):
            ahead = np.roll(now, -1, axis=0) if closed else now[1:]
            pairs = [w * a + (1 - w) * b for a, b in zip(now, ahead, strict=False) for w in (0.75, 0.25)]
            now = np.array(pairs if closed else [now[0], *pairs, now[-1]])
        assert [p for p, *_ in got[k]] == list(range(len(now)))
        assert np.allclose([p[1:] for p in got[k]], now)


def test_views(spark):
    path = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 1.0, 1.0), (2, 0, 5.0, 5.0)], "k long, t long, x double, y double")
    yaw = {(r.k, r.t): r.yaw for r in trajectory.tangent_yaw(path, "k", "t").collect()}
    assert yaw[1, 0] == 0 and yaw[1, 1] == pytest.approx(math.pi / 4) and yaw[1, 2] == pytest.approx(math.pi / 2) and yaw[2, 0] == 0
    one = spark.range(1).select(*[c.alias(n) for n, c in zip("yp", trajectory.look_at([F.lit(1.0), F.lit(1.0), F.lit(0.0)], [F.lit(1.0), F.lit(3.0), F.lit(2.0)]), strict=True)], trajectory.look_at([F.lit(0.0)] * 3, [F.lit(0.0)] * 3)[0].alias("same")).first()
    assert (one.y, one.p, one.same) == (pytest.approx(math.pi / 2), pytest.approx(math.pi / 4), None)


def _commit(store, n, **k):
    a = store.spark.range(n).withColumnRenamed("id", "a")
    return store.commit({"one": a, "two": a.select((F.col("a") * 2).alias("b"))}, {"one": ["a"], "two": ["b"]}, owner="me", **k)


def test_tables_are_committed_together(spark, tmp_path, monkeypatch):
    store = Commits(spark, f"file://{tmp_path}/c")
    assert store.head() == 0
    assert (_commit(store, 3), _commit(store, 5)) == (1, 2)
    assert (store.read("two").count(), store.read("two", 1).count(), store.manifest()["parent"]) == (5, 3, 1)
    assert store.faults(1) == store.faults() == []
    gates = spark.createDataFrame([("ids are there", "hard", False), ("many", "soft", False)], "rule string, severity string, passed boolean")
    with pytest.raises(Rejected, match="ids are there"):
        _commit(store, 9, gates=gates, notes={"run": 7})
    (told,) = store.rejected()
    assert told["broken"] == ["ids are there"] and told["notes"] == {"run": 7} and told["parent"] == 2 and store.head() == 2
    calls = []

    def dies(df, keys):
        calls.append(1)
        if len(calls) == 2:  # between the tables
            raise RuntimeError("lost")
        return sinks.manifest(df, keys)

    monkeypatch.setattr("palimpsest.sources.commits.manifest", dies)
    with pytest.raises(RuntimeError, match="lost"):
        _commit(store, 9)
    monkeypatch.undo()
    assert store.head() == 2 and store.read("one").count() == 5
    assert _commit(store, 7) == 3 and store.history().count() == 6


def test_one_owner_commits_at_a_time(spark, tmp_path):
    store = Commits(spark, f"file://{tmp_path}/c")
    store.lock("another")
    with pytest.raises(Locked, match="another"):
        _commit(store, 3)
    store.unlock("me")  # not mine to give back
    with pytest.raises(Locked):
        _commit(store, 3)
    store.unlock("another")
    assert _commit(store, 3) == 1


def test_rows_that_were_changed_are_told(spark, tmp_path):
    store = Commits(spark, f"file://{tmp_path}/c")
    _commit(store, 3)
    spark.range(4).withColumnRenamed("id", "a").write.mode("overwrite").parquet(f"{tmp_path}/c/{store.manifest()['tables']['one']['path']}")
    assert store.faults() == ["one"]


def _snapshot(spark, n):
    v = spark.createDataFrame([(k, k) for k in range(n)], "vid long, first_seen long")
    return v, spark.createDataFrame([(k, k, k, None) for k in range(n)], "node long, effective long, first long, last long")


def test_a_snapshot_appears_whole_and_can_be_written_again(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    store = StateStore(spark, f"file://{tmp_path}/s")
    store.append(10, *_snapshot(spark, 2))
    real, calls = DataFrameWriter.parquet, []

    def dies(self, path, *a, **k):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(RuntimeError):
        store.append(20, *_snapshot(spark, 5))
    monkeypatch.undo()
    assert store.stamps == [10] and store.mesh_at(99).count() == 2
    old = store.mesh_at(9)
    store.append(10, *_snapshot(spark, 4))
    assert store.stamps == [10] and store.mesh_at(9).count() == 4
    assert old.count() == 2  # a reader of the former one still has it


def test_two_timelines_are_composed(spark, tmp_path):
    a, b = (StateStore(spark, f"file://{tmp_path}/{n}") for n in "ab")
    for store, stamps in ((a, (10, 20)), (b, (30, 40))):
        for t in stamps:
            store.append(t, *_snapshot(spark, t // 10))
    a.extend(b)
    assert a.stamps == [10, 20, 30, 40] and [a.mesh_at(t).count() for t in (15, 25, 40)] == [2, 3, 4]
    with pytest.raises(ValueError, match="begins"):
        a.extend(b)

"""Object states, tracks, saved states and as-of joins against literal scenarios and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import association, clusters, gridjoin, objects, rays, surfaces, tracks, voxels
from palimpsest.operators.components import connected_components
from palimpsest.operators.evidence import Scan
from palimpsest.plans import scratch
from palimpsest.plans.state_store import StateStore
from palimpsest.sources import tables
from palimpsest.streaming import incremental

SEE, OK, NO = objects.OBSERVED, objects.SUPPORTED, objects.CONTRADICTED


def told(*events):
    """States after events (kind, first, last, cells, moved), which come in order: closed ones, the current one, candidates."""
    now, closed = None, []
    for kind, first, last, cells, moved in events:
        now, out = objects.state_step(now, kind, first, last, cells, moved)
        closed += out
    current = (now["birth"], now["last"], sorted(now["cells"])) if now["current"] else None
    return [c[1:4] for c in closed], current, [(c["birth"], c["last"], sorted(c["cells"])) for c in now["open"]]


def see(first, cells, last=None, moved=False):
    return (SEE, first, first if last is None else last, cells, moved)


def test_a_disjoint_view_is_unresolved():
    assert told(see(1, [1, 2]), see(5, [9])) == ([], (1, 1, [1, 2]), [(5, 5, [9])])


def test_a_bridge_absorbs_candidates_to_a_fixed_point():
    got = told(see(1, [1]), see(5, [4, 5]), see(6, [3, 4]), see(7, [7]), see(8, [1, 3]))
    assert got == ([], (1, 8, [1, 3, 4, 5]), [(7, 7, [7])])


def test_a_contradiction_promotes_the_newest_candidate():
    got = told(see(1, [1]), see(5, [5]), see(8, [8]), (NO, 9, 9, None, False))
    assert got == ([(1, 1, 9)], (8, 8, [8]), [(5, 5, [5])])
    assert told(see(1, [1]), (NO, 4, 4, None, False)) == ([(1, 1, 4)], None, [])
    assert told(see(1, [1], last=9), (NO, 4, 4, None, False))[0] == [(1, 9, 9)]  # never dead before its last support


def test_support_takes_up_what_was_seen_by_then():
    got = told(see(1, [1]), see(5, [5]), see(9, [9]), (OK, 6, 6, None, False))
    assert got == ([], (1, 6, [1, 5]), [(9, 9, [9])])
    assert told(see(1, [1]), (OK, 6, 6, None, False), see(5, [5])) == ([], (1, 6, [1, 5]), [])  # in either order


def test_motion_closes_and_begins():
    assert told(see(1, [1]), see(5, [5], moved=True)) == ([(1, 1, 5)], (5, 5, [5]), [])


def test_an_interval_counts_once():
    assert told(see(1, [1]), see(1, [2]), see(3, [])) == ([], (1, 1, [1]), [])
    once = told(see(1, [1]), see(2, [1, 2]))
    assert told(see(1, [1]), see(2, [1, 2]), see(1, [1]), see(2, [1, 2])) == once


def test_states_of_a_table(spark):
    rows = [("a", SEE, 1, 1, 1, [1], False), ("a", SEE, 5, 5, 2, [5], False), ("a", NO, 9, 9, 3, None, None), ("b", OK, 3, 3, 4, None, None), (None, SEE, 2, 2, 5, [1], False)]
    df = spark.createDataFrame(rows, "k string, kind string, first long, last long, order long, cells array<long>, moved boolean")
    got = {tuple(x) for x in objects.persistent_states(df, "k").collect()}
    assert got == {("a", 0, 1, 1, 9, 1, "closed"), ("a", 1, 5, 5, None, 1, "current"), (None, 0, 2, 2, None, 1, "current")}
    assert objects.persistent_states(df.limit(0), "k").collect() == []
    seeds = objects.session_seeds(objects.persistent_states(df, "k"), "k").where("k = 'a'").collect()
    assert [(x.node, x.kind, x.first, x.last) for x in seeds] == [("Ma", objects.SEED, 5, 5)]


def test_chains_end_above_their_start(spark):
    m = spark.createDataFrame([(1, 5), (5, 3), (3, 9), (2, 3), (7, 7)], "from_node long, to_node long")
    assert {tuple(x) for x in objects.merged_into(m).collect()} == {(1, 9), (5, 9), (3, 9), (2, 9), (9, 9)}
    long = spark.createDataFrame([(k, k + 1) for k in range(300)], "from_node long, to_node long")
    assert {x.final for x in objects.merged_into(long).collect()} == {300}
    with pytest.raises(RuntimeError):
        objects.merged_into(spark.createDataFrame([(1, 2), (2, 1)], "from_node long, to_node long"), rounds=4)


def test_geometry_holder_follows_the_rules(spark):
    def holder(*segments):
        rows = [("k", n, n, x, x + 1.0, m, s, p) for n, (x, m, s, p) in enumerate(segments)]
        df = spark.createDataFrame(rows, "k string, node long, first long, x0 double, x1 double, moved boolean, support int, size int")
        got = objects.geometry_holder(df, "k", "node", ["first"], x0=["x0"], x1=["x1"], motion="moved", support="support", size="size", move=1.5).collect()
        return [x.node for x in got]

    assert holder((0.0, False, 5, 9), (0.1, False, 3, 9)) == [0]  # a weaker view of the same place
    assert holder((0.0, False, 5, 9), (0.1, False, 5, 9)) == [1]  # no weaker
    assert holder((0.0, False, 5, 9), (0.1, True, 1, 9)) == [1]  # it moved
    assert holder((0.0, False, 5, 9), (2.0, False, 1, 9)) == [1]  # elsewhere
    assert holder((0.0, False, 5, 9), (1.2, False, 1, 9)) == [0]  # apart, not far
    assert holder((0.0, False, 5, 9), (2.0, True, 9, 0)) == [0]  # a trajectory owns no surface
    assert holder((0.0, False, 5, 0)) == []


@pytest.mark.parametrize("rows", [3, 10_000])
def test_as_of_equals_brute_force(spark, rows):
    r = random.Random(4)
    left = [(k, r.choice("ab"), r.randint(0, 400)) for k in range(150)]
    right = sorted({(r.choice("abc"), r.randint(50, 350)) for _ in range(60)})
    a, b = spark.createDataFrame(left, "id long, g string, t long"), spark.createDataFrame([(g, t, t * 2) for g, t in right], "g string, s long, v long")
    for forward in (False, True):
        got = {x.id: x.v for x in rays.as_of(a, b, by=["g"], at="t", ts="s", value="v", forward=forward, rows=rows).collect()}
        pick = (lambda ts, t: min((s for s in ts if s >= t), default=None)) if forward else (lambda ts, t: max((s for s in ts if s <= t), default=None))
        want = {k: pick([s for h, s in right if h == g], t) for k, g, t in left}
        assert got == {k: v and v * 2 for k, v in want.items()}
    assert rays.as_of(a, b.limit(0), by=["g"], at="t", ts="s", value="v").where("v is not null").count() == 0


def test_nearest_in_crowded_cells(spark):
    r = random.Random(8)
    pts = [(k, r.gauss(0, 0.02), r.gauss(0, 0.02), r.gauss(0, 0.02)) for k in range(120)] + [(200 + k, 0.01, 0.01, 0.01) for k in range(40)] + [(300, 0.9, 0.0, 0.0), (301, None, 0.0, 0.0)]
    a = spark.createDataFrame([p for p in pts if p[0] % 2 == 0], "vid long, x double, y double, z double")
    b = spark.createDataFrame([p for p in pts if p[0] % 2 == 1], "vid long, x double, y double, z double")
    plain = {tuple(x) for x in gridjoin.nearest(a, b, 1.0, left_id="vid", right_id="vid").collect()}
    fine = {tuple(x) for x in gridjoin.nearest(a, b, 1.0, left_id="vid", right_id="vid", dense=3).collect()}
    assert plain == fine and len(plain) == a.where("x is not null").count()


def test_hot_cells_of_rays_are_salted(spark, monkeypatch):
    r = random.Random(2)
    shots = spark.createDataFrame([(k, k, 0.0, 0.0, 0.0, r.uniform(0.5, 2), r.uniform(-0.3, 0.3), r.uniform(-0.3, 0.3)) for k in range(80)], "ray long, ts long, sx double, sy double, sz double, tx double, ty double, tz double")
    at = spark.createDataFrame([(k, r.uniform(0.1, 1), r.uniform(-0.2, 0.2), r.uniform(-0.2, 0.2)) for k in range(60)], "vid long, x double, y double, z double")
    run = lambda: {tuple(x) for x in rays.verify(at, shots, point_id="vid", ray_id="ray", block=0.25, radial=0.05, depth=0.05).where("verdict <> 'occluded'").collect()}
    want = run()
    monkeypatch.setattr(rays, "RAYS_A_CELL", 10)
    assert want and run() == want


@pytest.mark.parametrize("small", [0, 100_000])
def test_components_of_structs_and_words(spark, small):
    e = spark.createDataFrame([(("a", 1), ("a", 2)), (("a", 2), ("a", 9)), (("b", 1), ("b", 5)), (("b", 5), None)], "u struct<l: string, c: long>, v struct<l: string, c: long>")
    got = {(tuple(x.node), tuple(x.component)) for x in connected_components(e, small=small).collect()}
    assert got == {(("a", 1), ("a", 1)), (("a", 2), ("a", 1)), (("a", 9), ("a", 1)), (("b", 1), ("b", 1)), (("b", 5), ("b", 1))}
    assert connected_components(e.limit(0), small=small).collect() == []


def test_rounds_are_what_one_after_the_other_gets(spark):
    r = random.Random(6)
    rows = [(f, t, c, round(r.random(), 1)) for f in range(6) for t in range(6) for c in range(6) if r.random() < 0.6]
    want = set()
    for f in range(6):
        used = set()
        for t in range(6):
            mine = sorted(((-s, c) for g, u, c, s in rows if (g, u) == (f, t) and s > 0.2 and c not in used))
            if mine:
                used.add(mine[0][1])
                want.add((f, t, mine[0][1]))
    df = spark.createDataFrame(rows, "f long, t long, c long, s double")
    assert {(x.f, x.t, x.c) for x in association.ordered_greedy(df, "f", "t", "c", "s", least=0.2).collect()} == want


def test_optimal_is_cheapest_of_all(spark):
    r = random.Random(7)
    rows = [(g, a, b, round(r.uniform(0.1, 1.0), 3)) for g in range(3) for a in range(4) for b in range(3) if r.random() < 0.7]
    got = association.optimal(spark.createDataFrame(rows, "g long, a long, b long, c double"), "g", "a", "b", "c", missing=0.8).collect()
    assert len({(x.g, x.a) for x in got}) == len({(x.g, x.b) for x in got}) == len(got)
    for g in range(3):
        cost = {(a, b): c for h, a, b, c in rows if h == g}
        best = min(sum(cost.get((p[b], b), 9.0) - 0.8 for b in chosen) for n in range(4) for chosen in itertools.combinations(range(3), n) for p in ({b: q for b, q in zip(chosen, perm, strict=True)} for perm in itertools.permutations(range(4), n)))
        assert abs(sum(x.c - 0.8 for x in got if x.g == g) - best) < 1e-9
    with pytest.raises(Exception, match="too large"):
        association.optimal(spark.createDataFrame([(1, a, b, 0.1) for a in range(5) for b in range(5)], "g long, a long, b long, c double"), "g", "a", "b", "c", missing=1.0, most=50).collect()


def test_motion_states(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 4, False), (1, 6, False), (1, 7, True)], "k long, t long, m boolean")
    got = [(x.t, x.is_dynamic, x.has_history) for x in tracks.motion_states(df, "k", "t", F.col("m"), 5).orderBy("t").collect()]
    assert got == [(0, False, False), (1, True, True), (4, True, True), (6, False, True), (7, True, True)]


def test_seeds_grow_and_others_only_join(spark):
    at = lambda rows: spark.createDataFrame([(i, i, 0, 0) for i in rows], "cid long, i long, j long, k long")
    got = {x.cid: x.cluster for x in voxels.seeded_clusters(at([1, 2, 3, 4, 5, 8, 9]), at([1, 2, 5]), "cid", 6).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 5, 5: 5}  # 3 and 4 join, and don't bridge; 8 and 9 touch no seed


def test_ever_free_needs_its_neighbours(spark):
    rows = [(i, j, k, i == j == 0 and k == 2) for i in range(-1, 2) for j in range(-1, 2) for k in range(-1, 3)]
    cells = spark.createDataFrame(rows, "i long, j long, k long, occupied boolean")
    first = voxels.ever_free(cells, ~F.col("occupied"), None, 6)
    assert {tuple(x) for x in first.collect()} == {(0, 0, 0)}
    second = voxels.ever_free(cells, F.lit(True), first, 6)
    assert {tuple(x) for x in second.collect()} == {(0, 0, 0), (0, 0, 1)}


def test_small_components_take_their_border(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 1), (5, 3), (6, 0)], "fid long, label long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "u long, v long")
    got = {x.fid: x.label for x in clusters.without_small(labels, edges, "fid", "label", 2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 0, 6: 0}


def test_normals_of_a_plane(spark):
    r = random.Random(3)
    pts = [(k, x := r.uniform(0, 1), y := r.uniform(0, 1), 0.5 * x - 0.25 * y) for k in range(60)]
    df = spark.createDataFrame(pts, "vid long, x double, y double, z double")
    got = surfaces.normals(surfaces.neighbourhoods(df, 0.5), ["vid"]).collect()
    n = (1 + 0.25 + 0.0625) ** 0.5
    assert all(abs(x.spread) < 1e-9 and max(abs(a - b) for a, b in zip(x.normal, (-0.5 / n, 0.25 / n, 1 / n), strict=True)) < 1e-4 for x in got)


def test_changes_survive_a_restart(spark, tmp_path):
    rule, folder = Scan(20, 2, 0.4, 0.5), f"file://{tmp_path}/changes"
    r = random.Random(5)
    data = [(k, r.randint(0, 300), r.choice(["present", "absent"])) for k in range(8) for _ in range(12)]
    frame = lambda rows: spark.createDataFrame(rows, "k long, t long, v string")
    incremental.ChangeState(["k"], "t", "v", rule, folder).update(frame(data[:40]), 0)
    again = incremental.ChangeState(["k"], "t", "v", rule, folder)
    again.update(frame(data[:40]), 0)  # it is there
    again.update(frame(data[40:]), 1)
    from palimpsest.operators import evidence

    assert {tuple(x) for x in again.result.collect()} == {tuple(x) for x in evidence.scan(frame(data), ["k"], "t", "v", rule).collect()}


def test_saved_states(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state")
    assert (store.num_time_steps, store.earliest, store.latest) == (0, None, None)
    with pytest.raises(ValueError):
        store.answering(1)
    v = spark.createDataFrame([(1, 5), (2, 15)], "vid long, first_seen long")
    o = spark.createDataFrame([(1, None, 3, 12), (2, 18, 3, None)], "node long, effective long, first long, last long")
    store.append(10, v.where("first_seen <= 10"), o.where("node = 1").drop("last"), version=1)
    store.append(20, v, o)
    assert (store.stamps, store.answering(1), store.answering(11), store.answering(99)) == ([10, 20], 10, 20, 20)
    assert [x.node for x in store.objects_at(10).collect()] == [1] and [x.node for x in store.objects_at(19).collect()] == [2]
    assert [x.vid for x in store.mesh_at(14).collect()] == [1]
    with pytest.raises(ValueError):
        store.append(15, v, o)


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="shared folder"):
        scratch.scratch(Session(), "x")


def test_sources_check_their_contracts(spark, tmp_path):
    bad = tmp_path / "catalog.json"
    bad.write_text('{"entities": [{"physical_instance_id": 1, "semantic_id": 2, "name": "a"}, {"physical_instance_id": 1, "semantic_id": 3, "name": "b"}]}')
    with pytest.raises(ValueError, match="repeated id"):
        tables.read_catalog(spark, str(bad))
    pose = tmp_path / "pose.txt"
    pose.write_text("1 0 0 0\n0 2 0 0\n0 0 1 0\n0 0 0 1\n")
    with pytest.raises(Exception, match="rigid"):
        tables.read_pose(spark, str(pose)).collect()
    line = spark.createDataFrame([("a", 1, 0), ("b", 3, 1), ("c", 2, 2), ("c", 4, 3)], "ImageID string, TimeStamp long, n long")
    assert {x.fault: x.n for x in tables.ledger_faults(line, order="n").collect()} == {"repeated image": 1, "repeated stamp": 0, "not increasing": 1}
    truth = tmp_path / "truth.csv"
    truth.write_text("ObjectSymbol,AppearedAt,DisappearedAt\nO(12),5,0\n")
    assert [tuple(x) for x in tables.read_truth_changes(spark, str(truth)).collect()] == [(12, 5, None)]
    states = tmp_path / "bg.csv"
    states.write_text("vertex,state\n3,absent\n")
    assert [tuple(x) for x in tables.read_background_changes(spark, str(states)).collect()] == [(3, "absent")]
    runs = tmp_path / "runs.csv"
    runs.write_text("Query,Name,Value\n1,a,2\n3,b,n/a\n2,c,4\n")
    assert tuple(tables.newest_row(spark, str(runs), "Query").first()) == ("3.0", "b", "n/a")

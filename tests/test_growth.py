"""Steps whose shuffles must grow with the rows and not with the pairs."""

from __future__ import annotations

import math
import random

from palimpsest.operators import association, clusters, gridjoin, masks, rays, surfaces, tracks
from palimpsest.plans import scratch, track_queries


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rays_meet_points_once_and_pairs_are_not_dealt_again(spark):
    r = random.Random(5)
    at = [(k, *[r.gauss(0, 0.1) for _ in "xyz"]) for k in range(120)]
    ends = [(k, k, -0.6, 0.013, 0.007, *[r.gauss(0, 0.1) for _ in "xyz"], f"e{k}") for k in range(90)]
    p = spark.createDataFrame(at, "vid long, x double, y double, z double")
    s = spark.createDataFrame(ends, "ray long, ts long, sx double, sy double, sz double, tx double, ty double, tz double, endpoint string")
    met = rays.verify(p, s, point_id="vid", ray_id="ray", block=0.1, radial=0.02, depth=0.03, keep=["endpoint"]).where("verdict <> 'occluded'")
    want = set()
    for vid, *q in at:
        for ray, _, *e in ends:
            v, w = [b - a for a, b in zip(e[:3], q, strict=True)], [b - a for a, b in zip(e[:3], e[3:6], strict=True)]
            d = math.sqrt(sum(a * a for a in v))
            reach = sum(a * b for a, b in zip(v, w, strict=True)) / d
            aside = math.sqrt(max(sum(b * b for b in w) - reach * reach, 0.0))
            if aside <= 0.02 and d - reach <= 0.03:
                want.add((vid, ray, "absent" if reach - d > 0.03 else "present", f"e{ray}"))
    got = [(x["vid"], x["ray"], x["verdict"], x["endpoint"]) for x in met.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert _plan(met).count("Join ") == 1 and "Aggregate" not in _plan(met)


def test_within_ends_a_search_at_the_first_neighbour(spark):
    p = spark.createDataFrame([(k, 0.001 * k, 0.0, 0.0) for k in range(50)] + [(99, 5.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    for anti, want in ((False, set(range(50))), (True, {99})):
        got = gridjoin.within(p, p.where("vid < 50"), 0.1, left_id="vid", right_id="vid", anti=anti)
        assert {r["vid"] for r in got.collect()} == want
        assert "Join Inner" not in _plan(got)


def test_the_nearest_is_found_in_lists_and_on_one_axis(spark):
    r = random.Random(8)
    at = [(k, k % 3, round(r.random() * 4, 2)) for k in range(400)]
    p = spark.createDataFrame(at, "vid long, h long, x double")
    a, b = p.where("vid % 2 = 0"), p.where("vid % 2 = 1")
    want = {}
    for v, h, x in at[::2]:
        near = [(abs(x - y), w) for w, g, y in at[1::2] if g == h and (x - y) * (x - y) <= 0.05 * 0.05]
        if near:
            want[v] = min(near)[1]
    for listed, dense in ((8192, 256), (2, 256), (8192, 2)):  # lists that are cut, and finer cells first
        whole, gridjoin.LISTED = gridjoin.LISTED, listed
        try:
            got = gridjoin.nearest(a, b, 0.05, left_id="vid", right_id="vid", coords=["x"], equal=["h"], dense=dense)
            assert {x["vid"]: x["right_vid"] for x in got.collect()} == want
        finally:
            gridjoin.LISTED = whole


def test_poses_are_matched_without_shuffled_pairs(spark):
    r = random.Random(3)
    at = [(k, k % 2, *[r.random() for _ in "xyz"], 1.0 - k % 3, float(k % 3), 0.0) for k in range(60)]
    p = spark.createDataFrame(at, "vid long, run long, x double, y double, z double, fx double, fy double, fz double")
    got = masks.nearest_poses(p.where("vid % 4 < 2"), p.where("vid % 4 > 1"), 0.5, sparse_id="vid", dense_id="vid", forward=["fx", "fy", "fz"], run="run")
    want = {}
    for a in (a for a in at if a[0] % 4 < 2):
        near = [(math.dist(a[2:5], b[2:5]) + 0.25 * math.acos(max(-1, min(1, sum(x * y for x, y in zip(a[5:], b[5:], strict=True))))), b[0]) for b in at if b[0] % 4 > 1 and b[1] == a[1] and math.dist(a[2:5], b[2:5]) <= 0.5]
        if near:
            want[a[0]] = min(near)[1]
    assert {x["vid"]: x["right_vid"] for x in got.collect()} == want
    assert _plan(got).count("Join ") == 1


def test_matchings_deal_rows_by_number_and_once(spark, monkeypatch, tmp_path):
    r = random.Random(21)
    rows = [(f, n, float(r.randint(1, 50))) for f in range(60) for n in range(1, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(scratch.dealt_by_rows, "__kwdefaults__", {"most": 50})
    pairs = track_queries._overlaps(spark, str(tmp_path))
    assert pairs._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 2  # lines and lines, not their pairs
    assert pairs.rdd.getNumPartitions() == 6
    want = {}
    for f in range(60):
        q = {n: x for g, n, x in rows if g == f}
        free = set(q)
        for a in sorted(q):
            near = [(-round(1 - abs(q[a] - q[b]) / 50, 6), b) for b in free if b != a and round(1 - abs(q[a] - q[b]) / 50, 6) > 0.5]
            if near:
                want[f, a] = min(near)[1]
                free.remove(min(near)[1])
    monkeypatch.setattr(association, "SMALL", 100)
    got = track_queries.track_assign_greedy(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1  # both ranks and the parts
    assert {(x.frame, x.cluster): x.motion for x in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_a_large_part_is_matched_whole(spark):
    r = random.Random(31)
    steps = [round(r.uniform(0.1, 1.0), 4) for _ in range(2400)]  # a path over 1,200 left and 1,201 right ends
    rows = [(1, (k + 1) // 2 if k % 2 == 0 else k // 2, (k + 1) // 2, c) for k, c in enumerate(steps)]
    assert len({(a, b) for _, a, b, _ in rows}) == 2400
    without, with_ = 0.0, 0.0  # the most that is saved on the path so far, the last step not taken or taken
    for c in steps:
        without, with_ = max(without, with_), without + 0.8 - c
    got = association.optimal(spark.createDataFrame(rows, "g long, a long, b long, c double"), "g", "a", "b", "c", missing=0.8).collect()
    assert len({x.a for x in got}) == len({x.b for x in got}) == len(got)
    assert math.isclose(sum(0.8 - x.c for x in got), max(without, with_), abs_tol=1e-9)


def test_a_matching_of_the_cheapest_rows_is_widened_until_it_is_the_cheapest(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(association, "FIRST_ROWS", 1)
    r = np.random.default_rng(32)
    table = np.round(r.random((2, 25, 20)) + 2.0 * r.random((2, 25, 1)), 3)
    rows = [(g, a, b, float(table[g, a, b])) for g in range(2) for a in range(25) for b in range(20)]
    got = association.optimal(spark.createDataFrame(rows, "g long, a long, b long, c double"), "g", "a", "b", "c", missing=1.5).collect()
    for g in range(2):
        square = np.full((45, 45), 0.75)
        square[:25, :20], square[25:, 20:] = table[g], 0.0
        want = sum(table[g, i, j] - 1.5 for i, j in association.hungarian(square) if i < 25 and j < 20)
        own = [x for x in got if x.g == g]
        assert len({x.a for x in own}) == len({x.b for x in own}) == len(own)
        assert math.isclose(sum(x.c - 1.5 for x in own), want, abs_tol=1e-9)


def test_tracks_take_their_nearest_from_places_and_make_no_pairs(spark):
    r = random.Random(21)
    at = [(k, k % 3, *[round(r.random() * 2, 1) for _ in "xyz"]) for k in range(240)]  # many equal distances
    a = spark.createDataFrame([*at[::2], (900, None, 0.0, 0.0, 0.0), (901, 1, None, 0.0, 0.0), (0, 0, 1.0, 1.0, 1.0)], "vid long, f int, x double, y double, z double")
    b = spark.createDataFrame(at[1::2], "vid long, f int, x double, y double, z double").withColumnRenamed("vid", "cluster")
    for strict in (False, True):
        free, want = {v: row for v, *row in at[1::2]}, set()
        for v in range(0, 240, 2):
            mine = [row for row in (at[v], *([(0, 0, 1.0, 1.0, 1.0)] if v == 0 else [])) if row[0] == v]
            near = [((x - p) ** 2 + (y - q) ** 2 + (z - s) ** 2, w) for _, f, x, y, z in mine for w, (g, p, q, s) in free.items() if f == g]
            near = [n for n in near if n[0] < 0.6 * 0.6 or (n[0] == 0.6 * 0.6 and not strict)]
            if near:
                want.add((at[v][1], v, min(near)[1]))
                free.pop(min(near)[1])
        for most in (250_000, 60):  # settled in tasks, and in rounds
            got = tracks.nearest_tracks(a, b, 0.6, track="vid", cluster="cluster", frame=["f"], strict=strict, most=most)
            assert {(x["f"], x["vid"], x["cluster"]) for x in got.collect()} == want
            assert most == 60 or "Join" not in _plan(got)
    assert tracks.nearest_tracks(a.limit(0), b, 0.6, track="vid", cluster="cluster", frame=["f"]).collect() == []
    (one,) = tracks.nearest_tracks(a.where("vid = 2"), b.where("cluster = 5"), 9.0, track="vid", cluster="cluster").collect()
    assert (one["vid"], one["cluster"]) == (2, 5)


def test_crowded_poses_are_found_by_shorter_reaches_first(spark, monkeypatch):
    r = random.Random(13)
    turned = lambda: (lambda v: [c / math.sqrt(sum(x * x for x in v)) for c in v])([r.gauss(0, 1) for _ in "xyz"])
    at = [(k, k % 2, *[round(r.gauss(0, 0.2), 2) for _ in "xyz"], *turned()) for k in range(400)]
    p = spark.createDataFrame(at, "vid long, run long, x double, y double, z double, fx double, fy double, fz double")
    a, b, want = at[:200], at[200:], {}
    for vid, run, *v in a:
        near = []
        for w, other, *u in b:
            d2 = sum((s - t) * (s - t) for s, t in zip(v[:3], u[:3], strict=True))
            if other == run and d2 <= 0.5 * 0.5:
                near.append((math.sqrt(d2) + 0.25 * math.acos(max(-1.0, min(1.0, sum(s * t for s, t in zip(v[3:], u[3:], strict=True))))), w))
        if near:
            want[vid] = min(near)[1]
    tried, listed = [], masks.spread
    monkeypatch.setattr(masks, "spread", lambda df, c, reach: tried.append(reach) or listed(df, c, reach))
    monkeypatch.setattr(masks, "DENSE", 1)
    got = masks.nearest_poses(p.where("vid < 200"), p.where("vid >= 200"), 0.5, sparse_id="vid", dense_id="vid", forward=["fx", "fy", "fz"], run="run")
    assert {x["vid"]: x["right_vid"] for x in got.collect()} == want
    assert len(tried) > 2 and tried[-1] == 0.5 and tried == sorted(tried)


def test_tracks_and_clusters_may_be_of_one_table(spark):
    p = spark.createDataFrame([(k, 0.1 * k, 0.0, 0.0) for k in range(4)], "vid long, x double, y double, z double")
    got = tracks.nearest_tracks(p, p.where("vid > 1"), 5.0, track="vid", cluster="vid")
    assert {(r["vid"], r["right_vid"]) for r in got.collect()} == {(0, 2), (1, 3)}


def test_merge_proposals_are_judged_where_boxes_meet(spark, monkeypatch):
    r = random.Random(17)
    at = [(k, k % 2, k * 5, k * 5 + r.randint(0, 40), *[round(r.random(), 2) for _ in "xyz"]) for k in range(60)]
    boxes = spark.createDataFrame([(*row, *[round(c + 0.1 + r.random() * 0.8, 2) for c in row[4:]]) for row in at], "node long, label long, first long, last long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    rows, want = boxes.collect(), set()
    for p in rows:
        for q in rows:
            if p["node"] < q["node"] and p["label"] == q["label"] and (p["last"] < q["first"] or q["last"] < p["first"]):
                common = math.prod(max(min(p[f"{c}1"], q[f"{c}1"]) - max(p[f"{c}0"], q[f"{c}0"]), 0.0) for c in "xyz")
                both = sum(math.prod(b[f"{c}1"] - b[f"{c}0"] for c in "xyz") for b in (p, q)) - common
                if common / both >= 0.1:
                    want.add((q["node"], p["node"], round(common / both, 9)))
    for dealt in (4000, 7):
        monkeypatch.setattr(clusters, "DEALT", dealt)
        got = clusters.proposals(boxes, node="node", label="label", size=0.5, least=0.1)
        assert sorted((x["from_node"], x["to_node"], round(x["iou"], 9)) for x in got.collect()) == sorted(want)
        assert _plan(got).count("Join ") == 1


def test_neighbourhoods_are_summed_without_pairs(spark, monkeypatch):
    r = random.Random(19)
    at = [(k, *[round(r.gauss(0, 0.3), 2) for _ in "xyz"]) for k in range(150)]
    p = spark.createDataFrame([*at, (900, None, 0.0, 0.0)], "vid long, x double, y double, z double")
    for listed in (8192, 40):
        monkeypatch.setattr(surfaces, "HELD", listed)
        got = surfaces.neighbourhoods(p, 0.4)
        assert "Join" not in _plan(got)
        rows = {x["vid"]: x for x in got.collect()}
        assert set(rows) == set(range(150))
        for v, *a in at:
            near = [b for _, *b in at if sum((s - t) * (s - t) for s, t in zip(a, b, strict=True)) <= 0.4 * 0.4]
            mean = [sum(b[k] for b in near) / len(near) for k in range(3)]
            assert rows[v]["n"] == len(near)
            assert math.isclose(rows[v]["xz"], sum((b[0] - mean[0]) * (b[2] - mean[2]) for b in near) / len(near), abs_tol=1e-12)
            assert math.isclose(rows[v]["yy"], sum((b[1] - mean[1]) ** 2 for b in near) / len(near), abs_tol=1e-12)

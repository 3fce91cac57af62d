import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import belief, geometry, labels
from palimpsest.operators import association, freespace, gridjoin, mesh, objects, rays
from palimpsest.operators.components import connected_components


def cloud(spark, n, seed, first=0):
    r = random.Random(seed)
    data = [(first + k, r.randint(0, 2), *(round(r.uniform(-1, 1), 3) for _ in range(3))) for k in range(n)]
    return data, spark.createDataFrame(data, "vid long, label int, x double, y double, z double")


def d2(a, b):
    return sum((a[k] - b[k]) ** 2 for k in (2, 3, 4))


def test_pairs_nearest_and_within_equal_brute_force(spark):
    a, da = cloud(spark, 80, 1)
    b, db = cloud(spark, 90, 2, 1000)
    near = [(x[0], y[0]) for x in a for y in b if d2(x, y) <= 0.3**2]
    assert {tuple(r)[:2] for r in gridjoin.pairs(da, db, 0.3, left_id="vid", right_id="vid").select("vid", "right_vid").collect()} == set(near)
    best = {x[0]: min((d2(x, y), y[0]) for y in b)[1] for x in a if any((x[0], y[0]) in set(near) for y in b)}
    assert {r.vid: r.right_vid for r in gridjoin.nearest(da, db, 0.3, left_id="vid", right_id="vid").collect()} == best
    assert {r.vid for r in gridjoin.within(da, db, 0.3, left_id="vid", right_id="vid", anti=True).collect()} == {x[0] for x in a} - set(best)
    share = gridjoin.fraction_within(da.limit(0), db, 0.3, left_id="vid", right_id="vid").first()[0]
    assert share == 1.0


def test_no_nested_loop_in_the_plan(spark):
    _, da = cloud(spark, 10, 1)
    _, db = cloud(spark, 10, 2)
    plan = gridjoin.nearest(da, db, 0.3, left_id="vid", right_id="vid")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_voxel_key_is_exact_and_checked(spark):
    df = spark.createDataFrame([(-0.05, 0.0, 0.1), (0.05, 0.0, 0.1)], "x double, y double, z double")
    a, b = (r[0] for r in df.select(gridjoin.cell(("x", "y", "z"), 0.1)).collect())
    assert a != b
    with pytest.raises(Exception, match="packed range"):
        spark.createDataFrame([(1e9, 0.0, 0.0)], "x double, y double, z double").select(gridjoin.cell(("x", "y", "z"), 0.1)).collect()


def test_rays_equal_brute_force(spark):
    r = random.Random(5)
    ray = [(k, k, *(r.uniform(-1, 1) for _ in range(6))) for k in range(40)]
    a, da = cloud(spark, 60, 6)
    dr = spark.createDataFrame(ray, "ray long, ts long, sx double, sy double, sz double, tx double, ty double, tz double")
    want = set()
    for p in a:
        for q in ray:
            s, t, x = np.array(q[2:5]), np.array(q[5:8]), np.array(p[2:5])
            d = np.linalg.norm(x - s)
            if np.linalg.norm(np.cross(x - s, t - s)) / d > 0.1:
                continue
            reach = float(np.dot(t - s, x - s) / d)
            if abs(d - reach) <= 0.15 or reach > d:
                want.add((p[0], q[0], "present" if abs(d - reach) <= 0.15 else "absent"))
    got = rays.verify(da, dr, point_id="vid", ray_id="ray", block=0.4, radial=0.1, depth=0.15).where("verdict <> 'occluded'")
    # behind the source a ray shows nothing
    ahead = {(v, k) for v, k, _ in want}
    assert {tuple(x) for x in got.select("vid", "ray", "verdict").collect()} == want, len(ahead)


def test_physical_verdicts(spark):
    cases = [("absent", "object", 7, "present", "same_id"), ("absent", "object", 8, "inconclusive", "different_id"), ("present", "background", None, "absent", "background_replacement"), ("absent", "background", None, "absent", "free_space"), ("present", None, None, "inconclusive", "unavailable"), ("absent", None, None, "absent", "unavailable"), ("occluded", "object", 7, "occluded", "geometric_occlusion"), ("present", "unidentified", None, "inconclusive", "unidentified_object"), ("present", "invalid", None, "inconclusive", "invalid")]
    df = spark.createDataFrame(cases, "v string, e string, i long, want string, why string")
    out, reason = rays.physical_verdict(F.col("v"), F.lit(7), F.col("e"), F.col("i"))
    assert all(r.out == r.want and r.reason == r.why for r in df.select("*", out.alias("out"), reason.alias("reason")).collect())


def test_components_equal_union_find(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: root(k) for k in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_greedy_pairs_equal_the_sequential_rule(spark):
    r = random.Random(4)
    costs = [(g, a, b, r.randint(0, 12) / 4) for g in range(3) for a in range(9) for b in range(9) if r.random() < 0.6]
    want, used = set(), set()
    for c, g, a, b in sorted((c, g, a, b) for g, a, b, c in costs):
        if (g, "l", a) not in used and (g, "r", b) not in used:
            used |= {(g, "l", a), (g, "r", b)}
            want.add((g, a, b, c))
    got = association.greedy_pairs(spark.createDataFrame(costs, "g long, a long, b long, c double"), "a", "b", "c", group=["g"])
    assert {tuple(x) for x in got.collect()} == want


def test_hungarian_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4)):
        c = rng.integers(0, 20, (n, m)).astype(float)
        got = sum(c[i, j] for i, j in association.hungarian(c))
        small = c if n <= m else c.T
        assert got == min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(small.shape[1]), len(small)))


def test_ordered_greedy_and_optimal(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.95), (1, 2, 2, 0.2), (1, 3, 2, 0.5)], "f long, t long, c long, s double")
    assert {tuple(x) for x in association.ordered_greedy(df, "f", "t", "c", "s", least=0.2).collect()} == {(1, 1, 1, 0.9), (1, 3, 2, 0.5)}
    best = association.optimal(df.withColumn("s", 1 - F.col("s")), "f", "t", "c", "s", missing=5.0)
    assert {(x.t, x.c) for x in best.collect()} == {(2, 1), (1, 2)}


def test_weld_append_faces(spark):
    base = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    new = spark.createDataFrame([(10, 0.01, 0.0, 0.0), (11, 5.0, 0.0, 0.0), (12, 1.0, 0.02, 0.0)], "vid long, x double, y double, z double")
    to = mesh.weld(base, new, 0.05)
    assert {x.vid: x.target for x in to.collect()} == {10: 1, 11: 11, 12: 2}
    faces = spark.createDataFrame([(1, 10, 11, 12), (2, 10, 10, 12)], "fid long, a long, b long, c long")
    assert {tuple(x[c] for c in "abc") for x in mesh.reindex(faces, to).collect()} == {(1, 11, 2)}
    assert {x.vid for x in mesh.append(base, new, 0.05).collect()} == {1, 2, 11}
    assert {x.vid for x in mesh.append(base, new, 0.05, supported=True).collect()} == {1, 2, 10, 12}


def test_free_space_and_tsdf(spark):
    ray = spark.createDataFrame([(1, 0.05, 0.05, 0.05, 1.05, 0.05, 0.05)], "ray long, sx double, sy double, sz double, tx double, ty double, tz double")
    counts = freespace.free_counts(ray, ray_id="ray", size=0.1, short=0.15)
    assert counts.count() == 9
    p = spark.createDataFrame([(1, 0.51, 0.05, 0.05), (2, 3.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    assert [x.vid for x in freespace.consistent(p, counts, size=0.1).collect()] == [2]
    assert freespace.free_fraction(p, counts, size=0.1).first().fraction == 0.5
    field = freespace.ray_tsdf(ray, ray_id="ray", size=0.1, truncation=0.2)
    assert freespace.tsdf_change(field, field).first().change == 0


def test_fragments_fold(spark):
    obs = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.4), (1, 3, 2.0), (1, 3, 2.5), (1, 4, 2.1), (2, 9, 1.0)], "k long, t long, x double")
    got = objects.fragments(obs, "k", "t", ["x"], 1.0)
    assert {tuple(x) for x in got.collect()} == {(1, 0, 1, 2, 3, 2, "closed"), (1, 1, 3, 4, None, 2, "current"), (2, 0, 9, 9, None, 1, "current")}


def test_labels_and_boxes(spark):
    df = spark.range(1).select(labels.pack(F.lit(40000), F.lit(65535)).alias("p"))
    assert tuple(df.select(labels.semantic(F.col("p")), labels.instance(F.col("p"))).first()) == (40000, 65535)
    box = [[F.lit(0.0)] * 3, [F.lit(2.0)] * 3, [F.lit(1.0)] * 3, [F.lit(3.0)] * 3]
    assert math.isclose(spark.range(1).select(geometry.box_iou(*box)).first()[0], 1 / 15)
    assert spark.range(1).select(F.size(geometry.box_points(box[0], box[1]))).first()[0] == 15
    assert spark.range(1).select(labels.symbol_index(F.lit("O(12)"))).first()[0] == 12


def log_beta_posterior(mu, sigma, alpha, beta, delta, s, k, tau, top):
    from math import exp, lgamma, log, pi, sqrt

    lb = lambda a, b: lgamma(a) + lgamma(b) - lgamma(a + b)
    v = sigma**2 + tau**2
    a, b = alpha + k * s, beta + k * (1 - s)
    one = -0.5 * (log(2 * pi * v) + (delta - mu) ** 2 / v) + lb(a + 1, b)
    two = -log(2 * top) + lb(a, b + 1)
    w = 1 / (1 + exp(two - one))
    g = 1 / (1 / sigma**2 + 1 / tau**2)
    m = g * (mu / sigma**2 + delta / tau**2)
    new = w * m + (1 - w) * mu
    return new, sqrt(max(1e-8, w * (g + m * m) + (1 - w) * (sigma**2 + mu * mu) - new * new)), w


def test_posterior_equals_the_log_beta_form(spark):
    r = random.Random(7)
    cases = [(r.uniform(-0.3, 0.3), r.uniform(0.05, 0.4), r.uniform(0.5, 9), r.uniform(0.5, 9), r.uniform(-1, 1), r.randint(0, 1), r.choice([0.0, 0.5, 1.0])) for _ in range(50)]
    df = spark.createDataFrame(cases, "mu double, sigma double, alpha double, beta double, delta double, s int, k double")
    p = belief.posterior(*[F.col(c) for c in df.columns], tau=0.1, delta_max=1.0)
    for row in df.select("*", p.mu.alias("m"), p.sigma.alias("g"), p.inlier_weight.alias("w")).collect():
        assert np.allclose(log_beta_posterior(*row[:7], 0.1, 1.0), (row.m, row.g, row.w), atol=1e-9)


def test_move_decisions(spark):
    s = 10**9
    df = spark.createDataFrame([(None, 30 * s, None, 10 * s), (None, None, None, 10 * s), (None, 30 * s, None, None), (None, None, None, None)], "fa long, la long, fp long, lp long")
    p = [r[0] for r in df.select(belief.move_probability(F.col("fa"), F.col("la"), F.col("fp"), F.col("lp"), 10.0)).collect()]
    assert np.allclose(p, [1 / (1 + math.exp(-x)) for x in (-2 + 6 + 1, -2 - 2 - 1, -2 + 4 + 1, -2)])
    with pytest.raises(ValueError):
        belief.moved("guess", F.lit(0), F.lit(0), F.lit(0))


@pytest.mark.parametrize("small", [0, 30, 100_000])
def test_matchings_by_tasks_and_by_rounds(spark, monkeypatch, small):
    """Frames on either side of the bound, chains in which one pair settles the next, null ends and groups."""
    monkeypatch.setattr(association, "SMALL", small)
    r = random.Random(13)
    data = [(g, a, b, round(r.uniform(0, 1), 1)) for g in range(6) for a in range(7) for b in range(7) if r.random() < (0.2 if g % 2 else 0.9)]
    data += [(9, k, k + d, float(k + d)) for k in range(6) for d in (0, 1)]
    want_near, want_ordered = set(), set()
    for g in {x[0] for x in data}:
        used_a, used_b = set(), set()
        for c, a, b in sorted((c, a, b) for h, a, b, c in data if h == g):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                want_near.add((g, a, b, c))
        free = {b for h, _, b, _ in data if h == g}
        for a in sorted({a for h, a, _, _ in data if h == g}):
            if best := min(((-c, b) for h, x, b, c in data if (h, x) == (g, a) and b in free and c > 0.2), default=None):
                free.discard(best[1])
                want_ordered.add((g, a, best[1], -best[0]))
    df = spark.createDataFrame([*data, (None, 1, 1, 0.5), (1, None, 1, 0.0), (1, 1, None, 0.9)], "g long, a long, b long, c double")
    assert {tuple(x) for x in association.greedy_pairs(df, "a", "b", "c", group=["g"]).collect()} == want_near
    assert {tuple(x) for x in association.ordered_greedy(df, "g", "a", "b", "c", least=0.2).collect()} == want_ordered
    none = association.greedy_pairs(df.limit(0), "a", "b", "c", group=["g"])
    assert none.columns == ["g", "a", "b", "c"] and none.collect() == []
    one = df.where("g = 9").drop("g")
    assert {(9, *x) for x in association.greedy_pairs(one, "a", "b", "c").collect()} == {x for x in want_near if x[0] == 9}
    circle = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 1, 0), (2, 2, 0, 1), (2, 1, 1, 0)], "a long, b long, p long, q long")
    with pytest.raises(Exception, match="contradict"):
        association.rounds_of_pairs(circle, "a", "b", [F.col("p").asc()], [F.col("q").asc()], keep=["p", "q"]).collect()

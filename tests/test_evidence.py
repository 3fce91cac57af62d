import random

import pytest

from palimpsest.operators import evidence
from palimpsest.operators.evidence import Scan


def brute(rows, rule, forward):
    series = {}
    for t, v in rows:
        if v != "inconclusive" or rule.physical:
            series.setdefault(t // rule.resolution, []).append(v)
    far = None
    for b in sorted(series, reverse=not forward):
        near = [v for i in range(rule.window) for v in series.get(b + i if forward else b - i, [])]
        p, a = near.count("present"), near.count("absent")
        n = len(near)
        if (a / n if rule.relative else a) > rule.absence:
            return b * rule.resolution, far
        if (p / n if rule.relative else p) > rule.presence:
            far = b * rule.resolution
    return None, far


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("rule", [Scan(10), Scan(10, 3, 0.4, 0.5), Scan(5, 2, 1, 2, relative=False), Scan(7, 4, 0.3, 0.3, physical=True)])
def test_scan_equals_brute_force(spark, rule, forward):
    r = random.Random(2)
    data = [(k, r.randint(0, 200), r.choice(["present"] * 4 + ["absent", "inconclusive"])) for k in range(12) for _ in range(30)]
    got = {x.k: (x.closest_absent, x.furthest_persistent) for x in evidence.scan(spark.createDataFrame(data, "k long, t long, v string"), ["k"], "t", "v", rule, forward=forward).collect()}
    assert got == {k: brute([(t, v) for j, t, v in data if j == k], rule, forward) for k in range(12)}


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([(1, 5, "present"), (1, 5, "absent")], "k long, t long, v string")
    assert tuple(evidence.scan(df, ["k"], "t", "v", Scan(10)).first())[1:] == (None, None)


def test_vertex_states(spark):
    vertices = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10)], "k long, last_seen long")
    seen = spark.createDataFrame([(1, 30, "absent"), (2, 30, "present"), (3, 5, "absent"), (2, 3, "absent")], "k long, t long, v string")
    got = {x.k: x.state for x in evidence.vertex_states(vertices, seen, "k", "t", "v", Scan(10)).collect()}
    assert got == {1: "Absent", 2: "Persistent", 3: "Unobserved", 4: "Unobserved"}


def test_verify_current(spark):
    df = spark.createDataFrame([(1, "absent"), (1, "present"), (2, "absent"), (3, "inconclusive")], "k long, v string")
    assert {(x.k, x.event) for x in evidence.verify_current(df, ["k"], "v").collect()} == {(1, "support"), (2, "contradict")}


def test_scan_is_validated():
    with pytest.raises(ValueError):
        Scan(0)

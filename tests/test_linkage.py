import random
from statistics import median

import numpy as np
import pytest

from palimpsest.operators import linkage

SCHEMA = "vid long, label int, x double, y double, z double, track long"


def one_after_the_other(rows, radius):
    """Complete linkage by joining the closest two clusters until they are too far."""
    groups = [[r] for r in rows]

    def far(a, b):
        return max(sum((p[k] - q[k]) ** 2 for k in (2, 3, 4)) ** 0.5 for p in a for q in b)

    while True:
        close = [(far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j and a[0][1] == b[0][1]]
        if not close or min(close)[0] > radius:
            return groups
        _, i, j = min(close)
        groups[i] += groups.pop(j)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = [(k, k % 3, *(r.uniform(0, 1) for _ in range(3)), k // 6) for k in range(60)]
    return [*out, *[(60 + k, *out[k][1:5], 90) for k in range(4)]]  # four places twice


def test_complete_equals_one_after_the_other(spark, rows):
    got = {r.vid: r.cluster for r in linkage.complete(spark.createDataFrame(rows, SCHEMA), 0.5).collect()}
    assert got == {r[0]: min(m[0] for m in g) for g in one_after_the_other(rows, 0.5) for r in g}


def test_rounds_deal_pairs_by_their_number(spark, rows, monkeypatch):
    from palimpsest.plans import scratch

    dealt, whole = [], scratch.dealt_by_rows

    def few(df, n, *keys):
        out = whole(df, n, *keys, most=40)
        dealt.append((df.count() <= n, keys, out.rdd.getNumPartitions() == max(1, -(-n // 40))))
        return out

    monkeypatch.setattr(scratch, "dealt_by_rows", few)
    got = {r.vid: r.cluster for r in linkage.complete(spark.createDataFrame(rows, SCHEMA), 0.5).collect()}
    assert got == {r[0]: min(m[0] for m in g) for g in one_after_the_other(rows, 0.5) for r in g}
    assert {k for _, k, _ in dealt} == {("e",), ("u",), ("v",), ("u", "v")} and all(a and b for a, _, b in dealt)


def test_centres_and_identities(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for label in range(3):
        own = [r for r in rows if r[1] == label]
        groups = [own] if label == 2 else one_after_the_other(own, 0.5)
        major = [g for g in groups if len(g) >= 4] or [max(groups, key=lambda g: (len(g), -min(m[0] for m in g)))]
        want += sorted((label, *(median(m[k] for m in g) for k in (2, 3, 4)), len(g)) for g in major)
    centres = linkage.centres(df, 0.5, 4, singles=[2])
    got = sorted(centres.collect(), key=lambda r: r.canonical)
    assert [r.canonical for r in got] == list(range(1, len(want) + 1))
    assert [(r.label, r.n) for r in got] == [(w[0], w[4]) for w in want]
    assert [(r.x, r.y, r.z) for r in got] == [pytest.approx(w[1:4]) for w in want]

    near = {}
    for v, label, x, y, z, track in rows:
        d = sorted((((w[1] - x) ** 2 + (w[2] - y) ** 2 + (w[3] - z) ** 2) ** 0.5, k + 1) for k, w in enumerate(want) if w[0] == label)
        near[v] = d[0][1] if len(d) == 1 or d[0][0] <= 0.3 else None
    expected = {}
    for v, label, *_, track in rows:
        votes = [near[r[0]] for r in rows if r[1] == label and r[5] == track and near[r[0]]]
        alias = min(votes, key=lambda c: (-votes.count(c), c)) if votes else None
        expected[v] = (near[v] or alias, "near" if near[v] else "track" if alias else "none")
    assert {r.vid: (r.canonical, r.how) for r in linkage.identities(df, centres, 0.3, track="track").collect()} == expected


def test_nothing_and_nulls(spark):
    assert linkage.complete(spark.createDataFrame([], SCHEMA), 0.5).collect() == []
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1), (2, 0, None, 0.0, 0.0, 1), (3, None, 0.0, 0.0, 0.0, 1)], SCHEMA)
    assert [tuple(r) for r in linkage.complete(df, 0.5).collect()] == [(1, 0, 1)]
    got = {r.vid: (r.canonical, r.how) for r in linkage.identities(df, linkage.centres(df, 0.5, 2), 0.3, track="track").collect()}
    assert got == {1: (1, "near"), 2: (1, "near"), 3: (None, "none")}


def test_whole_labels_equal_one_after_the_other_and_make_no_pairs(spark, rows, monkeypatch):
    want = {r[0]: min(m[0] for m in g) for g in one_after_the_other(rows, 0.5) for r in g}
    monkeypatch.setattr(linkage, "pairs", None)  # of no use to labels that are settled whole
    df = spark.createDataFrame([*rows, (90, None, 0.0, 0.0, 0.0, 1), (91, 1, None, 0.0, 0.0, 1)], SCHEMA)
    assert {r.vid: r.cluster for r in linkage.complete(df, 0.5, whole_labels=100).collect()} == want
    monkeypatch.undo()
    assert {r.vid: r.cluster for r in linkage.complete(df, 0.5, whole_labels=20).collect()} == want  # some of them in rounds
    assert linkage.complete(df.limit(0), 0.5, whole_labels=20).collect() == []


@pytest.mark.parametrize("held", [0, 7, 2000])
def test_linked_equals_one_after_the_other_at_ties(held, monkeypatch):
    monkeypatch.setattr(linkage, "MATRIX", held)
    r = random.Random(held)
    for radius in (0.1, 0.31, 0.7):
        places = sorted({tuple(round(r.gauss(0, 0.3), 1) for _ in "xyz") for _ in range(70)}, key=lambda _: r.random())
        want = one_after_the_other([(k, 0, *p) for k, p in enumerate(places)], radius)
        assert linkage.linked(np.array(places), radius).tolist() == [next(min(m[0] for m in g) for g in want if any(m[0] == k for m in g)) for k in range(len(places))]

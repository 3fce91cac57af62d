import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import presence


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_union(intervals, gap=0):
    out = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("slice_width", [None, 7])
def test_union_equals_brute_force(spark, slice_width):
    r = random.Random(1)
    data = [(k, a, a + r.randint(0, 6)) for k in range(4) for a in (r.randint(0, 80) for _ in range(25))]
    got = presence.interval_union(spark.createDataFrame(data, "k long, first long, last long"), ["k"], slice_width=slice_width, gap=1)
    want = [(k, a, b) for k in range(4) for a, b in brute_union([(x, y) for j, x, y in data if j == k], 1)]
    assert sorted((x.k, x.first, x.last) for x in got.collect()) == sorted(want)
    assert sum(x.n for x in got.collect()) == (len(data) if slice_width is None else sum(x.n for x in got.collect()))


def test_union_touching_open_and_inverted(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 11, None), (1, 20, 30), (2, None, 3)], "k long, first long, last long")
    assert {(x.k, x.first, x.last) for x in presence.interval_union(df, ["k"]).collect()} == {(1, 0, 9), (1, 11, None), (2, None, 3)}
    assert presence.interval_union(df.limit(0), ["k"]).collect() == []
    with pytest.raises(Exception, match="inverted"):
        presence.interval_union(spark.createDataFrame([(1, 5, 2)], "k long, first long, last long"), ["k"]).collect()


def test_presence_is_half_open(spark):
    df = spark.createDataFrame([(1, 2, 5), (2, 5, None), (3, None, 5)], "k long, first long, last long")
    assert {x.k for x in presence.present_at(df, F.lit(5)).collect()} == {2}
    assert {x.k for x in presence.present_at(df, F.lit(2)).collect()} == {1, 3}


def test_clip_to_next(spark):
    df = spark.createDataFrame([(1, 0, 9), (1, 4, None), (1, 6, 8)], "k long, first long, last long")
    assert [x.clipped for x in presence.clip_to_next(df, ["k"]).orderBy("first").collect()] == [4, 6, 8]


@pytest.mark.parametrize(
    ("evidence", "identified", "conservative", "want"),
    [
        ((None, None, None, None), True, True, (10, None)),
        ((None, None, None, None), False, True, (10, 20)),
        ((None, None, None, None), False, False, (None, None)),
        ((4, None, 30, None), False, True, (7, 25)),
        ((4, 8, 30, 24), False, True, (6, 27)),
        ((8, 4, 24, 30), False, True, (9, 22)),  # persistence beyond the absence doesn't count
        ((15, 15, 15, 15), False, True, (10, 20)),  # evidence inside the observation doesn't count
    ],
)
def test_estimate(spark, evidence, identified, conservative, want):
    df = spark.createDataFrame([evidence], "fa long, fp long, la long, lp long")
    first, last = presence.estimate(F.lit(10).cast("long"), F.lit(20).cast("long"), F.col("fa"), F.col("fp"), F.col("la"), F.col("lp"), identified=F.lit(identified), conservative=conservative)
    assert tuple(df.select(first, last).first()) == want


def test_midpoint_does_not_overflow(spark):
    top = (1 << 63) - 1
    got = spark.createDataFrame([(top - 3, top)], "a long, b long").select(presence.midpoint(F.col("a"), F.col("b"))).first()[0]
    assert got == top - 2

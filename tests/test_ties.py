"""Ties and sums whose result must not depend on the order in which rows come."""

from __future__ import annotations

import shutil
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from palimpsest.operators import association, presence, reconcile, trajectory
from palimpsest.plans import presence_queries, space_queries

SF = "/root/testdata/sf0.001"


def test_orders_of_one_stamp_are_one_snapshot(spark, tmp_path):
    shutil.copy(f"{SF}/lineitem.parquet", tmp_path)
    orders = [(k, 7, "F", 1.0, "1995-01-01 00:00:00", "2-HIGH") for k in (900_003, 900_009, 900_001)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    for order in (orders, orders[::-1]):
        spark.createDataFrame(order, names).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        (row,) = presence_queries.as_of_snapshot(spark, str(tmp_path)).collect()
        assert (row["entity"], row["order_id"], row["open"]) == (7, 900_009, True)


def test_a_mean_on_the_limit_does_not_depend_on_the_order(spark):
    values = [0.07, 0.03, 0.06, 0.04, 0.01, 0.09] * 100
    got = {spark.createDataFrame([(float(v),) for v in vs], "d double").coalesce(1).agg(reconcile.exact_mean("d")).first()[0] for vs in (values, sorted(values), sorted(values, reverse=True))}
    assert got == {0.05}
    doubles = {reduce(add, vs) / 600 for vs in (values, sorted(values), sorted(values, reverse=True))}
    assert doubles != {0.05}  # what a sum of doubles makes of it


def test_merges_of_one_number_go_by_their_target(spark):
    rows = [(1, 9, True, 5), (1, 4, True, 5), (1, 2, True, 6), (2, 3, True, 5), (2, 3, False, 5)]
    for order in (rows, rows[::-1]):
        got = association.merge_targets(spark.createDataFrame(order, "from_node long, to_node long, is_valid boolean, n long").coalesce(1), order="n")
        assert [tuple(r) for r in got.collect()] == [(1, 4)]


def test_a_path_has_no_place_at_its_end(spark):
    steps = [(0.7, 10, 7), (0.1, 10, 1)]  # as sums of doubles a little more and a little less
    rows = [(k, t, step * (t % 2)) for k, (step, n, _) in enumerate(steps) for t in range(n + 1)]
    assert reduce(add, [0.7] * 10) > 7
    got = trajectory.resampled(spark.createDataFrame(rows, "entity long, t long, x double"), "entity", "t", ["x"], 1.0)
    assert {r["entity"]: r["n"] for r in got.groupBy("entity").agg(F.max("place").alias("n")).collect()} == {0: 6, 1: 0}


def test_equal_segments_go_by_their_ids(spark):
    rows = [(1, k, 10, 90) for k in (8, 3, 5)] + [(1, 9, 40, 70)]
    for order in (rows, rows[::-1]):
        got = presence.clip_to_next(spark.createDataFrame(order, "entity long, order_id long, first long, last long").coalesce(1), ["entity"], ties=["order_id"])
        assert {r["order_id"]: r["clipped"] for r in got.collect()} == {3: 10, 5: 10, 8: 40, 9: 70}

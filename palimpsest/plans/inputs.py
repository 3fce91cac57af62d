"""The stand-ins that the registered queries run on: whole tables seen as observations, point clouds and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000  # stamps are microseconds here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, entity, t, verdict, value of each event."""
    verdict = F.when(F.col("event_type").isin("view", "click"), "present").when(F.col("event_type") == "error", "absent").otherwise("inconclusive")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity"), micros("ts").alias("t"), verdict.alias("verdict"), "value")


OBSERVATIONS = """o AS (SELECT event_id, user_id AS entity, epoch_us(ts) AS t, value,
    CASE WHEN event_type IN ('view', 'click') THEN 'present' WHEN event_type = 'error' THEN 'absent' ELSE 'inconclusive' END AS verdict FROM events)"""


def points(spark: SparkSession, sf_dir: str, session: int | None = None) -> DataFrame:
    """vid, label, x, y, z of the point cloud; sessions are even and odd ids."""
    e = table(spark, sf_dir, "embeddings")
    if session is not None:
        e = e.where(F.col("vec_id") % 2 == session)
    return e.select(F.col("vec_id").alias("vid"), "label", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])


POINTS = "p AS (SELECT vec_id AS vid, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), a AS (SELECT * FROM p WHERE vid % 2 = 0), b AS (SELECT * FROM p WHERE vid % 2 = 1)"


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, entity, first, last: from the order to its last shipment; open orders have no last."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_shipdate").alias("_s"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("entity"), micros("o_orderdate").alias("first"))
    return orders.join(shipped, "order_id", "left").select("order_id", "entity", "first", F.when(F.col("_s").isNotNull(), F.greatest(micros("_s"), F.col("first"))).alias("last"))


STAYS = """s AS (SELECT o_orderkey AS order_id, o_custkey AS entity, epoch_us(o_orderdate) AS first,
    CASE WHEN l.s IS NOT NULL THEN greatest(epoch_us(l.s), epoch_us(o_orderdate)) END AS last
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)"""

"""Contracts as data: one row per rule with passed and detail, computed in one pass where possible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("hard", "soft")


def gates(df: DataFrame, rules: Mapping[str, Column], *, severity: str = "hard") -> DataFrame:
    """rule, severity, n, failed, passed: how many rows break each rule (a null breaks it)."""
    if severity not in SEVERITIES:
        raise ValueError(f"severity is one of {SEVERITIES}")
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{k}") for k, rule in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{k}").alias("failed")) for k, name in enumerate(rules)])
    return counts.select("n", F.explode(rows).alias("x")).select("x.rule", F.lit(severity).alias("severity"), "n", "x.failed", (F.col("x.failed") == 0).alias("passed"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, side: those that are only expected ("missing") or only there ("unexpected")."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, list(keys), "left_anti").withColumn("side", F.lit("unexpected")))


def override(df: DataFrame, catalog: DataFrame, key: str, value: str) -> DataFrame:
    """df whose value comes from the catalog where the key is not 0; a key that the catalog lacks is an error."""
    met = df.join(catalog.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_known")), F.col(key) == F.col("_k"), "left")
    named = F.when(F.col(key) == 0, F.col(value)).when(F.col("_known"), F.col("_v")).otherwise(F.raise_error(F.lit("key outside the catalog")).cast(df.schema[value].dataType))
    return met.withColumn(value, named).drop("_k", "_v", "_known")


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, n, both, appeared, disappeared, changed, closer, farther: rows of two aligned runs."""
    met = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys), "full_outer")
    d = F.col("_b") - F.col("_a")
    t = F.col("threshold")
    wide = met.withColumn("threshold", F.explode(F.array(*map(F.lit, map(float, thresholds)))))
    return wide.groupBy("threshold").agg(
        F.count("*").alias("n"),
        F.count(d).alias("both"),
        F.count_if(F.col("_a").isNull()).alias("appeared"),
        F.count_if(F.col("_b").isNull()).alias("disappeared"),
        F.count_if(F.abs(d) > t).alias("changed"),
        F.count_if(d < -t).alias("closer"),
        F.count_if(d > t).alias("farther"),
    )


def run_gates(frames: DataFrame, done: DataFrame, mesh: DataFrame, *, seed: DataFrame, written: DataFrame, frame: str = "frame", stamp: str = "stamp") -> DataFrame:
    """rule, failed: the accounting of a run. frames: what came in; done: what was processed; seed and written: one column, what a
    session began with and what the one before it had written."""
    known, acted = frames.select(frame).distinct(), done.select(frame).distinct()
    one = lambda df, c: df.agg(c.alias("failed"))
    newest = frames.agg(F.max(stamp).alias("a")).crossJoin(done.agg(F.max(stamp).alias("b")))  # a row each
    a, b = seed.columns[0], written.columns[0]
    differ = seed.select(F.col(a).alias("s")).distinct().join(written.select(F.col(b).alias("w")).distinct(), F.col("s") == F.col("w"), "full_outer").where("s is null or w is null")
    rules = {
        "frames accounted for": one(known.join(acted, frame, "left_anti"), F.count("*")),
        "frames processed once": one(done.groupBy(frame).count().where("count > 1"), F.count("*")),
        "no unknown frame": one(done.join(known, frame, "left_anti"), F.count("*")),
        "final stamp reached": newest.select(F.when(F.col("b") >= F.col("a"), 0).otherwise(1).cast("long").alias("failed")),
        "mesh is not empty": one(mesh, F.when(F.count("*") > 0, 0).otherwise(1).cast("long")),
        "seed equals what was written": one(differ, F.count("*")),
    }
    out = None
    for name, df in rules.items():
        row = df.select(F.lit(name).alias("rule"), "failed")
        out = row if out is None else out.unionByName(row)
    return out


def dataset_checks(pixels: DataFrame, valid: Column, poses: DataFrame, pose: str, distances: DataFrame, distance: str, *, least_valid: float, most_mean: float) -> DataFrame:
    """rule, value, passed: the share of valid depths, the share of rigid poses, the mean distance of points that came back."""
    from ..functions.geometry import rigid

    rows = [
        pixels.agg(F.avg(valid.cast("int")).alias("value")).select(F.lit("valid depths").alias("rule"), "value", (F.col("value") >= least_valid).alias("passed")),
        poses.agg(F.avg(rigid(F.col(pose)).cast("int")).alias("value")).select(F.lit("rigid poses").alias("rule"), "value", (F.col("value") >= 1.0).alias("passed")),
        distances.agg(F.avg(distance).alias("value")).select(F.lit("mean distance").alias("rule"), "value", (F.col("value") <= most_mean).alias("passed")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])

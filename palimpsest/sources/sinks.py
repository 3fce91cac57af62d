"""Sinks that keep contracts: equal schemas on appending, staging before publishing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import scratch


def append_csv(df: DataFrame, path: str) -> None:
    """Appends to a CSV table, whose header must be the same."""
    spark = df.sparkSession
    fs = _fs(spark, path)
    if fs[0].exists(fs[1]) and (there := spark.read.option("header", True).csv(path).columns) != df.columns:
        raise ValueError(f"the table has columns {there}, the rows {df.columns}")
    df.write.mode("append").option("header", True).csv(path)


def _fs(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, gates: DataFrame | None = None) -> None:
    """Writes to a staging folder of the same store and renames it to path, which must not exist: readers see all or
    nothing. gates: rows of rule, severity, passed; a broken hard one keeps the rows from being published."""
    if gates is not None and (broken := [r["rule"] for r in gates.where("severity = 'hard' and not passed").limit(20).collect()]):
        raise ValueError(f"broken rules: {broken}")
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.staging-{scratch(spark, 'x').rpartition('-')[2]}")
    df.write.parquet(staging.toString())
    if not fs.rename(staging, target):
        raise OSError(f"{path} could not be published")


def manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n, and a digest of all rows that doesn't depend on their order: sums of two hashes in wide decimals."""
    h = [F.sum(F.xxhash64(F.lit(s), *[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")) for s in (1, 2)]
    return df.agg(F.count("*").alias("n"), F.count_distinct(*keys).alias("n_keys"), F.sha2(F.concat_ws("|", *[x.cast("string") for x in h]), 256).alias("digest"))


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result table as text; more rows than the limit are an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many rows for a text table")
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def manifest_json(row) -> str:
    return json.dumps(row.asDict(), sort_keys=True)


def write_audits(tables: dict[str, DataFrame], path: str) -> None:
    """Audit tables of a state as CSV with headers, a folder each, beside a manifest of their columns; the folder must not
    exist. Nested columns are written as JSON text."""
    for name, df in tables.items():
        flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in df.columns]
        df.select(*flat).write.option("header", True).csv(f"{path}/{name}")
        df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.text(f"{path}/_schemas/{name}")


def read_audit(spark, path: str, name: str) -> DataFrame:
    """An audit table with the types it was written with."""
    from pyspark.sql import types as T

    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_schemas/{name}").first()[0]))
    rows = spark.read.option("header", True).csv(f"{path}/{name}")
    return rows.select(*[F.from_json(f.name, f.dataType).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name).cast(f.dataType) for f in schema])

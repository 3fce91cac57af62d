"""Written tables in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this driver has written.
_paths: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where that is unset, a local master gets a temporary one;
    on a cluster, whose executors don't share such a folder, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", root)
    _paths.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def clear(spark: SparkSession) -> int:
    """Deletes what this driver has written so far, and says how many tables that were. DataFrames that read them are
    lost, so it is for after their results have been written or collected."""
    n = len(_paths)
    while _paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one task where a step holds its rows sorted or hashed.
ROWS_OF_A_TASK = 250_000
#: Parts, at least, to which a few large groups are dealt.
PARTS = 48


def dealt_by_rows(df: DataFrame, rows: int, *keys: str, most: int = ROWS_OF_A_TASK) -> DataFrame:
    """df dealt by its keys to as many tasks as rows, its number of rows, need. Spark sizes tasks by bytes as they are
    shuffled, and rows of few small numbers take some fifty times as much once they are sorted or hashed."""
    return df.repartition(max(1, -(-rows // most)), *keys)

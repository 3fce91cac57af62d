"""Tables that grow by epochs and are merged as they grow, in a folder of the shared store."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Run(NamedTuple):
    """Epochs from low to high, n of them."""

    low: int
    high: int
    n: int

    @property
    def name(self) -> str:
        return f"run-{self.low}-{self.high}-{self.n}"


class Runs:
    """Runs of one or more tables, whose rows are dealt by a column bucket. A run appears with all its tables by one rename: what a crash
    cuts off is not part of it, and after a restart the folder tells which epochs are there.

    Runs are of size classes: single epochs, fan of them, fan times fan and so on. When the newest fan runs are of one class they become one of the
    next, so there are fewer than fan of each, and a row is written again once a class. What was merged is deleted at the next merge;
    DataFrames read before that stay good until then."""

    def __init__(self, folder: str, fan: int = 8) -> None:
        if fan < 2:
            raise ValueError("fan is at least 2")
        self.folder, self.fan = folder.rstrip("/"), fan
        self._open: dict[tuple[str, str], DataFrame] = {}  # runs do not change, so their files are listed once

    def _fs(self, spark: SparkSession, name: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def _found(self, spark: SparkSession) -> list[Run]:
        fs, pattern = self._fs(spark, "run-*")
        names = [f.getPath().getName() for f in fs.globStatus(pattern) or []]
        return sorted((Run(*map(int, n.split("-")[1:])) for n in names), key=lambda r: (r.low, -r.high))

    def live(self, spark: SparkSession) -> list[Run]:
        """The runs that hold all epochs once, oldest first."""
        out: list[Run] = []
        for run in self._found(spark):
            if not out or run.high > out[-1].high:
                out.append(run)
        return out

    def newest(self, spark: SparkSession) -> int:
        """The newest epoch, -1 if there is none."""
        return max((r.high for r in self._found(spark)), default=-1)

    def read(self, spark: SparkSession, table: str, buckets: Collection[int] | None = None, *, since: int = -1) -> DataFrame | None:
        """The table's rows, of some buckets only: the files of others are not opened, nor those of runs that end before epoch since. None
        if there is no such run."""
        parts = [self._of(spark, r, table) for r in self.live(spark) if r.high >= since]
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts)
        return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))

    def _of(self, spark: SparkSession, run: Run, table: str) -> DataFrame:
        if (run.name, table) not in self._open:
            self._open[run.name, table] = _read(spark, f"{self.folder}/{run.name}", table)
        return self._open[run.name, table]

    def stage(self, spark: SparkSession, run: Run) -> Stage:
        return Stage(self, spark, run)

    def compact(self, spark: SparkSession, merge: Mapping[str, Callable[[DataFrame], DataFrame]]) -> int:
        """Merges while there is something to merge; merge says for each table what becomes of the rows of several runs. Returns the number of merges."""
        done = 0
        while True:
            last = self.live(spark)[-self.fan :]
            if len(last) < self.fan or len({self._class(r.n) for r in last}) > 1:
                return done
            self._delete_merged(spark)
            stage = self.stage(spark, Run(last[0].low, last[-1].high, sum(r.n for r in last)))
            for table, act in merge.items():
                stage.write(table, act(reduce(DataFrame.unionByName, [self._of(spark, r, table) for r in last])))
            stage.commit()
            done += 1

    def _class(self, n: int) -> int:
        k = 0
        while n >= self.fan:
            n, k = n // self.fan, k + 1
        return k

    def _delete_merged(self, spark: SparkSession) -> None:
        for run in set(self._found(spark)) - set(self.live(spark)):
            fs, path = self._fs(spark, run.name)
            fs.delete(path, True)
            self._open = {of: rows for of, rows in self._open.items() if of[0] != run.name}


class Stage:
    """A run that is being written beside the others."""

    def __init__(self, runs: Runs, spark: SparkSession, run: Run) -> None:
        self.runs, self.spark, self.run = runs, spark, run
        self._name = f"_staging-{uuid.uuid4().hex}"

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Writes rows, which have a column bucket, and reads them back. Large buckets get several files, small ones share a task."""
        path = f"{self.runs.folder}/{self._name}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/{table}")
        fs, schema = self.runs._fs(self.spark, f"{self._name}/{table}.schema")
        out = fs.create(schema, False)
        try:
            out.write(bytearray(rows.schema.json().encode()))
        finally:
            out.close()
        return _read(self.spark, path, table)

    def commit(self) -> None:
        fs, path = self.runs._fs(self.spark, self._name)
        if not fs.rename(path, self.runs._fs(self.spark, self.run.name)[1]):
            raise OSError(f"{self.run.name} could not be committed")


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}.schema")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.read.schema(T.StructType.fromJson(json.loads(text))).parquet(f"{path}/{table}")


def bucket(keys: list[str] | list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def buckets_of(rows: DataFrame, most: int) -> list[int]:
    """The buckets of rows: at most so many, whatever the rows."""
    return [r[0] for r in rows.select("bucket").distinct().limit(most).collect()]

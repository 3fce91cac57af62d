"""A sink that refuses late rows: each trigger's rows and the newest stamp so far appear together, by one rename."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import scratch


class LateRows(ValueError):
    """Rows of a trigger are older than those of a trigger before it."""


class EpochTable:
    """Triggers of a stream as folders epoch=<n> of a shared folder, for foreachBatch. An epoch is written beside the table and renamed into it
    with its rows and its mark; one that is there already, as when a stream restarts, is left as it is, so its rows count once. The
    mark is the newest stamp (column ts) of this epoch and all before it; a later epoch with an older row, with strict an equally old one, is
    an error, and nothing of it is kept. Without ts rows have no order to keep."""

    def __init__(self, folder: str, ts: str | None = None, *, strict: bool = False) -> None:
        self.folder, self.ts, self.strict = folder.rstrip("/"), ts, strict

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def epochs(self, spark: SparkSession) -> list[int]:
        fs, p = self._fs(spark, f"{self.folder}/epoch=*")
        return sorted(int(f.getPath().getName().partition("=")[2]) for f in fs.globStatus(p) or [])

    def mark(self, spark: SparkSession, before: int | None = None) -> int | None:
        """The newest stamp, of the epochs before one."""
        done = [e for e in self.epochs(spark) if before is None or e < before]
        return spark.read.parquet(f"{self.folder}/epoch={done[-1]}/mark").first()[0] if done else None

    def write(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch in self.epochs(spark):
            return
        staging = f"{self.folder}/_staging-{scratch(spark, 'x').rpartition('-')[2]}"
        batch.write.parquet(f"{staging}/rows")
        fs, path = self._fs(spark, staging)
        if self.ts:
            self._mark(spark, batch, epoch, staging)
        if not fs.rename(path, self._fs(spark, f"{self.folder}/epoch={epoch}")[1]):
            raise OSError(f"epoch {epoch} could not be committed")

    def _mark(self, spark: SparkSession, batch: DataFrame, epoch: int, staging: str) -> None:
        newest = self.mark(spark, epoch)
        low, high = spark.read.schema(batch.schema).parquet(f"{staging}/rows").agg(F.min(self.ts), F.max(self.ts)).first()
        if low is not None and newest is not None and (low < newest or (self.strict and low == newest)):
            fs, path = self._fs(spark, staging)
            fs.delete(path, True)
            raise LateRows(f"epoch {epoch} has a row of {low}, before {newest}")
        mark = max((s for s in (newest, high) if s is not None), default=None)
        spark.createDataFrame([(mark,)], f"mark {batch.schema[self.ts].dataType.simpleString()}").coalesce(1).write.parquet(f"{staging}/mark")

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All rows with their epoch; None before the first epoch."""
        done = self.epochs(spark)
        if not done:
            return None
        rows = spark.read.option("basePath", self.folder).parquet(*[f"{self.folder}/epoch={e}/rows" for e in done])
        return rows.withColumn("epoch", F.col("epoch").cast("long"))

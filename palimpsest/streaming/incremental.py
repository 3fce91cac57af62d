"""Incremental change detection: only what new evidence touches is scanned again, and the result equals a fresh scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import VERDICTS, Scan, bins, scan_bins
from ..plans.scratch import scratch
from .runs import Run, Runs, bucket, buckets_of


class ChangeState:
    """Counts of all evidence by key and bin, and the scan's results, as tables of epochs in a folder of the shared store.

    update() is meant for foreachBatch. A batch adds its own counts and the results of the keys it touches, dealt by key
    into buckets; of the counts before it only the touched keys' buckets are read. Counts and results of an epoch appear together. What a
    folder holds is found again by its name: after a restart the epochs it has are not added again, and one that was cut off is
    written anew. Every fan epochs become one (and so on), in which a key and bin has one row of counts and a key its newest result."""

    def __init__(self, keys: Sequence[str], ts: str, verdict: str, scan: Scan, folder: str | None = None, *, buckets: int = 32, fan: int = 8) -> None:
        self.keys, self.ts, self.verdict, self.scan, self.folder = list(keys), ts, verdict, scan, folder
        self.buckets, self.fan = buckets, fan
        self.spark: SparkSession | None = None
        self.runs: Runs | None = None

    def _open(self, spark: SparkSession) -> None:
        self.spark = spark
        if self.folder is None:
            self.folder = scratch(spark, "changes")
        self.runs = self.runs or Runs(self.folder, self.fan)

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.select("*", bucket(self.keys, self.buckets))

    def _summed(self, counts: DataFrame) -> DataFrame:
        return counts.groupBy(*self.keys, "bin", "bucket").agg(*[F.sum(v).alias(v) for v in VERDICTS])

    def _newest(self, results: DataFrame) -> DataFrame:
        kept = [c for c in results.columns if c not in ("bucket", *self.keys)]
        return results.groupBy(*self.keys, "bucket").agg(F.max_by(F.struct(*kept), "epoch").alias("_r")).select(*self.keys, "_r.*", "bucket")

    def update(self, batch: DataFrame, epoch: int) -> None:
        self._open(batch.sparkSession)
        if epoch <= self.runs.newest(self.spark):
            return
        stage = self.runs.stage(self.spark, Run(epoch, epoch, 1))
        new = stage.write("counts", self._dealt(bins(batch, self.keys, self.ts, self.verdict, self.scan.resolution)))
        old = self.runs.read(self.spark, "counts", buckets_of(new, self.buckets))
        # bucket is a key of the join as well, so that the hash of the keys is compared first
        whole = new if old is None else new.unionByName(old.join(new.select(*self.keys, "bucket").distinct(), [*self.keys, "bucket"], "left_semi"))
        found = scan_bins(self._summed(whole), self.keys, self.scan).withColumn("epoch", F.lit(epoch).cast("long"))
        stage.write("results", self._dealt(found))
        stage.commit()
        self.runs.compact(self.spark, {"counts": self._summed, "results": self._newest})

    @property
    def result(self) -> DataFrame:
        """The newest result of every key."""
        return self._newest(self.runs.read(self.spark, "results")).drop("epoch", "bucket")


def every(n: int, act):
    """A foreachBatch function that acts on every n-th micro-batch, from the first."""

    def run(batch: DataFrame, epoch: int) -> None:
        if epoch % n == 0:
            act(batch, epoch)

    return run

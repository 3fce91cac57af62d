"""A saved state: versioned snapshots of a timeline in one folder, and the questions that its readers ask."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.presence import is_present

#: The layout that is written; older ones are brought to it on reading.
VERSION = 2


class StateStore:
    """Snapshots under folder/version=<v>/stamp=<s>.<k>/table=<t>, k counting the writings of a stamp, of which the last holds. A
    snapshot is written beside them and appears by one rename, with all its tables. Version 1 had no stamps of absence: its objects are open."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _stamps(self) -> dict[int, tuple[int, int]]:
        """Stamps, with the number of their last writing and the version that is in; a directory a snapshot."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version=*/stamp=*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        out: dict[int, tuple[int, int]] = {}
        for f in found:
            stamp, _, k = f.getPath().getName().partition("=")[2].partition(".")
            version = int(f.getPath().getParent().getName().partition("=")[2])
            out[int(stamp)] = max(out.get(int(stamp), (-1, 0)), (int(k or 0), version))
        return out

    @property
    def stamps(self) -> list[int]:
        return sorted(self._stamps())

    @property
    def num_time_steps(self) -> int:
        return len(self._stamps())

    @property
    def earliest(self) -> int | None:
        return min(self._stamps(), default=None)

    @property
    def latest(self) -> int | None:
        return max(self._stamps(), default=None)

    def append(self, stamp: int, vertices: DataFrame, objects: DataFrame, version: int = VERSION) -> None:
        """Adds a snapshot; an earlier one than the latest is an error, an equal one is written again."""
        if (latest := self.latest) is not None and stamp < latest:
            raise ValueError(f"snapshot {stamp} is older than {latest}")
        k = self._stamps().get(stamp, (-1, 0))[0] + 1
        path = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        staging, target = f"_staging-{uuid.uuid4().hex}", path(f"version={version}/stamp={stamp}.{k}")
        for name, df in (("vertices", vertices), ("objects", objects)):
            df.write.parquet(f"{self.folder}/{staging}/table={name}")
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(path(staging), target):
            raise OSError(f"snapshot {stamp} could not be published")

    def extend(self, later: StateStore) -> None:
        """Appends another timeline, which must begin after this one ends; its snapshots are copied in order."""
        latest, stamps = self.latest, later.stamps
        if latest is not None and stamps and stamps[0] <= latest:
            raise ValueError(f"the other timeline begins at {stamps[0]}, not after {latest}")
        for stamp in stamps:
            self.append(stamp, later._read(stamp, "vertices"), later._read(stamp, "objects"))

    def answering(self, t: int) -> int:
        """The first snapshot at or after t, which knows most, clamped to the timeline."""
        stamps = self.stamps
        if not stamps:
            raise ValueError("the state has no snapshot")
        return next((s for s in stamps if s >= t), stamps[-1])

    def _read(self, stamp: int, name: str) -> DataFrame:
        k, version = self._stamps()[stamp]
        df = self.spark.read.parquet(f"{self.folder}/version={version}/stamp={stamp}.{k}/table={name}")
        return df.withColumn("last", F.lit(None).cast("long")) if version < 2 and name == "objects" and "last" not in df.columns else df

    def mesh_at(self, t: int) -> DataFrame:
        return self._read(self.answering(t), "vertices").where(F.col("first_seen") <= t)

    def objects_at(self, t: int) -> DataFrame:
        """Objects known by t and present then. What has no effective time of its own has its first stamp."""
        objects = self._read(self.answering(t), "objects")
        return objects.where((F.coalesce("effective", "first") <= t) & is_present(F.col("first"), F.col("last"), F.lit(t)))

"""The bounded frame buffer as a stream, whose state can expire."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.frame_buffer import LEFT, Rule, buffer_step, held, start


class FrameBuffer(StatefulProcessor):
    """Rows (key, ts, kind, track). A trigger's rows may come in any order; one that is older than what the key has seen is an error.
    expire: milliseconds without a row after which a key's state is forgotten, so that sensors that are gone take no room; that needs
    processing time, for which a stream that runs on is meant (a trigger of availableNow did not end by itself with it)."""

    def __init__(self, rule: Rule, expire: int | None = None) -> None:
        self.rule, self.expire = rule, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "body string", self.expire) if self.expire else handle.getValueState("now", "body string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, out = json.loads(self.now.get()[0]) if self.now.exists() else start(), []
        got = [r for batch in rows for r in zip(*[batch[c].tolist() for c in ("ts", "kind", "track")], strict=True)]
        for ts, kind, track in sorted(got, key=lambda r: (r[0], r[1], r[2] or "")):
            if now["newest"] is not None and ts < now["newest"]:
                raise ValueError(f"sensor {key[0]}: a row of {ts} is older than {now['newest']}")
            out += buffer_step(now, kind, int(ts), track, self.rule)
        self.now.update((json.dumps(now),))
        frame = pd.DataFrame([(key[0], *r) for r in out + held(now)], columns=["key", "frame", "gone", "reason"])
        yield frame.astype({"gone": "Int64"})

    def close(self) -> None:
        pass


def buffered(rows: DataFrame, rule: Rule, *, expire: int | None = None) -> DataFrame:
    """A stream of (key long, ts long, kind, track) as a stream of the frames that leave, and of those that are held after each trigger."""
    return rows.groupBy("key").transformWithStateInPandas(FrameBuffer(rule, expire), outputStructType=f"key long, {LEFT}", outputMode="Update", timeMode="ProcessingTime" if expire else "None")


def last_buffers(emitted: DataFrame) -> DataFrame:
    """What has left, and what is held after each key's last trigger, of emitted rows with their epoch."""
    newest = F.max("epoch").over(Window.partitionBy("key"))
    return emitted.withColumn("_e", newest).where((F.col("reason") != "held") | (F.col("epoch") == F.col("_e"))).select("key", "frame", "gone", "reason")

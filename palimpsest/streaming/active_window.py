"""The active window as a stream: observations wait until the watermark has passed them, are taken in order of time, and a track is
emitted once, when the timer of its leaving fires."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.active_window import TRACK, Rule, close, observe

PENDING = "t long, ord long, x double, y double, z double"
OPEN = "track long, first long, last long, n long, x0 double, y0 double, z0 double, x double, y double, z double, far double"


class ActiveWindow(StatefulProcessor):
    """Rows (key, ts, t, ord, x, y, z). State of a key: the observations that the watermark has not passed, the open tracks and the next
    number, of which the first is bounded by what arrives within the watermark's delay, the second by what the window holds."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.open = handle.getListState("open", OPEN)
        self.number = handle.getValueState("number", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            got = list(zip(*[batch[c].tolist() for c in ("t", "ord", "x", "y", "z")], strict=True))
            if got:
                self.pending.appendList(got)
                low = min(r[0] for r in got)
                earliest = low if earliest is None else min(earliest, low)
        if earliest is not None:
            self._wake(earliest, timerValues)
        return iter(())

    def _wake(self, micros: int, timerValues: Any) -> None:
        """A timer in milliseconds, not before the watermark has passed the stamp."""
        self.handle.registerTimer(max(-(-micros // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        known = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.pending.get()) if self.pending.exists() else []
        ready, later = sorted(r for r in waiting if r[0] <= known), [tuple(r) for r in waiting if r[0] > known]
        open_ = [(*t[:4], tuple(t[4:7]), tuple(t[7:10]), t[10]) for t in (self.open.get() if self.open.exists() else [])]
        number, out = self.number.get()[0] if self.number.exists() else 0, []
        for t, _, *place in ready:
            open_, number, rows = observe(open_, number, t, tuple(place), self.rule)
            out += rows
        open_, rows = close(open_, known, self.rule)
        out += rows
        if ready:
            self.pending.put(later) if later else self.pending.clear()
        self.open.put([(*t[:4], *t[4], *t[5], t[6]) for t in open_]) if open_ else self.open.clear()
        self.number.update((number,))
        wakes = [r[0] for r in later] + [t[2] + self.rule.window + 1 for t in open_]
        if wakes:
            self._wake(min(wakes), timerValues)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *[c.split()[0] for c in TRACK.split(", ")]])

    def close(self) -> None:
        pass


def window_tracks(observations: DataFrame, rule: Rule, *, late: str = "0 seconds") -> DataFrame:
    """A stream of (key long, ts timestamp, ord long, x, y, z) as a stream of closed tracks (key and TRACK). Rows may come in any order within
    the delay late, so a result does not depend on how they are dealt to triggers."""
    rows = observations.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("t"), "ord", "x", "y", "z")
    return rows.groupBy("key").transformWithStateInPandas(ActiveWindow(rule), outputStructType=f"key long, {TRACK}", outputMode="Append", timeMode="EventTime")

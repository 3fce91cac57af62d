"""Fragments of identified objects as a stateful stream: where an object has moved, one ends and the next begins. Contradiction and support
are in streaming.persistent_states."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A closed or current fragment: key, fragment, birth, last_support, death (null: current), n.
FRAGMENT = "key long, fragment long, birth long, last_support long, death long, n long"
STATE = "fragment long, birth long, last_support long, n long, x double, y double, z double"


class Fragments(StatefulProcessor):
    """Rows (key, ts, x, y, z) in order of ts within each key and batch. A step of more than move from the fragment's
    first position closes it and begins the next; each change is emitted. State is one row per key."""

    def __init__(self, move: float) -> None:
        self.move = move

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "x", "y", "z"]).drop_duplicates("ts")
        now = list(self.now.get()) if self.now.exists() else None
        out = []
        for r in batch.itertuples(index=False):
            if now and r.ts <= now[2]:
                if r.ts < now[2]:
                    raise ValueError(f"object {key[0]}: {r.ts} is older than {now[2]}")
                continue
            if now and (r.x - now[4]) ** 2 + (r.y - now[5]) ** 2 + (r.z - now[6]) ** 2 <= self.move**2:
                now[2], now[3] = int(r.ts), now[3] + 1
                continue
            if now:
                out.append((key[0], now[0], now[1], now[2], int(r.ts), now[3]))
            now = [now[0] + 1 if now else 0, int(r.ts), int(r.ts), 1, float(r.x), float(r.y), float(r.z)]
        if now:
            self.now.update(tuple(now))
            out.append((key[0], now[0], now[1], now[2], None, now[3]))
        frame = pd.DataFrame(out, columns=["key", "fragment", "birth", "last_support", "death", "n"])
        yield frame.astype({"death": "Int64"})

    def close(self) -> None:
        pass


def fragments(observations: DataFrame, move: float) -> DataFrame:
    """A stream of (key, ts, x, y, z) as a stream of fragments; the last row of each (key, fragment) holds."""
    return observations.groupBy("key").transformWithStateInPandas(Fragments(move), outputStructType=FRAGMENT, outputMode="Update", timeMode="None")

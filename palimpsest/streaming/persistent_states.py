"""Persistent states of identified entities as a stream: observations, support and contradiction, and a session that begins with the
states that another one ended with."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.objects import SEED, state_rows, state_step

#: Columns of an event, and of what is emitted: closed states once, and the states that are open after each trigger.
EVENT = "key long, kind string, first long, last long, order long, cells array<long>, moved boolean"
OUT = "key long, fragment long, birth long, last_support long, death long, cells long, status string"


def _dump(now: dict) -> str:
    candidates = [{**c, "cells": sorted(c["cells"])} for c in now["open"]]
    return json.dumps({**now, "cells": sorted(now["cells"]), "open": candidates, "known": [now["known"][0], sorted(now["known"][1])]})


def _load(text: str) -> dict:
    now = json.loads(text)
    return {**now, "cells": set(now["cells"]), "open": [{**c, "cells": set(c["cells"])} for c in now["open"]], "known": (now["known"][0], set(now["known"][1]))}


class PersistentStates(StatefulProcessor):
    """The fold of objects.persistent_states over triggers. A key's state is its cells and candidates. Events of a trigger may come in
    any order; one that is older than what the key has seen is an error."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "body string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        now = _load(self.now.get()[0]) if self.now.exists() else None
        for r in initialState.sort_values(["first", "last"]).itertuples(index=False):
            now = state_step(now, SEED, int(r.first), int(r.last), [int(c) for c in r.cells], False)[0]
        self.now.update((_dump(now),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, out = _load(self.now.get()[0]) if self.now.exists() else None, []
        got = [r for batch in rows for r in zip(*[batch[c].tolist() for c in ("first", "kind", "order", "last", "cells", "moved")], strict=True)]
        for first, kind, _, last, cells, moved in sorted(got, key=lambda r: r[:3]):
            if now and now["known"][0] is not None and first < now["known"][0]:
                raise ValueError(f"entity {key[0]}: an event of {first} is older than {now['known'][0]}")
            now, closed = state_step(now, kind, int(first), int(last), [] if cells is None else [int(c) for c in cells], bool(moved))
            out += closed
        if now:
            self.now.update((_dump(now),))
            out += state_rows(now)
        frame = pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in OUT.split(", ")])
        yield frame.astype({"fragment": "Int64", "death": "Int64"})

    def close(self) -> None:
        pass


def persistent_states(events: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """A stream of events (EVENT) as a stream of states (OUT). seeds: a table of key, first, last, cells that the first trigger begins with."""
    start = None if seeds is None else seeds.groupBy("key")
    return events.groupBy("key").transformWithStateInPandas(PersistentStates(), outputStructType=OUT, outputMode="Update", timeMode="None", initialState=start)


def last_states(emitted: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """What holds after the last trigger, of emitted rows with their epoch: closed states, and each key's open ones of its last epoch; keys
    that had seeds but no event hold these."""
    newest = F.max("epoch").over(Window.partitionBy("key"))
    rows = emitted.withColumn("_e", newest).where((F.col("status") == "closed") | (F.col("epoch") == F.col("_e"))).select(*[c.split()[0] for c in OUT.split(", ")])
    if seeds is None:
        return rows
    quiet = seeds.join(emitted.select("key").distinct(), "key", "left_anti")
    held = quiet.select("key", F.lit(0).cast("long").alias("fragment"), F.col("first").alias("birth"), F.col("last").alias("last_support"), F.lit(None).cast("long").alias("death"), F.size(F.array_distinct("cells")).cast("long").alias("cells"), F.lit("current").alias("status"))
    return rows.unionByName(held)

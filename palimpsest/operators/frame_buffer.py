"""A bounded buffer of frames per sensor: what no live track refers to is dropped, of every few frames one is stored, the newest stand in for
those between, and the oldest go where there are too many. One step, folded in batch here and by streaming.frame_buffer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import ordered_fold

#: Kinds of rows: of one stamp, what tracks see comes before the frame itself.
SIGHT, FRAME = "0 sight", "1 frame"
#: A frame, when it left the buffer (null: it is held), and why: unreferenced, replaced, oldest, or held.
LEFT = "frame bigint, gone bigint, reason string"


@dataclass(frozen=True)
class Rule:
    """size: frames held at most. every: of so many frames one is stored. window: a track is live while it was seen within it."""

    size: int
    every: int = 1
    window: int = 0

    def __post_init__(self) -> None:
        if self.size < 1 or self.every < 1:
            raise ValueError("a buffer holds a frame at least, and stores one of every so many")


def start() -> dict:
    return {"frames": [], "count": 0, "tracks": {}, "newest": None}


def buffer_step(now: dict, kind: str, ts: int, track: str | None, rule: Rule) -> list[tuple]:
    """One row; changes now, and returns the frames that leave. State is the frames, at most size of them, and the live tracks with
    the stamps of buffered frames that they refer to."""
    now["newest"] = ts
    if kind == SIGHT:
        if track is not None:
            last, seen = now["tracks"].get(track, (ts, []))
            now["tracks"][track] = (ts, [*seen, ts] if not seen or seen[-1] != ts else seen)
        return []
    now["tracks"] = {k: v for k, v in now["tracks"].items() if v[0] >= ts - rule.window}
    used = {s for _, seen in now["tracks"].values() for s in seen}
    out = [(f, ts, "unreferenced") for f in now["frames"] if f not in used]
    frames = [f for f in now["frames"] if f in used]
    if now["count"] and frames:
        out.append((frames.pop(), ts, "replaced"))
    frames.append(ts)
    if len(frames) > rule.size:
        out.append((frames.pop(0), ts, "oldest"))
    held = set(frames)
    now["tracks"] = {k: (last, [s for s in seen if s in held]) for k, (last, seen) in now["tracks"].items()}
    now["frames"], now["count"] = frames, (now["count"] + 1) % rule.every
    return out


def held(now: dict) -> list[tuple]:
    return [(f, None, "held") for f in now["frames"]]


def buffered(rows: DataFrame, key: str, rule: Rule) -> DataFrame:
    """key and LEFT of every frame. rows: key, ts (long), kind, track (string, null for frames), in order of ts, kind and track."""

    def step(now, row: tuple):
        now = now or {**start(), "key": row[0]}
        return now, [(row[0], *r) for r in buffer_step(now, row[2], row[1], row[3], rule)]

    kind = rows.schema[key].dataType.simpleString()
    own = rows.select(key, F.col("ts").cast("long").alias("ts"), "kind", "track")
    return ordered_fold(own, [key], ["ts", "kind", "track"], step, lambda now: [(now["key"], *r) for r in held(now)], f"`{key}` {kind}, {LEFT}")

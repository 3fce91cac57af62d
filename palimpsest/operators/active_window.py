"""The active window of a tracker: observations join a track that has been seen lately, and a track that leaves the window is closed
once. The step is one function of a key's state and next row; the batch form folds over it here, the stream in streaming.active_window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import ordered_fold

#: A closed track. confidence is full at twice the least number of observations; far is the largest distance from the first place.
TRACK = "track bigint, first bigint, last bigint, n bigint, confidence double, far double, dynamic boolean"


@dataclass(frozen=True)
class Rule:
    """A track is active while it was seen within the window. reach: how far an observation may be from a track's last place,
    None: any, so that a key has one track at a time. It is dynamic if it has been as far as move from its first place."""

    window: int
    reach: float | None = None
    least: int = 2
    move: float = 1.0


#: An open track: number, first, last, n, first place, last place, far.
Open = tuple[int, int, int, int, tuple[float, ...], tuple[float, ...], float]


def _distance(a: Sequence[float], b: Sequence[float]) -> float:
    return sum((p - q) ** 2 for p, q in zip(a, b, strict=True)) ** 0.5


def close(open_: list[Open], now: int, rule: Rule) -> tuple[list[Open], list[tuple]]:
    """The tracks that are still active at a time, and rows of those that have left, in order of their numbers."""
    left = [t for t in open_ if t[2] < now - rule.window]
    rows = [(t[0], t[1], t[2], t[3], min(t[3] / (2 * rule.least), 1.0), t[6], t[6] >= rule.move) for t in left]
    return [t for t in open_ if t[2] >= now - rule.window], rows


def observe(open_: list[Open], number: int, ts: int, place: tuple[float, ...], rule: Rule) -> tuple[list[Open], int, list[tuple]]:
    """One observation: open tracks, the next number, and the tracks that it finds closed. It joins the nearest active track within
    reach, the smaller number on a tie; a track takes one observation a stamp, unless there is no reach."""
    open_, rows = close(open_, ts, rule)
    free = [(0.0 if rule.reach is None else _distance(t[5], place), t[0], k) for k, t in enumerate(open_) if rule.reach is None or t[2] < ts]
    best = min(free, default=None)
    if best is None or (rule.reach is not None and best[0] > rule.reach):
        return [*open_, (number, ts, ts, 1, place, place, 0.0)], number + 1, rows
    t = open_[best[2]]
    open_[best[2]] = (t[0], t[1], ts, t[3] + 1, t[4], place, max(t[6], _distance(t[4], place)))
    return open_, number, rows


def window_tracks(observations: DataFrame, key: str, ts: str, order: str, coords: Sequence[str], rule: Rule, until: int) -> DataFrame:
    """key and the closed tracks: those that have left the window at the time until, which is what is known. Rows in order of ts,
    then order; a key's state is its open tracks."""
    rows = observations.select(key, F.col(ts).cast("long"), F.col(order).cast("long"), *[F.col(c).cast("double") for c in coords])

    def step(now, row: tuple):
        open_, number, _ = now or ([], 0, row[0])
        open_, number, out = observe(open_, number, row[1], row[3:], rule)
        return (open_, number, row[0]), [(row[0], *r) for r in out]

    def end(now) -> list[tuple]:
        return [(now[2], *r) for r in close(now[0], until, rule)[1]]

    kind = observations.schema[key].dataType.simpleString()
    return ordered_fold(rows, [key], [ts, order], step, end, f"`{key}` {kind}, {TRACK}")

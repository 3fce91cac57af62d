"""Histories of identified entities: fragments of equal state, persistent states, canonical identities and merge chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fold import ordered_fold


def fragments(observations: DataFrame, key: str, ts: str, coords: Sequence[str], move: float) -> DataFrame:
    """key, fragment, birth, last_support, death, n, status: the observations of an entity in order; a step of more than
    move from the fragment's first position begins a new one, which ends the former. The last one is current.

    Of equal stamps the least position counts. An ordered fold whose state is one fragment per key."""
    least = observations.groupBy(key, ts).agg(F.min(F.struct(*[F.col(c).cast("double").alias(f"p{k}") for k, c in enumerate(coords)])).alias("p"))
    once = least.select(key, F.col(ts).cast("long").alias("ts"), "p.*")

    def closed(now: list, death: int | None) -> tuple:
        return (now[0], now[1], now[2], now[3], death, now[4], "current" if death is None else "closed")

    def step(now: list | None, row: tuple) -> tuple[list, list[tuple]]:
        place = row[2:]
        if now is None:
            return [row[0], 0, row[1], row[1], 1, place], []
        if sum((a - b) ** 2 for a, b in zip(place, now[5], strict=True)) > move * move:
            return [row[0], now[1] + 1, row[1], row[1], 1, place], [closed(now, row[1])]
        return [*now[:3], row[1], now[4] + 1, now[5]], []

    kind = once.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, fragment bigint, birth bigint, last_support bigint, death bigint, n bigint, status string"
    return ordered_fold(once, [key], ["ts"], step, lambda now: [closed(now, None)], schema)


def geometry_owner(segments: DataFrame, key: str, order: Sequence[str], *, moved: Column, support: Column) -> DataFrame:
    """key with its owning segment (as struct owner): the newest that moved, else the newest with the most support."""
    rank = Window.partitionBy(key).orderBy(moved.cast("int").desc(), F.when(moved, F.lit(0)).otherwise(support).desc(), *[F.col(c).desc() for c in order])
    return segments.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def geometry_holder(segments: DataFrame, key: str, node: str, order: Sequence[str], *, x0: Sequence[str], x1: Sequence[str], motion: str, support: str, size: str, move: float) -> DataFrame:
    """key, node: the segment whose geometry an entity has. In order, a segment with points takes over if it moved, if its
    box is apart from the holder's and their centres are at least move apart, or if it has no less support. An ordered fold
    whose state is one segment; entities whose segments have no points are not returned."""
    n, k = len(x0), len(order)
    rows = segments.where(F.col(size) > 0).select(key, *order, node, F.col(motion).cast("boolean"), F.col(support).cast("double"), *[F.col(c).cast("double") for c in (*x0, *x1)])

    def step(held: tuple | None, row: tuple) -> tuple[tuple, list]:
        if held is None or row[k + 2] or row[k + 3] >= held[k + 3]:
            return row, []
        a, b, c, d = held[k + 4 : k + 4 + n], held[k + 4 + n :], row[k + 4 : k + 4 + n], row[k + 4 + n :]
        apart = any(q < r or s < p for p, q, r, s in zip(a, b, c, d, strict=True))
        far = sum(((p + q - r - s) / 2) ** 2 for p, q, r, s in zip(a, b, c, d, strict=True)) >= move * move
        return (row, []) if apart and far else (held, [])

    schema = T.StructType([segments.schema[key], segments.schema[node]])
    return ordered_fold(rows, [key], list(order), step, lambda held: [(held[0], held[k + 1])], schema)


#: Kinds of events of a persistent state; seeds come first, of equal stamps observations before verdicts.
SEED, OBSERVED, SUPPORTED, CONTRADICTED = "0 seed", "1 observed", "2 supported", "3 contradicted"
STATES = "fragment bigint, birth bigint, last_support bigint, death bigint, cells bigint, status string"


def _absorb(now: dict, reach) -> None:
    """The current fragment takes up the candidates that reach tells, until none is left that it tells."""
    more = True
    while more:
        more = False
        for c in now["open"]:
            if reach(c):
                now["cells"] |= c["cells"]
                now["last"], now["birth"] = max(now["last"], c["last"]), min(now["birth"], c["birth"])
                now["open"].remove(c)
                more = True
                break


def _closed(now: dict, stamp: int) -> tuple:
    return now["n"], now["birth"], now["last"], max(stamp, now["last"]), len(now["cells"]), "closed"


def state_step(now: dict | None, kind: str, first: int, last: int, cells: Sequence[int], moved: bool) -> tuple[dict, list[tuple]]:
    """One event of an entity. An observation that shares a cell with the current fragment, or of a time at which that was
    known to be there, supports it; one with motion closes it and opens the next; another one is a candidate, unresolved.
    Support takes up the candidates born by then. A contradiction closes the current fragment and promotes the newest
    candidate. Whatever the current fragment comes to share a cell with is absorbed. An interval counts once; as events come in order of
    first, only the intervals of the newest first are remembered."""
    now = now or {"n": -1, "current": False, "cells": set(), "birth": 0, "last": 0, "open": [], "known": (None, set()), "moved": False}
    out: list[tuple] = []

    def begin(cells: set, birth: int, last: int) -> None:
        now.update(n=now["n"] + 1, current=True, cells=cells, birth=birth, last=last)

    def touches(c: dict) -> bool:
        return not now["cells"].isdisjoint(c["cells"])

    if now["known"][0] != first:
        now["known"] = (first, set())
    if kind in (SEED, OBSERVED):
        if last in now["known"][1]:
            return now, out
        now["known"][1].add(last)
        here = set(cells or ())
        if not here:
            return now, out  # a trajectory without a surface
        if not now["current"]:
            begin(here, first, last)
            now["moved"] |= moved
            _absorb(now, touches)
        elif not now["cells"].isdisjoint(here) or now["last"] >= first:
            now["cells"] |= here
            now["last"] = max(now["last"], last)
            _absorb(now, touches)
        elif moved:
            out.append(_closed(now, first))
            begin(here, first, last)
            now["moved"] = True
        else:
            for c in now["open"]:
                if not c["cells"].isdisjoint(here):
                    c["cells"] |= here
                    c["last"] = max(c["last"], last)
                    break
            else:
                now["open"].append({"cells": here, "birth": first, "last": last})
    elif now["current"] and kind == SUPPORTED:
        now["last"] = max(now["last"], last)
        _absorb(now, lambda c: c["birth"] <= last)
    elif now["current"] and kind == CONTRADICTED:
        out.append(_closed(now, last))
        now.update(current=False, moved=True)
        if now["open"]:
            newest = max(now["open"], key=lambda c: c["last"])
            now["open"].remove(newest)
            begin(newest["cells"], newest["birth"], newest["last"])
            _absorb(now, touches)
    return now, out


def state_rows(now: dict) -> list[tuple]:
    """The states that are open: the current one and the candidates."""
    out = [(now["n"], now["birth"], now["last"], None, len(now["cells"]), "current")] if now["current"] else []
    return out + [(None, c["birth"], c["last"], None, len(c["cells"]), "unresolved") for c in now["open"]]


def persistent_states(events: DataFrame, key: str) -> DataFrame:
    """key, fragment, birth, last_support, death, cells, status: the states of identified entities.

    events: key, kind (see above), first, last, order (a long that breaks ties), cells (array<long>, the cells of the
    surface), moved. closed fragments have ended, current is the one that holds; candidates that nothing has resolved
    are unresolved and have no number. A fold in order of first, kind and order; its state is the entity's cells."""
    rows = events.select(key, "first", "kind", "order", "last", "cells", F.coalesce("moved", F.lit(False)).alias("moved"))

    def step(now: dict | None, row: tuple) -> tuple[dict, list[tuple]]:
        now, out = state_step(now, row[2], row[1], row[4], row[5], row[6])
        now["key"] = row[0]
        return now, [(row[0], *r) for r in out]

    def end(now: dict) -> list[tuple]:
        return [(now["key"], *r) for r in state_rows(now)]

    kind = events.schema[key].dataType.simpleString()
    return ordered_fold(rows, [key], ["first", "kind", "order"], step, end, f"`{key}` {kind}, {STATES}")


def session_seeds(current: DataFrame, key: str) -> DataFrame:
    """node, key, kind, first, last: the first events of a later session, one a state that holds; history stays behind."""
    return current.where("status = 'current'").select(F.concat(F.lit("M"), F.col(key).cast("string")).alias("node"), key, F.lit(SEED).alias("kind"), F.col("birth").alias("first"), F.col("last_support").alias("last"))


def verdict_events(evidence: DataFrame, keys: Sequence[str], verdict: str, ts: str) -> DataFrame:
    """keys, kind, stamp: any sight supports the state that is held, else any absence contradicts it, else nothing."""
    out = evidence.groupBy(*keys).agg(*[F.max(F.when(F.col(verdict) == v, F.col(ts))).alias(f"_{v}") for v in ("present", "absent")])
    kind = F.when(F.col("_present").isNotNull(), SUPPORTED).when(F.col("_absent").isNotNull(), CONTRADICTED)
    return out.select(*keys, kind.alias("kind"), F.coalesce("_present", "_absent").alias("stamp")).where("kind is not null")


def merged_into(merges: DataFrame, from_col: str = "from_node", to_col: str = "to_node", *, rounds: int = 40) -> DataFrame:
    """node, final: the end of each chain of merges; ends are their own. A node has one target; chains double their reach
    each round, so rounds go with the logarithm of the longest. A cycle is an error."""
    from ..plans.scratch import saved

    steps = merges.select(F.col(from_col).alias("node"), F.col(to_col).alias("final")).where("node <> final").distinct()
    ends = steps.select(F.col("final").alias("node")).distinct().join(steps.select("node"), "node", "left_anti")
    now = saved(steps, "chains")
    for _ in range(rounds):
        further = now.select(F.col("node").alias("final"), F.col("final").alias("_next"))
        after = saved(now.join(further, "final", "left").select("node", F.coalesce("_next", "final").alias("final"), F.col("_next").isNotNull().alias("_on")), "chains")
        now = after.select("node", "final")
        if after.where("_on").isEmpty():
            return now.unionByName(ends.select("node", F.col("node").alias("final")))
    raise RuntimeError(f"merges form a cycle, or a chain of more than 2 ** {rounds}")


def merge_status(nodes: DataFrame, merges: DataFrame, node: str, from_col: str = "from_node", to_col: str = "to_node") -> DataFrame:
    """node, status: merged_away, final_merged (the end of a chain) or final_unmerged."""
    away = merges.select(F.col(from_col).alias(node), F.lit(True).alias("_a")).distinct()
    into = merges.select(F.col(to_col).alias(node), F.lit(True).alias("_i")).distinct()
    met = nodes.select(node).join(away, node, "left").join(into, node, "left")
    return met.select(node, F.when(F.col("_a"), "merged_away").when(F.col("_i"), "final_merged").otherwise("final_unmerged").alias("status"))


def merge_geometry(merges: DataFrame, attributes: DataFrame, node: str, *, low: Sequence[str], high: Sequence[str], last: str, size: str, identity: str, union: bool = True, from_col: str = "from_node", to_col: str = "to_node") -> DataFrame:
    """from_node, to_node, rule, low.., high.., size, identity of a node that another merges into.

    One identity whose boxes are apart has moved: the newer geometry holds (rule moved_newer, moved_kept). Else surfaces
    are joined (union), or the larger one is kept (larger, kept)."""
    names = (*low, *high, last, size, identity)
    a, b = (attributes.select(F.col(node).alias(c), *[F.col(n).alias(f"{p}{n}") for n in names]) for c, p in ((from_col, "f_"), (to_col, "i_")))
    met = merges.select(from_col, to_col).join(a, from_col).join(b, to_col)
    apart = F.lit(False)
    for x, y in zip(low, high, strict=True):
        apart = apart | (F.col(f"f_{y}") < F.col(f"i_{x}")) | (F.col(f"i_{y}") < F.col(f"f_{x}"))
    moved = F.coalesce(F.col(f"f_{identity}") == F.col(f"i_{identity}"), F.lit(False)) & apart
    newer = F.coalesce(F.col(f"f_{last}"), F.lit(0)) >= F.coalesce(F.col(f"i_{last}"), F.lit(0))
    still = F.lit("union") if union else F.when(F.col(f"f_{size}") > F.col(f"i_{size}"), "larger").otherwise("kept")
    ruled = met.withColumn("rule", F.when(moved & newer, "moved_newer").when(moved, "moved_kept").otherwise(still))
    takes, both = F.col("rule").isin("moved_newer", "larger"), F.col("rule") == "union"

    def pick(n: str, joined: Column) -> Column:
        return F.when(both, joined).when(takes, F.col(f"f_{n}")).otherwise(F.col(f"i_{n}")).alias(n)

    pair = lambda f, n: f(F.col(f"f_{n}"), F.col(f"i_{n}"))
    return ruled.select(from_col, to_col, "rule", *[pick(n, pair(F.least, n)) for n in low], *[pick(n, pair(F.greatest, n)) for n in high], pick(size, F.col(f"f_{size}") + F.col(f"i_{size}")), F.coalesce(f"i_{identity}", f"f_{identity}").alias(identity))


def canonical(nodes: DataFrame, identity: str, node: str, first: str = "first", last: str = "last") -> DataFrame:
    """identity, target (the node that is first seen, the smaller on a tie), newest (the one last seen), n, first and last of
    the newest, which alone sets the right end, for identities with more than one node. Partial aggregations only."""
    end = F.coalesce(F.col(last), F.lit((1 << 63) - 1))
    out = nodes.where(F.col(identity).isNotNull()).groupBy(identity).agg(
        F.min(F.struct(F.col(first).alias("f"), F.col(node).alias("n"))).alias("a"),
        F.max(F.struct(end.alias("e"), F.col(first).alias("f"), F.col(node).alias("n"), F.col(last).alias("l"))).alias("z"),
        F.count("*").alias("n"),
    )
    return out.where("n > 1").select(identity, F.col("a.n").alias("target"), F.col("z.n").alias("newest"), "n", F.col("z.f").alias("first"), F.col("z.l").alias("last"))


def combine_changes(changes: DataFrame, key: str) -> DataFrame:
    """key with the extremal evidence of its rows: the latest before and the earliest after the observation."""
    return changes.groupBy(key).agg(*[f(c).alias(c) for f, c in ((F.max, "first_absent"), (F.min, "first_persistent"), (F.min, "last_absent"), (F.max, "last_persistent"))])


def duplicates(nodes: DataFrame, physical_id: str) -> DataFrame:
    """Identities with more than one current node: none may have."""
    return nodes.where(F.col(physical_id).isNotNull()).groupBy(physical_id).agg(F.count("*").alias("n")).where("n > 1")

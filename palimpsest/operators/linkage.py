"""Complete linkage of labelled centres, and the canonical identities that observations and tracks take from it."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from math import floor
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gridjoin import XYZ, nearest, pairs
from .mesh import renumber


#: Clusters up to which their distances are held as a matrix.
MATRIX = 2000


class _Cells:
    """Clusters by the middles of their boxes, in cells of sizes that double up to the radius."""

    def __init__(self, low: np.ndarray, high: np.ndarray, names: np.ndarray, radius: float) -> None:
        middle = (low[names] + high[names]) / 2
        spread = np.maximum(middle.std(axis=0), radius / 1000)
        size = min(radius, float((1.5 * (2 * np.pi) ** (len(spread) / 2) * spread.prod() / len(names)) ** (1 / len(spread))))
        self.sizes = [radius * (1 + 1e-6)]
        while self.sizes[0] > size and len(self.sizes) < 12:
            self.sizes.insert(0, self.sizes[0] / 2)
        self.low, self.high, self.n = low, high, len(names)
        self.steps = list(product((-1, 0, 1), repeat=len(spread)))
        self.cells: list[dict[tuple[int, ...], set[int]]] = []
        for size in self.sizes:
            self.cells.append({})
            for name, at in zip(names.tolist(), map(tuple, np.floor(middle / size).astype(np.int64).tolist()), strict=True):
                self.cells[-1].setdefault(at, set()).add(name)

    def at(self, name: int, size: float) -> tuple[int, ...]:
        return tuple(floor(v / size) for v in ((self.low[name] + self.high[name]) / 2).tolist())

    def put(self, name: int) -> None:
        for size, cells in zip(self.sizes, self.cells, strict=True):
            cells.setdefault(self.at(name, size), set()).add(name)

    def drop(self, name: int) -> None:
        for size, cells in zip(self.sizes, self.cells, strict=True):
            cells[self.at(name, size)].remove(name)

    def around(self, name: int, level: int) -> list[int]:
        cells, own, out = self.cells[level], self.at(name, self.sizes[level]), []
        for step in self.steps:
            out += cells.get(tuple(map(add, own, step)), ())
        out.remove(name)
        return out


def _squares(away: np.ndarray) -> np.ndarray:
    """Squared lengths, summed as columns are, for the same last digit."""
    return sum((away[..., c] * away[..., c] for c in range(1, away.shape[-1])), away[..., 0] * away[..., 0])


def linked(at: np.ndarray, radius: float) -> np.ndarray:
    """The cluster (its smallest number) of each place, which are numbered in the order of their ids: complete linkage cut at the radius.

    From any cluster to its nearest, from there to that one's nearest, until two are nearest to each other and are joined: the same clusters
    as by always joining the closest two, as a joined cluster is no nearer to any other than the nearer of its parts. Distances are taken
    from the members, of those that are near on average; once few clusters are left, all are held. Memory goes with the places."""
    n = len(at)
    name, limit, slack = np.arange(n), radius * radius, 1 + 1e-9
    if n < 2:
        return name
    low, high, size = at.copy(), at.copy(), np.ones(n, int)
    mean, spread = at.copy(), np.zeros(n)  # the farthest are no nearer than the root of the mean square distance
    members = {}  # of clusters of several places
    places_of = lambda c: at[members[c]] if c in members else at[c : c + 1]
    open_ = np.ones(n, bool)
    left = n
    cells = None

    def joined(a: int, b: int) -> int:
        a, b = min(a, b), max(a, b)
        members[a] = [*members.get(a, [a]), *members.pop(b, [b])]
        share, apart = size[b] / (size[a] + size[b]), mean[b] - mean[a]
        spread[a] = spread[a] * (1 - share) + spread[b] * share + share * (1 - share) * (apart @ apart)
        mean[a] += apart * share
        low[a], high[a], size[a] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b]), size[a] + size[b]
        open_[b] = False
        return a

    def nearest(c: int) -> int | None:
        """Of all clusters within the radius."""
        best = None
        for level, reach in enumerate(cells.sizes):
            others = np.array(cells.around(c, level), int)
            if not len(others):
                continue
            span = np.maximum(high[c] - low[others], high[others] - low[c])
            least, most = np.maximum(np.sqrt(_squares(mean[others] - mean[c]) + spread[others] + spread[c]), span.max(axis=1)), _squares(span)
            near = np.flatnonzero(least <= min(radius, np.sqrt(most.min())) * slack)
            best = None
            for k in near[np.argsort(least[near], kind="stable")].tolist():
                if best is not None and least[k] > best[0] * slack:
                    break
                o = int(others[k])
                d2 = most[k] if size[c] == 1 and size[o] == 1 else _squares(places_of(c)[:, None] - places_of(o)[None]).max()
                if d2 <= limit:
                    found = (float(np.sqrt(d2)), min(c, o), max(c, o), o)
                    best = found if best is None else min(best, found)
            if best is not None and best[0] * slack <= reach:
                break
        return best and best[3]

    todo, chain = list(range(n - 1, -1, -1)), []
    while left > MATRIX:
        if cells is None or left < cells.n / 2:
            cells = _Cells(low, high, np.flatnonzero(open_), radius)
        if not chain:
            while not open_[todo[-1]]:
                todo.pop()
            chain.append(todo[-1])
        last = chain[-1]
        to = nearest(last)
        if to is None:  # and it stays alone, as the others only grow
            chain.pop()
            cells.drop(last)
            open_[last] = False
            left -= 1
        elif len(chain) > 1 and chain[-2] == to:
            del chain[-2:]
            cells.drop(last)
            cells.drop(to)
            todo.append(joined(last, to))
            cells.put(todo[-1])
            left -= 1
        else:
            chain.append(to)
    names = np.flatnonzero(open_)
    away = np.full((len(names), len(names)), np.inf)
    every = np.concatenate([places_of(c) for c in names.tolist()]) if len(names) else at[:0]
    of = np.repeat(np.arange(len(names)), size[names])
    for i, c in enumerate(names.tolist()):
        near = np.flatnonzero(np.maximum(high[c] - low[names[i + 1 :]], high[names[i + 1 :]] - low[c]).max(axis=1) <= radius * slack) + i + 1
        if not len(near):
            continue
        some = np.zeros(len(names), bool)
        some[near] = True
        far, own = np.zeros(int(size[names[near]].sum())), every[some[of]]
        for p in places_of(c):
            np.maximum(far, _squares(own - p), out=far)
        d2 = np.maximum.reduceat(far, np.cumsum(size[names[near]]) - size[names[near]])
        away[i, near] = away[near, i] = np.where(d2 <= limit, np.sqrt(d2), np.inf)
    del every, of
    todo, chain = list(range(len(names))), []
    while todo or chain:
        if not chain:
            chain.append(todo.pop())
        i = chain[-1]
        d = away[i].min()
        if d == np.inf:  # alone, or joined to another since
            chain.pop()
            continue
        j = min(np.flatnonzero(away[i] == d).tolist(), key=lambda j: (min(i, j), max(i, j)))
        if len(chain) > 1 and chain[-2] == j:
            del chain[-2:]
            keep, gone = min(i, j), max(i, j)
            joined(int(names[i]), int(names[j]))
            away[keep] = np.maximum(away[i], away[j])
            away[:, keep] = away[keep]
            away[gone] = away[:, gone] = np.inf
            todo.append(keep)
        else:
            chain.append(j)
    for c, m in members.items():
        name[m] = c
    return name


def complete(points: DataFrame, radius: float, *, vid: str = "vid", label: str = "label", coords: Sequence[str] = XYZ, whole_labels: int = 0) -> DataFrame:
    """vid, label, cluster (its smallest vid): complete linkage of equal labels, cut at the radius.

    Points of one place are one from the start. Labels of at most whole_labels places are joined in a task each, from the places and without
    pairs. The others go in rounds: all clusters that are nearest to each other are joined at once,
    which leads to the same clusters as one pair after the other; pairs beyond the radius are never made. A joined cluster
    is as far as the farther of its two parts, and apart if either was. Equal distances go by the smaller ids. A point with a null
    coordinate or label has no cluster. Each round deals its pairs by their number, so that tasks hold as many however many there are."""
    from ..plans.scratch import PARTS, saved

    whole = points.select(vid, label, *coords).dropna()
    places = saved(whole.groupBy(label, *coords).agg(F.min(vid).alias("_p")), "places")
    if not whole_labels:
        return whole.join(_in_rounds(places, radius, label, coords), [label, *coords]).select(vid, label, "cluster")

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        out = part[[label, *coords]].assign(cluster=part["_p"])
        ids, at = part["_p"].to_numpy(), part[list(coords)].to_numpy(float)
        for rows in part.groupby(label, sort=False).indices.values():
            rows = rows[np.isfinite(at[rows]).all(axis=1)]
            rows = rows[np.argsort(ids[rows], kind="stable")]
            out.iloc[rows, -1] = ids[rows[linked(at[rows], radius)]]
        return out

    sizes = places.groupBy(label).agg(F.count("*").alias("_n"))
    crowded = saved(sizes.where(F.col("_n") > whole_labels).select(label), "labels")
    large = not crowded.isEmpty()
    small = places.join(crowded, label, "left_anti") if large else places
    parts = max(PARTS, -(-places.count() // whole_labels))
    # few labels get a part each, as ranges tell their hashes apart; many share one
    dealt = small.withColumn("_part", F.pmod(F.xxhash64(label), F.lit(16 * parts))).repartitionByRange(parts, "_part")
    schema = T.StructType([*places.select(label, *coords).schema.fields, T.StructField("cluster", places.schema["_p"].dataType)])
    named = saved(dealt.groupBy("_part").applyInPandas(settle, schema), "settled")
    if large:
        named = named.unionByName(_in_rounds(saved(places.join(crowded, label, "left_semi"), "places"), radius, label, coords))
    return whole.join(named, [label, *coords]).select(vid, label, "cluster")


def _in_rounds(places: DataFrame, radius: float, label: str, coords: Sequence[str]) -> DataFrame:
    """label, coords, cluster of places with their ids (_p), over all pairs within the radius."""
    from ..plans.scratch import dealt_by_rows, saved

    open_ = saved(pairs(places, places, radius, left_id="_p", right_id="_p", coords=coords, equal=[label]).where("_p < right__p").select(F.col("_p").alias("u"), F.col("right__p").alias("v"), F.sqrt("d2").alias("d")), "pairs")
    joined = saved(places.select("_p", F.col("_p").alias("cluster")), "joined")
    rank = F.struct("d", "u", "v")
    while left := open_.count():
        ends = dealt_by_rows(open_.select(F.explode(F.array("u", "v")).alias("e"), rank.alias("r")), 2 * left, "e").groupBy("e").agg(F.min("r").alias("best"))
        chosen = ends.groupBy("best").agg(F.count("*").alias("n")).where("n = 2")  # the best pair of both its ends
        moves = saved(chosen.select(F.col("best.v").alias("_from"), F.col("best.u").alias("_to")), "moves")
        parts = moves.select(F.col("_to").alias("_of"))
        now = open_
        for e in ("u", "v"):
            now = dealt_by_rows(now, left, e).join(moves, F.col(e) == F.col("_from"), "left").withColumn(e, F.coalesce("_to", e)).drop("_from", "_to")
            now = now.join(parts, F.col(e) == F.col("_of"), "left").withColumn(f"_n{e}", F.when(F.col("_of").isNotNull(), 2).otherwise(1)).drop("_of")
        ordered = now.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "d", (F.col("_nu") * F.col("_nv")).alias("_all"))
        met = dealt_by_rows(ordered, left, "u", "v").groupBy("u", "v").agg(F.max("d").alias("d"), F.count("*").alias("_n"), F.max("_all").alias("_all"))
        open_ = saved(met.where("_n = _all").select("u", "v", "d"), "pairs")
        joined = saved(joined.join(moves, F.col("cluster") == F.col("_from"), "left").select("_p", F.coalesce("_to", "cluster").alias("cluster")), "joined")
    return places.join(joined, "_p").select(label, *coords, "cluster")


def medians(rows: DataFrame, keys: Sequence[str], coords: Sequence[str] = XYZ) -> DataFrame:
    """keys, n, the median of each coordinate: the middle of sorted rows, so that no group is held in memory."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    for c in coords:
        w = Window.partitionBy(*keys)
        at = rows.select(*keys, c, F.row_number().over(w.orderBy(c)).alias("_k")).join(out.select(*keys, F.col("n").alias("_n")), list(keys))
        middle = at.where("_k = (_n + 1) div 2 or _k = _n div 2 + 1").groupBy(*keys).agg(F.avg(c).alias(c))
        out = out.join(middle, list(keys))
    return out


def centres(points: DataFrame, radius: float, least: int, *, singles: Sequence[int] = (), vid: str = "vid", label: str = "label", coords: Sequence[str] = XYZ, whole_labels: int = 0) -> DataFrame:
    """canonical (from 1, by label and place), label, n, coords: the medians of clusters of at least least points; of a label
    that has none, of its largest cluster, the smaller id on a tie. A label of singles is one cluster."""
    from ..plans.scratch import saved

    one = F.col(label).isin(*singles) if singles else F.lit(False)
    whole = points.select(vid, label, *coords).dropna()
    first = whole.where(one).groupBy(label).agg(F.min(vid).alias("cluster"))
    own = complete(whole.where(~one), radius, vid=vid, label=label, coords=coords, whole_labels=whole_labels).unionByName(whole.where(one).select(vid, label).join(first, label).select(vid, label, "cluster"))
    n = own.groupBy(label, "cluster").agg(F.count("*").alias("n"))
    top = n.groupBy(label).agg(F.max(F.struct("n", -F.col("cluster"))).alias("_top"), F.max("n").alias("_most"))
    kept = n.join(top, label).where((F.col("n") >= least) | ((F.col("_most") < least) & (F.col("cluster") == -F.col("_top")["col2"]))).select(label, "cluster")
    at = medians(whole.join(own.select(vid, "cluster"), vid).join(kept, [label, "cluster"]), [label, "cluster"], coords)
    at = saved(at, "centres")
    return at.join(renumber(at, [label, *coords], vid="cluster"), "cluster").select((F.col("target").cast("long") + 1).alias("canonical"), label, "n", *coords)


def identities(points: DataFrame, centres: DataFrame, radius: float, *, track: str, vid: str = "vid", label: str = "label", coords: Sequence[str] = XYZ) -> DataFrame:
    """vid, canonical, how: the nearest centre of its label within the radius, or the label's only centre at any distance
    (near); else what most of its track's observations of that label have, the smaller on a tie (track); else null (none)."""
    alone = centres.groupBy(label).agg(F.min("canonical").alias("_only"), F.count("*").alias("_m")).where("_m = 1").select(label, "_only")
    near = nearest(points, centres, radius, left_id=vid, right_id="canonical", coords=coords, equal=[label]).select(vid, F.col("right_canonical").alias("_near"))
    met = points.select(vid, label, track).join(near, vid, "left").join(alone, label, "left").withColumn("_own", F.coalesce("_only", "_near"))
    votes = met.where("_own is not null").groupBy(label, track, "_own").agg(F.count("*").alias("_n"))
    best = votes.groupBy(label, track).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col("_own").alias("c"))).alias("_best")).select(label, track, F.col("_best.c").alias("_alias"))
    out = met.join(best, [label, track], "left")
    how = F.when(F.col("_own").isNotNull(), "near").when(F.col("_alias").isNotNull(), "track").otherwise("none")
    return out.select(vid, F.coalesce("_own", "_alias").alias("canonical"), how.alias("how"))

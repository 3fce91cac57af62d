"""Associations between entities: votes, nearest centres, box overlap, first match, greedy and optimal assignment."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import box_iou
from .gridjoin import XYZ, nearest, pairs


def by_votes(left: DataFrame, right: DataFrame, radius: float, *, left_id: str, right_id: str, left_key: str, right_key: str, label: str | None = None, coords: Sequence[str] = XYZ) -> DataFrame:
    """left_key, right_<right_key>, votes: each point of an entity votes for the entity of its nearest point within the radius
    and, if given, of its label; most votes win, the smaller key on a tie. Entities without votes are not returned."""
    near = nearest(left, right, radius, left_id=left_id, right_id=right_id, coords=coords, equal=[label] if label else ())
    to = right.select(F.col(right_id).alias(f"right_{right_id}"), F.col(right_key).alias("_to"))
    votes = near.join(to, f"right_{right_id}").join(left.select(left_id, left_key), left_id).groupBy(left_key, "_to").agg(F.count("*").alias("votes"))
    best = votes.groupBy(left_key).agg(F.max_by(F.struct("_to", "votes"), F.struct("votes", -F.col("_to"))).alias("m"))
    return best.select(left_key, F.col("m._to").alias(f"right_{right_key}"), F.col("m.votes").alias("votes"))


def by_centroid(left: DataFrame, right: DataFrame, radius: float, *, left_id: str, right_id: str, equal: Sequence[str] = (), coords: Sequence[str] = XYZ) -> DataFrame:
    """left_id, right_<right_id> (null: failed), distance."""
    return left.select(left_id).join(nearest(left, right, radius, left_id=left_id, right_id=right_id, coords=coords, equal=equal), left_id, "left")


def by_box_iou(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, size: float, least: float = 0.0, equal: Sequence[str] = (), keep: Sequence[str] = (), where: Column | None = None, deals: int = 1) -> DataFrame:
    """left_id, right_<right_id>, iou for boxes (x0..z1) that overlap by at least so much; boxes meet in the grid cells of the
    first corner of their intersection, so that each pair meets once. keep are columns of both sides (right_<column> of the right one), of
    which where is asked as pairs meet. The right boxes of a crowded cell are dealt over so many places, where the left ones all come."""
    from ..plans.scratch import PARTS
    from ..functions.geometry import pack_voxel, voxel

    low, high = [[f"{c}{k}" for c in "xyz"] for k in (0, 1)]

    def dealt(df: DataFrame) -> DataFrame:
        for c, a, b in zip("ijk", low, high, strict=True):
            df = df.withColumn(f"_{c}", F.explode(F.sequence(voxel(F.col(a), size), voxel(F.col(b), size))))
        return df.withColumn("cell", pack_voxel(F.col("_i"), F.col("_j"), F.col("_k")))

    a = dealt(left.select(left_id, *equal, *keep, *low, *high))
    b = dealt(right.select(right_id, *equal, *keep, *low, *high))
    b = b.select(F.col(right_id).alias(f"right_{right_id}"), *equal, *[F.col(c).alias(f"right_{c}") for c in keep], *[F.col(c).alias(f"r_{c}") for c in (*low, *high)], "cell")
    keys = ["cell", *equal]
    if deals > 1:
        keys.append("_deal")
        a = a.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long")))).repartition(PARTS * 4, *keys)
        b = b.withColumn("_deal", F.pmod(F.xxhash64(f"right_{right_id}"), F.lit(deals))).repartition(PARTS * 4, *keys)
    met = a.join(b, keys)
    met = met if where is None else met.where(where)
    for c, n in zip(low, "ijk", strict=True):
        met = met.where(F.col(f"_{n}") == voxel(F.greatest(F.col(c), F.col(f"r_{c}")), size))
    iou = box_iou([F.col(c) for c in low], [F.col(c) for c in high], [F.col(f"r_{c}") for c in low], [F.col(f"r_{c}") for c in high])
    return met.select(left_id, f"right_{right_id}", iou.alias("iou")).where((F.col("iou") > 0) & (F.col("iou") >= least))


def first_match(candidates: DataFrame, cluster: str, track: str, passes: Column) -> DataFrame:
    """Each cluster takes the first track, in order, that passes; several clusters may take one track."""
    return candidates.where(passes).groupBy(cluster).agg(F.min(track).alias(track))


def greedy_pairs(costs: DataFrame, left: str, right: str, cost: str, *, group: Sequence[str] = ()) -> DataFrame:
    """A one-to-one matching: by ascending cost (then ids) each pair is taken if both its ends are free.

    Every pair that is the best one of both its ends is taken and its ends' other pairs go; that yields the sequential result without
    sorting all pairs. group is kept apart by being part of the ends' keys."""
    return rounds_of_pairs(costs, left, right, [F.col(cost).asc(), F.col(right).asc()], [F.col(cost).asc(), F.col(left).asc()], group=group, keep=[cost])


def greedy_nearest(left: DataFrame, right: DataFrame, radius: float, *, left_id: str, right_id: str, label: str, coords: Sequence[str] = XYZ) -> DataFrame:
    """left_id, right_<right_id>, label, d2: global greedy matching of equal labels within the radius, nearest first."""
    near = pairs(left, right, radius, left_id=left_id, right_id=right_id, coords=coords, equal=[label])
    return greedy_pairs(near, left_id, f"right_{right_id}", "d2", group=[label])


#: Candidates of a group that one task settles; larger groups go in rounds.
SMALL = 50_000


def _by_rank(end: np.ndarray, rank: np.ndarray) -> tuple[list[int], list[int]]:
    """Rows by end and rank, and where each end's rows begin."""
    order = np.lexsort((rank, end))
    return order.tolist(), [*np.searchsorted(end[order], np.arange(end.max() + 1)).tolist(), len(end)]


def _settled(l: np.ndarray, r: np.ndarray, l_rank: np.ndarray, r_rank: np.ndarray) -> list[int]:  # noqa: E741
    """The rows taken of candidates between ends 0, 1, ...: from an end that is open to the one it wants most, from there to the one that
    that wants most, until two want each other. Ends that are passed wait for it, so each is passed once a pair that is taken."""
    (of_l, at_l), (of_r, at_r) = _by_rank(l, l_rank), _by_rank(r, r_rank)
    end_l, end_r, left, right = at_l[1:], at_r[1:], l.tolist(), r.tolist()
    open_l, open_r, taken = [True] * len(end_l), [True] * len(end_r), []
    for first in range(len(end_l)):
        chain = [first] if open_l[first] else []
        while chain:
            a = chain[-1]
            while at_l[a] < end_l[a] and not open_r[right[of_l[at_l[a]]]]:
                at_l[a] += 1
            if at_l[a] == end_l[a]:
                open_l[chain.pop()] = False
                continue
            row = of_l[at_l[a]]
            b = right[row]
            while not open_l[left[of_r[at_r[b]]]]:
                at_r[b] += 1
            wanted = left[of_r[at_r[b]]]
            if wanted == a:
                taken.append(row)
                open_l[chain.pop()] = open_r[b] = False
            elif len(chain) > len(end_l):
                raise ValueError("the orders contradict each other: no pair is first on both sides")
            else:
                chain.append(wanted)
    return taken


def nearest_in_order(ids: np.ndarray, at: np.ndarray, other: np.ndarray, places: np.ndarray, reach: float, *, strict: bool = False) -> list[tuple[int, int, float]]:
    """Rows of both sides and their squared distance: by ascending id, each takes the nearest other one within reach (strict: below it) that
    is free, the smaller one on a tie. Those that are near along the first axis are looked through; the taken ones go as they grow many."""
    limit = reach * reach
    kept = np.flatnonzero(np.isfinite(places).all(axis=1))
    kept = kept[np.argsort(places[kept, 0], kind="stable")]
    rank = np.unique(other, return_inverse=True)[1][kept]
    line = np.argsort(ids, kind="stable")
    line = line[np.isfinite(at[line]).all(axis=1)]
    places, gone, taken, n = places[kept], np.zeros(len(kept)), [], 0
    begin = 0
    while begin < len(line) and len(kept):
        near = [np.searchsorted(places[:, 0], at[line[begin:], 0] + side * reach * (1 + 1e-9), how) for side, how in ((-1, "left"), (1, "right"))]
        first, k = begin, begin
        while k < len(line) and 2 * n <= len(kept):
            best, k0 = None, k
            while k < len(line) and ids[line[k]] == ids[line[k0]]:  # an id may lie at several places
                low, high = near[0][k - first], near[1][k - first]
                if low < high:
                    d2 = gone[low:high].copy()
                    away = places[low:high] - at[line[k]]
                    # summed as columns are, for the same last digit
                    d2 += sum((away[:, c] * away[:, c] for c in range(1, away.shape[1])), away[:, 0] * away[:, 0])
                    d = d2.min()
                    if d < limit or (d == limit and not strict):
                        j = min((low + np.flatnonzero(d2 == d)).tolist(), key=rank.__getitem__)
                        best = min(best or (np.inf,), (d, rank[j], line[k], j))
                k += 1
            if best:
                taken.append((int(best[2]), int(kept[best[3]]), float(best[0])))
                same = np.flatnonzero(rank == best[1])
                gone[same] = np.inf
                n += len(same)
        begin = k
        free = gone == 0
        kept, rank, places, gone, n = kept[free], rank[free], places[free], gone[free], 0
    return taken


def rounds_of_pairs(candidates: DataFrame, left: str, right: str, left_order: Sequence[Column], right_order: Sequence[Column], *, group: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """group, left, right, keep: a one-to-one matching in which a pair is taken if it is the first of its left end's open
    candidates by left_order and of its right end's by right_order, and its ends' other pairs go, until none is open. If
    right_order is that of the left ends, this is what these get who choose one after the other. A row with a null end or group is no candidate.

    Groups of at most SMALL candidates are settled in tasks, each of which has about so many rows of whole groups. Larger ones go in
    rounds, of which each takes all pairs that are first on both sides at once."""
    from ..plans.scratch import dealt_by_rows, saved

    ends = [*group, left, right]

    def ranks(*more: str) -> dict[str, Column]:
        at = [Window.partitionBy(*more, *group, c).orderBy(*o) for c, o in ((left, left_order), (right, right_order))]
        return {"_l": F.row_number().over(at[0]), "_r": F.row_number().over(at[1])}

    rows = saved(candidates.select(*ends, *keep).dropna(subset=ends), "pairs")
    total = rows.count()
    if not total:
        return rows
    # only where many rows lie can a large group be: counts of all groups would grow with these
    dealt = (lambda most: F.pmod(F.xxhash64(*group), F.lit(-(-total // max(most, 1))))) if group else (lambda _: F.lit(0))
    crowded = saved(rows.groupBy(dealt(SMALL // 10).alias("_bin")).agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL).select("_bin"), "bins")
    open_, small = None, rows
    if not crowded.isEmpty():
        open_, small = rows, None
        if group:
            near = rows.withColumn("_bin", dealt(SMALL // 10)).join(crowded, "_bin", "left_semi")
            big = saved(near.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL).select(*group), "groups")  # at most a row for each SMALL candidates
            open_, small = saved(rows.join(big, list(group), "left_semi"), "pairs"), rows.join(big, list(group), "left_anti")
    taken = None
    if small is not None:
        columns, keys = small.columns, [[*group, left], [*group, right]]

        def settle(part: pd.DataFrame) -> pd.DataFrame:
            l, r = (part.groupby(k, sort=False).ngroup().to_numpy() for k in keys)  # noqa: E741
            return part.iloc[_settled(l, r, part["_l"].to_numpy(), part["_r"].to_numpy())][columns]

        parted = dealt_by_rows(small.withColumn("_part", dealt(SMALL)), total, "_part")  # once: ranks and parts are taken where rows lie
        taken = parted.withColumns(ranks("_part")).groupBy("_part").applyInPandas(settle, small.schema)
    while open_ is not None and not open_.isEmpty():
        won = saved(open_.withColumns(ranks()).where("_l = 1 and _r = 1").drop("_l", "_r"), "won")
        if won.isEmpty():
            raise ValueError("the orders contradict each other: no pair is first on both sides")
        taken = won if taken is None else taken.unionByName(won)
        open_ = saved(open_.join(won.select(*group, left), [*group, left], "left_anti").join(won.select(*group, right), [*group, right], "left_anti"), "pairs")
    return taken


def ordered_greedy(candidates: DataFrame, frame: str, track: str, cluster: str, score: str, *, least: float) -> DataFrame:
    """frame, track, cluster, score: within a frame, tracks in order take their best cluster that is still free and scores
    strictly more; the smaller cluster on a tie. Large frames go in rounds, so that none comes to one task."""
    rows = candidates.select(frame, track, cluster, score).where(F.col(score) > least)
    return rounds_of_pairs(rows, track, cluster, [F.col(score).desc(), F.col(cluster).asc()], [F.col(track).asc()], group=[frame], keep=[score])


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of a cheapest complete matching of the smaller side (shortest augmenting paths)."""
    if cost.shape[0] > cost.shape[1]:
        return [(i, j) for j, i in hungarian(cost.T)]
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j]:
            done[j] = True
            row = match[j]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = j
            k = int(np.where(done, np.inf, least)[1:].argmin()) + 1
            delta = least[k]
            u[match[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j = k
        while j:
            match[j] = match[way[j]]
            j = way[j]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def _cheapest(left: np.ndarray, right: np.ndarray, cost: np.ndarray, alone: float) -> tuple[list[int], list[float], list[float]]:
    """The row by which each left end 0, 1, ... is matched (-1: it stays alone, for that much), and the prices of left and right ends: no
    row costs less than both its ends' prices, and matched ones as much, which is what proves the matching cheapest.

    Each left end in turn takes the shortest path, in costs less prices, to a right end that is free or to a left end on it that had
    better be alone; memory goes with the rows and not with left times right ends."""
    order = np.lexsort((cost, left))
    n, m = int(left.max()) + 1, int(right.max()) + 1
    at = np.searchsorted(left[order], np.arange(n + 1)).tolist()
    to, price, row_of = right[order].tolist(), cost[order].tolist(), order.tolist()
    v, owner, taken = [0.0] * m, [-1] * m, [-1] * n  # prices of right ends, who has them, places of the rows taken
    u = [alone] * n
    for start in range(n):
        far: dict[int, float] = {}
        via: dict[int, int] = {}
        settled: dict[int, None] = {}  # rounding must not open them again
        heap: list[tuple[float, int]] = []
        i, base, end, last = start, 0.0, alone, start  # end: the cheapest way to leave someone alone, who is last
        while True:
            for k in range(at[i], at[i + 1]):
                if base + price[k] >= end:
                    break  # prices of right ends are not above 0, so no later row is cheaper
                j = to[k]
                d = base + price[k] - v[j]
                if d < far.get(j, end) and j not in settled:
                    far[j], via[j] = d, k
                    heappush(heap, (d, j))
            while heap and heap[0][1] in settled:
                heappop(heap)
            if not heap or heap[0][0] >= end:
                free = -1
                break
            d, free = heappop(heap)
            if owner[free] < 0:
                end = d
                break
            settled[free] = None
            i = owner[free]
            base = d - u[i]
            if base + alone < end:
                end, last = base + alone, i
        for j in settled:
            v[j] -= end - far[j]
            u[owner[j]] += end - far[j]
        u[start] = end
        if free < 0:  # last is alone from here on
            free, taken[last], i = taken[last], -1, last
            u[last] = alone
            if i == start:
                continue
            free = to[free]
        # along the path each left end takes the right end that it came to, and gives up the one it had
        while True:
            k = via[free]
            i = bisect_right(at, k) - 1
            had, taken[i], owner[free] = taken[i], k, i
            if i == start:
                break
            free = to[had]
    return [row_of[k] if k >= 0 else -1 for k in taken], u, v


#: Rows of a left end, about, with which a matching begins; bins of costs by which these are told.
FIRST_ROWS, COST_BINS = 16, 1024


def optimal(costs: DataFrame, group: str, left: str, right: str, cost: str, *, missing: float, most: int | None = None) -> DataFrame:
    """group, left, right, cost: a cheapest one-to-one matching in each group, in which a pair without a row, or left apart, costs
    missing. A null end has no pair.

    A matching of the cheapest rows, some FIRST_ROWS for a left end, has prices of its ends. Rows that cost less than their ends' prices are
    added, of all rows there are, and the matching is made anew until there are none, which proves it cheapest of all. So no task holds
    all rows. What the rows regarded connect is solved in one task, whose memory goes with these rows; if most is given, a part of more than
    so many ends, squared, is an error instead."""
    from ..plans.scratch import saved
    from .components import connected_components

    end = lambda c, side: F.struct(F.col(group).alias("g"), F.lit(side).alias("s"), F.col(c).cast("string").alias("c"))
    rows = costs.select(group, left, right, cost).where(F.col(cost) < missing).dropna(subset=[left, right])
    binned = rows.withColumns({"_g": F.struct(group), "_bin": F.greatest(F.floor(F.col(cost) / missing * COST_BINS), F.lit(0)) if missing > 0 else F.lit(0)})
    counts = saved(binned.groupBy("_g", "_bin").agg(F.count("*").alias("_n"), F.approx_count_distinct(end(left, 0)).alias("_m")), "costs")
    up = Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    # of a group with few rows all are regarded
    first = counts.withColumn("_before", F.coalesce(F.sum("_n").over(up), F.lit(0))).withColumn("_ends", F.max("_m").over(Window.partitionBy("_g")))
    limits = saved(first.where(F.col("_before") <= FIRST_ROWS * F.col("_ends")).groupBy("_g").agg(F.max("_bin").alias("_limit")), "limits")
    known = saved(binned.join(limits, "_g").where(F.col("_bin") <= F.col("_limit")).drop("_g", "_bin", "_limit"), "regarded")
    whole = counts.agg(F.sum("_n")).first()[0] or 0

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns="_part").reset_index(drop=True)
        (l, lefts), (r, rights) = (pd.factorize(part[c], sort=True) for c in (left, right))  # noqa: E741
        if most is not None and (len(lefts) + len(rights)) ** 2 > most:
            raise ValueError(f"a part of {len(lefts)} by {len(rights)} is too large for one task")
        taken, u, v = _cheapest(l, r, part[cost].to_numpy(float), float(missing))
        some = np.unique(l, return_index=True)[1]  # a row of each left end, of which one that is alone keeps no right end
        out = part.iloc[[k if k >= 0 else some[i] for i, k in enumerate(taken)]].copy()
        out["_alone"] = [k < 0 for k in taken]
        out["_u"] = u
        out["_v"] = [v[r[k]] if k >= 0 else 0.0 for k in taken]
        return out

    fields = T.StructType([*rows.schema.fields, T.StructField("_alone", T.BooleanType()), T.StructField("_u", T.DoubleType()), T.StructField("_v", T.DoubleType())])
    while True:
        part = connected_components(known.select(end(left, 0).alias("u"), end(right, 1).alias("v")))
        named = known.withColumn("_u", end(left, 0)).join(part, F.col("_u") == part["node"]).select(*rows.columns, F.col("component").alias("_part"))
        solved = saved(named.groupBy("_part").applyInPandas(solve, fields), "matching")
        met = known.count()
        if met < whole:
            own, other = solved.select(end(left, 0).alias("_a"), "_u"), solved.where("not _alone and _v < 0").select(end(right, 1).alias("_b"), "_v")
            cheap = rows.withColumn("_a", end(left, 0)).join(own, "_a", "left").where(F.col(cost) < F.coalesce("_u", F.lit(float(missing))))
            cheap = cheap.withColumn("_b", end(right, 1)).join(other, "_b", "left").where(F.col(cost) < F.coalesce("_u", F.lit(float(missing))) + F.coalesce("_v", F.lit(0.0)) - 1e-12 * abs(missing))
            wider = saved(known.unionByName(cheap.select(*rows.columns)).distinct(), "regarded")
            if wider.count() > known.distinct().count():
                known = wider
                continue
        return solved.where("not _alone").select(*rows.columns)


def merge_targets(merges: DataFrame, from_col: str = "from_node", to_col: str = "to_node", valid: str = "is_valid", order: str | None = None) -> DataFrame:
    """from, to: of each node's proposals the first one, if it is valid; later valid ones don't count. Of equal ones the smaller
    to is first, and of these the one that is not valid."""
    rank = Window.partitionBy(from_col).orderBy(order or to_col, to_col, F.col(valid).cast("boolean"))
    return merges.withColumn("_n", F.row_number().over(rank)).where((F.col("_n") == 1) & F.col(valid).cast("boolean")).select(from_col, to_col)

"""Clusters of points and pixels: filters, growth, islands, votes and merge proposals."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cosine
from .association import by_box_iou
from .components import connected_components
from .gridjoin import XYZ, cell, nearest, pairs


def sized(points: DataFrame, keys: Sequence[str], least: int = 1, most: int | None = None) -> DataFrame:
    """keys, n of clusters within the limits, both included."""
    n = F.col("n")
    return points.groupBy(*keys).agg(F.count("*").alias("n")).where((n >= least) & (n <= most if most else F.lit(True)))


def rejected(rows: DataFrame, prompts: DataFrame, feature: str, prompt: str, limit: float, *, most: int = 1000) -> DataFrame:
    """rows without those that resemble a prompt by more than the limit. Prompts are a dimension of a few rows, joined as one
    array; more than most are an error. A row without a feature stays."""
    if prompts.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} prompts")
    line = prompts.agg(F.collect_list(prompt).alias("_prompts"))
    best = F.array_max(F.transform("_prompts", lambda p: cosine(F.col(feature), p)))
    return rows.crossJoin(F.broadcast(line)).where(F.coalesce(best <= limit, F.lit(True))).drop("_prompts")


def flagged_share(points: DataFrame, keys: Sequence[str], flag: Column, limit: float) -> DataFrame:
    """keys, n, share of clusters in which less than the limit is flagged."""
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(flag.cast("int")).alias("share")).where(F.col("share") < limit)


def euclidean(points: DataFrame, radius: float, *, vid: str = "vid", label: str = "label", coords: Sequence[str] = XYZ) -> DataFrame:
    """vid, label, cluster (its smallest vid): single linkage of equal labels within the radius.

    A cell whose diagonal is the radius holds one cluster per label, so a cell is one node: its points are never paired
    with each other, and two cells are linked once, however many of their points are close."""
    keyed = points.select(vid, label, *coords, cell(coords, radius / 3**0.5).alias("_c"))
    near = pairs(keyed, keyed, radius, left_id=vid, right_id=vid, coords=coords, equal=[label], differ="_c")
    links = near.groupBy(label, F.least("_c", "__c").alias("_a"), F.greatest("_c", "__c").alias("_b")).agg(F.count("*").alias("_n"))
    found = connected_components(links.select(F.struct(label, F.col("_a").alias("_c")).alias("u"), F.struct(label, F.col("_b").alias("_c")).alias("v")))
    root = found.select(F.col(f"node.{label}").alias(label), F.col("node._c").alias("_c"), F.col("component._c").alias("_r"))
    placed = keyed.select(vid, label, "_c").join(root, [label, "_c"], "left").select(vid, label, F.coalesce("_r", "_c").alias("_r"))
    names = placed.groupBy(label, "_r").agg(F.min(vid).alias("cluster"))
    return placed.join(names, [label, "_r"]).select(vid, label, "cluster")


def islands(members: DataFrame, label: str, component: str, *, least: int, share: float) -> DataFrame:
    """label, component, n, kept: components of at least least members and that share of their label's largest."""
    sizes = members.groupBy(label, component).agg(F.count("*").alias("n"))
    top = sizes.groupBy(label).agg(F.max("n").alias("_top"))
    return sizes.join(top, label).select(label, component, "n", ((F.col("n") >= least) & (F.col("n") >= share * F.col("_top"))).alias("kept"))


def islands_by_gap(components: DataFrame, label: str, component: str, low: Sequence[str], high: Sequence[str], *, least: int, gap: float) -> DataFrame:
    """label, component, n, kept for components with their size n and box: the largest of a label stays (the smaller id on a
    tie), another one of at least least members only if its box is no farther than gap from the largest's, along every axis."""
    top = components.groupBy(label).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(component).alias("c"), *[F.col(c).alias(f"t_{c}") for c in (*low, *high)])).alias("t"))
    near = F.lit(True)
    for a, b in zip(low, high, strict=True):
        near = near & (F.greatest(F.col(a) - F.col(f"t.t_{b}"), F.col(f"t.t_{a}") - F.col(b)) <= gap)
    kept = (F.col(component) == F.col("t.c")) | ((F.col("n") >= least) & near)
    return components.join(top, label).select(label, component, "n", kept.alias("kept"))


def face_neighbours(faces: DataFrame, fid: str = "fid", corners: Sequence[str] = ("a", "b", "c")) -> DataFrame:
    """u, v: faces that share an edge, each pair once."""
    a, b, c = corners
    edges = faces.select(fid, F.explode(F.array(*[F.struct(F.least(x, y).alias("p"), F.greatest(x, y).alias("q")) for x, y in ((a, b), (b, c), (c, a))])).alias("e"))
    return edges.select(F.col(fid).alias("u"), "e").join(edges.select(F.col(fid).alias("v"), "e"), "e").where("u < v").select("u", "v").distinct()


def without_small(labels: DataFrame, edges: DataFrame, fid: str, label: str, least: int) -> DataFrame:
    """fid, label: members (labels other than 0) of components of fewer than least take the label that most of their border's
    edges lead to, the smaller one on a tie; 0, which is no label, if there is none."""
    a, b = (labels.select(F.col(fid).alias(n), F.col(label).alias(f"l{n}")) for n in "uv")
    met = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(a, "u").join(b, "v")
    found = connected_components(met.where("lu = lv and lu <> 0").select("u", "v"))
    placed = labels.join(found, labels[fid] == found["node"], "left").select(fid, label, F.coalesce("component", fid).alias("_c"))
    small = placed.where(F.col(label) != 0).groupBy("_c").agg(F.count("*").alias("_n")).where(F.col("_n") < least).select("_c")
    votes = met.where("lu <> lv and lv <> 0").join(placed.select(F.col(fid).alias("u"), "_c"), "u").join(small, "_c").groupBy("_c", "lv").agg(F.count("*").alias("_m"))
    best = votes.groupBy("_c").agg(F.min(F.struct((-F.col("_m")).alias("m"), F.col("lv").alias("l"))).alias("_b"))
    whole = placed.join(small.withColumn("_small", F.lit(True)), "_c", "left").join(best, "_c", "left")
    return whole.select(fid, F.when(F.col("_small") & (F.col(label) != 0), F.coalesce("_b.l", F.lit(0))).otherwise(F.col(label)).alias(label))


def attach(centres: DataFrame, major: Column, radius: float, *, cid: str, label: str, coords: Sequence[str] = XYZ) -> DataFrame:
    """cid, target: small components go to the nearest major one of their label within the radius, else to none."""
    small, large = centres.where(~major), centres.where(major)
    near = nearest(small, large, radius, left_id=cid, right_id=cid, coords=coords, equal=[label])
    joined = small.select(cid).join(near, cid, "left").select(cid, F.col(f"right_{cid}").alias("target"))
    return joined.unionByName(large.select(cid, F.col(cid).alias("target")))


def stable_voxels(points: DataFrame, frame: str, size: float, least: int, coords: Sequence[str] = XYZ) -> DataFrame:
    """cell, frames: voxels that at least so many frames see."""
    seen = points.select(cell(coords, size).alias("cell"), frame).distinct().groupBy("cell").agg(F.count("*").alias("frames"))
    return seen.where(F.col("frames") >= least)


#: Boxes of one deal of a crowded cell.
DEALT = 4000


def proposals(boxes: DataFrame, *, node: str, label: str, size: float, least: float, first: str = "first", last: str = "last") -> DataFrame:
    """from_node, to_node, iou: boxes of one label that overlap by at least so much and were never seen at one time."""
    apart = (F.col(last) < F.col(f"right_{first}")) | (F.col(f"right_{last}") < F.col(first))
    deals = -(-boxes.count() // DEALT)
    # times come along with the boxes, so that pairs are judged where they meet and never shuffled
    met = by_box_iou(boxes, boxes, left_id=node, right_id=node, size=size, least=least, equal=[label], keep=[first, last], where=(F.col(node) < F.col(f"right_{node}")) & apart, deals=deals)
    return met.select(F.col(f"right_{node}").alias("from_node"), F.col(node).alias("to_node"), "iou")


def pixel_iou(a: DataFrame, b: DataFrame, pixel: Sequence[str], left: str, right: str) -> DataFrame:
    """left, right, common, iou for masks that share a pixel; masks hold each pixel once."""
    x, y = a.select(*pixel, left).distinct(), b.select(*pixel, right).distinct()
    nx, ny = x.groupBy(left).agg(F.count("*").alias("_nx")), y.groupBy(right).agg(F.count("*").alias("_ny"))
    common = x.join(y, list(pixel)).groupBy(left, right).agg(F.count("*").alias("common"))
    return common.join(nx, left).join(ny, right).select(left, right, "common", (F.col("common") / (F.col("_nx") + F.col("_ny") - F.col("common"))).alias("iou"))


def hops(edges: DataFrame, seeds: DataFrame, node: str, limit: int | None = None) -> DataFrame:
    """node, distance: steps along undirected edges (u, v) from the nearest seed; a frontier join a step. With a limit only
    those within it, without one all that are reached."""
    from ..plans.scratch import saved

    both = saved(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    seen = saved(seeds.select(F.col(node).alias("node"), F.lit(0).alias("distance")).distinct(), "seen")
    front = seen
    for k in count(1):
        if limit is not None and k > limit:
            break
        step = both.join(front, both["u"] == front["node"]).select(F.col("v").alias("node")).distinct()
        front = saved(step.join(seen, "node", "left_anti").select("node", F.lit(k).alias("distance")), "front")
        if front.isEmpty():
            break
        seen = saved(seen.unionByName(front), "seen")
    return seen

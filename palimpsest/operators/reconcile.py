"""Reconciliation of a prior state with new evidence: what is refreshed, removed, kept or put aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refresh(old: DataFrame, fresh: DataFrame, dirty: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the dirty keys, and of fresh these keys and those that old lacks."""
    stale = dirty.select(*keys).distinct()
    kept = old.join(stale, list(keys), "left_anti")
    return kept.unionByName(fresh.join(kept.select(*keys), list(keys), "left_anti"))


def object_changes(nodes: DataFrame, merges: DataFrame, evidence: DataFrame, node: str, identity: str, *, size: str) -> DataFrame:
    """node, merged_id, and evidence's columns: a record a node. Only nodes without an identity follow merge proposals, and only those
    that have a surface now get evidence. merges: node, merged_id; evidence: a row a node at most."""
    free = merges.join(nodes.where(F.col(identity).isNull()).select(node), node, "left_semi")
    seen = evidence.join(nodes.where(F.col(size) > 0).select(node), node, "left_semi")
    return nodes.select(node).join(free.select(node, "merged_id"), node, "left").join(seen, node, "left")


def residue(vertices: DataFrame, evidence: DataFrame, vid: str, *, protected: Column, quarantine: bool) -> DataFrame:
    """vid, decision for vertices near what moved: confirmed (seen through, and never seen), rejected (seen again), protected,
    and those without evidence, which are kept or, if quarantine, put aside. evidence: vid, absent, present."""
    met = vertices.join(evidence.select(vid, "absent", "present"), vid, "left")
    absent, present = F.coalesce("absent", F.lit(0)), F.coalesce("present", F.lit(0))
    rest = F.lit("quarantined" if quarantine else "kept")
    return met.select(vid, F.when(protected, "protected").when(present > 0, "rejected").when(absent > 0, "confirmed").otherwise(rest).alias("decision"))


def protects(label: Column, labels: Sequence[int], normal_z: Column | None = None, steep: float = 0.85) -> Column:
    """Whether a vertex is one of a protected label or of a level surface."""
    out = label.isin(list(labels))
    return out | F.coalesce(F.abs(normal_z) >= steep, F.lit(False)) if normal_z is not None else out


def object_modes(vertices: DataFrame, evidence: DataFrame, vid: str, key: str, *, least_observed: float, absent_share: float, seen_share: float) -> DataFrame:
    """key, n, observed, absent, mode: what is done with an object of the prior state. Of one that too few rays reach nothing is known
    (unobserved); one of which most observed vertices are seen through is cleaned up; one of which enough are seen again is
    taken as observed again; another one keeps its surface and takes up new parts (injected)."""
    met = vertices.join(evidence.select(vid, "absent", "present"), vid, "left")
    a, p = F.coalesce("absent", F.lit(0)) > 0, F.coalesce("present", F.lit(0)) > 0
    out = met.groupBy(key).agg(F.count("*").alias("n"), F.count_if(a | p).alias("observed"), F.count_if(a & ~p).alias("absent"), F.count_if(p).alias("_p"))
    o = F.col("observed")
    mode = F.when(o < least_observed * F.col("n"), "unobserved").when(F.col("absent") >= absent_share * o, "cleanup").when(F.col("_p") >= seen_share * o, "reobserved").otherwise("injection")
    return out.select(key, "n", "observed", "absent", mode.alias("mode"))


def without_absent(vertices: DataFrame, inside: DataFrame, boxes: DataFrame, *, vid: str, box: str, label: str, box_label: str) -> DataFrame:
    """vertices without those inside a box of what is known to be absent, if they have its label. inside: vid, box."""
    named = inside.join(boxes.select(box, F.col(box_label).alias("_l")), box)
    gone = named.join(vertices.select(vid, label), vid).where(F.col(label) == F.col("_l")).select(vid).distinct()
    return vertices.join(gone, vid, "left_anti")


#: Fixed words: what a decision says, and the status of an audited object.
DECISIONS = ("absent", "unobserved", "new_current", "support_filter", "supported_prior", "current_only", "persistent_union")


def exact_mean(value: str) -> Column:
    """The mean of a group to the last digit of its values (18 after the point), whatever order they come in: a sum of doubles may miss a
    limit that the mean is on."""
    return F.sum(F.col(value).cast("decimal(28,18)")).cast("double") / F.count(value)


def logical_state(change: Column, decision: Column, known: Column, summarised: Column) -> Column:
    """The state that a belief's decision amounts to, by the kind of change that truly happened."""
    removed = F.when(~summarised & decision.contains("absent"), "Absent").when(~summarised & decision.contains("unobserved"), "Unobserved").otherwise("Leaked")
    new = F.when(summarised & decision.contains("new_current"), "New").otherwise("MissingOrMisclassified")
    filtered = decision.contains("support_filter") | decision.contains("supported_prior") | decision.contains("current_only")
    moved = F.when(~summarised, "MissingCurrent").when(filtered, "MovedCurrent").when(decision.contains("persistent_union"), "RiskyUnion").otherwise("Persistent")
    return F.when(~known, "Missing").when(change == "removed", removed).when(change == "new", new).when(change == "moved", moved).otherwise("Unknown")


def audit_status(change: Column, state: Column, *, truth_points: Column, known: Column, support: Column, agrees: Column, free_conflict: Column) -> Column:
    """ok, warning or error of an audited object."""
    support, agrees, free_conflict = (F.coalesce(c, F.lit(0.0)) for c in (support, agrees, free_conflict))
    moved = F.when((support >= 0.98) & (agrees >= 0.98), "ok_stable_overlap").when(state == "MovedCurrent", "ok_moved_filtered").when((state == "RiskyUnion") & (free_conflict < 0.2), "warn_union_low_conflict").otherwise("error_moved_stale_risk")
    return (
        F.when((truth_points == 0) & ~known, "ignore_no_gt_geometry")
        .when(change == "removed", F.when(state == "Absent", "ok").otherwise("error_removed_leaked"))
        .when(change == "new", F.when(state == "New", "ok").otherwise("error_new_missing"))
        .when(change == "moved", moved)
        .otherwise("unknown")
    )

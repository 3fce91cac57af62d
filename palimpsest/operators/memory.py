"""Object memory across sessions: what is new, persistent, changed, absent or not seen again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .association import greedy_nearest


def session_update(before: DataFrame, after: DataFrame, label: str, *, free_share: str, least_free: float, delta: Column, tolerance: float, background: Column | None = None) -> DataFrame:
    """label, decision for the labels of either session. before and after have one row per label; before's free_share is the
    share of its points that the later session sees through. delta may name columns of before (b_...) and after (a_...)."""
    a = after.select(label, F.lit(True).alias("_after"), *[F.col(c).alias(f"a_{c}") for c in after.columns if c != label])
    b = before.select(label, F.lit(True).alias("_before"), *[F.col(c).alias(f"b_{c}") for c in before.columns if c != label])
    met = b.join(a, label, "full_outer")
    decision = (
        F.when(background, "background_union") if background is not None else F.when(F.lit(False), "")
    )
    decision = (
        decision.when(F.col("_before").isNull(), "new")
        .when(F.col("_after").isNull() & (F.col(f"b_{free_share}") >= least_free), "absent")
        .when(F.col("_after").isNull(), "unobserved")
        .when(delta <= tolerance, "persistent")
        .otherwise("changed")
    )
    return met.withColumn("decision", decision).drop("_before", "_after")


def decide(known: DataFrame, now: DataFrame, label: str, *, free: str, support: str, least_free: float, supported: float, background: Sequence[int] = ()) -> DataFrame:
    """label, decision for the labels of either session: background is joined; what only the later session has is new; what it
    lacks is absent if it sees through most of it, else unobserved; what both have is joined where the prior is supported,
    else the later one holds alone if it sees through the prior, or with the prior's supported part."""
    a, b = known.select(label, free, support, F.lit(True).alias("_k")), now.select(label).distinct().withColumn("_n", F.lit(True))
    met = a.join(b, label, "full_outer")
    decision = (
        F.when(F.col(label).isin(list(background)), "background_union")
        .when(F.col("_k").isNull(), "new_current")
        .when(F.col("_n").isNull() & (F.col(free) >= least_free), "absent")
        .when(F.col("_n").isNull(), "unobserved")
        .when(F.col(support) >= supported, "persistent_union")
        .when(F.col(free) >= least_free, "current_only")
        .otherwise("supported_prior")
    )
    return met.select(label, decision.alias("decision"))


def match_prior(prior: DataFrame, current: DataFrame, radius: float, *, prior_id: str, current_id: str, label: str) -> DataFrame:
    """prior_id, right_<current_id> (null: not matched), d2: one-to-one, nearest first, equal labels."""
    found = greedy_nearest(prior, current, radius, left_id=prior_id, right_id=current_id, label=label)
    return prior.select(prior_id).join(found.select(prior_id, f"right_{current_id}", "d2"), prior_id, "left")


def conflict(samples: DataFrame, pair: list[str], *, weight: Column, conflicting: Column, matching: Column, rejection: Column, acceptance: Column) -> DataFrame:
    """pair, conflict_weight, match_weight, conflicts, matches: weighted votes of a pair's samples. A sum only grows, so
    comparing the final one is the same as stopping early."""
    sums = samples.groupBy(*pair).agg(F.sum(F.when(conflicting, weight).otherwise(0.0)).alias("conflict_weight"), F.sum(F.when(matching, weight).otherwise(0.0)).alias("match_weight"), F.count("*").alias("n"))
    return sums.select(*pair, "n", "conflict_weight", "match_weight", (F.col("conflict_weight") > rejection).alias("conflicts"), (F.col("match_weight") > acceptance).alias("matches"))


def pair_state(conflicts: Column, same_class: Column, matches: Column, state: Column) -> Column:
    """A conflict makes a submap absent, a match of the same class persistent; else it keeps its state."""
    return F.when(conflicts, "absent").when(same_class & matches, "persistent").otherwise(state)

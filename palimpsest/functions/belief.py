"""Beliefs about change: move probability, stationarity and their decisions, in closed form."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The log-odds of a move before any evidence, per time scale, for one-sided evidence and for its order.
BASE, PER_SCALE, SCALE_LIMIT, ONLY_ABSENT, ONLY_PRESENT, ORDER = -2.0, 3.0, 2.0, 4.0, -2.0, 1.0
#: Fixed words that mark things that move by themselves.
MOVERS = ("person", "human", "robot", "cart", "trolley", "vehicle", "animal")
#: Stationarity below which an object with absence votes counts as absent.
STATIONARITY = 0.4


def move_probability(first_absent: Column, last_absent: Column, first_persistent: Column, last_persistent: Column, scale_s: float) -> Column:
    """Of stamps in nanoseconds, null where there is no evidence."""
    absent, persistent = F.coalesce(last_absent, first_absent), F.coalesce(last_persistent, first_persistent)
    gap = (absent.cast("double") - persistent.cast("double")) / 1e9 / max(scale_s, 1.0)
    sides = (
        F.when(absent.isNotNull() & persistent.isNotNull(), PER_SCALE * F.greatest(F.lit(-SCALE_LIMIT), F.least(F.lit(SCALE_LIMIT), gap)))
        .when(absent.isNotNull(), ONLY_ABSENT)
        .when(persistent.isNotNull(), ONLY_PRESENT)
        .otherwise(0.0)
    )
    later = F.coalesce(last_absent, F.lit(0)) > F.coalesce(last_persistent, F.lit(0))
    order = F.when(later, ORDER).when(last_persistent.isNotNull(), -ORDER).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-(BASE + sides + order)))


def moved(policy: str, probability: Column, last_absent: Column, last_persistent: Column, *, threshold: float = 0.5, missing_cost: float = 1.0) -> Column:
    """policy: "hard" goes by the later evidence, "probability" by a threshold, "expected_utility" by the cost of an error."""
    rules = {
        "hard": F.coalesce(last_absent, F.lit(0)) > F.coalesce(last_persistent, F.lit(0)),
        "probability": probability >= threshold,
        "expected_utility": probability > (1 - probability) * missing_cost,
    }
    if policy not in rules:
        raise ValueError(f"policy is one of {sorted(rules)}")
    return rules[policy]


def track_confidence(observations: Column, least: int) -> Column:
    return F.least(observations / F.lit(2.0 * least), F.lit(1.0))


def stationary_class(*words: Column) -> Column:
    """0 for what moves by itself, else 1."""
    return F.when(F.lower(F.concat_ws(" ", *words)).rlike("|".join(MOVERS)), 0).otherwise(1)


def stationarity_weight(stationary: Column, delta: Column, tau: float, hidden: Column) -> Column:
    """How far a semantic class counts: not for hidden objects, less the further an object is from where it was."""
    size = F.abs(delta)
    return F.when(hidden, 0.0).when(stationary == 0, 1.0).when(size <= tau, 1.0).when(size <= 2 * tau, 0.5).otherwise(0.0)


def combined_weight(w1: Column, w2: Column, full: float) -> Column:
    share = [F.least(w / full, F.lit(1.0)) for w in (w1, w2)]
    return F.when((w1 <= 0) | (w2 <= 0), 0.0).when((w1 >= full) & (w2 >= full), 1.0).otherwise(F.sqrt(share[0] * share[1]))


@dataclass(frozen=True)
class Posterior:
    mu: Column
    sigma: Column
    alpha: Column
    beta: Column
    inlier_weight: Column


def posterior(mu: Column, sigma: Column, alpha: Column, beta: Column, delta: Column, stationary: Column, k: Column, *, tau: float, delta_max: float) -> Posterior:
    """Gaussian-Beta update by moment matching of two components, geometry seen or not.

    Both components share alpha + k s and beta + k (1 - s), so the ratio of their Beta functions is the ratio of these."""
    tau = max(tau, 1e-6)
    delta_max = max(delta_max, tau)
    sigma = F.greatest(sigma, F.lit(1e-6))
    variance, noise = sigma * sigma, tau * tau
    gain = 1 / (1 / variance + 1 / noise)
    seen_mu = gain * (mu / variance + delta / noise)
    a, b = alpha + k * stationary, beta + k * (1 - stationary)
    spread = variance + noise
    near = F.exp(-(delta - mu) * (delta - mu) / (2 * spread)) / F.sqrt(spread * (2 * math.pi)) * a
    far = b / (2 * delta_max)
    seen = near / (near + far)
    unseen = 1 - seen
    new_mu = seen * seen_mu + unseen * mu
    second = seen * (gain + seen_mu * seen_mu) + unseen * (variance + mu * mu)
    new_sigma = F.sqrt(F.greatest(F.lit(1e-8), second - new_mu * new_mu))
    n = a + b + 1
    mean = (seen * (a + 1) + unseen * a) / n
    square = (seen * (a + 1) * (a + 2) + unseen * a * (a + 1)) / (n * (n + 1))
    mean = F.greatest(F.lit(1e-5), F.least(F.lit(1 - 1e-5), mean))
    strength = F.greatest(F.lit(1e-6), mean * (1 - mean) / F.greatest(F.lit(1e-8), square - mean * mean) - 1)
    return Posterior(new_mu, new_sigma, mean * strength, (1 - mean) * strength, seen)


def memory_state(absent_votes: Column, present_votes: Column, alpha: Column, beta: Column, threshold: float = STATIONARITY) -> Column:
    """absent, supported or unobserved: what isn't seen again is never taken for absent."""
    return F.when((absent_votes > 0) & (alpha / (alpha + beta) < threshold), "absent").when(present_votes > 0, "supported").otherwise("unobserved")


def cull(policy: str, absent: Column, present: Column, *, least_absent: int = 1, most_present: int = 0) -> Column:
    """Whether free space contradicts a point."""
    rules = {"no_present": (absent >= least_absent) & (present <= most_present), "absence_majority": (absent >= least_absent) & (absent > present)}
    if policy not in rules:
        raise ValueError(f"policy is one of {sorted(rules)}")
    return rules[policy]

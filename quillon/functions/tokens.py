"""Per-token expressions: KL estimators, clipped objectives, importance weights.

Each takes and returns Columns, so it serves a table with a row per token as
well as the lambda of a higher-order function over arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bounds that the definitions clamp log ratios with.
LOG_RATIO_BOUND = 20.0
KL_BOUND = 10.0


def clamp(x: Column, low, high) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, lit(low)), lit(high))


def ratio(lp: Column, old: Column) -> Column:
    """exp(log ratio), the log ratio clamped."""
    return F.exp(clamp(lp - old, -LOG_RATIO_BOUND, LOG_RATIO_BOUND))


def kl(lp: Column, ref: Column, kind: str = "k1") -> Column:
    """Estimators of KL(policy, reference) per token; a trailing ``+`` keeps the value."""
    kind = kind.rstrip("+")
    d = lp - ref
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return 0.5 * d * d
    if kind in ("k3", "low_var_kl"):
        e = clamp(-d, -LOG_RATIO_BOUND, LOG_RATIO_BOUND)
        return clamp(F.exp(e) - e - 1, -KL_BOUND, KL_BOUND)
    raise ValueError(f"unknown KL estimator {kind!r}")


def ppo_clip(lp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """Clipped surrogate loss; below zero advantage it is bounded by ``dual``."""
    r = ratio(lp, old)
    clipped = F.greatest(-adv * r, -adv * clamp(r, 1 - low, 1 + high))
    return F.when(adv < 0, F.least(-adv * dual, clipped)).otherwise(clipped)


def dppo_tv(lp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, most: float = 20.0) -> Column:
    """Drops tokens whose probability moved too far in the advantage's direction."""
    moved = F.exp(lp) - F.exp(old)
    kept = ~(((adv > 0) & (moved > high)) | ((adv < 0) & (moved < -low)))
    return F.when(kept, -adv * F.least(ratio(lp, old), F.lit(most))).otherwise(F.lit(0.0))


def binary_kl(old: Column, lp: Column) -> Column:
    """KL between the two-way choices 'this token or another'."""
    p, q = clamp(F.exp(old), 1e-8, 1 - 1e-8), clamp(F.exp(lp), 1e-8, 1 - 1e-8)
    return p * F.ln(p / q) + (1 - p) * F.ln((1 - p) / (1 - q))


def dppo_kl(lp: Column, old: Column, adv: Column, bound: float = 0.05, most: float = 20.0) -> Column:
    far = binary_kl(old, lp) > bound
    kept = ~((far & (adv > 0) & (lp > old)) | (far & (adv < 0) & (lp < old)))
    return F.when(kept, -adv * F.least(ratio(lp, old), F.lit(most))).otherwise(F.lit(0.0))


def sapo(lp: Column, old: Column, adv: Column, tau_pos: float = 1.0, tau_neg: float = 1.05) -> Column:
    """Soft gate: 4 / tau times the sigmoid of tau (ratio - 1), tau by the advantage's sign."""
    r, tau = ratio(lp, old), F.when(adv > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
    return -adv * (4 / tau) / (1 + F.exp(-tau * (r - 1)))


def gpg(lp: Column, adv: Column) -> Column:
    return -lp * adv


def cispo(lp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    return -clamp(ratio(lp, old), 1 - low, 1 + high) * adv * lp


def reinforce(lp: Column, adv: Column, weight: Column | None = None) -> Column:
    loss = -adv * lp
    return loss if weight is None else loss * weight


def value_loss(predicted: Column, returns: Column, values: Column, clip: float = 0.5) -> Column:
    """Half the greater squared error of the prediction and the clipped one."""
    bounded = clamp(predicted, values - clip, values + clip)
    return 0.5 * F.greatest((predicted - returns) * (predicted - returns), (bounded - returns) * (bounded - returns))


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of an array of logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    weighted = F.aggregate(logits, F.lit(0.0), lambda s, x: s + x * F.exp(x - top))
    return F.ln(total) + top - weighted / total


def importance_weight(log_ratio: Column, upper: float, lower: float | None = None) -> Column:
    """exp of the clamped log ratio: truncated above, or zero outside ``[lower, upper]``."""
    w = F.exp(clamp(log_ratio, -LOG_RATIO_BOUND, LOG_RATIO_BOUND))
    if lower is None:
        return F.least(w, F.lit(float(upper)))
    return F.when(w.between(lower, upper), w).otherwise(F.lit(0.0))


def overlong_penalty(length: Column, expected: int, buffer: int, factor: float) -> Column:
    """What exceeds the expected length costs up to ``factor`` per buffer."""
    return F.least(-(length - expected) / buffer * factor, F.lit(0.0))


def workload(tokens: Column) -> Column:
    """Cost of a sequence: a linear and a quadratic part."""
    return 24576 * tokens + tokens * tokens

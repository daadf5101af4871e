"""Reductions, losses and rejection over tables with a row per token.

The tables have ``row_id`` (sequence), ``t`` (place in it), ``mask`` (0 or 1)
and value columns.  What is masked out never counts, NaN included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import tokens as T

#: Added to a count of tokens before dividing by it.
MASK_EPSILON = 1e-8


def in_mask(x: Column, mask: Column | str = "mask") -> Column:
    mask = F.col(mask) if isinstance(mask, str) else mask
    return F.when(mask > 0, x)


def masked_stats(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Sum, mean, Bessel-corrected variance and count of what is in the mask."""
    x = in_mask(F.col(value))
    out = df.groupBy(*by).agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.var_samp(x).alias("var"), F.count(x).alias("n"))
    return out.withColumn("mean", F.col("sum") / (F.col("n") + MASK_EPSILON))


def whiten(df: DataFrame, value: str, shift_mean: bool = True, name: str = "whitened") -> DataFrame:
    """``(x - mean) / sqrt(var + eps)`` over all tokens in the mask; one row of
    statistics is joined to all."""
    x = in_mask(F.col(value))
    stats = df.agg((F.sum(x) / (F.count(x) + MASK_EPSILON)).alias("_mean"), F.var_samp(x).alias("_var"))
    scaled = (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + MASK_EPSILON)
    if not shift_mean:
        scaled = scaled + F.col("_mean")
    return df.join(F.broadcast(stats)).withColumn(name, F.when(F.col("mask") > 0, scaled).otherwise(F.lit(0.0))).drop("_mean", "_var")


def aggregate_loss(df: DataFrame, loss: Column, mode: str = "token-mean", scale: float | None = None) -> DataFrame:
    """One row ``loss``: the reduction of a per-token loss.

    ``token-mean``; ``seq-mean-token-sum``; ``seq-mean-token-sum-norm`` (divided
    by ``scale``); ``seq-mean-token-mean``.  Rows masked throughout do not count.
    """
    rows = df.groupBy("row_id").agg(F.sum(in_mask(loss)).alias("s"), F.sum("mask").alias("n")).filter("n > 0")
    mean = {
        "token-mean": F.sum("s") / F.sum("n"),
        "seq-mean-token-sum": F.sum("s") / F.count("*"),
        "seq-mean-token-sum-norm": F.sum("s") / F.lit(float(scale or 1)),
        "seq-mean-token-mean": F.sum(F.col("s") / (F.col("n") + MASK_EPSILON)) / F.count("*"),
    }
    if mode not in mean:
        raise ValueError(f"unknown reduction {mode!r}")
    return rows.agg(mean[mode].alias("loss"))


def per_row(df: DataFrame, **columns: Column) -> DataFrame:
    """Aggregates of each sequence over the tokens in its mask."""
    return df.groupBy("row_id").agg(*[c.alias(n) for n, c in columns.items()])


def sequence_ratio(df: DataFrame, lp: str, old: str) -> Column:
    """Mean log ratio of a sequence, as a window column (one exchange on row_id)."""
    w = Window.partitionBy("row_id")
    d = in_mask(F.col(lp) - F.col(old))
    return F.sum(d).over(w) / F.greatest(F.sum("mask").over(w), F.lit(1))


def gspo_loss(df: DataFrame, lp: str, old: str, adv: str, low: float = 3e-4, high: float = 4e-4) -> DataFrame:
    """Clipped objective of the sequence's mean ratio, averaged by sequence."""
    df = df.withColumn("_r", F.exp(F.least(sequence_ratio(df, lp, old), F.lit(10.0))))
    loss = F.greatest(-F.col(adv) * F.col("_r"), -F.col(adv) * T.clamp(F.col("_r"), 1 - low, 1 + high))
    return aggregate_loss(df, loss, "seq-mean-token-mean")


def geo_mean_loss(df: DataFrame, lp: str, old: str, adv: str, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """exp of the mean clipped log ratio of each sequence times its mean advantage."""
    d, a = F.col(lp) - F.col(old), F.col(adv)
    sign = F.when(a >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    pessimistic = sign * F.least(sign * d, sign * T.clamp(d, -low, high))
    rows = df.groupBy("row_id").agg(
        (F.sum(in_mask(pessimistic)) / (F.sum("mask") + MASK_EPSILON)).alias("r"), (F.sum(in_mask(a)) / (F.sum("mask") + MASK_EPSILON)).alias("a")
    )
    return rows.agg(F.avg(-F.col("a") * F.exp("r")).alias("loss"))


def covariance(df: DataFrame, lp: str, adv: str) -> DataFrame:
    """Add ``cov``: each token's term of the covariance of log probability and advantage."""
    stats = df.agg(F.avg(in_mask(F.col(lp))).alias("_lp"), F.avg(in_mask(F.col(adv))).alias("_adv"))
    return df.join(F.broadcast(stats)).withColumn("cov", in_mask((F.col(lp) - F.col("_lp")) * (F.col(adv) - F.col("_adv")))).drop("_lp", "_adv")


#: Of how fine a share the bound is that cuts an order before its first tokens are ranked.
FINE = 10_000


def _leading(df: DataFrame, n: int, total: int, order: Column) -> DataFrame:
    """The first ``n`` of ``total`` tokens of an order, then by ``row_id, t``.

    A quantile a little beyond cuts the others off; what is left is ranked in ranges.
    """
    from quillon.operators.batch import with_ordinal

    named = df.withColumn("_order", order)
    share = n / max(total, 1) + 3 / FINE
    if share < 1:
        bound = named.agg(F.percentile_approx("_order", share, FINE)).first()[0]
        near = named.filter(F.col("_order") <= F.lit(bound)) if bound is not None else named
        named = near if near.count() >= n else named
    ranked = with_ordinal(named.withColumnsRenamed({"row_id": "_row", "t": "_t"}), "_order", "_row", "_t")
    return ranked.filter(F.col("row_id") < n).drop("row_id", "_order").withColumnsRenamed({"_row": "row_id", "_t": "t"})


def _with_covariance(df: DataFrame, lp: str, old: str, adv: str) -> tuple[DataFrame, int]:
    """What the losses by covariance read of the tokens in the mask, written once, and how many they are."""
    from quillon.sources.scratch import written

    inside = written(df.filter("mask > 0").select(*dict.fromkeys(["row_id", "t", "mask", lp, old, adv])), "tokens")
    return covariance(inside, lp, adv), inside.count()


def _mean_changed(all_: DataFrame, loss: Column, some: DataFrame, change: Column) -> DataFrame:
    """One row ``loss``: the mean over tokens, with a change for some of them."""
    whole = all_.agg(F.sum(loss).alias("s"), F.count("*").alias("n"))
    more = some.agg(F.coalesce(F.sum(change), F.lit(0.0)).alias("more"))
    return whole.crossJoin(F.broadcast(more)).select(((F.col("s") + F.col("more")) / F.col("n")).alias("loss"))


def kl_cov_loss(df: DataFrame, lp: str, old: str, adv: str, share: float = 0.002, weight: float = 1.0) -> DataFrame:
    """Adds a KL term to the tokens of greatest covariance (``share`` of them, one at least)."""
    inside, total = _with_covariance(df, lp, old, adv)
    top = _leading(inside, max(1, int(total * share)), total, -F.col("cov"))
    return _mean_changed(inside, -F.col(adv) * T.ratio(F.col(lp), F.col(old)), top, weight * F.abs(F.col(lp) - F.col(old)))


def clip_cov_loss(df: DataFrame, lp: str, old: str, adv: str, low: float = 1.0, high: float = 5.0, share: float = 0.002, seed: int = 0) -> DataFrame:
    """Drops a random ``share`` of the tokens whose covariance lies in ``(low, high)``."""
    inside, total = _with_covariance(df, lp, old, adv)
    among = inside.filter((F.col("cov") > low) & (F.col("cov") < high))
    chosen = _leading(among, max(1, int(total * share)), among.count(), F.xxhash64(F.lit(seed), "row_id", "t"))
    loss = T.ppo_clip(F.col(lp), F.col(old), F.col(adv))
    return _mean_changed(inside, loss, chosen, -loss)


def entropy_loss(df: DataFrame, logits: str, mode: str = "token-mean", scale: float | None = None) -> DataFrame:
    """The reduction of the entropy of each token's logits."""
    return aggregate_loss(df, T.entropy(F.col(logits)), mode, scale)


# The names of the eleven rejection statistics.
REJECTIONS = [
    "token_k1", "token_k2", "token_k3", "seq_sum_k1", "seq_sum_k2", "seq_sum_k3", "seq_mean_k1", "seq_mean_k2", "seq_mean_k3", "seq_max_k2", "seq_max_k3",
]


def threshold(option: str, spec: str | float) -> tuple[float | None, float]:
    """Bounds in the option's own space: k1 takes ``low_high`` or one upper ratio."""
    import math

    if option.endswith("k1"):
        low, _, high = str(spec).partition("_")
        upper = float(high) if high else float(low)
        lower = float(low) if high else 1 / upper
        return math.log(lower), math.log(upper)
    return None, float(spec)


def reject(df: DataFrame, log_ratio: str, options: dict[str, str | float], name: str = "kept") -> DataFrame:
    """Add ``kept``: 1 where the token is in the mask and every option passes.

    Token options judge tokens; ``seq_*`` options judge the sum, mean or
    greatest value of a sequence and drop it whole.
    """
    d = T.clamp(F.col(log_ratio), -T.LOG_RATIO_BOUND, T.LOG_RATIO_BOUND)
    terms = {"k1": d, "k2": 0.5 * d * d, "k3": F.exp(d) - 1 - d}
    w = Window.partitionBy("row_id")
    passes = F.col("mask") > 0
    for option, spec in options.items():
        if option not in REJECTIONS:
            raise ValueError(f"unknown rejection option {option!r}")
        level, _, rest = option.partition("_")
        low, high = threshold(option, spec)
        x = terms[option[-2:]]
        if level == "seq":
            inside = in_mask(x)
            total, n = F.coalesce(F.sum(inside).over(w), F.lit(0.0)), F.sum("mask").over(w)
            x = {"sum": total, "mean": total / (n + MASK_EPSILON), "max": F.coalesce(F.max(inside).over(w), F.lit(0.0))}[rest.split("_")[0]]
        passes = passes & (x <= high) & (F.lit(True) if low is None else x >= low)
    return df.withColumn(name, F.when(passes, 1).otherwise(0))


def off_policy_metrics(df: DataFrame, old: str, rollout: str) -> DataFrame:
    """Perplexities, KL and chi-square of the training against the rollout policy."""
    d = F.col(old) - F.col(rollout)
    n = F.sum("mask") + MASK_EPSILON
    rows = df.groupBy("row_id").agg(
        (F.sum(in_mask(F.col(old))) / n).alias("lp"),
        (F.sum(in_mask(F.col(rollout))) / n).alias("rp"),
        F.sum(in_mask(d)).alias("d"),
        F.sum(in_mask(F.exp(d) - d - 1)).alias("k3"),
        F.sum(in_mask(F.exp(2 * T.clamp(d, -20, 20)))).alias("sq"),
        F.sum("mask").alias("n"),
    ).filter("n > 0")
    return rows.agg(
        F.avg(F.exp(-F.col("lp"))).alias("training_ppl"),
        F.avg(F.exp(-F.col("rp"))).alias("rollout_ppl"),
        (-F.sum("d") / F.sum("n")).alias("kl"),
        (F.sum("k3") / F.sum("n")).alias("k3_kl"),
        F.avg(F.exp(F.col("rp") - F.col("lp"))).alias("ppl_ratio"),
        (F.sum("sq") / F.sum("n") - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * T.clamp(F.col("d"), -20, 20))) - 1).alias("chi2_seq"),
    )


def importance_metrics(df: DataFrame, weight: str, high: float, low: float) -> DataFrame:
    """Mean, extremes, spread, effective sample size and shares beyond the bounds."""
    w = in_mask(F.col(weight))
    return df.agg(
        F.avg(w).alias("mean"), F.min(w).alias("min"), F.max(w).alias("max"), F.stddev_pop(w).alias("std"),
        (F.sum(w) * F.sum(w) / (F.sum(w * w) * F.count(w))).alias("ess"),
        F.avg(in_mask((F.col(weight) > high).cast("double"))).alias("above"),
        F.avg(in_mask((F.col(weight) < low).cast("double"))).alias("below"),
    )


def correct_rollout(df: DataFrame, old: str, rollout: str, level: str = "token", upper: float = 2.0, lower: float | None = None, normalise: bool = False, options: dict | None = None) -> DataFrame:
    """Add ``weight`` (importance of each token) and ``kept`` (mask after rejection).

    ``sequence`` weighs all tokens of a row by its summed log ratio.  ``normalise``
    divides by the mean weight in the mask.  ``options`` are rejection options.
    """
    d = F.col(old) - F.col(rollout)
    if level == "sequence":
        d = F.coalesce(F.sum(in_mask(d)).over(Window.partitionBy("row_id")), F.lit(0.0))
    df = df.withColumn("_d", F.col(old) - F.col(rollout)).withColumn("weight", T.importance_weight(d, upper, lower) * F.col("mask"))
    if normalise:
        mean = df.agg((F.sum("weight") / (F.sum("mask") + MASK_EPSILON)).alias("_mean"))
        df = df.join(F.broadcast(mean)).withColumn("weight", F.col("weight") / (F.col("_mean") + MASK_EPSILON)).drop("_mean")
    return reject(df, "_d", options or {}).drop("_d")


def bypass_loss(df: DataFrame, lp: str, rollout: str, adv: str, clipped: bool, **correction) -> DataFrame:
    """Loss against the rollout policy: rejection always, weights for the plain form only."""
    df = correct_rollout(df, lp, rollout, **correction)
    df = df.withColumn("mask", F.col("kept"))
    loss = T.ppo_clip(F.col(lp), F.col(rollout), F.col(adv)) if clipped else T.reinforce(F.col(lp), F.col(adv), F.col("weight"))
    return aggregate_loss(df, loss)

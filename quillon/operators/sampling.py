"""Weighted samples without replacement, by weights that feedback changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *key: str | Column) -> Column:
    """A number in (0, 1) that the seed and the key decide: 52 bits of a digest."""
    parts = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / 2.0**52


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, each next one with a chance in proportion to its ``weight``.

    Every row draws an exponential time at the rate of its weight; the ``n`` first are
    the sample, so each task keeps ``n`` rows at most.  Rows without a positive weight are
    never drawn.  ``key`` must tell rows apart; the same seed gives the same sample.
    """
    time = -F.ln(uniform(seed, key)) / F.col(weight)
    return df.filter(F.col(weight) > 0).withColumn("_time", time).orderBy("_time", key).limit(n).drop("_time")


def with_feedback(weights: DataFrame, feedback: DataFrame, key: str, rate: float) -> DataFrame:
    """``key, weight`` after a batch: those with ``feedback(key, signal)`` move by ``rate`` to their mean signal."""
    mean = feedback.groupBy(key).agg(F.avg("signal").alias("_signal"))
    moved = F.col("weight") * (1 - rate) + F.col("_signal") * rate
    return weights.join(mean, key, "left").select(key, F.coalesce(moved, F.col("weight")).alias("weight"))


def curriculum(prompts: DataFrame, weights: DataFrame, key: str, n: int, epoch: int, fresh: float = 1.0) -> DataFrame:
    """The ``n`` prompts of an epoch: ``prompts`` may have got rows since; those without a row in
    ``weights(key, weight)`` have the weight ``fresh``."""
    known = prompts.join(weights, key, "left").withColumn("weight", F.coalesce("weight", F.lit(fresh)))
    return weighted_sample(known, key, "weight", n, epoch).withColumn("epoch", F.lit(epoch))

"""Registries of policy losses and of rewards, per-item and batched.

A loss is a DataFrame function of a token table that returns one row ``loss``;
a reward is either a function of the row's columns that returns a Column
(per item), or a function of an Arrow batch that returns its scores (batched).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import tokens as T
from quillon.operators import tokens as O

LOSSES: dict[str, Callable[..., DataFrame]] = {}
REWARDS: dict[str, Callable[..., Column]] = {}
BATCH_REWARDS: dict[str, Callable[[pa.RecordBatch], list[float]]] = {}


def _register(table: dict, kind: str, name: str) -> Callable:
    def add(f: Callable) -> Callable:
        if table.get(name, f) is not f:
            raise ValueError(f"{kind} {name!r} is registered already")
        table[name] = f
        return f

    return add


def register_loss(name: str) -> Callable:
    """Register a loss under a name; another one under it is an error."""
    return _register(LOSSES, "loss", name)


def register_reward(name: str) -> Callable:
    """Register a reward of single rows under a name."""
    return _register(REWARDS, "reward", name)


def register_batch_reward(name: str) -> Callable:
    """Register a reward of Arrow batches under a name."""
    return _register(BATCH_REWARDS, "batched reward", name)


def _of(table: dict, kind: str, name: str) -> Callable:
    if name not in table:
        raise ValueError(f"unknown {kind} {name!r}; known: {sorted(table)}")
    return table[name]


def policy_loss(df: DataFrame, name: str, **options) -> DataFrame:
    """The registered loss of a token table with ``lp``, ``old`` and ``adv``."""
    return _of(LOSSES, "loss", name)(df, **options)


def reward(df: DataFrame, name: str, *columns: str, score: str = "score") -> DataFrame:
    """Add the registered reward of each row's ``columns``."""
    return df.withColumn(score, _of(REWARDS, "reward", name)(*[F.col(c) for c in columns]).cast("double"))


def batch_reward(df: DataFrame, name: str, key: str, *columns: str) -> DataFrame:
    """``key, score``: the registered reward of Arrow batches of ``columns``."""
    score = _of(BATCH_REWARDS, "batched reward", name)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(score(batch), pa.float64())], [key, "score"])

    return df.select(key, *columns).mapInArrow(run, f"{key} {kind}, score double")


def reward_by_source(df: DataFrame, source: str, names: dict[str, str], *columns: str, default: float = 0.0, score: str = "score") -> DataFrame:
    """Add the reward whose name ``names`` gives to the row's source, else ``default``."""
    value = F.lit(float(default))
    for label, name in names.items():
        value = F.when(F.col(source) == label, _of(REWARDS, "reward", name)(*[F.col(c) for c in columns]).cast("double")).otherwise(value)
    return df.withColumn(score, value)


def _per_token(expression: Callable[..., Column]) -> Callable[..., DataFrame]:
    def loss(df: DataFrame, mode: str = "token-mean", scale: float | None = None, **options) -> DataFrame:
        return O.aggregate_loss(df, expression(F.col("lp"), F.col("old"), F.col("adv"), **options), mode, scale)

    return loss


for _name, _f in {
    "ppo_clip": _per_token(T.ppo_clip), "dppo_tv": _per_token(T.dppo_tv), "dppo_kl": _per_token(T.dppo_kl), "sapo": _per_token(T.sapo), "cispo": _per_token(T.cispo),
    "gpg": _per_token(lambda lp, old, adv: T.gpg(lp, adv)), "reinforce": _per_token(lambda lp, old, adv: T.reinforce(lp, adv)),
    "gspo": lambda df, **o: O.gspo_loss(df, "lp", "old", "adv", **o), "geo_mean": lambda df, **o: O.geo_mean_loss(df, "lp", "old", "adv", **o),
    "kl_cov": lambda df, **o: O.kl_cov_loss(df, "lp", "old", "adv", **o), "clip_cov": lambda df, **o: O.clip_cov_loss(df, "lp", "old", "adv", **o),
}.items():
    register_loss(_name)(_f)

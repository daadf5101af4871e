"""Group-relative statistics and estimators.

Outcome estimators take a table with a row per response: a score, a group and
where needed a length; window columns over the group serve every statistic of
a call in one exchange.  Step estimators take a table with a row per token
(``row_id, t, mask``) or, where the recursion is inherently sequential, arrays
per response folded with higher-order functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import tokens as T

#: Added to standard deviations before dividing by them.
EPSILON = 1e-6


def _over(group) -> Window:
    return Window.partitionBy(*([group] if isinstance(group, str) else group))


def canonical_label(label: str) -> Column:
    """Labels as vectorised estimators group them: numeric strings and
    near-integer numbers are one integer label, anything else stands for itself."""
    x = F.trim(F.col(label).cast("string"))
    number = F.when(x.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), x.try_cast("double"))
    return F.when(F.abs(number - F.rint(number)) < 1e-6, F.rint(number).cast("long").cast("string")).otherwise(x)


def group_ids(df: DataFrame, label: str, name: str = "gid") -> DataFrame:
    """Dense ids from 0 by sorted canonical label; only distinct labels are ranked,
    each among those with its first three characters, after the counts of lower ones."""
    labels = df.select(canonical_label(label).alias("_label")).distinct().withColumn("_head", F.substring("_label", 1, 3))
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    heads = labels.groupBy("_head").agg(F.count("*").alias("_n")).select("_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_head").orderBy("_label")) - 1
    ids = labels.withColumn("_rank", rank).join(heads, "_head").select("_label", (F.col("_rank") + F.col("_before")).alias(name))
    return df.withColumn("_label", canonical_label(label)).join(ids, "_label", "left").drop("_label")


def group_stats(df: DataFrame, score: str, group: str | list[str], floor: float | None = None) -> DataFrame:
    """Add ``n, mean, std``: a group of one has mean 0 and std 1.

    ``floor`` is a least variance, as the vectorised form has it.
    """
    w = _over(group)
    n = F.count(score).over(w)
    std = F.stddev_samp(score).over(w) if floor is None else F.sqrt(F.greatest(F.var_samp(score).over(w), F.lit(floor)))
    return df.withColumns(
        {
            "n": n,
            "mean": F.when(n > 1, F.avg(score).over(w)).otherwise(F.lit(0.0)),
            "std": F.when(n > 1, std).otherwise(F.lit(1.0)),
        }
    )


def group_norm(df: DataFrame, score: str, group: str, epsilon: float = EPSILON, by_std: bool = True) -> DataFrame:
    """``(score - mean) / (std + epsilon)`` within each group, or without the std."""
    df = group_stats(df, score, group)
    centred: Column = F.col(score) - F.col("mean")
    return df.withColumn("adv", centred / (F.col("std") + epsilon) if by_std else centred)


def group_norm_floored(df: DataFrame, score: str, group: str, epsilon: float = EPSILON) -> DataFrame:
    """The vectorised form: the variance is floored at ``epsilon``."""
    df = group_stats(df, score, group, floor=epsilon)
    return df.withColumn("adv", (F.col(score) - F.col("mean")) / (F.col("std") + epsilon))


def multi_reward_norm(df: DataFrame, scores: dict[str, float], group: str, epsilon: float = EPSILON) -> DataFrame:
    """Each reward normalised in its group, summed with weights, then whitened."""
    w, total = _over(group), F.lit(0.0)
    for name, weight in scores.items():
        n = F.count(name).over(w)
        mean = F.when(n > 1, F.avg(name).over(w)).otherwise(F.lit(0.0))
        std = F.when(n > 1, F.stddev_samp(name).over(w)).otherwise(F.lit(1.0))
        total = total + weight * (F.col(name) - mean) / (std + epsilon)
    df = df.withColumn("_sum", total)
    stats = df.agg(F.avg("_sum").alias("_m"), F.var_samp("_sum").alias("_v"))
    return df.join(F.broadcast(stats)).withColumn("adv", (F.col("_sum") - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)).drop("_sum", "_m", "_v")


def best_over_second(df: DataFrame, score: str, group: str, order: str, by_std: bool = True, epsilon: float = EPSILON) -> DataFrame:
    """Only the group's best row scores: its lead over the second best, over the std."""
    w = _over(group)
    ranked = w.orderBy(F.col(score).desc(), order)
    lead = F.col(score) - F.lead(score).over(ranked)
    if by_std:
        lead = lead / (F.stddev_samp(score).over(w) + epsilon)
    return df.withColumn("adv", F.when(F.row_number().over(ranked) == 1, F.coalesce(lead, F.lit(0.0))).otherwise(F.lit(0.0)))


def mean_baseline(df: DataFrame, score: str, group: str) -> DataFrame:
    """Score less the group's mean (0 for a group of one), whitened over the batch."""
    w = _over(group)
    centred = F.col(score) - F.when(F.count(score).over(w) > 1, F.avg(score).over(w)).otherwise(F.lit(0.0))
    df = df.withColumn("_c", centred)
    stats = df.agg(F.avg("_c").alias("_m"), F.var_samp("_c").alias("_v"))
    return df.join(F.broadcast(stats)).withColumn("adv", (F.col("_c") - F.col("_m")) / F.sqrt(F.col("_v") + 1e-8)).drop("_c", "_m", "_v")


def leave_one_out(df: DataFrame, score: str, group: str) -> DataFrame:
    """``n / (n - 1) * (score - mean)``; a group of one keeps its score."""
    w = _over(group)
    n = F.count(score).over(w)
    return df.withColumn("adv", F.when(n > 1, n * (F.col(score) - F.avg(score).over(w)) / F.nullif(n - 1, F.lit(0))).otherwise(F.col(score)))


def leave_one_out_vectorised(df: DataFrame, score: str, group: str) -> DataFrame:
    """``(n * score - sum) / (n - 1)``; a group of one has 0."""
    w = _over(group)
    n = F.count(score).over(w)
    return df.withColumn("adv", F.when(n > 1, (n * F.col(score) - F.sum(score).over(w)) / F.nullif(n - 1, F.lit(0))).otherwise(F.lit(0.0)))


def weighted_baseline(df: DataFrame, score: str, group: str, length: str) -> DataFrame:
    """Score less the group's mean weighted by length (0 for a group of one)."""
    w = _over(group)
    mean = F.try_divide(F.sum(F.col(length) * F.col(score)).over(w), F.sum(length).over(w))
    return df.withColumn("adv", F.col(score) - F.when(F.count(score).over(w) > 1, mean).otherwise(F.lit(0.0)))


def scaled_baseline(df: DataFrame, score: str, group: str, f_norm: float = 1.0) -> DataFrame:
    """``alpha * (score - mean) / f_norm`` with alpha the rows over the non-zero scores."""
    w = _over(group)
    alpha = df.agg((F.count("*") / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("_alpha"))
    mean = F.when(F.count(score).over(w) > 1, F.avg(score).over(w)).otherwise(F.lit(0.0))
    return df.join(F.broadcast(alpha)).withColumn("adv", F.col("_alpha") * (F.col(score) - mean) / f_norm).drop("_alpha")


# --- step estimators -------------------------------------------------------


def reward_to_go(df: DataFrame, reward: str, baseline: Column | None = None) -> DataFrame:
    """Sum of the rewards from each token on, less a baseline, in the mask."""
    w = Window.partitionBy("row_id").orderBy(F.col("t").desc())
    total = F.sum(F.when(F.col("mask") > 0, F.col(reward)).otherwise(F.lit(0.0))).over(w)
    return df.withColumn("returns", total).withColumn("adv", (F.col("returns") - (F.lit(0.0) if baseline is None else baseline)) * F.col("mask"))


def discounted_return(rewards: Column, mask: Column, gamma: float) -> Column:
    """Array of discounted returns; after a masked token the sum starts anew."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("g"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        g = (x["r"] + gamma * s["g"]).cast("double")
        return F.struct((g * x["m"]).alias("g"), F.concat(s["out"], F.array(g)).alias("out"))

    return F.aggregate(steps, start, step, lambda s: F.reverse(s["out"]))


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Array of generalised advantages; masked tokens pass the next value and the
    last advantage on, so what they hold does not matter."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        new = x["r"] + gamma * s["v"] - x["v"] + gamma * lam * s["a"]
        a = F.when(x["m"] > 0, new).otherwise(s["a"]).cast("double")
        v = F.when(x["m"] > 0, x["v"]).otherwise(s["v"]).cast("double")
        return F.struct(v.alias("v"), a.alias("a"), F.concat(s["out"], F.array(a)).alias("out"))

    return F.aggregate(steps, start, step, lambda s: F.reverse(s["out"]))


def prefix_weighted_baseline(df: DataFrame, reward: str, lp: str, sum_pi2: str, group: str = "uid", compact: bool = False, epsilon: float = 1e-8) -> DataFrame:
    """Per (group, step) baseline weighted by accumulated path variance.

    A token's weight is the prefix sum of ``1 - 2 p + sum p^2``.  ``compact``
    counts steps among the tokens in the mask only (several turns).
    """
    inside = df.filter("mask > 0")
    by_row = Window.partitionBy("row_id").orderBy("t")
    step = (F.row_number().over(by_row) - 1) if compact else F.col("t")
    inside = inside.withColumns(
        {
            "_step": step,
            "_w": F.sum(1 - 2 * F.exp(lp) + F.col(sum_pi2)).over(by_row.rowsBetween(Window.unboundedPreceding, 0)),
            "_g": F.sum(reward).over(Window.partitionBy("row_id").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    w = Window.partitionBy(group, "_step")
    base = F.sum(F.col("_g") * F.col("_w")).over(w) / (F.sum("_w").over(w) + epsilon)
    return inside.withColumns({"returns": F.col("_g"), "adv": F.col("_g") - base}).drop("_step", "_w", "_g")


def session_broadcast(df: DataFrame, key: str, score: str) -> DataFrame:
    """Keys ``uid_session_index``: the score of each session's last row goes to all its rows."""
    parts = F.regexp_extract(key, r"^(.*)_([^_]+)_(\d+)$", 1), F.regexp_extract(key, r"^(.*)_([^_]+)_(\d+)$", 2), F.regexp_extract(key, r"^(.*)_([^_]+)_(\d+)$", 3)
    df = df.withColumns({"uid": parts[0], "session": parts[1], "step": parts[2].cast("int")})
    return df.withColumn("final_score", F.max_by(score, "step").over(Window.partitionBy("uid", "session")))


def session_advantage(df: DataFrame, key: str, score: str, epsilon: float = EPSILON, by_std: bool = True) -> DataFrame:
    """Keys ``uid_session_index``: add ``adv``, of the last row of each session within its uid, to all rows of the session.

    Only last rows enter the mean and spread of a uid; of a uid with one session they are
    0 and 1.  Of rows with the same last index the one with the greater score counts.
    """
    parts = [F.regexp_extract(key, r"(?s)^(.*)_([^_]+)_(\d+)$", i) for i in (1, 2, 3)]
    df = df.withColumns({"uid": parts[0], "session": parts[1], "step": parts[2].cast("int")})
    last = Window.partitionBy("uid", "session").orderBy(F.col("step").desc(), F.col(score).desc())
    df = df.withColumns({"_last": F.row_number().over(last) == 1, "_score": F.first(score).over(last)})
    w = Window.partitionBy("uid")
    final = F.when(F.col("_last"), F.col("_score"))
    n = F.count(final).over(w)
    mean = F.when(n > 1, F.avg(final).over(w)).otherwise(F.lit(0.0))
    std = F.when(n > 1, F.stddev_samp(final).over(w)).otherwise(F.lit(1.0))
    adv = (F.col("_score") - mean) / (std + epsilon) if by_std else F.col("_score") - mean
    return df.withColumn("adv", adv).drop("_last", "_score")


def kl_reward(df: DataFrame, score: str, lp: str, ref: str, beta: float, kind: str = "k1") -> DataFrame:
    """Add ``kl`` and ``reward``: score less beta times the masked KL."""
    k = T.kl(F.col(lp), F.col(ref), kind) * F.col("mask")
    return df.withColumn("kl", k).withColumn("reward", F.col(score) - beta * F.col("kl"))


def mean_kl(df: DataFrame) -> DataFrame:
    """Mean KL of each sequence, then of the batch."""
    rows = df.groupBy("row_id").agg((F.sum("kl") / (F.sum("mask") + 1e-8)).alias("kl"))
    return rows.agg(F.avg("kl").alias("kl"))


def adapt_beta(beta: float, current: float, target: float, n: int, horizon: int) -> float:
    """The adaptive controller: a proportional step, its error clipped at 0.2."""
    error = min(max(current / target - 1, -0.2), 0.2)
    return beta * (1 + error * n / horizon)


def resample_by_score(df: DataFrame, score: str, order: str, power: float = 1.0, seed: int = 0) -> DataFrame:
    """As many rows drawn with replacement, in proportion to ``|score| ** power``.

    Draws come from a hash of seed and ordinal; a draw takes the first row whose
    cumulated weight is beyond it.  Rows and draws are sorted together, within
    buckets of the order, and a draw finds its row in one pass.
    """
    spark = df.sparkSession
    buckets = max(256, -(-df.count() // BUCKET_ROWS))
    w = df.withColumn("_w", F.pow(F.abs(F.col(score)), F.lit(power))).withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    each = w.groupBy("_b").agg(F.coalesce(F.sum("_w"), F.lit(0.0)).alias("s"), F.count("*").alias("n")).orderBy("_b").collect()
    base, first, held = [], [], []  # of each bucket: the weight and the rows before it
    total, rows = 0.0, 0
    for r in each:
        base.append(total)
        first.append(rows)
        held.append((r["_b"], base[-1], first[-1], r.s > 0))
        total, rows = total + r.s, rows + r.n
    sums = spark.createDataFrame(held, "_b long, _base double, _first long, _some boolean")
    starts = [(start, b) for b, start, _, some in held if some]
    wide = max(1, math.isqrt(len(starts)))
    runs = [starts[i : i + wide] for i in range(0, len(starts), wide)]
    table = spark.createDataFrame([([run[0][0] for run in runs], [[{"at": a, "b": b} for a, b in run] for run in runs])], "_heads array<double>, _runs array<array<struct<at: double, b: long>>>")
    inside = Window.partitionBy("_b").orderBy(order)
    w = w.join(F.broadcast(sums), "_b")
    high = F.col("_base") + F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    w = w.withColumn("_high", high).withColumn("_n", F.col("_first") + F.row_number().over(inside) - 1)
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.col("_n")), F.lit(1 << 53)) / float(1 << 53)) * F.lit(total)
    # The bucket of a draw, by the square root of them twice.
    run = F.get("_runs", F.size(F.filter("_heads", lambda x: x <= F.col("_at"))) - 1)
    draws = w.select(draw.alias("_at"), F.col("_n").alias("draw")).crossJoin(F.broadcast(table))
    draws = draws.select(F.get(run, F.size(F.filter(run, lambda x: x["at"] <= F.col("_at"))) - 1)["b"].alias("_b"), "_at", "draw").filter("_b is not null")
    own = w.filter("_w > 0").select("_b", F.col("_high").alias("_at"), F.lit(None).cast("long").alias("draw"), "_n", F.struct(*df.columns).alias("_row"))
    both = own.unionByName(draws, allowMissingColumns=True)
    # From the top down, a draw before a row at its own place: the last row seen is the first beyond it.
    down = Window.partitionBy("_b").orderBy(F.col("_at").desc(), F.col("draw").asc_nulls_last(), F.col("_n").desc())
    found = F.last("_row", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    top = F.max_by("_row", F.struct("_at", "_n")).over(Window.partitionBy("_b"))  # where rounding puts a draw beyond its bucket's last row
    hit = both.select("draw", F.coalesce(found, top).alias("_row")).filter("draw is not null")
    return hit.select("draw", "_row.*")


#: Rows of a bucket of an order.
BUCKET_ROWS = 1_000_000


# --- registry --------------------------------------------------------------

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register_estimator(name: str) -> Callable:
    """Register a DataFrame function under a name; another one under it is an error."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"estimator {name!r} is registered already")
        ESTIMATORS[name] = f
        return f

    return add


for _name, _f in {
    "group_norm": group_norm, "group_norm_floored": group_norm_floored, "multi_reward_norm": multi_reward_norm, "best_over_second": best_over_second,
    "mean_baseline": mean_baseline, "leave_one_out": leave_one_out, "leave_one_out_vectorised": leave_one_out_vectorised,
    "weighted_baseline": weighted_baseline, "scaled_baseline": scaled_baseline, "reward_to_go": reward_to_go, "prefix_weighted_baseline": prefix_weighted_baseline,
}.items():
    register_estimator(_name)(_f)


def advantage(df: DataFrame, estimator: str, **options) -> DataFrame:
    """The registered estimator applied to ``df``."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[estimator](df, **options)

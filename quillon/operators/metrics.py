"""Metrics over evaluation rows: validation metrics, pass@k, rollups, percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.batch import with_range
from quillon.operators.ranking import in_order
from quillon.sources.scratch import written


def pass_at_k(df: DataFrame, problem: str, passed: Column, ks: list[int], by: list[str] = ()) -> DataFrame:
    """Mean over problems of ``1 - prod(1 - k / i)`` for i from n - c + 1 to n.

    ``k`` is left out where a problem has fewer samples.
    """
    counts = df.groupBy(*by, problem).agg(F.count("*").alias("n"), F.count_if(passed).alias("c"))
    each = counts.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("n >= k")
    miss = F.aggregate(F.sequence(F.col("n") - F.col("c") + 1, F.col("n")), F.lit(1.0), lambda p, i: p * (1 - F.col("k") / i))
    value = F.when(F.col("n") - F.col("c") < F.col("k"), 1.0).when(F.col("c") == 0, 0.0).otherwise(1 - miss)
    return each.groupBy(*by, "k").agg(F.avg(value).alias("pass_at_k"), F.count("*").alias("problems"))


def majority(df: DataFrame, group: list[str], vote: str, value: str, order: str) -> DataFrame:
    """The most frequent vote's first value per group; ties go to the vote seen first."""
    votes = df.groupBy(*group, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias(value))
    rank = Window.partitionBy(*group).orderBy(F.col("n").desc(), "first")
    return votes.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").select(*group, vote, value, "n")


def best_of_n(df: DataFrame, group: list[str], value: str, n: int, worst: bool = False) -> DataFrame:
    """Expected best (or worst) of n draws with replacement, in closed form.

    With values sorted, the i-th of N is the best with ``(i/N)^n - ((i-1)/N)^n``.
    """
    w = Window.partitionBy(*group)
    order = w.orderBy(F.col(value).desc() if worst else F.col(value))
    ranked = df.withColumns({"_i": F.row_number().over(order), "_n": F.count("*").over(w)})
    p = F.pow(F.col("_i") / F.col("_n"), F.lit(float(n))) - F.pow((F.col("_i") - 1) / F.col("_n"), F.lit(float(n)))
    return ranked.groupBy(*group).agg(F.sum(p * F.col(value)).alias(("worst" if worst else "best") + f"_at_{n}"))


def bootstrap(df: DataFrame, group: list[str], value: str, order: str, size: int, times: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and std over resamples of the maximum and minimum of ``size`` draws.

    The draws are numpy's legacy stream of ``seed``, restarted for each group;
    a group is one prompt's samples; more than ``ranking.BATCH_ROWS`` are an error.
    """
    import numpy as np
    import pyarrow as pa

    key = df.select(*group).schema
    names = ["max_mean", "max_std", "min_mean", "min_std"]

    def run(table: pa.Table) -> pa.Table:
        x = np.array(in_order(table, order).column(value), dtype=np.float64)
        r = np.random.RandomState(seed)
        drawn = np.array([x[r.choice(len(x), size=size, replace=True)] for _ in range(times)])
        high, low = drawn.max(axis=1), drawn.min(axis=1)
        out = {g: table.column(g)[:1] for g in group}
        return pa.table(out | {n: [float(v)] for n, v in zip(names, (high.mean(), high.std(), low.mean(), low.std()))})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key) + "".join(f", {n} double" for n in names)
    return df.select(*group, value, order).groupBy(*group).applyInArrow(run, schema)


def validation_metrics(df: DataFrame, source: str, uid: str, value: str, order: str, vote: str | None = None) -> DataFrame:
    """Per source: mean, spread, best and worst over a prompt's samples, for n = 2, 4, ...
    below N and N itself, then their means over prompts.  With ``vote`` also
    ``majority``: the value of the vote that most of the prompt's samples have."""
    by = [source, uid]
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(value)), "_d": F.row_number().over(w.orderBy(F.col(value).desc())), "_n": F.count("*").over(w)})
    ns = F.array_distinct(F.concat(F.filter(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.pow(F.lit(2.0), i).cast("int")), lambda n: n < F.col("_n")), F.array(F.col("_n").cast("int"))))
    each = ranked.withColumn("n", F.explode(F.when(F.col("_n") > 1, ns).otherwise(F.array(F.lit(1)))))
    share = lambda i: F.pow(F.col(i) / F.col("_n"), F.col("n")) - F.pow((F.col(i) - 1) / F.col("_n"), F.col("n"))
    prompts = each.groupBy(*by, "n").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.sum(share("_i") * F.col(value)).alias("best"), F.sum(share("_d") * F.col(value)).alias("worst")
    )
    names = ["mean", "std", "best", "worst"]
    if vote is not None:
        prompts = prompts.join(majority(df, by, vote, value, order).select(*by, F.col(value).alias("majority")), by)
        names.append("majority")
    return prompts.groupBy(source, "n").agg(*[F.avg(c).alias(c) for c in names], F.count("*").alias("prompts"))


def reduce_by_name(df: DataFrame) -> DataFrame:
    """Metrics ``(name, value)``: max or min where the name says so, else the mean."""
    return df.groupBy("name").agg(
        F.when(F.contains("name", F.lit("max")), F.max("value")).when(F.contains("name", F.lit("min")), F.min("value")).otherwise(F.avg("value")).alias("value")
    )


def reduce_ranks(df: DataFrame, kind: str) -> DataFrame:
    """``(name, rank, value)``: mean or sum over ranks of each rank's, extremes over all."""
    if kind in ("min", "max"):
        return df.groupBy("name").agg(getattr(F, kind)("value").alias("value"))
    per_rank = df.groupBy("name", "rank").agg((F.avg if kind == "mean" else F.sum)("value").alias("value"))
    return per_rank.groupBy("name").agg(F.avg("value").alias("value"))


def rollup_steps(df: DataFrame) -> DataFrame:
    """``(step, name, value, weight)`` over steps: last, sum, max, min, weighted or plain mean by name."""
    n = F.col("name")
    return df.groupBy("name").agg(
        F.when(F.endswith(n, F.lit("/last")), F.max_by("value", "step"))
        .when(F.startswith(n, F.lit("timing")) | F.endswith(n, F.lit("/sum")), F.sum("value"))
        .when(F.contains(n, F.lit("max")), F.max("value"))
        .when(F.contains(n, F.lit("min")), F.min("value"))
        .when(F.endswith(n, F.lit("/weighted")), F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")))
        .otherwise(F.avg("value"))
        .alias("value")
    )


#: Rows of one range that are ranked together when quantiles are selected.
RANKED = 100_000


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def quantiles(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """``by, values``: exact quantiles of each group, between two values by their distance (null and NaN left out).

    Groups are not gathered: rows are counted by ranges of (group, value), whose bounds
    a sample gives, and only the ranges that hold a wanted rank are looked at again, with
    finer bounds, until such a range has at most RANKED rows or one value.
    """
    kept = df.select(*by, F.col(value).cast("double").alias("_v"), F.lit("").alias("_cell")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows, key = kept, [*by, "_cell"]
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = kept.groupBy(*by).agg(F.count("*").alias("_n"))
    place = F.array(*[F.lit(float(x)) for x in shares])
    asked = total.select(*by, F.lit("").alias("_cell"), F.posexplode(place).alias("_i", "_q"), "_n").withColumn("_at", F.col("_q") * (F.col("_n") - 1))
    end = F.explode(F.array(F.struct(F.lit(0).alias("_up"), F.floor("_at").alias("_rank")), F.struct(F.lit(1).alias("_up"), F.ceil("_at").alias("_rank"))))
    wanted = written(asked.withColumn("_end", end).select(*key, "_i", (F.col("_at") - F.floor("_at")).alias("_part"), "_end.*"), "quantile-ranks")
    while True:
        ranged = with_range(rows, [*key, "_v"], ranges)
        sizes = written(ranged.groupBy(*key, "_range").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "quantile-ranges")
        below = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        there = sizes.withColumn("_below", below).withColumnsRenamed({c: f"_r{c}" for c in key})
        found = wanted.join(there, _same(key, [f"_r{c}" for c in key]) & (F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_n")))
        finer = F.concat_ws("/", "_cell", F.col("_range").cast("string"))
        found = written(found.select(*by, finer.alias("_cell"), "_i", "_part", "_up", (F.col("_rank") - F.col("_below")).alias("_rank"), "_n", "_low", "_high"), "quantile-found")
        wanted = found.drop("_n", "_low", "_high")
        cells = found.select(*key).distinct().withColumnsRenamed({c: f"_r{c}" for c in key})
        rows = written(ranged.withColumn("_cell", finer).drop("_range").join(cells, _same(key, [f"_r{c}" for c in key]), "left_semi"), "quantile-rows")
        if found.filter((F.col("_n") > RANKED) & (F.col("_low") < F.col("_high"))).isEmpty():
            break
    counts = rows.groupBy(*key, "_v").agg(F.count("*").alias("_n"))
    last = F.sum("_n").over(Window.partitionBy(*key).orderBy("_v"))
    counts = counts.withColumn("_last", last).withColumnsRenamed({c: f"_r{c}" for c in key})
    ends = wanted.join(counts, _same(key, [f"_r{c}" for c in key]) & (F.col("_rank") < F.col("_last")) & (F.col("_rank") >= F.col("_last") - F.col("_n")))
    pairs = ends.groupBy(*by, "_i").agg(F.max(F.when(F.col("_up") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_up") == 1, F.col("_v"))).alias("_b"), F.first("_part").alias("_part"))
    # Two infinite ends are themselves, not their difference.
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part"))
    return pairs.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", between.alias("x")))), lambda p: p["x"]).alias("values"))


def latency(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Exact interpolated percentiles, mean and extremes."""
    by = list(by)
    means = df.groupBy(*by).agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    found = quantiles(df, value, by, [0.5, 0.95, 0.99]).withColumnsRenamed({c: f"_q_{c}" for c in by})
    both = means.join(found, _same(by, [f"_q_{c}" for c in by]) if by else F.lit(True), "left")
    p = lambda i: F.get("values", F.lit(i))
    return both.select(*by, p(0).alias("tp50"), p(1).alias("tp95"), p(2).alias("tp99"), "avg", "min", "max")


def version_spans(df: DataFrame, first: str, last: str) -> DataFrame:
    """Samples produced across versions: count, share, widest span, distinct versions."""
    span = F.abs(F.col(last) - F.col(first))
    return df.agg(F.count_if(span > 0).alias("partial"), (F.count_if(span > 0) / F.count("*")).alias("ratio"), F.max(span).alias("widest"), F.countDistinct(last).alias("versions"))


def imbalance(df: DataFrame, bucket: str, size: str) -> DataFrame:
    """Least, greatest and mean sum of the buckets."""
    sums = df.groupBy(bucket).agg(F.sum(size).alias("s"))
    return sums.agg(F.min("s").alias("min"), F.max("s").alias("max"), F.avg("s").alias("mean"), (F.max("s") - F.min("s")).alias("spread"))


def explained_variance(df: DataFrame, values: str, returns: str) -> DataFrame:
    """``1 - var(returns - values) / var(returns)`` in the mask."""
    inside = df.filter("mask > 0")
    return inside.agg((1 - F.try_divide(F.var_samp(F.col(returns) - F.col(values)), F.var_samp(returns))).alias("explained"))


def two_level_mean(df: DataFrame, source: str, item: str, value: str) -> DataFrame:
    """Mean over responses, then over items by source."""
    return df.groupBy(source, item).agg(F.avg(value).alias("v")).groupBy(source).agg(F.avg("v").alias("score"), F.count("*").alias("items"))


def multiset_overlap(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Sum of least counts over the size of the multiset union, by key."""
    a = df.select(key, F.explode(left).alias("x")).groupBy(key, "x").agg(F.count("*").alias("n"))
    b = df.select(key, F.explode(right).alias("x")).groupBy(key, "x").agg(F.count("*").alias("m"))
    both = a.join(b, [key, "x"]).groupBy(key).agg(F.sum(F.least("n", "m")).alias("common"))
    out = df.select(key, F.size(left).alias("a"), F.size(right).alias("b")).join(both, key, "left").fillna(0, ["common"])
    return out.select(key, F.coalesce(F.try_divide(F.col("common"), F.col("a") + F.col("b") - F.col("common")), F.lit(1.0)).alias("score"))


def batch_metrics(df: DataFrame, score: str, reward: str, adv: str, longest: int) -> DataFrame:
    """Means and extremes of sequence scores, rewards, advantages and lengths; shares cut off and aborted."""
    inside = F.when(F.col("mask") > 0, F.col(adv))
    rows = df.groupBy("row_id").agg(
        F.sum(score).alias("score"), F.sum(reward).alias("reward"), F.sum("mask").alias("length"), F.sum(inside).alias("a"), F.min(inside).alias("lo"), F.max(inside).alias("hi")
    )
    live = F.col("length") > 0
    of = lambda c: F.when(live, F.col(c))
    stats = [f(of(c)).alias(f"{c}_{n}") for c in ("score", "reward") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return rows.agg(
        *stats, (F.sum("a") / F.sum("length")).alias("adv_mean"), F.min("lo").alias("adv_min"), F.max("hi").alias("adv_max"),
        F.avg("length").alias("length_mean"), F.avg((F.col("length") >= longest).cast("double")).alias("clipped"), F.avg((~live).cast("double")).alias("aborted"),
    )


def timing(df: DataFrame, timings: dict[str, float], response: list[str]) -> DataFrame:
    """``stage, seconds, ms_per_token``: stages of ``response`` by response tokens, others by all."""
    tokens = df.agg(F.sum("mask").alias("response"), F.count("*").alias("all"))
    stages = df.sparkSession.createDataFrame([(k, float(v), k in response) for k, v in timings.items()], "stage string, seconds double, own boolean")
    per = F.col("seconds") * 1000 / F.when(F.col("own"), F.col("response")).otherwise(F.col("all"))
    return stages.join(F.broadcast(tokens)).select("stage", "seconds", per.alias("ms_per_token"))


def throughput(df: DataFrame, seconds: float, devices: int) -> DataFrame:
    return df.agg(F.count("*").alias("tokens"), (F.count("*") / (seconds * devices)).alias("per_device_second"))


def variance_proxies(df: DataFrame, adv: str, lp: str, sum_pi2: str, gradient_norm: float | None = None) -> DataFrame:
    """Signal, power and noise of a batch's gradient by per-sequence advantage and path variance."""
    inside = lambda x: F.when(F.col("mask") > 0, x)
    rows = df.groupBy("row_id").agg(
        (F.coalesce(F.sum(inside(F.col(adv))), F.lit(0.0)) / (F.sum("mask") + 1e-8)).alias("a"),
        F.coalesce(F.sum(inside(1 - 2 * F.exp(lp) + F.col(sum_pi2))), F.lit(0.0)).alias("w"),
    )
    signal = None if gradient_norm is None else gradient_norm**2
    out = rows.agg(F.avg(F.col("a") * F.col("a") * F.greatest("w", F.lit(0.0))).alias("power"), F.avg(F.col("a") * F.col("a")).alias("a_squared"), F.avg("w").alias("w"), F.count("*").alias("n"))
    noise = F.lit(0.0) if signal is None else F.when(F.col("n") > 1, F.greatest((F.col("power") - signal) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0))).otherwise(0.0)
    return out.select(F.lit(signal or 0.0).alias("signal"), "power", noise.alias("noise"), "a_squared", "w")


def rejection_metrics(df: DataFrame, statistic: Column, low: float | None, high: float) -> DataFrame:
    """Mean, extremes, spread and shares beyond the bounds, of tokens and of sequence means."""
    x = F.when(F.col("mask") > 0, statistic)
    rows = df.withColumn("_x", x).groupBy("row_id").agg(F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_x")).alias("q"), F.count("_x").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count_if(F.col("_x") > high).alias("over"), F.count_if(F.lit(False) if low is None else F.col("_x") < low).alias("under")).filter("n > 0")
    n = F.sum("n")
    return rows.agg(
        (F.sum("s") / n).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sqrt(F.greatest(F.sum("q") / n - F.pow(F.sum("s") / n, 2), F.lit(0.0))).alias("std"),
        (F.sum("over") / n).alias("over"), (F.sum("under") / n).alias("under"),
        F.avg(F.col("s") / F.col("n")).alias("seq_mean"), F.avg(F.when(F.col("s") / F.col("n") > high, 1.0).otherwise(0.0)).alias("seq_over"),
    )


def metric_section(df: DataFrame, source: str = "source", var: str = "var", name: str = "name") -> DataFrame:
    """Add ``path``: core for the main variable's mean, majority and best at its largest n, else aux."""
    from pyspark.sql import Window as W

    n = F.regexp_extract(name, r"@(\d+)", 1).try_cast("int")
    has_acc = F.bool_or(F.col(var) == "acc").over(W.partitionBy(source))
    main = F.col(var) == F.when(has_acc, F.lit("acc")).otherwise(F.lit("reward"))
    core = main & F.regexp_like(name, F.lit("^(mean|maj|best)")) & (n == F.max(n).over(W.partitionBy(source, var)))
    return df.withColumn("path", F.concat_ws("/", F.when(core, "val-core").otherwise("val-aux"), source, var, name))


def assembly_stats(samples: DataFrame, seconds: str, version: str, current: int) -> DataFrame:
    """One row on the samples of a training batch: time percentiles, versions and how far they lag."""
    lag = F.lit(current) - F.col(version)
    out = samples.agg(
        F.count("*").alias("samples"), F.avg(seconds).alias("mean"), F.max(seconds).alias("longest"),
        F.countDistinct(version).alias("versions"), F.count_if(lag > 0).alias("stale"), F.max(lag).alias("lag"),
    )
    out = out.join(quantiles(samples, seconds, [], [0.5, 0.95, 0.99]), F.lit(True), "left")
    return out.select("samples", *[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(("tp50", "tp95", "tp99"))], "mean", "longest", "versions", "stale", "lag")


def recounted(counters: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """``group, n, repaired``: the stored counters, those that are missing or wrong counted anew."""
    true = rows.groupBy(group).agg(F.count("*").alias("_n"))
    joined = counters.join(true, group, "full_outer").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return joined.select(group, F.col("_n").alias("n"), (~F.col("n").eqNullSafe(F.col("_n"))).alias("repaired"))

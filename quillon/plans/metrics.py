"""Metric queries over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import metrics as M
from quillon.plans.tokens import TOK, tokens


#: Keeps means of short decimals off rounding ties.
_OFF = 1e-7


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "ts")


def q_pass_at_k(spark, sf_dir):
    out = M.pass_at_k(events(spark, sf_dir), "user_id", F.col("event_type") == "purchase", [1, 2, 5])
    return out.select("k", F.round("pass_at_k", 6).alias("pass_at_k"), "problems")


def q_pass_at_k_category(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("category", F.col("user_id") % 5)
    out = M.pass_at_k(df, "user_id", F.col("event_type").isin("purchase", "click"), [1, 3], ["category"])
    return out.select("category", "k", F.round("pass_at_k", 6).alias("pass_at_k"), "problems")


def q_majority(spark, sf_dir):
    out = M.majority(events(spark, sf_dir), ["user_id"], "event_type", "value", "event_id")
    return out.select("user_id", "event_type", F.round("value", 4).alias("value"), "n")


def q_best_of_n(spark, sf_dir):
    out = M.best_of_n(events(spark, sf_dir).filter("value is not null"), ["user_id"], "value", 4)
    return out.select("user_id", F.round("best_at_4", 4).alias("best_at_4"))


def q_worst_of_n(spark, sf_dir):
    out = M.best_of_n(events(spark, sf_dir).filter("value is not null"), ["user_id"], "value", 4, worst=True)
    return out.select("user_id", F.round("worst_at_4", 4).alias("worst_at_4"))


def q_bootstrap(spark, sf_dir):
    df = events(spark, sf_dir).filter("value is not null")
    return M.bootstrap(df, ["user_id"], "value", "event_id", 4, 200)


def q_validation_metrics(spark, sf_dir):
    df = events(spark, sf_dir).filter("value is not null")
    out = M.validation_metrics(df, "event_type", "user_id", "value", "event_id")
    return out.select("event_type", "n", "prompts", *[F.round(c, 4).alias(c) for c in ("mean", "std", "best", "worst")])


def _named(spark, sf_dir):
    name = F.concat(F.element_at(F.array(F.lit("reward/max"), F.lit("kl/min"), F.lit("timing/step"), F.lit("acc/weighted"), F.lit("lr/last"), F.lit("loss")), (F.col("event_id") % 6 + 1).cast("int")))
    return events(spark, sf_dir).filter("value is not null").select(name.alias("name"), (F.col("user_id") % 4).alias("rank"), F.col("event_id").alias("step"), "value", (F.col("user_id") + 1).alias("weight"))


_NAMED = "n AS (SELECT (['reward/max', 'kl/min', 'timing/step', 'acc/weighted', 'lr/last', 'loss'])[event_id % 6 + 1] AS name, user_id % 4 AS rank, event_id AS step, value, user_id + 1 AS weight FROM events WHERE value IS NOT NULL)"


def q_reduce_by_name(spark, sf_dir):
    return M.reduce_by_name(_named(spark, sf_dir)).select("name", F.round(F.col("value") + _OFF, 3).alias("value"))


def q_reduce_ranks(spark, sf_dir):
    return M.reduce_ranks(_named(spark, sf_dir), "sum").select("name", F.round(F.col("value") + _OFF, 3).alias("value"))


def q_metric_rollup(spark, sf_dir):
    return M.rollup_steps(_named(spark, sf_dir)).select("name", F.round(F.col("value") + _OFF, 3).alias("value"))


def q_latency_percentiles(spark, sf_dir):
    out = M.latency(events(spark, sf_dir), "value", ["event_type"])
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in ("tp50", "tp95", "tp99", "avg", "min", "max")])


def q_version_span(spark, sf_dir):
    df = events(spark, sf_dir).select((F.col("event_id") % 7).alias("a"), (F.col("user_id") % 7).alias("b"))
    out = M.version_spans(df, "a", "b")
    return out.select("partial", F.round("ratio", 6).alias("ratio"), "widest", "versions")


def q_imbalance(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 8).alias("bucket"), "n_chars")
    out = M.imbalance(df, "bucket", "n_chars")
    return out.select("min", "max", F.round("mean", 3).alias("mean"), "spread")


def q_explained_variance(spark, sf_dir):
    return M.explained_variance(tokens(spark, sf_dir), "value", "reward").select(F.round("explained", 6).alias("explained"))


def q_two_level_mean(spark, sf_dir):
    out = M.two_level_mean(events(spark, sf_dir), "event_type", "user_id", "value")
    return out.select("event_type", F.round(F.col("score") + _OFF, 4).alias("score"), "items")


def q_multiset_score(spark, sf_dir):
    words = lambda c: F.split(F.lower(c), " ")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", words(F.concat_ws(" ", "p_name", "p_type")).alias("a"), words(F.concat_ws(" ", "p_type", "p_brand")).alias("b"))
    return M.multiset_overlap(p, "p_partkey", "a", "b").select("p_partkey", F.round("score", 6).alias("score"))


def q_batch_metrics(spark, sf_dir):
    out = M.batch_metrics(tokens(spark, sf_dir), "reward", "value", "adv", 5)
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


def q_timing(spark, sf_dir):
    out = M.timing(tokens(spark, sf_dir), {"gen": 12.5, "update": 30.0}, ["gen"])
    return out.select("stage", "seconds", F.round("ms_per_token", 6).alias("ms_per_token"))


def q_throughput(spark, sf_dir):
    return M.throughput(tokens(spark, sf_dir), 2.0, 8)


def q_variance_proxy(spark, sf_dir):
    out = M.variance_proxies(tokens(spark, sf_dir).withColumn("pi2", F.exp("ref")), "adv", "lp", "pi2", 0.3)
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


def q_rejection_metrics(spark, sf_dir):
    out = M.rejection_metrics(tokens(spark, sf_dir), F.col("lp") - F.col("old"), -0.2, 0.2)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def q_metric_section(spark, sf_dir):
    k = F.col("event_id")
    names = F.element_at(F.array(F.lit("mean@4"), F.lit("best@4/mean"), F.lit("best@2/mean"), F.lit("std@4")), (k % 4 + 1).cast("int"))
    var = F.element_at(F.array(F.lit("reward"), F.lit("acc"), F.lit("len")), (k % 3 + 1).cast("int"))
    e = events(spark, sf_dir).select(F.when(k % 24 < 12, "a").otherwise("b").alias("source"), var.alias("var"), names.alias("name")).filter("not (source = 'b' and var = 'acc')")
    return M.metric_section(e.distinct()).select("path")


def q_category(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.regexp_extract(F.concat(F.lit("Evo_"), "p_type", F.lit("_Evo/"), F.col("p_partkey").cast("string")), "Evo_(.*)_Evo", 1).alias("category"))
    return p.groupBy("category").agg(F.count("*").alias("n"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

_PASS = """WITH c AS (SELECT {by} user_id, count(*) AS n, count(*) FILTER ({passed}) AS c FROM events GROUP BY ALL), e AS (SELECT * FROM c, (VALUES {ks}) v(k) WHERE n >= k),
s AS (SELECT {b} k, CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i), lambda p, q: p * q) END AS v FROM e)
SELECT {b} k, round(avg(v), 6) AS pass_at_k, count(*) AS problems FROM s GROUP BY {b} k"""
_BEST = """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value {d}) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, round(sum((power(i / n, 4) - power((i - 1) / n, 4)) * value), 4) AS {name} FROM r GROUP BY user_id"""

ORACLE = {
    "q_pass_at_k": _PASS.format(by="", b="", passed="event_type = 'purchase'", ks="(1), (2), (5)"),
    "q_pass_at_k_category": _PASS.format(by="user_id % 5 AS category,", b="category,", passed="event_type IN ('purchase', 'click')", ks="(1), (3)"),
    "q_majority": """WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first, arg_min(value, event_id) AS value FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM v) SELECT user_id, event_type, round(value, 4) AS value, n FROM r WHERE k = 1""",
    "q_best_of_n": _BEST.format(d="", name="best_at_4"),
    "q_worst_of_n": _BEST.format(d="DESC", name="worst_at_4"),
    "q_validation_metrics": """WITH r AS (SELECT event_type, user_id, value, row_number() OVER (w ORDER BY value) AS i, row_number() OVER (w ORDER BY value DESC) AS d, count(*) OVER w AS total
  FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type, user_id)),
e AS (SELECT r.*, k.n FROM r, (SELECT CAST(power(2, i) AS INTEGER) AS n FROM range(1, 21) t(i)) k WHERE total > 1 AND k.n < total UNION ALL SELECT *, CAST(total AS INTEGER) FROM r),
p AS (SELECT event_type, user_id, n, avg(value) AS mean, stddev_pop(value) AS std, sum((power(i / total, n) - power((i - 1) / total, n)) * value) AS best, sum((power(d / total, n) - power((d - 1) / total, n)) * value) AS worst FROM e GROUP BY ALL)
SELECT event_type, n, count(*) AS prompts, round(avg(mean), 4) AS mean, round(avg(std), 4) AS std, round(avg(best), 4) AS best, round(avg(worst), 4) AS worst FROM p GROUP BY event_type, n""",
    "q_reduce_by_name": f"WITH {_NAMED} SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END + 1e-7, 3) AS value FROM n GROUP BY name",
    "q_reduce_ranks": f"WITH {_NAMED}, r AS (SELECT name, rank, sum(value) AS v FROM n GROUP BY ALL) SELECT name, round(avg(v) + 1e-7, 3) AS value FROM r GROUP BY name",
    "q_metric_rollup": f"""WITH {_NAMED} SELECT name, round(CASE WHEN name LIKE '%/last' THEN arg_max(value, step) WHEN name LIKE 'timing%' THEN sum(value) WHEN contains(name, 'max') THEN max(value)
  WHEN contains(name, 'min') THEN min(value) WHEN name LIKE '%/weighted' THEN sum(value * weight) / sum(weight) ELSE avg(value) END + 1e-7, 3) AS value FROM n GROUP BY name""",
    "q_latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS tp50, round(quantile_cont(value, 0.95), 4) AS tp95, round(quantile_cont(value, 0.99), 4) AS tp99, round(avg(value), 4) AS avg, round(min(value), 4) AS min, round(max(value), 4) AS max FROM events GROUP BY event_type",
    "q_version_span": "WITH s AS (SELECT abs(user_id % 7 - event_id % 7) AS d, user_id % 7 AS b FROM events) SELECT count(*) FILTER (d > 0) AS partial, round(count(*) FILTER (d > 0) / count(*), 6) AS ratio, max(d) AS widest, count(DISTINCT b) AS versions FROM s",
    "q_imbalance": "WITH s AS (SELECT doc_id % 8 AS b, CAST(sum(n_chars) AS BIGINT) AS s FROM documents GROUP BY 1) SELECT min(s) AS min, max(s) AS max, round(avg(s), 3) AS mean, max(s) - min(s) AS spread FROM s",
    "q_explained_variance": f"WITH {TOK} SELECT round(1 - var_samp(reward - value) / var_samp(reward), 6) AS explained FROM tok WHERE mask > 0",
    "q_two_level_mean": "WITH u AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type, round(avg(v) + 1e-7, 4) AS score, count(*) AS items FROM u GROUP BY event_type",
    "q_multiset_score": """WITH p AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS a, string_split(lower(p_type || ' ' || p_brand), ' ') AS b FROM part),
x AS (SELECT p_partkey, unnest(a) AS x FROM p), y AS (SELECT p_partkey, unnest(b) AS x FROM p), xc AS (SELECT p_partkey, x, count(*) AS n FROM x GROUP BY ALL), yc AS (SELECT p_partkey, x, count(*) AS n FROM y GROUP BY ALL),
m AS (SELECT xc.p_partkey, sum(least(xc.n, yc.n)) AS c FROM xc JOIN yc ON xc.p_partkey = yc.p_partkey AND xc.x = yc.x GROUP BY 1)
SELECT p.p_partkey, round(coalesce(c, 0) / (len(a) + len(b) - coalesce(c, 0)), 6) AS score FROM p LEFT JOIN m ON p.p_partkey = m.p_partkey""",
    "q_batch_metrics": f"""WITH {TOK}, r AS (SELECT row_id, sum(reward) AS score, sum(value) AS reward, sum(mask) AS length, sum(CASE WHEN mask > 0 THEN adv END) AS a, min(CASE WHEN mask > 0 THEN adv END) AS lo, max(CASE WHEN mask > 0 THEN adv END) AS hi FROM tok GROUP BY row_id)
SELECT round(avg(score) FILTER (length > 0), 5) AS score_mean, round(min(score) FILTER (length > 0), 5) AS score_min, round(max(score) FILTER (length > 0), 5) AS score_max, round(avg(reward) FILTER (length > 0), 5) AS reward_mean,
  round(min(reward) FILTER (length > 0), 5) AS reward_min, round(max(reward) FILTER (length > 0), 5) AS reward_max, round(sum(a) / sum(length), 5) AS adv_mean, round(min(lo), 5) AS adv_min, round(max(hi), 5) AS adv_max, round(avg(length), 5) AS length_mean,
  round(avg(CASE WHEN length >= 5 THEN 1.0 ELSE 0.0 END), 5) AS clipped, round(avg(CASE WHEN length = 0 THEN 1.0 ELSE 0.0 END), 5) AS aborted FROM r""",
    "q_timing": f"WITH {TOK}, n AS (SELECT sum(mask) AS r, count(*) AS a FROM tok) SELECT 'gen' AS stage, 12.5::DOUBLE AS seconds, round(12500 / r, 6) AS ms_per_token FROM n UNION ALL SELECT 'update', 30.0, round(30000 / a, 6) FROM n",
    "q_throughput": "SELECT count(*) AS tokens, count(*) / 16 AS per_device_second FROM lineitem",
    "q_variance_proxy": f"""WITH {TOK}, r AS (SELECT coalesce(sum(CASE WHEN mask > 0 THEN adv END), 0) / (sum(mask) + 1e-8) AS a, coalesce(sum(CASE WHEN mask > 0 THEN 1 - 2 * exp(lp) + exp(ref) END), 0) AS w FROM tok GROUP BY row_id),
p AS (SELECT avg(a * a * greatest(w, 0)) AS power, avg(a * a) AS a_squared, avg(w) AS w, count(*) AS n FROM r) SELECT 0.09::DOUBLE AS signal, round(power, 8) AS power, round(greatest((power - 0.09) / (n - 1), 0), 8) AS noise, round(a_squared, 8) AS a_squared, round(w, 8) AS w FROM p""",
    "q_rejection_metrics": f"""WITH {TOK}, x AS (SELECT row_id, lp - old AS x FROM tok WHERE mask > 0), r AS (SELECT row_id, avg(x) AS m FROM x GROUP BY 1)
SELECT round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max, round(stddev_pop(x), 6) AS std, round(avg(CASE WHEN x > 0.2 THEN 1.0 ELSE 0.0 END), 6) AS over, round(avg(CASE WHEN x < -0.2 THEN 1.0 ELSE 0.0 END), 6) AS under,
  (SELECT round(avg(m), 6) FROM r) AS seq_mean, (SELECT round(avg(CASE WHEN m > 0.2 THEN 1.0 ELSE 0.0 END), 6) FROM r) AS seq_over FROM x""",
    "q_metric_section": """WITH e AS (SELECT DISTINCT CASE WHEN event_id % 24 < 12 THEN 'a' ELSE 'b' END AS source, (['reward', 'acc', 'len'])[event_id % 3 + 1] AS var, (['mean@4', 'best@4/mean', 'best@2/mean', 'std@4'])[event_id % 4 + 1] AS name FROM events)
SELECT CASE WHEN var = CASE source WHEN 'a' THEN 'acc' ELSE 'reward' END AND name IN ('mean@4', 'best@4/mean') THEN 'val-core' ELSE 'val-aux' END || '/' || source || '/' || var || '/' || name AS path FROM e WHERE NOT (source = 'b' AND var = 'acc')""",
    "q_category": "SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1",
}

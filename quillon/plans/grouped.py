"""Queries over group-relative estimators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import grouped as G
from quillon.plans.tokens import TOK, tokens

#: Keeps means of two-decimal prices off rounding ties.
_OFF = 1e-7


def responses(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("score"), "l_quantity", "l_discount")


def _rows(df):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", (F.round(F.col("adv") + _OFF, 4) + F.lit(0.0)).alias("adv"))


def q_group_norm(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = G.group_norm(df, "l_extendedprice", "l_orderkey")
    return out.select("l_orderkey", "l_linenumber", "n", *[F.round(F.col(x) + _OFF, 4).alias(x) for x in ("mean", "std", "adv")])


def q_group_norm_vec(spark, sf_dir):
    return _rows(G.group_norm_floored(responses(spark, sf_dir), "score", "l_orderkey"))


def q_group_center(spark, sf_dir):
    return _rows(G.advantage(responses(spark, sf_dir), "group_norm", score="score", group="l_orderkey", by_std=False))


def q_multi_reward(spark, sf_dir):
    return _rows(G.multi_reward_norm(responses(spark, sf_dir), {"score": 1.0, "l_quantity": 0.5}, "l_orderkey"))


def q_passk_top2(spark, sf_dir):
    return _rows(G.best_over_second(responses(spark, sf_dir).dropDuplicates(["l_orderkey", "score"]), "score", "l_orderkey", "l_linenumber")).select("l_orderkey", "adv")


def q_mean_baseline(spark, sf_dir):
    return _rows(G.mean_baseline(responses(spark, sf_dir), "score", "l_orderkey"))


def q_loo(spark, sf_dir):
    return _rows(G.leave_one_out(responses(spark, sf_dir), "score", "l_orderkey"))


def q_loo_vec(spark, sf_dir):
    return _rows(G.leave_one_out_vectorised(responses(spark, sf_dir), "score", "l_orderkey"))


def q_weighted_baseline(spark, sf_dir):
    return _rows(G.weighted_baseline(responses(spark, sf_dir), "score", "l_orderkey", "l_quantity"))


def q_gpg(spark, sf_dir):
    return _rows(G.scaled_baseline(responses(spark, sf_dir).withColumn("score", F.floor(F.col("l_discount") * 100 + 0.5) - 3), "score", "l_orderkey", 2.0))


def q_reward_to_go(spark, sf_dir):
    out = G.reward_to_go(tokens(spark, sf_dir), "reward", F.lit(0.5))
    return out.select("row_id", "t", F.round("returns", 5).alias("returns"), (F.round("adv", 5) + F.lit(0.0)).alias("adv"))


def _arrays(spark, sf_dir):
    x = F.sort_array(F.collect_list(F.struct("t", "reward", "value", "mask")))
    return tokens(spark, sf_dir).groupBy("row_id").agg(x.alias("x"))


def q_discounted_return(spark, sf_dir):
    out = _arrays(spark, sf_dir).withColumn("g", G.discounted_return(F.col("x.reward"), F.col("x.mask"), 0.9))
    return out.select("row_id", F.posexplode("g").alias("t", "g")).select("row_id", "t", F.round("g", 5).alias("g"))


def q_gae(spark, sf_dir):
    out = _arrays(spark, sf_dir).withColumn("a", G.gae(F.col("x.reward"), F.col("x.value"), F.col("x.mask"), 0.95, 0.9))
    return out.select("row_id", F.posexplode("a").alias("t", "a")).select("row_id", "t", F.round(F.col("a") + 1e-8, 5).alias("a"))


def q_prefix_weighted_baseline(spark, sf_dir):
    df = tokens(spark, sf_dir).withColumn("pi2", F.exp(F.col("ref")))
    out = G.prefix_weighted_baseline(df, "reward", "lp", "pi2")
    return out.select("row_id", "t", F.round("returns", 5).alias("returns"), (F.round("adv", 4) + F.lit(0.0)).alias("adv"))


def q_prefix_weighted_turns(spark, sf_dir):
    df = tokens(spark, sf_dir).withColumn("pi2", F.exp(F.col("ref")))
    out = G.prefix_weighted_baseline(df, "reward", "lp", "pi2", compact=True)
    return out.select("row_id", "t", (F.round("adv", 4) + F.lit(0.0)).alias("adv"))


def q_kl_reward(spark, sf_dir):
    out = G.kl_reward(tokens(spark, sf_dir), "reward", "lp", "ref", 0.1, "k3")
    return out.select("row_id", "t", F.round("reward", 6).alias("reward"))


def q_mean_kl(spark, sf_dir):
    return G.mean_kl(G.kl_reward(tokens(spark, sf_dir), "reward", "lp", "ref", 0.1, "k1")).select(F.round("kl", 6).alias("kl"))


def q_session_broadcast(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    df = df.select(F.concat_ws("_", F.lit("c"), F.col("conv_id") % 7, "conv_id", "turn").alias("key"), F.length("text").alias("score"))
    return G.session_broadcast(df, "key", "score").select("key", "uid", "session", "step", "final_score")


def q_group_ids(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "0").otherwise(""), (F.col("o_custkey") % 12).cast("string")).alias("label"))
    return G.group_ids(df, "label").select("o_orderkey", F.col("gid").cast("long").alias("gid"))


def q_resample(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return G.resample_by_score(df, "o_totalprice", "o_orderkey").select("draw", "o_orderkey")


_NAMES = [n for n in dir() if n.startswith("q_")]
QUERIES = {n: globals()[n] for n in _NAMES}

_ROWS = """SELECT l_orderkey, l_linenumber, l_partkey, round({adv} + 1e-7, 4) + 0.0::DOUBLE AS adv FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice AS score, count(*) OVER w AS n, avg(l_extendedprice) OVER w AS mean, stddev_samp(l_extendedprice) OVER w AS std,
         sum(l_extendedprice) OVER w AS total, sum(l_quantity * l_extendedprice) OVER w / sum(l_quantity) OVER w AS weighted
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))"""

ORACLE = {
    "q_group_norm": """
SELECT l_orderkey, l_linenumber, n, round(mean + 1e-7, 4) AS mean, round(std + 1e-7, 4) AS std,
       round((l_extendedprice - mean) / (std + 1e-6) + 1e-7, 4) + 0.0::DOUBLE AS adv
FROM (
  SELECT l_orderkey, l_linenumber, l_extendedprice, count(*) OVER w AS n,
         CASE WHEN count(*) OVER w > 1 THEN avg(l_extendedprice) OVER w ELSE 0.0 END AS mean,
         CASE WHEN count(*) OVER w > 1 THEN stddev_samp(l_extendedprice) OVER w ELSE 1.0 END AS std
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)
)
""",
    "q_group_norm_vec": _ROWS.format(adv="CASE WHEN n > 1 THEN (score - mean) / (sqrt(greatest(std * std, 1e-6)) + 1e-6) ELSE score / (1 + 1e-6) END"),
    "q_group_center": _ROWS.format(adv="CASE WHEN n > 1 THEN score - mean ELSE score END"),
    "q_loo": _ROWS.format(adv="CASE WHEN n > 1 THEN n * (score - mean) / (n - 1) ELSE score END"),
    "q_loo_vec": _ROWS.format(adv="CASE WHEN n > 1 THEN (n * score - total) / (n - 1) ELSE 0 END"),
    "q_weighted_baseline": _ROWS.format(adv="CASE WHEN n > 1 THEN score - weighted ELSE score END"),
    "q_mean_baseline": """WITH c AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice - CASE WHEN count(*) OVER w > 1 THEN avg(l_extendedprice) OVER w ELSE 0 END AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)
), s AS (SELECT avg(c) AS m, var_samp(c) AS v FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, round((c - m) / sqrt(v + 1e-8) + 1e-7, 4) AS adv FROM c, s""",
    "q_multi_reward": """WITH g AS (
  SELECT *, count(*) OVER w AS n, avg(l_extendedprice) OVER w AS m1, stddev_samp(l_extendedprice) OVER w AS s1, avg(l_quantity) OVER w AS m2, stddev_samp(l_quantity) OVER w AS s2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)
), c AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n > 1 THEN (l_extendedprice - m1) / (s1 + 1e-6) + 0.5 * (l_quantity - m2) / (s2 + 1e-6) ELSE l_extendedprice / (1 + 1e-6) + 0.5 * l_quantity / (1 + 1e-6) END AS c FROM g
), s AS (SELECT avg(c) AS m, var_samp(c) AS v FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, round((c - m) / sqrt(v + 1e-8) + 1e-7, 4) AS adv FROM c, s""",
    "q_passk_top2": """WITH d AS (SELECT DISTINCT l_orderkey, l_extendedprice AS score FROM lineitem), r AS (
  SELECT l_orderkey, score, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC) AS n, lead(score) OVER (PARTITION BY l_orderkey ORDER BY score DESC) AS second, stddev_samp(score) OVER (PARTITION BY l_orderkey) AS std FROM d)
SELECT l_orderkey, round(CASE WHEN n = 1 THEN coalesce((score - second) / (std + 1e-6), 0) ELSE 0 END + 1e-7, 4) AS adv FROM r""",
    "q_gpg": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_discount * 100 + 0.5) - 3 AS score FROM lineitem), a AS (SELECT count(*) / greatest(count(*) FILTER (score <> 0), 1) AS alpha FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, round(alpha * (score - CASE WHEN count(*) OVER w > 1 THEN avg(score) OVER w ELSE 0 END) / 2.0 + 1e-7, 4) AS adv FROM r, a WINDOW w AS (PARTITION BY l_orderkey)""",
    "q_reward_to_go": f"""WITH {TOK}, r AS (SELECT *, sum(CASE WHEN mask > 0 THEN reward ELSE 0 END) OVER (PARTITION BY row_id ORDER BY t DESC) AS g FROM tok)
SELECT row_id, CAST(t AS INTEGER) AS t, round(g, 5) AS returns, round((g - 0.5) * mask, 5) + 0.0::DOUBLE AS adv FROM r""",
    "q_discounted_return": f"""WITH RECURSIVE {TOK}, n AS (SELECT *, max(t) OVER (PARTITION BY row_id) AS last FROM tok), g AS (
  SELECT row_id, t, mask, CAST(reward AS DOUBLE) AS g FROM n WHERE t = last
  UNION ALL SELECT n.row_id, n.t, n.mask, n.reward + 0.9 * g.g * g.mask FROM n JOIN g ON n.row_id = g.row_id AND n.t = g.t - 1)
SELECT row_id, CAST(t AS INTEGER) AS t, round(g, 5) AS g FROM g""",
    "q_gae": f"""WITH RECURSIVE {TOK}, n AS (SELECT *, max(t) OVER (PARTITION BY row_id) AS last FROM tok), g AS (
  SELECT row_id, t, CASE WHEN mask > 0 THEN value ELSE 0.0 END AS v, CASE WHEN mask > 0 THEN reward - value ELSE 0.0 END AS a FROM n WHERE t = last
  UNION ALL SELECT n.row_id, n.t, CASE WHEN n.mask > 0 THEN n.value ELSE g.v END, CASE WHEN n.mask > 0 THEN n.reward + 0.95 * g.v - n.value + 0.95 * 0.9 * g.a ELSE g.a END FROM n JOIN g ON n.row_id = g.row_id AND n.t = g.t - 1)
SELECT row_id, CAST(t AS INTEGER) AS t, round(a + 1e-8, 5) AS a FROM g""",
    "q_prefix_weighted_baseline": f"""WITH {TOK}, w AS (
  SELECT row_id, uid, t, sum(1 - 2 * exp(lp) + exp(ref)) OVER (PARTITION BY row_id ORDER BY t) AS w, sum(reward) OVER (PARTITION BY row_id ORDER BY t DESC) AS g FROM tok WHERE mask > 0)
SELECT row_id, CAST(t AS INTEGER) AS t, round(g, 5) AS returns, round(g - sum(g * w) OVER (PARTITION BY uid, t) / (sum(w) OVER (PARTITION BY uid, t) + 1e-8), 4) + 0.0::DOUBLE AS adv FROM w""",
    "q_prefix_weighted_turns": f"""WITH {TOK}, w AS (
  SELECT row_id, uid, t, row_number() OVER (PARTITION BY row_id ORDER BY t) AS k, sum(1 - 2 * exp(lp) + exp(ref)) OVER (PARTITION BY row_id ORDER BY t) AS w, sum(reward) OVER (PARTITION BY row_id ORDER BY t DESC) AS g FROM tok WHERE mask > 0)
SELECT row_id, CAST(t AS INTEGER) AS t, round(g - sum(g * w) OVER (PARTITION BY uid, k) / (sum(w) OVER (PARTITION BY uid, k) + 1e-8), 4) + 0.0::DOUBLE AS adv FROM w""",
    "q_kl_reward": f"""WITH {TOK} SELECT row_id, CAST(t AS INTEGER) AS t, round(reward - 0.1 * least(greatest(exp(ref - lp) - (ref - lp) - 1, -10), 10) * mask, 6) AS reward FROM tok""",
    "q_mean_kl": f"""WITH {TOK}, r AS (SELECT sum((lp - ref) * mask) / (sum(mask) + 1e-8) AS kl FROM tok GROUP BY row_id) SELECT round(avg(kl), 6) AS kl FROM r""",
    "q_session_broadcast": """SELECT 'c_' || conv_id % 7 || '_' || conv_id || '_' || turn AS key, 'c_' || conv_id % 7 AS uid, CAST(conv_id AS VARCHAR) AS session, CAST(turn AS INTEGER) AS step,
       CAST(last_value(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS INTEGER) AS final_score FROM conversations""",
    "q_group_ids": """WITH l AS (SELECT o_orderkey, CAST(o_custkey % 12 AS VARCHAR) AS label FROM orders)
SELECT o_orderkey, dense_rank() OVER (ORDER BY label) - 1 AS gid FROM l""",
}

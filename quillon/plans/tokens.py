"""Queries over per-token tables derived from line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import tokens as T
from quillon.operators import tokens as O

_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def tokens(spark, sf_dir):
    """An order is a sequence, its lines are tokens by their full-row order."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select(
        F.col("l_orderkey").alias("row_id"),
        (F.col("l_orderkey") % 97).alias("uid"),
        (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1).alias("t"),
        F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("mask"),
        (F.col("l_quantity") / 50).alias("reward"),
        (F.col("l_discount") * 10 - 0.5).alias("value"),
        (-(F.col("l_tax") * 10 + 0.05)).alias("lp"),
        (-(F.col("l_discount") * 8 + 0.05)).alias("old"),
        (-(F.col("l_tax") * 5 + F.col("l_discount") * 5 + 0.05)).alias("ref"),
        ((F.col("l_quantity") - 25) / 25).alias("adv"),
    )


TOK = f"""tok AS (
  SELECT l_orderkey AS row_id, l_orderkey % 97 AS uid,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1 AS t,
         CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask, l_quantity / 50 AS reward, l_discount * 10 - 0.5 AS value,
         -(l_tax * 10 + 0.05) AS lp, -(l_discount * 8 + 0.05) AS old, -(l_tax * 5 + l_discount * 5 + 0.05) AS ref, (l_quantity - 25) / 25 AS adv
  FROM lineitem
)"""

c = F.col


def _loss(expression, mode="token-mean", scale=None):
    def run(spark, sf_dir):
        return O.aggregate_loss(tokens(spark, sf_dir), expression(), mode, scale).select(F.round("loss", 6).alias("loss"))

    return run


def _loss_sql(expression, mode="token-mean", scale=None):
    mean = {
        "token-mean": "sum(s) / sum(n)",
        "seq-mean-token-sum": "sum(s) / count(*)",
        "seq-mean-token-sum-norm": f"sum(s) / {scale}",
        "seq-mean-token-mean": "sum(s / (n + 1e-8)) / count(*)",
    }[mode]
    return f"""WITH {TOK}, r AS (SELECT row_id, sum(CASE WHEN mask > 0 THEN {expression} END) AS s, sum(mask) AS n FROM tok GROUP BY row_id)
SELECT round({mean}, 6) AS loss FROM r WHERE n > 0"""


_R = "exp(least(greatest(lp - old, -20), 20))"
_PPO = f"greatest(-adv * {_R}, -adv * least(greatest({_R}, 0.8), 1.2))"
_PPO = f"(CASE WHEN adv < 0 THEN least(-adv * 3, {_PPO}) ELSE {_PPO} END)"
_P, _Q = "least(greatest(exp(old), 1e-8), 1 - 1e-8)", "least(greatest(exp(lp), 1e-8), 1 - 1e-8)"
_BKL = f"({_P} * ln({_P} / {_Q}) + (1 - {_P}) * ln((1 - {_P}) / (1 - {_Q})))"
_E = "least(greatest(ref - lp, -20), 20)"

#: name -> (Spark expression, SQL expression)
LOSSES = {
    "ppo_clip": (lambda: T.ppo_clip(c("lp"), c("old"), c("adv")), _PPO),
    "dppo_tv": (lambda: T.dppo_tv(c("lp"), c("old"), c("adv")), f"(CASE WHEN (adv > 0 AND exp(lp) - exp(old) > 0.2) OR (adv < 0 AND exp(lp) - exp(old) < -0.2) THEN 0 ELSE -adv * least({_R}, 20) END)"),
    "dppo_kl": (lambda: T.dppo_kl(c("lp"), c("old"), c("adv")), f"(CASE WHEN {_BKL} > 0.05 AND ((adv > 0 AND lp > old) OR (adv < 0 AND lp < old)) THEN 0 ELSE -adv * least({_R}, 20) END)"),
    "sapo": (lambda: T.sapo(c("lp"), c("old"), c("adv")), f"(-adv * (CASE WHEN adv > 0 THEN 4.0 ELSE 4 / 1.05 END) / (1 + exp(-(CASE WHEN adv > 0 THEN 1.0 ELSE 1.05 END) * ({_R} - 1))))"),
    "gpg_loss": (lambda: T.gpg(c("lp"), c("adv")), "(-lp * adv)"),
    "cispo": (lambda: T.cispo(c("lp"), c("old"), c("adv")), f"(-least(greatest({_R}, 0.8), 1.2) * adv * lp)"),
    "reinforce": (lambda: T.reinforce(c("lp"), c("adv"), T.importance_weight(c("lp") - c("old"), 2.0)), f"(-adv * lp * least({_R}, 2.0))"),
    "value_loss": (lambda: T.value_loss(c("value"), c("reward"), c("adv")), "(0.5 * greatest((value - reward) * (value - reward), (least(greatest(value, adv - 0.5), adv + 0.5) - reward) * (least(greatest(value, adv - 0.5), adv + 0.5) - reward)))"),
    "kl_k1": (lambda: T.kl(c("lp"), c("ref"), "k1"), "(lp - ref)"),
    "kl_abs": (lambda: T.kl(c("lp"), c("ref"), "abs"), "abs(lp - ref)"),
    "kl_k2": (lambda: T.kl(c("lp"), c("ref"), "k2+"), "(0.5 * (lp - ref) * (lp - ref))"),
    "kl_k3": (lambda: T.kl(c("lp"), c("ref"), "k3"), f"least(greatest(exp({_E}) - {_E} - 1, -10), 10)"),
}
QUERIES = {f"q_loss_{name}": _loss(spark) for name, (spark, _) in LOSSES.items()}
ORACLE = {f"q_loss_{name}": _loss_sql(sql) for name, (_, sql) in LOSSES.items()}
for _mode, _name, _scale in (("seq-mean-token-sum", "seq_mean_sum", None), ("seq-mean-token-sum-norm", "seq_sum_norm", 1000), ("seq-mean-token-mean", "seq_mean_mean", None)):
    QUERIES[f"q_loss_{_name}"] = _loss(LOSSES["ppo_clip"][0], _mode, _scale)
    ORACLE[f"q_loss_{_name}"] = _loss_sql(_PPO, _mode, _scale)


def q_loss_gspo(spark, sf_dir):
    return O.gspo_loss(tokens(spark, sf_dir), "lp", "old", "adv").select(F.round("loss", 6).alias("loss"))


def q_loss_geo_mean(spark, sf_dir):
    return O.geo_mean_loss(tokens(spark, sf_dir), "lp", "old", "adv").select(F.round("loss", 6).alias("loss"))


def q_loss_kl_cov(spark, sf_dir):
    return O.kl_cov_loss(tokens(spark, sf_dir), "lp", "old", "adv").select(F.round("loss", 6).alias("loss"))


def q_loss_clip_cov(spark, sf_dir):
    return O.clip_cov_loss(tokens(spark, sf_dir), "lp", "old", "adv", 0.02, 5.0).select(F.round("loss", 6).alias("loss"))


def q_masked_stats(spark, sf_dir):
    out = O.masked_stats(tokens(spark, sf_dir), "reward", ["uid"])
    return out.select("uid", "n", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


def q_whiten(spark, sf_dir):
    out = O.whiten(tokens(spark, sf_dir), "reward")
    return out.select("row_id", "t", F.round("whitened", 5).alias("whitened"))


def _reject(option, spec):
    def run(spark, sf_dir):
        df = tokens(spark, sf_dir).withColumn("d", c("lp") - c("old"))
        return O.reject(df, "d", {option: spec}).groupBy("uid").agg(F.sum("kept").alias("kept"), F.sum("mask").alias("n"))

    return run


_SPECS = {"k1": "0.8_1.2", "k2": 0.02, "k3": 0.02}
_TERMS = {"k1": "x", "k2": "(0.5 * x * x)", "k3": "(exp(x) - 1 - x)"}
for _option in O.REJECTIONS:
    _k = _option[-2:]
    _term, _spec = _TERMS[_k], _SPECS[_k]
    if _option.startswith("seq"):
        _inside = f"CASE WHEN mask > 0 THEN {_term} END"
        _over = "OVER (PARTITION BY row_id)"
        _total = f"coalesce(sum({_inside}) {_over}, 0)"
        _term = {"sum": _total, "mean": f"{_total} / (sum(mask) {_over} + 1e-8)", "max": f"coalesce(max({_inside}) {_over}, 0)"}[_option.split("_")[1]]
    _cond = f"s BETWEEN ln(0.8) AND ln(1.2)" if _k == "k1" else f"s <= {_spec}"
    QUERIES[f"q_reject_{_option}"] = _reject(_option, _spec)
    ORACLE[f"q_reject_{_option}"] = f"""WITH {TOK}, d AS (SELECT *, least(greatest(lp - old, -20), 20) AS x FROM tok), st AS (SELECT *, {_term} AS s FROM d)
SELECT uid, CAST(sum(CASE WHEN mask > 0 AND {_cond} THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(mask) AS BIGINT) AS n FROM st GROUP BY uid"""


def q_reject_all(spark, sf_dir):
    df = tokens(spark, sf_dir).withColumn("d", c("lp") - c("old"))
    out = O.reject(df, "d", {"token_k1": "0.7_1.4", "seq_mean_k2": 0.05, "seq_max_k3": 0.2})
    return out.groupBy("uid").agg(F.sum("kept").alias("kept"))


def q_is_truncate(spark, sf_dir):
    w = T.importance_weight(c("lp") - c("old"), 1.2)
    z = T.importance_weight(c("lp") - c("old"), 1.2, 0.8)
    return tokens(spark, sf_dir).select("row_id", "t", F.round(w, 6).alias("truncated"), F.round(z, 6).alias("zeroed"))


def q_is_metrics(spark, sf_dir):
    df = tokens(spark, sf_dir).withColumn("w", T.ratio(c("lp"), c("old")))
    out = O.importance_metrics(df, "w", 1.2, 0.8)
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


def q_off_policy(spark, sf_dir):
    out = O.off_policy_metrics(tokens(spark, sf_dir), "old", "lp")
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


def q_workload(spark, sf_dir):
    rows = tokens(spark, sf_dir).groupBy("row_id").agg(F.sum("mask").alias("n"))
    return rows.select("row_id", T.workload(c("n")).alias("cost"), F.round(T.overlong_penalty(c("n"), 3, 2, 0.5), 6).alias("penalty"))


def q_entropy(spark, sf_dir):
    rows = tokens(spark, sf_dir).groupBy("row_id").agg(F.sort_array(F.collect_list("lp")).alias("logits"))
    return rows.select("row_id", F.round(T.entropy(c("logits")), 5).alias("entropy"))


def q_rollout_correction(spark, sf_dir):
    out = O.correct_rollout(tokens(spark, sf_dir), "lp", "old", level="sequence", upper=1.5, normalise=True, options={"token_k1": "0.7_1.4"})
    return out.groupBy("uid").agg(F.round(F.sum("weight"), 4).alias("weight"), F.sum("kept").alias("kept"))


def q_loss_bypass(spark, sf_dir):
    df = tokens(spark, sf_dir)
    a = O.bypass_loss(df, "lp", "old", "adv", False, upper=1.2, options={"seq_mean_k3": 0.02}).select(F.lit("plain").alias("kind"), F.round("loss", 6).alias("loss"))
    b = O.bypass_loss(df, "lp", "old", "adv", True, upper=1.2, options={"seq_mean_k3": 0.02}).select(F.lit("clipped").alias("kind"), F.round("loss", 6).alias("loss"))
    return a.union(b)


for _f in (q_rollout_correction, q_loss_bypass, q_loss_gspo, q_loss_geo_mean, q_loss_kl_cov, q_loss_clip_cov, q_masked_stats, q_whiten, q_reject_all, q_is_truncate, q_is_metrics, q_off_policy, q_workload, q_entropy):
    QUERIES[_f.__name__] = _f

ORACLE |= {
    "q_loss_kl_cov": f"""WITH {TOK}, m AS (SELECT avg(lp) AS mlp, avg(adv) AS madv, greatest(1, CAST(floor(count(*) * 0.002) AS BIGINT)) AS n FROM tok WHERE mask > 0),
r AS (SELECT tok.*, row_number() OVER (ORDER BY (lp - mlp) * (adv - madv) DESC, row_id, t) <= n AS top FROM tok, m WHERE mask > 0)
SELECT round(avg(-adv * {_R} + CASE WHEN top THEN abs(lp - old) ELSE 0 END), 6) AS loss FROM r""",
    "q_loss_gspo": f"""WITH {TOK}, r AS (
  SELECT *, exp(least(sum(CASE WHEN mask > 0 THEN lp - old END) OVER (PARTITION BY row_id) / greatest(sum(mask) OVER (PARTITION BY row_id), 1), 10)) AS r FROM tok
), s AS (SELECT row_id, sum(CASE WHEN mask > 0 THEN greatest(-adv * r, -adv * least(greatest(r, 1 - 3e-4), 1 + 4e-4)) END) AS s, sum(mask) AS n FROM r GROUP BY row_id)
SELECT round(sum(s / (n + 1e-8)) / count(*), 6) AS loss FROM s WHERE n > 0""",
    "q_loss_geo_mean": f"""WITH {TOK}, r AS (
  SELECT row_id, sum(CASE WHEN mask > 0 THEN CASE WHEN adv >= 0 THEN least(lp - old, least(greatest(lp - old, -0.2), 0.2)) ELSE -least(old - lp, -least(greatest(lp - old, -0.2), 0.2)) END END) / (sum(mask) + 1e-8) AS r,
         sum(CASE WHEN mask > 0 THEN adv END) / (sum(mask) + 1e-8) AS a FROM tok GROUP BY row_id)
SELECT round(avg(-a * exp(r)), 6) AS loss FROM r""",
    "q_masked_stats": f"""WITH {TOK}
SELECT uid, count(CASE WHEN mask > 0 THEN reward END) AS n, round(coalesce(sum(CASE WHEN mask > 0 THEN reward END), 0), 4) AS sum,
       round(coalesce(sum(CASE WHEN mask > 0 THEN reward END), 0) / (count(CASE WHEN mask > 0 THEN reward END) + 1e-8), 6) AS mean,
       round(var_samp(CASE WHEN mask > 0 THEN reward END), 6) AS var FROM tok GROUP BY uid""",
    "q_whiten": f"""WITH {TOK}, s AS (SELECT sum(CASE WHEN mask > 0 THEN reward END) / (sum(mask) + 1e-8) AS m, var_samp(CASE WHEN mask > 0 THEN reward END) AS v FROM tok)
SELECT row_id, CAST(t AS INTEGER) AS t, round(CASE WHEN mask > 0 THEN (reward - m) / sqrt(v + 1e-8) ELSE 0 END, 5) AS whitened FROM tok, s""",
    "q_reject_all": f"""WITH {TOK}, d AS (SELECT *, least(greatest(lp - old, -20), 20) AS x FROM tok), st AS (
  SELECT *, coalesce(sum(CASE WHEN mask > 0 THEN 0.5 * x * x END) OVER (PARTITION BY row_id), 0) / (sum(mask) OVER (PARTITION BY row_id) + 1e-8) AS m2,
         coalesce(max(CASE WHEN mask > 0 THEN exp(x) - 1 - x END) OVER (PARTITION BY row_id), 0) AS x3 FROM d)
SELECT uid, CAST(sum(CASE WHEN mask > 0 AND x BETWEEN ln(0.7) AND ln(1.4) AND m2 <= 0.05 AND x3 <= 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM st GROUP BY uid""",
    "q_is_truncate": f"""WITH {TOK}, w AS (SELECT row_id, t, {_R} AS w FROM tok)
SELECT row_id, CAST(t AS INTEGER) AS t, round(least(w, 1.2), 6) AS truncated, round(CASE WHEN w BETWEEN 0.8 AND 1.2 THEN w ELSE 0 END, 6) AS zeroed FROM w""",
    "q_is_metrics": f"""WITH {TOK}, w AS (SELECT {_R} AS w FROM tok WHERE mask > 0)
SELECT round(avg(w), 6) AS mean, round(min(w), 6) AS min, round(max(w), 6) AS max, round(stddev_pop(w), 6) AS std,
       round(sum(w) * sum(w) / (sum(w * w) * count(*)), 6) AS ess, round(avg(CASE WHEN w > 1.2 THEN 1.0 ELSE 0.0 END), 6) AS above, round(avg(CASE WHEN w < 0.8 THEN 1.0 ELSE 0.0 END), 6) AS below FROM w""",
    "q_off_policy": f"""WITH {TOK}, r AS (
  SELECT row_id, sum(old) / (count(*) + 1e-8) AS lp, sum(lp) / (count(*) + 1e-8) AS rp, sum(old - lp) AS d, sum(exp(old - lp) - (old - lp) - 1) AS k3, sum(exp(2 * (old - lp))) AS sq, count(*) AS n
  FROM tok WHERE mask > 0 GROUP BY row_id)
SELECT round(avg(exp(-lp)), 6) AS training_ppl, round(avg(exp(-rp)), 6) AS rollout_ppl, round(-sum(d) / sum(n), 6) AS kl, round(sum(k3) / sum(n), 6) AS k3_kl,
       round(avg(exp(rp - lp)), 6) AS ppl_ratio, round(sum(sq) / sum(n) - 1, 6) AS chi2_token, round(avg(exp(2 * d)) - 1, 6) AS chi2_seq FROM r""",
    "q_workload": f"""WITH {TOK}, r AS (SELECT row_id, CAST(sum(mask) AS BIGINT) AS n FROM tok GROUP BY row_id)
SELECT row_id, 24576 * n + n * n AS cost, round(least(-(n - 3) / 2 * 0.5, 0), 6) AS penalty FROM r""",
    "q_entropy": f"""WITH {TOK}, m AS (SELECT row_id, lp, max(lp) OVER (PARTITION BY row_id) AS top FROM tok)
SELECT row_id, round(ln(sum(exp(lp - top))) + max(top) - sum(lp * exp(lp - top)) / sum(exp(lp - top)), 5) AS entropy FROM m GROUP BY row_id""",
    "q_rollout_correction": f"""WITH {TOK}, w AS (SELECT *, least(exp(least(greatest(coalesce(sum(CASE WHEN mask > 0 THEN lp - old END) OVER (PARTITION BY row_id), 0), -20), 20)), 1.5) * mask AS w, lp - old AS d FROM tok),
m AS (SELECT sum(w) / (sum(mask) + 1e-8) AS mean FROM w) SELECT uid, round(sum(w / (mean + 1e-8)), 4) AS weight, CAST(sum(CASE WHEN mask > 0 AND d BETWEEN ln(0.7) AND ln(1.4) THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM w, m GROUP BY uid""",
    "q_loss_bypass": f"""WITH {TOK}, k AS (SELECT *, CASE WHEN mask > 0 AND coalesce(sum(CASE WHEN mask > 0 THEN exp(lp - old) - 1 - (lp - old) END) OVER (PARTITION BY row_id), 0) / (sum(mask) OVER (PARTITION BY row_id) + 1e-8) <= 0.02 THEN 1 ELSE 0 END AS kept FROM tok)
SELECT 'plain' AS kind, round(sum(-adv * lp * least({_R}, 1.2)) / count(*), 6) AS loss FROM k WHERE kept = 1 UNION ALL SELECT 'clipped', round(sum({_PPO}) / count(*), 6) FROM k WHERE kept = 1""",
}

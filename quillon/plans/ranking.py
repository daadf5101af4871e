"""Queries over pages, queues, intervals, partitions and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import ranking as R
from quillon.operators import retrieval as V


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    return o.select(
        k.alias("job_id"), F.element_at(F.array(F.lit("queued"), F.lit("running"), F.lit("done"), F.lit("error")), (k % 4 + 1).cast("int")).alias("status"), day.alias("created_at"),
        (day + F.col("o_custkey")).alias("finished_at"), (k % 3 - 1).alias("attempts"), (day + 1000).alias("next_retry"),
    )


JOBS = """jobs AS (SELECT o_orderkey AS job_id, (['queued', 'running', 'done', 'error'])[o_orderkey % 4 + 1] AS status, epoch(o_orderdate) AS created_at, epoch(o_orderdate) + o_custkey AS finished_at,
  o_orderkey % 3 - 1 AS attempts, epoch(o_orderdate) + 1000 AS next_retry FROM orders)"""
NOW = 900_000_000.0


def q_page(spark, sf_dir):
    return R.page(_read(spark, sf_dir, "orders"), ["o_orderkey"], 100, 25).select("o_orderkey", "o_custkey")


def q_topk(spark, sf_dir):
    return R.top_k_per_group(_read(spark, sf_dir, "orders"), ["o_orderpriority"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_orderpriority", "o_orderkey", "rank")


def q_claim_oldest(spark, sf_dir):
    return R.claim_oldest(jobs(spark, sf_dir))


def q_cleanup_batch(spark, sf_dir):
    return R.cleanup_batch(jobs(spark, sf_dir), NOW, 40, 0.25, NOW)


def q_status_counts(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def q_quota(spark, sf_dir):
    return R.round_robin_quota(_read(spark, sf_dir, "part"), "p_brand", "p_partkey", 60).select("p_brand", "p_partkey", "turn")


def q_interval_union(spark, sf_dir):
    e = _read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("first"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("last"))
    return R.merge_intervals(e, ["l_suppkey"], "first", "last")


def q_dedupe_first(spark, sf_dir):
    return R.dedupe_first(_read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


def q_backoff(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", R.backoff(30, 3600, F.col("job_id") % 15).alias("delay"))


def _steps(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select((F.col("doc_id") / 64).cast("long").alias("step"), "doc_id", "n_chars", (F.col("doc_id") / 4).cast("long").alias("prompt"))


def q_balance_partitions(spark, sf_dir):
    return R.balance(_steps(spark, sf_dir), "step", "doc_id", "n_chars", 4)


def q_balance_groups(spark, sf_dir):
    return R.balance_groups(_steps(spark, sf_dir), "step", "prompt", "n_chars", 4)


def q_microbatch(spark, sf_dir):
    return R.micro_batches(_steps(spark, sf_dir), "step", "doc_id", "n_chars", 40_000)


def q_bm25_topk(spark, sf_dir):
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return V.bm25(_read(spark, sf_dir, "documents"), queries, 5).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def q_dense_topk(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings")
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.dense(v, queries, 5).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


def q_fetch(spark, sf_dir):
    corpus = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_idx"), "lang")
    return V.fetch(corpus, spark.createDataFrame([(5, 0), (3, 1), (5, 2)], "doc_idx long, place int")).select("place", "doc_idx", "lang")


def q_passages(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.col("role").alias("title"), "text").alias("p"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select("conv_id", V.passages_to_text("p").alias("passages"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLE = {
    "q_page": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100",
    "q_topk": "WITH r AS (SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) SELECT * FROM r WHERE rank <= 3",
    "q_claim_oldest": f"WITH {JOBS} SELECT job_id, created_at FROM jobs WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 1",
    "q_cleanup_batch": f"""WITH {JOBS}, d AS (SELECT *, CASE WHEN attempts > 0 THEN CASE WHEN next_retry <= {NOW} THEN 'retry' END ELSE 'fresh' END AS kind FROM jobs WHERE status IN ('done', 'error') AND greatest(finished_at, created_at) < {NOW}),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY finished_at, job_id) AS rank FROM d WHERE kind IS NOT NULL)
SELECT job_id, kind, finished_at FROM r ORDER BY CASE WHEN kind = 'retry' THEN CASE WHEN rank <= 10 THEN 0 ELSE 2 END ELSE 1 END, rank, job_id LIMIT 40""",
    "q_status_counts": f"WITH {JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY status",
    "q_quota": "WITH r AS (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS turn FROM part) SELECT * FROM r ORDER BY turn, p_brand LIMIT 60",
    "q_interval_union": """WITH e AS (SELECT l_suppkey, l_orderkey AS first, l_orderkey + CAST(l_quantity AS BIGINT) AS last FROM lineitem),
r AS (SELECT *, max(last) OVER (PARTITION BY l_suppkey ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR first > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT l_suppkey, min(first) AS first, max(last) AS last FROM i GROUP BY l_suppkey, island""",
    "q_dedupe_first": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type",
    "q_backoff": "SELECT o_orderkey AS job_id, CAST(least(3600, 30 * power(2, least(o_orderkey % 15, 10))) AS DOUBLE) AS delay FROM orders",
    "q_bm25_topk": r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents), x AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS length FROM x GROUP BY 1), c AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
qw AS (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS qtf FROM qw WHERE term <> '' GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM x WHERE term IN (SELECT term FROM q) GROUP BY 1),
s AS (SELECT query_id, x.doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * length / mean))) AS score FROM x JOIN d ON x.term = d.term JOIN l ON x.doc_id = l.doc_id JOIN q ON x.term = q.term, c GROUP BY ALL),
r AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 5""",
    "q_dense_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 5""",
    "q_fetch": "SELECT CAST(place AS INTEGER) AS place, doc_id AS doc_idx, lang FROM (VALUES (5, 0), (3, 1), (5, 2)) v(d, place) JOIN documents ON doc_id = d",
    "q_passages": "SELECT conv_id, string_agg('Doc ' || (k + 1) || ' (Title: ' || role || ') ' || text, chr(10) ORDER BY turn) AS passages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) GROUP BY conv_id",
}

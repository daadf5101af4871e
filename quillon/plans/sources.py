"""Queries that go through a file: write, read back, compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.sources import records as R
from quillon.streaming.run import shared_folder


def q_jsonl_round_trip(spark, sf_dir):
    path = shared_folder(spark) + "/gen"
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 4).alias("step"), F.col("o_orderkey").alias("input"), F.round("o_totalprice", 2).alias("score"))
    R.write_generations(o, path)
    return spark.read.schema("input bigint, score double, step bigint").json(path).select("step", "input", "score")


def q_metrics_jsonl(spark, sf_dir):
    path = shared_folder(spark) + "/metrics"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("event_id") % 10).alias("step"), F.col("event_type").alias("name")).agg(F.count("*").cast("double").alias("value"))
    R.write_metrics(e, path)
    return spark.read.schema("step bigint, data map<string,double>").json(path).select("step", F.explode("data").alias("name", "value"))


def q_scan_mixed(spark, sf_dir):
    path = shared_folder(spark) + "/more.jsonl"
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n.filter("n_nationkey < 5").select("n_nationkey", F.lower("n_name").alias("n_name")).write.json(path)
    out = R.scan(spark, [f"{sf_dir}/nation.parquet", path], ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey int, n_name string")
    return out.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def q_csv_lines(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    odd = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('a "b", '), "p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_name"))
    return p.select("p_partkey", R.csv_line(F.col("p_partkey"), odd, F.col("p_size")).alias("line"))


def q_prompt_length(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return R.within_length(d, F.when(F.col("doc_id") % 10 > 0, F.size(F.split("text", " "))), 200).select("doc_id")


def q_nested_to_text(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.array("n_name").alias("names"))
    return R.texts_of_nested(n)


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLE = {
    "q_jsonl_round_trip": "SELECT o_orderkey % 4 AS step, o_orderkey AS input, round(o_totalprice, 2) AS score FROM orders",
    "q_metrics_jsonl": "SELECT event_id % 10 AS step, event_type AS name, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL",
    "q_scan_mixed": "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, lower(n_name), NULL FROM nation WHERE n_nationkey < 5",
    "q_csv_lines": """SELECT p_partkey, p_partkey || ',' || CASE p_partkey % 3 WHEN 0 THEN '"a ""b"", ' || p_name || '"' WHEN 1 THEN p_name ELSE '' END || ',' || p_size AS line FROM part""",
    "q_prompt_length": "SELECT doc_id FROM documents WHERE doc_id % 10 > 0 AND len(string_split(text, ' ')) <= 200",
    "q_nested_to_text": """SELECT n_nationkey, '["' || n_name || '"]' AS names FROM nation""",
}

"""Queries over the batch algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import batch as B


def parts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return B.with_ordinal(df, "p_partkey")


_P = "p AS (SELECT p_partkey, p_brand, p_size, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, count(*) OVER () AS total FROM part)"


def q_ordinal(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return B.with_ordinal(df.select("o_orderkey", "o_orderdate", "o_custkey"), "o_orderdate", "o_orderkey").select("o_orderkey", "row_id")


def q_select_rename_pop(spark, sf_dir):
    popped, rest = B.pop(parts(spark, sf_dir), ["p_size"])
    return B.union_columns(B.rename(B.select(rest, ["p_partkey", "p_brand"]), ["p_brand"], ["brand"]), popped)


def q_slice_step(spark, sf_dir):
    return B.slice_rows(parts(spark, sf_dir), 5, -7, 3).select("row_id", "p_partkey")


def q_gather(spark, sf_dir):
    return B.gather(parts(spark, sf_dir), [7, 3, 3, 0]).select("row_id", "p_partkey")


def q_repeat_interleave(spark, sf_dir):
    return B.repeat(parts(spark, sf_dir), 3).select("row_id", "p_partkey")


def q_repeat_tile(spark, sf_dir):
    return B.repeat(parts(spark, sf_dir), 3, interleave=False).select("row_id", "p_partkey")


def q_repeat_each(spark, sf_dir):
    return B.repeat_each(parts(spark, sf_dir).withColumn("times", F.col("p_size") % 3), "times").select("p_partkey", "copy")


def q_chunk(spark, sf_dir):
    return B.chunk(parts(spark, sf_dir), 4).groupBy("chunk").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def q_split(spark, sf_dir):
    return B.split(parts(spark, sf_dir), 64).groupBy("chunk").agg(F.count("*").alias("n"), F.max("p_partkey").alias("last"))


def q_split_equal(spark, sf_dir):
    return B.split_equal(parts(spark, sf_dir), 7).groupBy("chunk").agg(F.count("*").alias("n"))


def q_pad(spark, sf_dir):
    padded, _ = B.pad_to_divisor(parts(spark, sf_dir), 37)
    return padded.select("row_id", "p_partkey", "is_pad")


def q_pad_last(spark, sf_dir):
    return B.pad_with(parts(spark, sf_dir), 3, last=True).select("row_id", "p_partkey")


def q_concat(spark, sf_dir):
    p = parts(spark, sf_dir).select("row_id", "p_partkey")
    return B.concat([B.slice_rows(p, 0, 10), B.slice_rows(p, 50, 60)])


def q_fold(spark, sf_dir):
    folded = B.fold(parts(spark, sf_dir).select("row_id", "p_partkey", "p_size"), 8)
    return folded.select("row_id", F.size("p_size").cast("long").alias("n"), F.aggregate("p_size", F.lit(0), lambda s, x: s + x).cast("long").alias("sizes"))


def q_fold_unfold(spark, sf_dir):
    return B.unfold_batch(B.fold(parts(spark, sf_dir).select("row_id", "p_partkey"), 4))


def q_unfold(spark, sf_dir):
    folded = B.fold(parts(spark, sf_dir).select("row_id", "p_partkey"), 8)
    return B.unfold(folded, "p_partkey", 2).select("row_id", F.array_min("p_partkey").alias("first"), F.array_max("p_partkey").alias("last"))


def q_reorder(spark, sf_dir):
    p = parts(spark, sf_dir)
    order = p.select("row_id", (F.lit(p.count() - 1) - F.col("row_id")).alias("new_id"))
    return B.reorder(p, order).select("row_id", "p_partkey")


def q_mini_batches(spark, sf_dir):
    return B.mini_batches(parts(spark, sf_dir), 50, 2, 7).groupBy("epoch", "batch").agg(F.count("*").alias("n"))


def q_response_mask(spark, sf_dir):
    p = parts(spark, sf_dir).withColumn("mask", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (i <= F.col("p_size") % 7).cast("int")))
    return p.select("p_partkey", F.aggregate(B.response_mask("mask", 4), F.lit(0), lambda s, x: s + x).alias("n"))


def q_sample_head(spark, sf_dir):
    return B.sample(parts(spark, sf_dir), 25, "p_partkey").select("p_partkey")


def q_sample_hash(spark, sf_dir):
    return B.sample(parts(spark, sf_dir), 25, "p_partkey", seed=3).select("p_partkey")


def q_hold_out(spark, sf_dir):
    return B.hold_out(parts(spark, sf_dir), 0.1, "p_partkey").groupBy("split").agg(F.count("*").alias("n"))


def q_head_split(spark, sf_dir):
    return B.head_split(parts(spark, sf_dir), 0.75).groupBy("split").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLE = {
    "q_ordinal": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders",
    "q_select_rename_pop": f"WITH {_P} SELECT row_id, p_partkey, p_brand AS brand, p_size FROM p",
    "q_slice_step": f"WITH {_P} SELECT CAST((row_id - 5) / 3 AS BIGINT) AS row_id, p_partkey FROM p WHERE row_id >= 5 AND row_id < total - 7 AND (row_id - 5) % 3 = 0",
    "q_gather": f"WITH {_P}, i(row_id, n) AS (VALUES (7, 0), (3, 1), (3, 2), (0, 3)) SELECT CAST(i.n AS BIGINT) AS row_id, p_partkey FROM p JOIN i ON p.row_id = i.row_id",
    "q_repeat_interleave": f"WITH {_P} SELECT row_id * 3 + i AS row_id, p_partkey FROM p, range(3) r(i)",
    "q_repeat_tile": f"WITH {_P} SELECT i * total + row_id AS row_id, p_partkey FROM p, range(3) r(i)",
    "q_repeat_each": f"WITH {_P} SELECT p_partkey, CAST(i AS INTEGER) AS copy FROM p, range(3) r(i) WHERE i < p_size % 3",
    "q_chunk": f"WITH {_P} SELECT CAST(floor(row_id / (total / 4)) AS BIGINT) AS chunk, count(*) AS n, min(p_partkey) AS first FROM p GROUP BY 1",
    "q_split": f"WITH {_P} SELECT row_id // 64 AS chunk, count(*) AS n, max(p_partkey) AS last FROM p GROUP BY 1",
    "q_split_equal": f"WITH {_P} SELECT row_id // (total // 7) AS chunk, count(*) AS n FROM p WHERE row_id < (total // 7) * 7 GROUP BY 1",
    "q_pad": f"WITH {_P} SELECT row_id, p_partkey, false AS is_pad FROM p UNION ALL SELECT total + row_id, p_partkey, true FROM p WHERE row_id < (37 - total % 37) % 37",
    "q_pad_last": f"WITH {_P} SELECT row_id, p_partkey FROM p UNION ALL SELECT total + i, p_partkey FROM p, range(3) r(i) WHERE row_id = total - 1",
    "q_concat": f"WITH {_P} SELECT row_id, p_partkey FROM p WHERE row_id < 10 UNION ALL SELECT row_id - 40, p_partkey FROM p WHERE row_id BETWEEN 50 AND 59",
    "q_fold": f"WITH {_P} SELECT row_id // 8 AS row_id, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM p GROUP BY 1",
    "q_fold_unfold": f"WITH {_P} SELECT row_id, p_partkey FROM p",
    "q_unfold": f"WITH {_P} SELECT row_id // 4 AS row_id, min(p_partkey) AS first, max(p_partkey) AS last FROM p GROUP BY 1",
    "q_reorder": f"WITH {_P} SELECT total - 1 - row_id AS row_id, p_partkey FROM p",
    "q_mini_batches": f"WITH {_P} SELECT CAST(e AS INTEGER) AS epoch, row_id // 50 AS batch, count(*) AS n FROM p, range(2) r(e) GROUP BY ALL",
    "q_response_mask": f"WITH {_P} SELECT p_partkey, CAST(greatest(p_size % 7 - 2, 0) AS INTEGER) AS n FROM p",
    "q_sample_head": f"WITH {_P} SELECT p_partkey FROM p WHERE row_id < 25",
    "q_head_split": f"WITH {_P} SELECT CASE WHEN row_id < floor(total * 0.75) THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(p_partkey) AS first FROM p GROUP BY 1",
}

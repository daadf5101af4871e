"""Queries of registries, code and answer rules, partitions and restored batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import answers as A
from quillon.functions import cells as Z
from quillon.functions import text as T
from quillon.operators import batch as B
from quillon.operators import grouped as G
from quillon.operators import metrics as M
from quillon.operators import ranking as R
from quillon.operators import rewards as W
from quillon.operators import cells as Q
from quillon.operators import sampling as P
from quillon.operators import tokens as O
from quillon.plans.tokens import LOSSES, TOK, tokens
from quillon.streaming.run import shared_folder

c = F.col


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(c("o_orderkey").alias("row_id"), c("o_custkey").alias("customer"), c("o_orderstatus").alias("status"))


def q_registered_losses(spark, sf_dir):
    df, out = tokens(spark, sf_dir), None
    for name in ("ppo_clip", "cispo", "dppo_tv"):
        row = W.policy_loss(df, name).select(F.lit(name).alias("name"), F.round("loss", 6).alias("loss"))
        out = row if out is None else out.union(row)
    return out


def _longest(batch):
    return [float(len(x or "")) for x in batch.column("c_name").to_pylist()]


@W.register_reward("same_sign")
def _same_sign(balance):
    return F.when(balance >= 0, 1.0).otherwise(0.0)


@W.register_reward("full_name")
def _full_name(balance):
    return F.greatest(balance / 1000, F.lit(0.0))


W.register_batch_reward("name_length")(_longest)


def q_reward_items(spark, sf_dir):
    customers = _read(spark, sf_dir, "customer")
    out = W.reward_by_source(customers, "c_mktsegment", {"BUILDING": "same_sign", "MACHINERY": "full_name"}, "c_acctbal", default=-1.0)
    return out.select("c_custkey", F.round("score", 6).alias("score"))


def q_reward_batches(spark, sf_dir):
    return W.batch_reward(_read(spark, sf_dir, "customer"), "name_length", "c_custkey", "c_name")


def q_entropy_loss(spark, sf_dir):
    df = tokens(spark, sf_dir).withColumn("logits", F.array("lp", "old", "ref"))
    return O.entropy_loss(df, "logits").select(F.round("loss", 6).alias("loss"))


def q_validation_majority(spark, sf_dir):
    """Three votes in each group of a type and user, of which one wins or was first among equals."""
    df = _read(spark, sf_dir, "events").filter("value is not null").withColumn("vote", c("event_id") % 3)
    out = M.validation_metrics(df, "event_type", "user_id", "value", "event_id", vote="vote")
    # The sum of the prompts' values in hundredths: they have two decimals.
    return out.select("event_type", "n", "prompts", F.round(c("majority") * c("prompts") * 100).cast("long").alias("hundredths"))


def q_weighted_sample(spark, sf_dir):
    """200 orders, drawn by their price."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", c("o_totalprice").cast("double").alias("weight"))
    return P.weighted_sample(o, "o_orderkey", "weight", 200, 7).select("o_orderkey")


def q_curriculum(spark, sf_dir):
    """Weights of customers after feedback by their orders, and the 100 of an epoch; customers without weight are new."""
    o = _read(spark, sf_dir, "orders").select("o_custkey", (c("o_orderkey") % 5).cast("double").alias("signal"))
    known = _read(spark, sf_dir, "customer").filter("c_custkey % 4 > 0").select(c("c_custkey").alias("o_custkey"), F.lit(1.0).alias("weight"))
    weights = P.with_feedback(known, o, "o_custkey", 0.5)
    prompts = _read(spark, sf_dir, "customer").select(c("c_custkey").alias("o_custkey"))
    return P.curriculum(prompts, weights, "o_custkey", 100, 3, 2.0).select(c("o_custkey").alias("c_custkey"), F.round("weight", 6).alias("weight"), "epoch")


def q_scan_groups(spark, sf_dir):
    """Scans for the ranges of each brand: a range a part, some so wide or far that they stand alone."""
    p = _read(spark, sf_dir, "part")
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    ranges = p.select(c("p_brand").alias("task_id"), (at + (c("p_size") % 11 == 0).cast("int") * 1000).alias("range_idx"), F.lit("f").alias("file"), F.lit("s").alias("sheet"),
        (c("p_partkey") % 200 + 1).alias("min_row"), (c("p_size") % 5 + 1).alias("min_col"), (c("p_partkey") % 200 + c("p_size")).alias("max_row"), (c("p_size") % 7 + 5).alias("max_col"))
    return Q.scan_groups(ranges).select("task_id", "scan", "first", "last", "min_row", "min_col", "max_row", "max_col")


def q_assembly(spark, sf_dir):
    df = _read(spark, sf_dir, "events").select("value", (c("event_id") % 7).alias("version"))
    return M.assembly_stats(df, "value", "version", 6).select("samples", *[F.round(p, 4).alias(p) for p in ("tp50", "tp95", "tp99")], F.round("mean", 4).alias("mean"), F.round("longest", 4).alias("longest"), "versions", "stale", "lag")


def q_recounted(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_type")
    counters = rows.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("n", F.when(c("event_type") == "click", c("n") + 5).when(c("event_type") != "view", c("n")))
    return M.recounted(counters, rows, "event_type")


def q_inverse_permutation(spark, sf_dir):
    p = _numbered(spark, sf_dir).select("row_id", (F.lit(7) - c("row_id")).alias("new_id"))
    return R.inverse_permutation(p)


def q_greedy_partition(spark, sf_dir):
    """Each order's lines, one after the other, to the lighter of two parts."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("n"))
    parts = R.greedy_partition(lines, "l_orderkey", "l_linenumber", "n", 2)
    return parts.select("l_orderkey", "l_linenumber", "part")


def q_rank_balanced(spark, sf_dir):
    """Whatever the parts, the places of a batch count from 0 without gaps."""
    docs = _read(spark, sf_dir, "documents").select((c("doc_id") % 20).alias("batch"), "doc_id", c("n_chars").cast("long").alias("n"))
    out = R.rank_balanced_order(docs, "batch", "doc_id", "n", 4)
    return out.groupBy("batch").agg(F.count("*").alias("rows"), F.min("place").cast("long").alias("first"), F.max("place").cast("long").alias("last"), F.countDistinct("place").alias("places"))


def q_union_columns(spark, sf_dir):
    o = _numbered(spark, sf_dir)
    return B.union_columns(o.select("row_id", "customer"), o.select("row_id", "customer", "status"))


def q_unpad(spark, sf_dir):
    padded, _ = B.pad_to_divisor(_numbered(spark, sf_dir), 64)
    return B.unpad(padded).select("row_id", "status")


def q_tag_count(spark, sf_dir):
    k = _read(spark, sf_dir, "orders").select("o_orderkey", T.tag_count(F.concat(F.lit("<answer>a</answer> <answer>"), "o_orderstatus")).alias("t"))
    return k.select("o_orderkey", "t.opens", "t.closes")


def q_first_code_line(spark, sf_dir):
    text = F.concat(F.lit("# note\n\n  # more\n"), "p_name", F.lit(" = 1\nprint()"))
    return _read(spark, sf_dir, "part").select("p_partkey", T.first_code_line(text, "python").alias("line"))


def q_freeform(spark, sf_dir):
    k = c("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("so:\n```python\nx = '"), "p_name", F.lit("'\nif __name__ == '__main__':\n  run()\n```"))).when(
        k == 1, F.concat(F.lit("open\n```python\ny = '"), "p_name", F.lit("'"))
    ).otherwise(F.concat(F.lit("plain\ndef f():\n    return '"), "p_name", F.lit("'\nthat is it")))
    return _read(spark, sf_dir, "part").select("p_partkey", T.freeform_code(text, "python").alias("code"))


def q_jest_cases(spark, sf_dir):
    report = F.concat(F.lit('{"testResults":[{"name":"a.js","assertionResults":[{"fullName":"'), "p_brand", F.lit('","status":"passed"},{"fullName":"other","status":"'), F.when(c("p_partkey") % 2 == 0, "passed").otherwise("failed"), F.lit('"}]},{"name":"b.js","assertionResults":[]}]}'))
    return _read(spark, sf_dir, "part").select("p_partkey", F.explode(T.jest_cases(report)).alias("x")).select("p_partkey", "x.suite", "x.test", "x.passed")


def q_case_result(spark, sf_dir):
    k = c("o_orderkey")
    api, comp = F.when(k % 11 == 0, "down").otherwise("ok"), F.when(k % 7 == 0, "failed").otherwise("success")
    run = F.when(k % 5 == 0, "timeout").when(k % 5 == 1, "failed").otherwise("success")
    return _read(spark, sf_dir, "orders").select("o_orderkey", T.case_result(api, comp, run, k.cast("string"), F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise("no")).alias("result"))


def q_same_answer(spark, sf_dir):
    k = c("p_partkey")
    a = F.when(k % 4 == 0, F.concat(F.lit("x = \\dfrac{1}{"), k.cast("string"), F.lit("}"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit("\\%"))).when(k % 4 == 2, F.concat(F.lit("\\sqrt"), (k % 9).cast("string"))).otherwise("0.5")
    b = F.when(k % 4 == 0, F.concat(F.lit("1/"), k.cast("string"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit("\\text{ apples}"))).when(k % 4 == 2, "\\sqrt{6}").otherwise("\\frac12")
    return _read(spark, sf_dir, "part").select("p_partkey", A.same_answer(a, b).alias("same"))


def q_trim_at_stops(spark, sf_dir):
    text = F.concat("p_name", F.lit("\nclass X\n# end 12"))
    return _read(spark, sf_dir, "part").select("p_partkey", T.trim_at_stops(text, ["\nclass", "re:# end [0-9]+"]).alias("text"))


def q_geometry_score(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(A.geometry_score(c("o_orderkey") % 2 == 0, c("o_orderkey") % 3 == 0), 6).alias("score"))


def q_session_advantage(spark, sf_dir):
    """Conversations as sessions of ten users: advantages of their last turns, for every turn."""
    df = _read(spark, sf_dir, "conversations").select(F.concat_ws("_", F.lit("u_x"), c("conv_id") % 10, "conv_id", "turn").alias("key"), F.length("text").cast("double").alias("score"))
    return G.session_advantage(df, "key", "score").select("key", F.round("adv", 6).alias("adv"))


def q_line_tokens(spark, sf_dir):
    """Rows to delete, a list a part, merged by brand."""
    p = _read(spark, sf_dir, "part").select(c("p_brand").alias("sheet"), (c("p_partkey") * 3 % 5000 + 1).alias("k"))
    k = lambda n: (c("k") + n).cast("string")
    text = F.concat(k(0), F.lit(", $"), k(9), F.lit(":"), k(7), F.lit(", A"), k(0), F.lit(", 0"))
    each = p.select("sheet", F.explode(Z.lines(text)).alias("x")).select("sheet", "x.first", "x.last").filter("first is not null")
    return R.merge_intervals(each, ["sheet"], "first", "last")


def q_column_tokens(spark, sf_dir):
    """Columns of one list a part: two good ends, sorted, or none."""
    p = _read(spark, sf_dir, "part").select("p_partkey", Z.column_name(c("p_size") + 20).alias("a"), Z.column_name(c("p_partkey") % 700 + 1).alias("b"))
    x = F.explode(Z.lines(F.concat(c("a"), F.lit(":$"), F.lower("b"), F.lit(",XFE")), "column")).alias("x")
    return p.select("p_partkey", x).select("p_partkey", "x.first", "x.last")


def q_batch_round_trip(spark, sf_dir):
    """A batch of orders in order of date, saved, loaded and compared."""
    df = B.with_ordinal(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "o_orderkey")
    path = f"{shared_folder(spark)}/batch"
    B.save_batch(df, path)
    again = B.load_batch(spark, path)
    if not B.same_rows(df, again):
        raise ValueError("the batch has changed")
    return again.select("row_id", "o_orderkey")


def q_next_pending(spark, sf_dir):
    """Each customer's oldest order of which no line was returned."""
    orders = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    done = _read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    return R.next_pending(orders, done, "o_orderkey", ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

_L = {n: sql for n, (_, sql) in LOSSES.items()}
ORACLE = {
    "q_registered_losses": f"WITH {TOK} " + " UNION ALL ".join(f"SELECT '{n}' AS name, round(sum({_L[n]}) / count(*), 6) AS loss FROM tok WHERE mask > 0" for n in ("ppo_clip", "cispo", "dppo_tv")),
    "q_reward_items": "SELECT c_custkey, CAST(round(CASE c_mktsegment WHEN 'BUILDING' THEN CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0.0 END WHEN 'MACHINERY' THEN greatest(c_acctbal / 1000, 0) ELSE -1 END, 6) AS DOUBLE) AS score FROM customer",
    "q_reward_batches": "SELECT c_custkey, CAST(length(c_name) AS DOUBLE) AS score FROM customer",
    "q_entropy_loss": f"WITH {TOK}, e AS (SELECT ln(exp(lp) + exp(old) + exp(ref)) - (lp * exp(lp) + old * exp(old) + ref * exp(ref)) / (exp(lp) + exp(old) + exp(ref)) AS e FROM tok WHERE mask > 0) SELECT round(avg(e), 6) AS loss FROM e",
    "q_validation_majority": """WITH s AS (SELECT event_type, user_id, event_id % 3 AS vote, count(*) AS n, min(event_id) AS first, arg_min(value, event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY event_type, user_id) AS total, row_number() OVER (PARTITION BY event_type, user_id ORDER BY n DESC, first) AS place FROM s),
r AS (SELECT * EXCLUDE (n) FROM w WHERE place = 1),
e AS (SELECT r.*, k.n FROM r, (SELECT CAST(power(2, i) AS INTEGER) AS n FROM range(1, 21) t(i)) k WHERE total > 1 AND k.n < total UNION ALL SELECT *, CAST(total AS INTEGER) FROM r)
SELECT event_type, n, count(*) AS prompts, CAST(round(sum(v) * 100) AS BIGINT) AS hundredths FROM e GROUP BY event_type, n""",
    "q_weighted_sample": "SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY -ln((CAST('0x' || substring(md5('7:' || o_orderkey), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / CAST(o_totalprice AS DOUBLE), o_orderkey LIMIT 200",
    "q_curriculum": """WITH f AS (SELECT o_custkey, avg(CAST(o_orderkey % 5 AS DOUBLE)) AS s FROM orders GROUP BY 1),
w AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 2.0::DOUBLE WHEN s IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE + s * 0.5::DOUBLE END AS weight FROM customer LEFT JOIN f ON o_custkey = c_custkey)
SELECT c_custkey, round(weight, 6) AS weight, 3 AS epoch FROM w WHERE weight > 0 ORDER BY -ln((CAST('0x' || substring(md5('3:' || c_custkey), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight, c_custkey LIMIT 100""",
    "q_scan_groups": """WITH RECURSIVE p AS (SELECT p_brand AS t, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + CASE WHEN p_size % 11 = 0 THEN 1000 ELSE 0 END AS idx, p_partkey % 200 + 1 AS r1, p_size % 5 + 1 AS c1, p_partkey % 200 + p_size AS r2, p_size % 7 + 5 AS c2 FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY idx) AS i, (r2 - r1 + 1) * (c2 - c1 + 1) AS a FROM p),
g(t, i, scan, first, idx, asked, r1, c1, r2, c2) AS (SELECT t, i, 0, idx, idx, a, r1, c1, r2, c2 FROM r WHERE i = 1
UNION ALL SELECT t, i, CASE WHEN fits THEN scan ELSE scan + 1 END, CASE WHEN fits THEN first ELSE idx END, idx, CASE WHEN fits THEN asked + a ELSE a END,
  CASE WHEN fits THEN b1 ELSE r1 END, CASE WHEN fits THEN d1 ELSE c1 END, CASE WHEN fits THEN b2 ELSE r2 END, CASE WHEN fits THEN d2 ELSE c2 END FROM (
  SELECT r.*, g.scan, g.first, g.asked, least(g.r1, r.r1) AS b1, least(g.c1, r.c1) AS d1, greatest(g.r2, r.r2) AS b2, greatest(g.c2, r.c2) AS d2,
    r.idx = g.idx + 1 AND (b2 - b1 + 1) * (d2 - d1 + 1) <= 100000 AND (b2 - b1 + 1) * (d2 - d1 + 1) <= greatest(1024, 4 * (g.asked + r.a)) AS fits FROM g JOIN r ON r.t = g.t AND r.i = g.i + 1)),
l AS (SELECT *, row_number() OVER (PARTITION BY t, scan ORDER BY i DESC) AS d FROM g)
SELECT t AS task_id, scan, first, idx AS last, CAST(r1 AS BIGINT) AS min_row, CAST(c1 AS BIGINT) AS min_col, CAST(r2 AS BIGINT) AS max_row, CAST(c2 AS BIGINT) AS max_col FROM l WHERE d = 1""",
    "q_assembly": "SELECT count(*) AS samples, round(quantile_cont(value, 0.5), 4) AS tp50, round(quantile_cont(value, 0.95), 4) AS tp95, round(quantile_cont(value, 0.99), 4) AS tp99, round(avg(value), 4) AS mean, round(max(value), 4) AS longest, count(DISTINCT event_id % 7) AS versions, count(*) FILTER (event_id % 7 < 6) AS stale, max(6 - event_id % 7) AS lag FROM events",
    "q_session_advantage": """WITH c AS (SELECT conv_id, conv_id % 10 AS u, turn, CAST(length(text) AS DOUBLE) AS s FROM conversations), l AS (SELECT conv_id, u, arg_max(s, turn) AS s FROM c GROUP BY ALL),
g AS (SELECT u, count(*) AS n, avg(s) AS m, stddev_samp(s) AS d FROM l GROUP BY u)
SELECT 'u_x_' || c.u || '_' || c.conv_id || '_' || turn AS key, round((l.s - CASE WHEN n > 1 THEN m ELSE 0 END) / (CASE WHEN n > 1 THEN d ELSE 1 END + 1e-6), 6) AS adv FROM c JOIN l ON c.conv_id = l.conv_id JOIN g ON g.u = c.u""",
    "q_line_tokens": """WITH p AS (SELECT p_brand AS sheet, p_partkey * 3 % 5000 + 1 AS k FROM part), e AS (SELECT sheet, k AS a, k AS b FROM p UNION ALL SELECT sheet, k + 7, k + 9 FROM p),
s AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY sheet ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (PARTITION BY sheet ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT sheet, CAST(min(a) AS INTEGER) AS first, CAST(max(b) AS INTEGER) AS last FROM i GROUP BY sheet, island""",
    "q_column_tokens": """SELECT p_partkey, CAST(least(p_size + 20, p_partkey % 700 + 1) AS INTEGER) AS first, CAST(greatest(p_size + 20, p_partkey % 700 + 1) AS INTEGER) AS last FROM part UNION ALL SELECT p_partkey, NULL, NULL FROM part""",
    "q_batch_round_trip": "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id, o_orderkey FROM orders",
    "q_next_pending": """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT o_custkey, o_orderkey FROM r WHERE n = 1""",
    "q_recounted": "SELECT event_type, count(*) AS n, event_type IN ('click', 'view') AS repaired FROM events GROUP BY event_type",
    "q_inverse_permutation": "SELECT 7 - o_orderkey AS row_id, o_orderkey AS new_id FROM orders",
    "q_greedy_partition": """WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM l),
g(k, n, i, a, b, part) AS (SELECT l_orderkey, l_linenumber, i, q, CAST(0 AS BIGINT), 0 FROM r WHERE i = 1
UNION ALL SELECT k, l_linenumber, r.i, a + CASE WHEN a <= b THEN q ELSE 0 END, b + CASE WHEN a <= b THEN 0 ELSE q END, CASE WHEN a <= b THEN 0 ELSE 1 END FROM g JOIN r ON l_orderkey = k AND r.i = g.i + 1)
SELECT k AS l_orderkey, n AS l_linenumber, part FROM g""",
    "q_rank_balanced": "SELECT doc_id % 20 AS batch, count(*) AS rows, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) AS places FROM documents GROUP BY 1",
    "q_union_columns": "SELECT o_orderkey AS row_id, o_custkey AS customer, o_orderstatus AS status FROM orders",
    "q_unpad": "SELECT o_orderkey AS row_id, o_orderstatus AS status FROM orders",
    "q_tag_count": "SELECT o_orderkey, 2 AS opens, 1 AS closes FROM orders",
    "q_first_code_line": "SELECT p_partkey, p_name || ' = 1' AS line FROM part",
    "q_freeform": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x = ''' || p_name || '''' || chr(10) WHEN 1 THEN 'y = ''' || p_name || '''' ELSE 'def f():' || chr(10) || '    return ''' || p_name || '''' || chr(10) END AS code FROM part",
    "q_jest_cases": "SELECT p_partkey, 'a.js' AS suite, p_brand AS test, true AS passed FROM part UNION ALL SELECT p_partkey, 'a.js', 'other', p_partkey % 2 = 0 FROM part",
    "q_case_result": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 WHEN o_orderkey % 7 = 0 THEN -4 WHEN o_orderkey % 5 = 0 THEN -3 WHEN o_orderkey % 5 = 1 THEN -2 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS result FROM orders",
    "q_same_answer": "SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN p_partkey % 9 = 6 ELSE true END AS same FROM part",
    "q_trim_at_stops": "SELECT p_partkey, p_name AS text FROM part",
    "q_geometry_score": "SELECT o_orderkey, CAST(round(CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.1 ELSE 0 END, 6) AS DOUBLE) AS score FROM orders",
}

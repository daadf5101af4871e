"""Audit queries: customers as auditors, parts as tasks, line items as answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import audit as A

SPLITS = ["training", "domain"]


def relations(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    tasks = read("part").select(
        F.col("p_partkey").alias("task_id"), F.when(F.col("p_size") % 2 == 0, "training").otherwise("domain").alias("split"), F.col("p_type").alias("category"), F.col("p_name").alias("label")
    )
    orders = read("orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("email"), (F.col("o_orderkey") % 200).alias("task_id"), F.col("o_orderkey").alias("k"), "o_orderpriority", "o_totalprice")
    assignments = orders.groupBy("email", "task_id").agg(F.min("k").alias("assignment_order"))
    audits = A.latest(orders.filter(F.col("o_totalprice") > 100_000).select("email", "task_id", "k", "o_orderpriority"), ["email", "task_id"], "k")
    level = F.substring("o_orderpriority", 1, 1)
    audits = audits.select(
        "email", "task_id", F.when(level.isin("1", "2"), "yes").when(level == "3", "almost").otherwise("no").alias("assessment"), F.when(F.col("k") % 3 > 0, F.col("k") % 3 - 1).cast("int").alias("reasonable")
    )
    return tasks, assignments, audits


REL = """tasks AS (SELECT p_partkey AS task_id, CASE WHEN p_size % 2 = 0 THEN 'training' ELSE 'domain' END AS split, p_type AS category, p_name AS label FROM part),
o AS (SELECT 'u' || o_custkey AS email, o_orderkey % 200 AS task_id, o_orderkey AS k, o_orderpriority, o_totalprice FROM orders),
assignments AS (SELECT email, task_id, min(k) AS assignment_order FROM o GROUP BY ALL),
last AS (SELECT email, task_id, max(k) AS k, arg_max(o_orderpriority, k) AS p FROM o WHERE o_totalprice > 100000 GROUP BY email, task_id),
audits AS (SELECT email, task_id, CASE WHEN p[1] IN ('1', '2') THEN 'yes' WHEN p[1] = '3' THEN 'almost' ELSE 'no' END AS assessment, CASE WHEN k % 3 > 0 THEN CAST(k % 3 - 1 AS INTEGER) END AS reasonable FROM last),
j AS (SELECT a.email, a.task_id, assignment_order, split, category, label, assessment, reasonable FROM assignments a JOIN tasks t ON a.task_id = t.task_id LEFT JOIN audits u ON a.email = u.email AND a.task_id = u.task_id)"""


def q_dashboard(spark, sf_dir):
    return A.dashboard(*relations(spark, sf_dir), "u7", status="completed").select("task_id", "split", "assessment", "assignment_order")


def q_semi_exists(spark, sf_dir):
    tasks, assignments, _ = relations(spark, sf_dir)
    wanted = assignments.select("email", (F.col("task_id") + 1).alias("task_id"))
    return A.is_assigned(assignments, wanted)


def q_auditor_stats(spark, sf_dir):
    return A.auditor_stats(*relations(spark, sf_dir))


def q_densify(spark, sf_dir):
    whitelist = spark.createDataFrame([(f"u{i}",) for i in range(40)], "email string")
    return A.densify(A.auditor_stats(*relations(spark, sf_dir)), whitelist, SPLITS)


def q_progress(spark, sf_dir):
    return A.progress(A.auditor_stats(*relations(spark, sf_dir)))


def q_pivot_totals(spark, sf_dir):
    return A.pivot_totals(A.auditor_stats(*relations(spark, sf_dir)), SPLITS)


def q_task_stats(spark, sf_dir):
    out = A.task_stats(*relations(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("yes_rate", "match_rate")})


def q_search(spark, sf_dir):
    tasks, _, _ = relations(spark, sf_dir)
    return tasks.filter(A.matches_query(" Rin ", "label", "category")).select("task_id", "category")


def q_audit_validation(spark, sf_dir):
    tasks, assignments, audits = relations(spark, sf_dir)
    rows = audits.join(tasks, "task_id")
    error = A.audit_error(F.col("split"), F.col("assessment"), F.col("reasonable"), F.substring("label", 1, 4))
    return rows.select("email", "task_id", error.alias("error"))


def q_latest_write(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "value")
    return A.latest(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


def q_eligible(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("dir"), F.col("event_type").alias("member"))
    return A.eligible(e, ["purchase", "error", "signup"])


def q_anti_omission(spark, sf_dir):
    tasks, _, _ = relations(spark, sf_dir)
    return A.assign(tasks.select("task_id", "split"), tasks.filter("task_id % 5 = 0").select("task_id"), "task_id")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLE = {
    "q_dashboard": f"WITH {REL} SELECT task_id, split, assessment, assignment_order FROM j WHERE email = 'u7' AND assessment IS NOT NULL",
    "q_semi_exists": f"WITH {REL} SELECT email, task_id + 1 AS task_id FROM assignments a WHERE EXISTS (SELECT 1 FROM assignments b WHERE b.email = a.email AND b.task_id = a.task_id + 1)",
    "q_auditor_stats": f"WITH {REL} SELECT email, split, count(*) AS assigned, count(assessment) AS completed FROM j GROUP BY ALL",
    "q_densify": f"""WITH {REL}, s AS (SELECT email, split, count(*) AS assigned, count(assessment) AS completed FROM j GROUP BY ALL)
SELECT w.email, w.split, coalesce(assigned, 0) AS assigned, coalesce(completed, 0) AS completed FROM (SELECT 'u' || i AS email, split FROM range(40) r(i), (VALUES ('training'), ('domain')) v(split)) w LEFT JOIN s ON w.email = s.email AND w.split = s.split""",
    "q_progress": f"WITH {REL} SELECT split, count(*) AS assigned, count(assessment) AS completed, count(*) - count(assessment) AS remaining FROM j GROUP BY split",
    "q_pivot_totals": f"WITH {REL} SELECT email, count(assessment) FILTER (split = 'training') AS training, count(assessment) FILTER (split = 'domain') AS domain, count(assessment) AS total FROM j GROUP BY email",
    "q_task_stats": f"""WITH {REL}, s AS (SELECT task_id, count(email) AS assigned, count(assessment) AS completed, count(*) FILTER (assessment = 'yes') AS yes, count(*) FILTER (assessment = 'almost') AS almost,
  count(*) FILTER (assessment = 'no') AS no, count(*) FILTER (reasonable = 1) AS reasonable, count(*) FILTER (reasonable = 0) AS unreasonable FROM j GROUP BY task_id)
SELECT *, round(yes / nullif(completed, 0), 6) AS yes_rate, round(reasonable / nullif(reasonable + unreasonable, 0), 6) AS match_rate FROM s""",
    "q_search": f"WITH {REL} SELECT task_id, category FROM tasks WHERE contains(lower(label), 'rin') OR contains(lower(category), 'rin')",
    "q_audit_validation": f"""WITH {REL} SELECT u.email, u.task_id, CASE WHEN split = 'domain' AND reasonable IS NULL THEN 'reasonable missing' WHEN split <> 'domain' AND reasonable IS NOT NULL THEN 'reasonable not asked'
  WHEN assessment <> 'yes' OR coalesce(reasonable = 0, false) THEN 'description too short' END AS error FROM audits u JOIN tasks t ON u.task_id = t.task_id""",
    "q_latest_write": "SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY user_id, event_type",
    "q_eligible": "SELECT user_id AS dir FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY user_id HAVING count(DISTINCT event_type) = 3",
    "q_anti_omission": f"WITH {REL} SELECT task_id, split FROM tasks WHERE task_id % 5 <> 0",
}

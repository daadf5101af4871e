"""Queries over job states, queues and event time; ``x_`` are extensions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillon.operators import batch as B
from quillon.plans.ranking import JOBS, jobs
from quillon.sources import scratch
from quillon.sources.scratch import written
from quillon.streaming import epochs as N
from quillon.streaming import events as E
from quillon.streaming import run as R
from quillon.streaming import state as S
from quillon.streaming import stateful as T

c = F.col


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def log(spark, sf_dir, *more):
    """Events as a job log: users are jobs, types are states."""
    status = F.when(c("event_type") == "signup", "queued").when(c("event_type").isin("view", "click"), "running").when(c("event_type") == "purchase", "done").otherwise("error")
    return events(spark, sf_dir).select(c("user_id").alias("job_id"), "event_id", status.alias("status"), *more)


LOG = "log AS (SELECT user_id AS job_id, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'error' END AS status FROM events)"


def q_queue_drop_oldest(spark, sf_dir):
    return S.drop_oldest(events(spark, sf_dir), ["event_type"], ["ts", "event_id"], 100).select("event_type", "event_id")


def q_queue_statistics(spark, sf_dir):
    return S.queue_statistics(events(spark, sf_dir), ["event_type"], 100)


def q_latest_state(spark, sf_dir):
    return S.latest_state(log(spark, sf_dir), "job_id", "event_id")


def q_transitions(spark, sf_dir):
    return S.valid_transitions(log(spark, sf_dir), "job_id", "event_id")


def q_stale_jobs(spark, sf_dir):
    j = jobs(spark, sf_dir).withColumn("started_at", c("created_at") + 500)
    return S.stale_jobs(j, 900_000_000.0, 86_400.0).select("job_id")


def q_admission(spark, sf_dir):
    return S.admitted(jobs(spark, sf_dir), ["status"], ["created_at", "job_id"], 50).filter("accepted").select("job_id", "status")


def q_claims(spark, sf_dir):
    return S.claims(jobs(spark, sf_dir), ["created_at", "job_id"], 3, 20).select("job_id")


def q_quarantine(spark, sf_dir):
    k = c("job_id")
    j = jobs(spark, sf_dir).select(
        k.cast("string").alias("job_id"), "status", "created_at", F.when(k % 5 > 0, c("created_at") + 1).alias("started_at"), F.when(k % 7 > 1, c("finished_at")).alias("finished_at"),
        F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 3 > 0, F.lit(1.0)).alias("reward"), F.when(k % 2 == 0, F.lit("w")).otherwise(F.lit(" ")).alias("worker_id"),
    )
    _, bad = S.quarantine(j)
    return bad.select("job_id", F.array_join("reasons", ";").alias("reasons"))


def q_replay_ready(spark, sf_dir):
    s = log(spark, sf_dir).select("event_id", (c("event_id") % 5000).alias("step"), F.when(c("status") == "done", "success").otherwise(c("status")).alias("status")).filter("event_id % 3 > 0 or status <> 'running'")
    return S.replay_ready(s, "step").select("event_id", "step")


def q_ring(spark, sf_dir):
    return S.ring(events(spark, sf_dir).select("event_id", "event_type"), "event_id", 64).select("slot", "event_id", "event_type")


def q_staleness(spark, sf_dir):
    return S.staleness(events(spark, sf_dir).select((c("event_id") % 10).alias("version")), 9, 0.5, 1000, 4)


def q_mixed_sample(spark, sf_dir):
    out = S.mixed_sample(events(spark, sf_dir), c("event_type") == "error", 100, 0.3, "event_id")
    return out.groupBy((c("event_type") == "error").alias("positive")).agg(F.count("*").alias("n"))


def q_token_bucket(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", F.unix_timestamp(c("ts").cast("timestamp")).cast("double").alias("at"), (c("event_id") % 9 + 1).cast("double").alias("tokens"))
    return S.token_bucket(e, "user_id", "at", "tokens", 0.0001, 5.0).select("event_id", F.round("wait", 3).alias("wait"))


_W = ["start", "end", "event_type", "n"]


def x_tumbling(spark, sf_dir):
    return E.tumbling(events(spark, sf_dir), "1 day", ["event_type"], "value").select(*[c(x).cast("timestamp_ntz").alias(x) if x in ("start", "end") else c(x) for x in _W], F.round("total", 3).alias("total"))


def x_sliding(spark, sf_dir):
    return E.sliding(events(spark, sf_dir), "1 day", "12 hours", ["event_type"], "value").select(*[c(x).cast("timestamp_ntz").alias(x) if x in ("start", "end") else c(x) for x in _W], F.round("total", 3).alias("total"))


def x_session(spark, sf_dir):
    return E.sessions(events(spark, sf_dir), "6 hours", ["user_id"], "value").select(c("start").cast("timestamp_ntz").alias("start"), "user_id", "n", F.round("total", 3).alias("total"))


def x_watermark_late(spark, sf_dir):
    return E.late(events(spark, sf_dir).withColumn("arrival", F.pmod(c("event_id") * 7919, F.lit(10007))), "arrival", "20 DAYS", oldest="event_id").select("event_id")


def x_stream_dedupe(spark, sf_dir):
    return E.deduplicated(events(spark, sf_dir).select("ts", "event_type", (c("event_id") % 50).alias("k")), ["k", "event_type"]).select("k", "event_type")


def x_stream_tumbling(spark, sf_dir):
    """The same windows from a stream of the file, complete."""
    folder = R.shared_folder(spark)
    events(spark, sf_dir).repartition(4).write.parquet(folder)  # a stream reads folders
    stream = R.source(spark, folder, files=1)
    out = R.available_now(E.tumbling(stream, "1 day", ["event_type"], "value"), "complete")
    return out.select(*[c(x).cast("timestamp_ntz").alias(x) if x in ("start", "end") else c(x) for x in _W], F.round("total", 3).alias("total"))


#: Rows of a file, and so of a trigger: what a task of a stream holds does not grow with the events.
FILE_ROWS = 1_000_000


def _written(spark, df, files=4, folder=None):
    """The rows in files of consecutive times, written one after the other, as they would have come."""
    folder, dealt = folder or R.shared_folder(spark), R.shared_folder(spark)
    first, last, n = df.agg(F.unix_millis(F.min("ts")), F.unix_millis(F.max("ts")), F.count("*")).first()
    files = max(files, -(-n // FILE_ROWS))
    part = F.least(F.floor((F.unix_millis("ts") - first) * files / max(1, last - first)), F.lit(files - 1)).cast("int")
    df.withColumn("_part", part).write.partitionBy("_part").parquet(dealt)  # dealt once: each file reads its own rows
    parts = spark.read.schema(StructType([*df.schema, StructField("_part", IntegerType())])).parquet(dealt)
    for i in range(files):
        parts.filter(c("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    scratch.remove(dealt)
    return folder


def timed_log(spark, sf_dir):
    """The log with its times: both are of one row, so nothing is joined."""
    return log(spark, sf_dir, c("ts").cast("timestamp").alias("ts")).select("job_id", "event_id", "ts", "status")


def q_stream_queue(spark, sf_dir):
    """What bounded queues lose, by a stream with list state."""
    e = events(spark, sf_dir).select("event_type", "event_id", c("ts").cast("timestamp").alias("ts"))
    stream = R.source(spark, _written(spark, e))
    return R.available_now(T.dropped_oldest(stream, ["event_type"], ["ts", "event_id"], 100)).select("event_type", "event_id")


def q_stream_latest(spark, sf_dir):
    """The last state of every job, by a stream with value state that is stopped half way and goes on."""
    log_ = timed_log(spark, sf_dir)
    folder, half = R.shared_folder(spark), _written(spark, log_.filter("event_id % 2 = 0"))
    out = lambda: R.available_now(T.latest(R.source(spark, half), ["job_id"], ["event_id"]), folder=folder)
    out()
    _written(spark, log_.filter("event_id % 2 = 1"), 1, half)
    return S.latest_state(out().select("job_id", "event_id", "status"), "job_id", "event_id")


def q_stream_stale(spark, sf_dir):
    """Jobs whose session of event time ends, two days after their last word, while they run."""
    stream = R.source(spark, _written(spark, timed_log(spark, sf_dir)))
    return R.available_now(T.stale_to_error(stream, "job_id", "event_id", ["running"], 2 * 86_400, "1 hour"))


def q_stream_groups(spark, sf_dir):
    """Groups of 500 events that a restarted stream hands on, each once: their numbers, sizes and first events."""
    e = events(spark, sf_dir).select("event_id", c("ts").cast("timestamp").alias("ts"))
    source, folder = R.shared_folder(spark), R.shared_folder(spark)
    out = f"{folder}/groups"

    def use(groups, first, end):
        each = groups.groupBy(c("group").alias("number")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
        each.write.mode("overwrite").parquet(f"{out}/groups={first}-{end}")

    for part in range(2):
        # The second half of the events comes, in one trigger, when the stream has ended once.
        e.filter(F.floor(c("event_id") * 2 / (e.agg(F.max("event_id")).first()[0] + 1)) == part).write.mode("append").parquet(source)
        R.group_batches(R.source(spark, source, files=1_000_000), 500, "event_id", use, folder)
    return spark.read.schema("number long, n long, first long, last long").parquet(f"{out}/*").select("number", "n", "first", "last")


def q_epoch_feed(spark, sf_dir):
    """Two and a half epochs of the users in triggers of 7000 rows or less, stopped and begun again: what each epoch gave out."""
    u = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c("c_custkey"), (c("c_custkey") % 7).alias("k"))
    numbered = B.with_ordinal(u, "c_custkey")
    n = u.count()
    table, folder = written(numbered, "feed-table"), R.shared_folder(spark)

    def use(batch, i):
        batch.groupBy("epoch").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.min("step").alias("first"), F.max("step").alias("last")).write.mode("overwrite").parquet(f"{folder}/out/batch={i}")

    for steps in (n, n * 5 // 2):  # the second run goes on where the first ended
        N.run_feed(N.feed(table, max(1, min(7000, n // 3)), steps), use, folder)
    out = spark.read.schema("epoch long, n long, keys long, first long, last long").parquet(f"{folder}/out/*")
    return out.groupBy("epoch").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.min("first").alias("first"), F.max("last").alias("last"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("q_", "x_"))}

_TUMBLING = "SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS end, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL"
ORACLE = {
    "q_queue_drop_oldest": "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_type, event_id FROM r WHERE n <= 100",
    "q_queue_statistics": "SELECT event_type, count(*) AS produced, greatest(count(*) - 100, 0) AS dropped, least(count(*), 100) AS held FROM events GROUP BY event_type",
    "q_latest_state": f"WITH {LOG} SELECT job_id, max(event_id) AS event_id, arg_max(status, event_id) AS status FROM log GROUP BY job_id",
    "q_transitions": f"""WITH {LOG}, p AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY event_id) AS previous FROM log)
SELECT *, CASE WHEN previous IS NULL THEN status = 'queued' ELSE (previous = 'queued' AND status IN ('running', 'error')) OR (previous = 'running' AND status IN ('done', 'error', 'queued')) END AS valid FROM p""",
    "q_stale_jobs": f"WITH {JOBS} SELECT job_id FROM jobs WHERE status = 'running' AND created_at + 500 < 900000000 - 86400",
    "q_admission": f"WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY created_at, job_id) AS n FROM jobs) SELECT job_id, status FROM r WHERE n <= 50",
    "q_claims": f"WITH {JOBS} SELECT job_id FROM jobs WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 17",
    "q_quarantine": f"""WITH {JOBS}, j AS (SELECT job_id AS k, CAST(job_id AS VARCHAR) AS job_id, status, job_id % 5 > 0 AS started, job_id % 7 > 1 AS finished, CASE WHEN job_id % 11 = 0 THEN 'nan' WHEN job_id % 3 > 0 THEN 'ok' END AS reward, job_id % 2 = 0 AS worker FROM jobs),
r AS (SELECT job_id, concat_ws(';', CASE WHEN reward = 'nan' THEN 'reward' END, CASE WHEN status = 'running' AND NOT started THEN 'running without start' END, CASE WHEN status = 'running' AND NOT worker THEN 'running without worker' END,
  CASE WHEN status = 'running' AND finished THEN 'running but finished' END, CASE WHEN status IN ('done', 'error') AND NOT finished THEN 'finished without time' END, CASE WHEN status = 'done' AND reward IS NULL THEN 'done without reward' END) AS reasons FROM j)
SELECT * FROM r WHERE reasons <> ''""",
    "q_replay_ready": f"""WITH {LOG}, s AS (SELECT event_id, event_id % 5000 AS step, CASE WHEN status = 'done' THEN 'success' ELSE status END AS status FROM log WHERE event_id % 3 > 0 OR status <> 'running')
SELECT event_id, step FROM s WHERE status = 'success' AND step NOT IN (SELECT step FROM s WHERE status = 'running')""",
    "q_ring": "SELECT event_id % 64 AS slot, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "q_staleness": "SELECT count(*) AS held, count(*) FILTER (event_id % 10 < 9) AS stale, max(9 - event_id % 10) AS lag, count(*) >= 6000 AS paused FROM events",
    "q_mixed_sample": "SELECT positive, CAST(n AS BIGINT) AS n FROM (VALUES (true, 30), (false, 70)) v(positive, n)",
    "q_stream_queue": "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_type, event_id FROM r WHERE n > 100",
    "q_stream_latest": f"WITH {LOG} SELECT job_id, max(event_id) AS event_id, arg_max(status, event_id) AS status FROM log GROUP BY job_id",
    "q_stream_stale": f"""WITH {LOG}, t AS (SELECT job_id, log.event_id, epoch_us(ts) // 1000 AS ms, status FROM log JOIN events ON log.event_id = events.event_id),
n AS (SELECT *, lead(ms) OVER (PARTITION BY job_id ORDER BY ms, event_id) AS next, (SELECT max(ms) FROM t) - 3600000 AS mark FROM t)
SELECT job_id, event_id, ms + 172800000 AS at_ms FROM n WHERE status = 'running' AND (next IS NULL OR next > ms + 172800000) AND ms + 172800000 <= mark""",
    "q_stream_groups": "WITH g AS (SELECT event_id, event_id // 500 AS number FROM events) SELECT number, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM g GROUP BY number HAVING count(*) = 500",
    "q_epoch_feed": """WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), n AS (SELECT count(*) AS n FROM customer),
e AS (SELECT unnest(range(0, 3)) AS epoch), s AS (SELECT epoch, c_custkey, epoch * n + i AS step FROM c, n, e WHERE epoch * n + i < n * 5 // 2)
SELECT epoch, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, min(step) AS first, max(step) AS last FROM s GROUP BY epoch""",
    "x_tumbling": _TUMBLING,
    "x_stream_tumbling": _TUMBLING,
    "x_sliding": """SELECT s AS start, s + INTERVAL 1 DAY AS end, event_type, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR AS s FROM events, range(2) r(k)) GROUP BY ALL""",
    "x_session": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, user_id, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, k""",
    "x_watermark_late": """WITH a AS (SELECT event_id, ts, event_id * 7919 % 10007 AS arrival FROM events), s AS (SELECT *, max(ts) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a) SELECT event_id FROM s WHERE ts < seen - INTERVAL 20 DAY""",
    "x_stream_dedupe": "SELECT DISTINCT event_id % 50 AS k, event_type FROM events",
}

"""Job state, queues and limits over append-only event tables.

Plain tables have no update: state is a view over events, and every operator
here is one pass over a partition of them, in batch or in a stream's
``foreachBatch``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_oldest(events: DataFrame, key: list[str], order: list[str], capacity: int) -> DataFrame:
    """What a bounded first-in queue holds at the end: the newest ``capacity`` by key."""
    newest = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= capacity).drop("_n")


def queue_statistics(events: DataFrame, key: list[str], capacity: int) -> DataFrame:
    """Produced, dropped and held of a queue that is only written."""
    out = events.groupBy(*key).agg(F.count("*").alias("produced"))
    return out.select(*key, "produced", F.greatest(F.col("produced") - capacity, F.lit(0)).alias("dropped"), F.least("produced", F.lit(capacity)).cast("long").alias("held"))


def latest_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key; combines before the shuffle."""
    others = [c for c in events.columns if c not in (key, order)]
    return events.groupBy(key).agg(F.max(order).alias(order), F.max_by(F.struct(*others), order).alias("_x")).select(key, order, "_x.*")


# From which states a job may go where.
TRANSITIONS = {"queued": ["running", "error"], "running": ["done", "error", "queued"], "done": [], "error": []}


def valid_transitions(events: DataFrame, key: str, order: str, status: str = "status") -> DataFrame:
    """Add ``previous`` and ``valid``: a job starts queued and follows the allowed steps."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(order))
    table = F.create_map(*[x for a, b in TRANSITIONS.items() for x in (F.lit(a), F.array(*[F.lit(v) for v in b]).cast("array<string>"))])
    valid = F.when(F.col("previous").isNull(), F.col(status) == "queued").otherwise(F.array_contains(F.try_element_at(table, F.col("previous")), F.col(status)))
    return events.withColumn("previous", before).withColumn("valid", F.coalesce(valid, F.lit(False)))


def stale_jobs(jobs: DataFrame, now: float, age: float) -> DataFrame:
    """Running jobs whose creation and start both lie more than ``age`` seconds back."""
    return jobs.filter((F.col("status") == "running") & (F.greatest("created_at", "started_at") < now - age))


def admitted(jobs: DataFrame, queue: list[str], order: list[str], capacity: int) -> DataFrame:
    """The first ``capacity`` requests of each queue; the rest are rejected.

    ``order`` must be total within a queue.  Each task keeps its first ``capacity``
    of a queue; the last of these that is accepted is what the others are held against.
    """
    place = F.row_number().over(Window.partitionBy(*queue).orderBy(*order))
    first = jobs.select(*queue, *[c for c in order if c not in queue]).withColumn("_place", place).filter(F.col("_place") <= capacity)
    last = first.groupBy(*[F.col(c).alias(f"_{c}") for c in queue]).agg(F.max(F.struct(*order)).alias("_last"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in queue])
    return jobs.join(last, same, "left").withColumn("accepted", F.coalesce(F.struct(*order) <= F.col("_last"), F.lit(False))).select(*jobs.columns, "accepted")


def claims(jobs: DataFrame, order: list[str], running: int, most: int) -> DataFrame:
    """The queued jobs that free workers take, oldest first: a bounded top-k."""
    return jobs.filter("status = 'queued'").orderBy(*order).limit(max(0, most - running))


def invalid_reasons(jobs: DataFrame) -> Column:
    """Rules a persisted job breaks, as an array: missing or blank text, bad numbers, states that do not fit."""
    bad = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(F.col(c)) > 1e15))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    s = F.coalesce(F.col("status"), F.lit(""))
    rules = {
        "job_id": blank("job_id"), "status": ~s.isin("queued", "running", "done", "error"), "created_at": F.col("created_at").isNull() | bad("created_at"),
        "started_at": bad("started_at"), "finished_at": bad("finished_at"), "reward": bad("reward"),
        "running without start": (s == "running") & F.col("started_at").isNull(), "running without worker": (s == "running") & blank("worker_id"),
        "running but finished": (s == "running") & F.col("finished_at").isNotNull(), "finished without time": s.isin("done", "error") & F.col("finished_at").isNull(),
        "done without reward": (s == "done") & F.col("reward").isNull(),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def quarantine(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their reasons."""
    marked = jobs.withColumn("reasons", invalid_reasons(jobs))
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def replay_ready(samples: DataFrame, step: str, status: str = "status") -> DataFrame:
    """The successes of those steps in which nothing runs any more."""
    busy = samples.groupBy(step).agg(F.bool_or(F.col(status) == "running").alias("_busy")).filter("not _busy").select(step)
    return samples.filter(F.col(status) == "success").join(busy, step, "left_semi")


def mixed_sample(samples: DataFrame, positive: Column, size: int, share: float, key: str, seed: int = 0) -> DataFrame:
    """``size`` rows with a share of positives; what one side lacks the other fills."""
    ordered = F.xxhash64(F.lit(seed), key)
    counts = samples.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).first()
    wanted = min(int(size * share), counts["p"])
    others = min(size - wanted, counts["n"])
    wanted = min(size - others, counts["p"])
    return samples.filter(positive).orderBy(ordered, key).limit(wanted).unionByName(samples.filter(~positive).orderBy(ordered, key).limit(others))


def ring(events: DataFrame, order: str, capacity: int) -> DataFrame:
    """A circular buffer: slot = place % capacity, the last writer of a slot stays.

    ``place`` must count from 0 without gaps.
    """
    slot = F.pmod(F.col(order), F.lit(capacity))
    return events.groupBy(slot.alias("slot")).agg(F.max_by(F.struct(*events.columns), order).alias("_x")).select("slot", "_x.*")


def staleness(samples: DataFrame, version: int, threshold: float, required: int, sync: int) -> DataFrame:
    """Samples by the versions they lag behind, and whether production must pause."""
    most = int(required * (1 + threshold) * sync)
    out = samples.agg(F.count("*").alias("held"), F.count_if(F.col("version") < version).alias("stale"), F.max(F.lit(version) - F.col("version")).alias("lag"))
    return out.withColumn("paused", F.col("held") >= most)


def token_bucket(requests: DataFrame, key: str, time: str, tokens: str, rate: float, most: float) -> DataFrame:
    """Add ``wait``: how long each request waits for a bucket that refills continuously.

    A request beyond the bucket's size runs it into debt.  Requests of one key
    follow each other by time and wait in line; each key is folded apart.
    """
    import pyarrow as pa

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        level, last, waits = most, None, []
        for at, n in zip(table.column(time).to_pylist(), table.column(tokens).to_pylist()):
            now = at if last is None else max(at, last)
            level = min(most, level + (0.0 if last is None else (now - last) * rate))
            wait = max(0.0, (n - level) / rate)
            if n <= most and wait > 0:  # it sleeps until the tokens are there
                now, level = now + wait, n
            level -= n
            last = now
            waits.append(float(now - at if n <= most else now - at + wait))
        return table.append_column("wait", pa.array(waits, pa.float64()))

    return requests.groupBy(key).applyInArrow(run, f"{fields}, wait double")

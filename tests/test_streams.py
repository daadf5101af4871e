"""Streams with state: equal to a batch however rows come, also after a stop and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.streaming import epochs, run, state, stateful


def _log(spark, n=300):
    rng = random.Random(4)
    rows, at = [], 1_700_000_000_000
    for i in range(n):
        at += rng.randrange(0, 40_000)
        rows.append((rng.choice("aab" if i % 3 else "cde") if i % 11 else None, i, at, rng.choice(("queued", "running", "done"))))
    return spark.createDataFrame(rows, "job string, id long, ms long, status string").select("job", "id", F.timestamp_millis("ms").alias("ts"), "status")


def _put(df, folder, parts):
    for i in range(parts):
        df.filter(F.floor(F.col("id") * parts / 300) == i).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("capacity", [1, 7, 1000])
def test_bounded_queue_equals_batch_after_restart(spark, tmp_path, capacity):
    log, source, folder = _log(spark), f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    _put(log.filter("id % 2 = 0"), source, 2)
    out = lambda: run.available_now(stateful.dropped_oldest(run.source(spark, source), ["job"], ["ts", "id"], capacity), folder=folder)
    out()
    _put(log.filter("id % 2 = 1"), source, 2)
    held = state.drop_oldest(log, ["job"], ["ts", "id"], capacity)
    want = log.join(held.select("id"), "id", "left_anti").select("job", "id", "ts", "status").collect()
    assert sorted(map(str, out().collect())) == sorted(map(str, want))
    assert sorted(map(str, out().collect())) == sorted(map(str, want))  # nothing new: nothing more


def test_latest_equals_batch(spark, tmp_path):
    log, source = _log(spark), f"file://{tmp_path}/in"
    _put(log, source, 3)
    found = run.available_now(stateful.latest(run.source(spark, source), ["job"], ["ts", "id"]))
    last = {r.job: r.id for r in sorted(found.collect(), key=lambda r: (r.ts, r.id))}
    assert last == {r.job: r.id for r in log.orderBy("ts", "id").collect()}


def test_stale_jobs_by_timers(spark, tmp_path):
    log, source, folder = _log(spark), f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    rows = [(r.job, r.id, r.ms, r.status) for r in log.withColumn("ms", F.unix_millis("ts")).collect()]
    age, mark = 100_000, max(r[2] for r in rows) - 60_000
    want = set()
    for job, i, ms, status in rows:
        later = [r for r in rows if r[0] == job and (r[2], r[1]) > (ms, i)]
        if status == "running" and ms + age <= mark and not any(r[2] <= ms + age for r in later):
            want.add((job, i, ms + age))
    assert len(want) > 5
    found = None
    for part in range(3):  # a restart before each part
        log.filter(F.floor(F.col("id") * 3 / 300) == part).coalesce(1).write.mode("append").parquet(source)
        found = run.available_now(stateful.stale_to_error(run.source(spark, source), "job", "id", ["running"], 100, "60 seconds"), folder=folder)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_stale_jobs_at_the_edges(spark, tmp_path):
    t = 1_700_000_000_000
    rows = [
        ("a", 1, t, "running"), ("a", 2, t + 100_000, "done"),  # a word just in time
        ("b", 3, t, "running"), ("b", 4, t + 100_001, "done"),  # too late by a millisecond
        ("c", 5, t, "done"), ("c", 6, t, "running"), ("d", 7, t, "running"), ("d", 8, t, "done"),  # one time: by id
        ("e", 9, t + 300_000, "running"), ("f", 10, t + 300_001, "running"),  # the watermark is at t + 400_000
        ("g", 11, t, None), ("g", 12, t + 200_000, "running"), (None, 13, t, "running"), ("h", 14, t + 460_000, "done"),
    ]
    log = spark.createDataFrame(rows, "job string, id long, ms long, status string").select("job", "id", F.timestamp_millis("ms").alias("ts"), "status")
    for parts in (1, 3):
        source = f"file://{tmp_path}/{parts}"
        for i in range(parts):
            log.orderBy("ts").filter(F.floor((F.unix_millis("ts") - t) * parts / 460_001) == i).coalesce(1).write.mode("append").parquet(source)
        found = run.available_now(stateful.stale_to_error(run.source(spark, source), "job", "id", ["running"], 100, "60 seconds"))
        want = {("b", 3, t + 100_000), ("c", 6, t + 100_000), ("e", 9, t + 400_000), ("g", 12, t + 300_000), (None, 13, t + 100_000)}
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_stale_jobs_keep_no_rows_of_a_key_in_python(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    _put(_log(spark), source, 1)
    plan = stateful.stale_to_error(run.source(spark, source), "job", "id", ["running"], 100, "60 seconds")._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "session_window" in plan


def test_the_session_keeps_its_state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), run.state_store(spark):
        assert spark.conf.get(name) == run.STORE
        raise ZeroDivisionError
    assert spark.conf.get(name) == before


def test_groups_are_used_once_over_failures_and_restarts(spark, tmp_path):
    log, source, folder = _log(spark), f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    _put(log.filter("id < 200"), source, 2)
    used: dict[int, list] = {}
    fail = {1, 3}

    def use(group, n):
        if n in fail:
            fail.discard(n)
            raise RuntimeError("the driver is killed here")
        used.setdefault(n, []).append(sorted(r.id for r in group.collect()))

    for _ in range(2):
        with pytest.raises(Exception):
            run.micro_batches(run.source(spark, source), 40, "id", use, folder)
    run.micro_batches(run.source(spark, source), 40, "id", use, folder)
    assert {n: x[0] for n, x in used.items()} == {n: list(range(n * 40, n * 40 + 40)) for n in range(5)}
    _put(log.filter("id >= 200"), source, 2)
    run.micro_batches(run.source(spark, source), 40, ["status", "id"], use, folder)
    assert sorted(used) == list(range(7)) and all(len(x) == 1 and len(x[0]) == 40 for x in used.values())
    assert len({i for x in used.values() for i in x[0]}) == 280


def test_sinks_get_each_batch_once(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    _put(_log(spark), source, 2)
    got, broken = ([], []), [True]

    def second(batch, epoch):
        if broken and epoch == 1:
            broken.clear()
            raise RuntimeError
        got[1].extend(r.id for r in batch.collect())

    sinks = [lambda b, n: got[0].extend(r.id for r in b.collect()), second]
    with pytest.raises(Exception):
        run.fan_out(run.source(spark, source), sinks, folder)
    run.fan_out(run.source(spark, source), sinks, folder)
    assert sorted(got[0]) == sorted(got[1]) == list(range(300))


@pytest.mark.parametrize("shuffle", [False, True])
def test_a_feed_of_two_and_a_half_epochs_with_restart(spark, tmp_path, shuffle):
    table = spark.range(10).select(F.col("id").alias("row_id"), (F.col("id") * 100).alias("v"))
    got, sizes = [], []

    def use(batch, i):
        rows = batch.collect()
        sizes.append(len(rows))
        got.extend((r.step, r.epoch, r.v) for r in rows)

    folder = f"file://{tmp_path}/run"
    for steps in (13, 25, 25):  # stopped in the second epoch; the last has nothing to do
        epochs.run_feed(epochs.feed(table, 4, steps, shuffle), use, folder)
    got.sort()
    assert [x[:2] for x in got] == [(i, i // 10) for i in range(25)]
    orders = [[v for _, e, v in got if e == epoch] for epoch in range(3)]
    assert all(sorted(x) == [i * 100 for i in range(10)] for x in orders[:2]) and len(set(orders[2])) == 5
    assert (orders[0] == sorted(orders[0])) is not shuffle
    assert max(sizes) == 4 and sum(sizes) == 25
    epochs.run_feed(epochs.feed(table.limit(0), 4, 25), lambda b, i: sizes.append(b.count()))
    assert sum(sizes) == 25

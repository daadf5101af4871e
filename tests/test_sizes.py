"""What a query holds at once, and what its results are, on tables larger than the samples."""

from pyspark.sql import functions as F

from quillon.operators import cells
from quillon.sources import workbook_source


def _tables(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


def test_blocks_of_the_lexical_index_are_in_small_row_groups(spark):
    import pyarrow.parquet as pq

    from quillon.llm import lexical

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: F.hex(F.xxhash64("id", i))), " ")
    blocks = lexical.index(spark.range(0, 320, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")))
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in blocks.inputFiles()]
    assert sum(f.metadata.num_rows for f in files) == 5
    assert sum(f.metadata.num_row_groups for f in files) > 1


def test_ranges_are_sent_to_the_cells(spark):
    grid = spark.range(100).select(F.lit("f").alias("file"), F.lit("s").alias("sheet"), F.col("id").cast("int").alias("row"), F.lit(1).alias("col"))
    targets = spark.createDataFrame([(1, "f", "s", 3, 1, 5, 1)], "task_id int, file string, sheet string, min_row int, min_col int, max_row int, max_col int")
    found = cells.in_range(grid, targets)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert sorted(r.row for r in found.collect()) == [3, 4, 5]


def test_column_names_go_on_after_zzz(spark, tmp_path):
    from quillon.plans.cells import q_col_letters

    orders = spark.createDataFrame([(i - 1,) for i in (1, 702, 703, 18278, 18279, 35854, 35855, 900_000)], "o_orderkey long")
    got = {r.n: (r.name, r.back) for r in q_col_letters(spark, _tables(tmp_path, orders=orders)).collect()}
    assert {n: x[0] for n, x in got.items()} == {1: "A", 702: "ZZ", 703: "AAA", 18278: "ZZZ", 18279: "AAA", 35854: "ZZZ", 35855: "AAA", 900_000: got[900_000][0]}
    assert all(back == n for n, (_, back) in got.items())


def test_rows_beyond_a_sheet_are_read(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook_source.workbook_bytes({"S": [(1, 1, 5.0), (1_048_576, 1, 6.0), (1_200_000, 1, 7.0)]}, {}))
    workbook_source.register(spark)
    rows = lambda where: [r.num for r in spark.read.format("workbook").load(str(tmp_path)).filter(where).orderBy("row").collect()]
    assert rows("true") == [5.0, 6.0, 7.0] and rows("row >= 3") == [6.0, 7.0] and rows("row < 1200000") == [5.0, 6.0]


def test_groups_of_a_trigger_are_used_together(spark, tmp_path):
    from quillon.streaming import run

    source, folder, calls, got = f"file://{tmp_path}/in", f"file://{tmp_path}/run", [], {}

    def use(groups, first, end):
        calls.append((first, end))
        if len(calls) == 2:
            raise RuntimeError("the driver is killed here")
        for r in groups.collect():
            got.setdefault(r.group, []).append(r.id)

    go = lambda: run.group_batches(run.source(spark, source, files=100), 7, "id", use, folder)
    spark.range(0, 1000, 1, 3).write.parquet(source)
    go()
    spark.range(1000, 2000, 1, 3).write.mode("append").parquet(source)
    try:
        go()
    except Exception:
        go()
    go()
    assert calls == [(0, 142), (142, 285), (142, 285)]
    assert {n: sorted(x) for n, x in got.items()} == {n: list(range(n * 7, n * 7 + 7)) for n in range(285)}


def test_a_feed_does_not_send_its_table(spark, tmp_path):
    from quillon.streaming import epochs

    table = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") * 3).alias("v"))
    plans, got = [], []

    def use(batch, i):
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        got.extend((r.step, r.epoch, r.v) for r in batch.collect())

    for shuffle in (False, True):
        epochs.run_feed(epochs.feed(table, 4000, 7000, shuffle), use, f"file://{tmp_path}/{shuffle}")
        got.sort()
        assert [x[:2] for x in got] == [(i, i // 5000) for i in range(7000)] and sorted(x[2] for x in got[:5000]) == [i * 3 for i in range(5000)]
        got.clear()
    assert plans


def test_files_of_a_stream_are_bounded(spark, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from quillon.plans import streaming

    monkeypatch.setattr(streaming, "FILE_ROWS", 100)
    df = spark.range(1000).select("id", F.timestamp_millis(F.col("id") * 1000).alias("ts"))
    folder = streaming._written(spark, df)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{folder.removeprefix('file://')}/*.parquet")]
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) <= 110
    plan = streaming.timed_log(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_draws_find_their_rows_in_order(spark):
    from quillon.operators import grouped

    df = spark.range(3000).select(F.col("id").alias("i"), F.when(F.col("id") % 7 > 0, (F.col("id") % 5).cast("double")).alias("s"))
    drawn = grouped.resample_by_score(df, "s", "i", seed=5)
    plan = drawn._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan  # no rows of a bucket against its draws
    got = [tuple(r) for r in drawn.collect()]
    assert sorted(x[0] for x in got) == list(range(3000)) and all(s for _, _, s in got)
    assert abs(sum(s == 4 for _, _, s in got) - 1200) < 120


def test_greedy_parts_of_many_batches_in_one_pass(spark):
    from quillon.operators import ranking

    df = spark.range(50_000).select((F.col("id") % 12_345).alias("b"), F.col("id").alias("i"), (F.col("id") * 7 % 11).alias("n"))
    parts = ranking.greedy_partition(df, "b", "i", "n", 3)
    assert "FlatMapGroups" not in parts._jdf.queryExecution().sparkPlan().toString()
    want, sums = {}, {}
    for i in range(50_000):
        own = sums.setdefault(i % 12_345, [0, 0, 0])
        want[i] = own.index(min(own))
        own[want[i]] += i * 7 % 11
    assert {r.i: r.part for r in parts.collect()} == want
    try:
        ranking.greedy_partition(df.filter("b < 2"), "b", "i", "n", 3, True).collect()
        raise AssertionError
    except Exception as e:
        assert "rows do not divide into 3 parts" in str(e)


def test_groups_of_ranges_are_dealt_by_their_number(spark, monkeypatch):
    from quillon.operators import ranking

    monkeypatch.setattr(ranking, "TASK_ROWS", 50)
    df = spark.range(1000).select((F.col("id") % 100).alias("g"), F.col("id").alias("f"), (F.col("id") + F.col("id") % 3 * 60).alias("l"))
    out = ranking.merge_intervals(df, ["g"], "f", "l")
    plan = out._jdf.queryExecution()
    assert "RepartitionByExpression" in plan.optimizedPlan().toString() and ", 20)" in plan.sparkPlan().toString()
    want = []
    for g in range(100):
        at = [(i, i + i % 3 * 60) for i in range(g, 1000, 100)]
        own = [list(at[0])]
        for f, last in at[1:]:
            if f <= own[-1][1] + 1:
                own[-1][1] = max(own[-1][1], last)
            else:
                own.append([f, last])
        want += [(g, *x) for x in own]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_a_first_block_of_products_brings_no_more_pairs():
    import numpy as np

    from quillon.operators.retrieval import _Best

    best, seen = _Best(3, 2), []
    scores = np.random.default_rng(1).normal(size=(3, 500))
    inner = np.lexsort

    def counted(keys):
        seen.append(len(keys[0]))
        return inner(keys)

    np.lexsort = counted
    try:
        best.take(scores, np.arange(500))
    finally:
        np.lexsort = inner
    assert seen == [6]
    assert {(int(q), int(v)) for q, v in zip(best.q, best.vec)} == {(q, int(v)) for q in range(3) for v in np.argsort(-scores[q])[:2]}


def test_late_events_do_not_depend_on_the_order_of_rows(spark):
    from quillon.streaming import events

    df = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 86_400).alias("ts"), F.lit(1).alias("arrival"))
    for rows in (df, df.orderBy(F.col("event_id").desc())):
        assert events.late(rows.coalesce(1), "arrival", "20 DAYS", "event_id").count() == 179


def test_events_that_arrive_together_come_by_their_ids(spark, tmp_path):
    from quillon.plans.streaming import x_watermark_late

    rows = [(0, 0), (10_007, 30), (20_014, 5)]  # all of arrival 0
    events = spark.createDataFrame(rows, "event_id long, day int").select("event_id", F.timestamp_seconds(F.col("day") * 86_400).alias("ts"), F.lit(1).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    assert [r.event_id for r in x_watermark_late(spark, _tables(tmp_path, events=events)).collect()] == [20_014]


def test_a_long_list_of_ranges_is_scanned_in_one_pass(spark):
    # Ranges of one cell far apart: each is a scan.  As one row the list was copied with each of them.
    n = 60_000
    df = spark.range(n).select(F.lit("t").alias("task_id"), F.lit("f").alias("file"), F.lit("s").alias("sheet"), F.col("id").cast("int").alias("range_idx"),
        *[(F.col("id") * 2000 + 1).alias(x) for x in ("min_row", "max_row")], *[F.lit(1).alias(x) for x in ("min_col", "max_col")])
    scans = cells.scan_groups(df.repartition(3))
    assert "collect_list" not in scans._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.scan, r.first, r["last"], r.min_row) for r in scans.collect())
    assert got == [(i, i, i, i * 2000 + 1) for i in range(n)]


def test_scans_over_batches_and_nulls(spark):
    rows = [("a", i, 1, 1, 5, 2) for i in range(50)] + [(None, 1, 1, 1, 1, 1), (None, 2, None, 1, 2, 2), (None, None, 1, 1, 1, 1), ("b", 1, 1, 1, 1, 1), ("b", 2, 3, 1, 3, 1), ("b", 4, 4, 1, 4, 1)]
    names = "task_id string, range_idx int, min_row int, min_col int, max_row int, max_col int"
    df = spark.createDataFrame(rows, names).withColumns({"file": F.lit("f"), "sheet": F.lit("s")})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r) for r in cells.scan_groups(df).drop("file", "sheet").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {
        ("a", 0, 0, 49, 1, 1, 5, 2), (None, 0, None, None, 1, 1, 1, 1), (None, 1, 1, 2, 1, 1, 2, 2),
        ("b", 0, 1, 2, 1, 1, 3, 1), ("b", 1, 4, 4, 4, 1, 4, 1),
    }


def test_a_workbook_of_many_tables_is_read(spark, tmp_path):
    tables = [("table", f"T{i}", f"A{i}:B{i}") for i in range(1, 10_101)]
    (tmp_path / "a.xlsx").write_bytes(workbook_source.workbook_bytes({"S": [(1, 1, 5.0)]}, {"S": tables}))
    workbook_source.register(spark)
    rows = spark.read.format("workbook").load(str(tmp_path)).collect()
    assert [(r.num, r.error) for r in rows] == [(5.0, None)]

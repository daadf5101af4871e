"""Pages, top-k, queues, quotas, intervals and balanced partitions."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, offset: int, n: int) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` of an order; Spark keeps only the leading rows of each task."""
    return df.orderBy(*order).offset(offset).limit(n)


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def claim_oldest(jobs: DataFrame) -> DataFrame:
    """The queued job that was created first."""
    return jobs.filter("status = 'queued'").agg(F.min(F.struct("created_at", "job_id")).alias("x")).select("x.job_id", "x.created_at").filter("job_id is not null")


def next_pending(tasks: DataFrame, done: DataFrame, key: str, who: list[str], order: list[str]) -> DataFrame:
    """For each of ``who`` the first task by ``order`` that is not in ``done(key)``, where one is left."""
    left = tasks.join(done.select(key).distinct(), key, "left_anti")
    first = F.min_by(F.struct(*[c for c in tasks.columns if c not in who]), F.struct(*order))
    return left.groupBy(*who).agg(first.alias("_x")).select(*who, "_x.*")


def cleanup_batch(jobs: DataFrame, cutoff: float, size: int, retry_share: float, now: float) -> DataFrame:
    """Finished jobs to clean: a share of retries first, then fresh ones, then what is left of either.

    Both kinds are cut to the batch size before they are ranked together.
    """
    done = jobs.filter(F.col("status").isin("done", "error") & (F.greatest("finished_at", "created_at") < cutoff))
    kind = F.when(F.col("attempts") > 0, F.when(F.col("next_retry") <= now, "retry")).otherwise("fresh")
    heads = top_k_per_group(done.withColumn("kind", kind).filter("kind is not null"), ["kind"], ["finished_at", "job_id"], size)
    share = int(size * retry_share)
    turn = F.when(F.col("kind") == "retry", F.when(F.col("rank") <= share, 0).otherwise(2)).otherwise(1)
    ordered = heads.withColumn("turn", turn).orderBy("turn", "rank", "job_id").limit(size)
    return ordered.select("job_id", "kind", "finished_at")


def round_robin_quota(df: DataFrame, group: str, order: str, total: int) -> DataFrame:
    """``total`` rows dealt in turns over the groups, each capped by its size."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("turn", turn).filter(F.col("turn") <= total).orderBy("turn", group).limit(total)


#: Rows that a task sorts, about, where groups are dealt by their number.
TASK_ROWS = 1_000_000


def merge_intervals(df: DataFrame, group: list[str], first: str, last: str) -> DataFrame:
    """Overlapping or touching integer ranges as one.

    Groups are dealt to as many tasks as the ranges ask for, so that none sorts more of them as they grow.
    """
    tasks = -(-df.count() // TASK_ROWS)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if tasks > least:
        df = df.repartition(tasks, *group)
    w = Window.partitionBy(*group).orderBy(first, last)
    reach = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = df.withColumn("_new", F.when(F.col(first) > reach + 1, 1).otherwise(F.when(reach.isNull(), 1).otherwise(0)))
    islands = starts.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*group, "_island").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_island")


def dedupe_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key; minima combine before the shuffle."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("_x")).select(*key, "_x.*")


def backoff(base: float, most: float, attempts: Column) -> Column:
    """``min(most, base * 2 ** min(attempts, 10))``"""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempts, F.lit(10))))


#: Rows of a batch that one task takes: a training step's, not a corpus.
BATCH_ROWS = 1_000_000


def in_order(table, key: str):
    """The rows of one batch by key; more than a batch may have are an error, not a task that dies."""
    if len(table) > BATCH_ROWS:
        raise ValueError(f"a batch of {len(table)} rows: at most {BATCH_ROWS} are balanced together")
    return table.sort_by(key)


def _balanced(sizes: list[int], k: int) -> list[int]:
    """Largest differencing: partition of each size; the two widest spreads are merged until one is left."""
    heap = [(-s, i, [[s, [i]]] + [[0, []] for _ in range(k - 1)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # The greatest part of one goes with the least of the other.
        merged = sorted(([x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b))), key=lambda p: -p[0])
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), i, merged))
    out = [0] * len(sizes)
    for part, (_, members) in enumerate(heap[0][2] if heap else []):
        for i in members:
            out[i] = part
    return out


def balance(df: DataFrame, batch: str, key: str, size: str, k: int) -> DataFrame:
    """Add ``part``: each batch's rows in k parts of nearly equal sum.

    A batch is a training step's rows and bounded; batches are balanced apart.
    """
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        table = in_order(table, key)
        return table.append_column("part", pa.array(_balanced(table.column(size).to_pylist(), k), pa.int32()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(batch, key, size).schema)
    return df.select(batch, key, size).groupBy(batch).applyInArrow(run, f"{fields}, part int")


def balance_groups(df: DataFrame, batch: str, group: str, size: str, k: int) -> DataFrame:
    """Add ``part``, rows of one group together: group sums are balanced."""
    sums = df.groupBy(batch, group).agg(F.sum(size).alias("_s"))
    parts = balance(sums, batch, group, "_s", k).drop("_s")
    return df.join(parts, [batch, group])


def micro_batches(df: DataFrame, batch: str, key: str, size: str, budget: int) -> DataFrame:
    """Add ``micro``: as many micro-batches as the budget asks for, balanced by size,
    numbered from light to heavy."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        table = in_order(table, key)
        sizes = table.column(size).to_pylist()
        k = max(1, -(-sum(sizes) // budget))
        part = _balanced(sizes, min(k, len(sizes)))
        sums: dict[int, int] = {}
        for p, s in zip(part, sizes):
            sums[p] = sums.get(p, 0) + s
        order = {p: i for i, p in enumerate(sorted(sums, key=lambda p: (sums[p], p)))}
        return table.append_column("micro", pa.array([order[p] for p in part], pa.int32()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(batch, key, size).schema)
    return df.select(batch, key, size).groupBy(batch).applyInArrow(run, f"{fields}, micro int")


def greedy_partition(df: DataFrame, batch: str, key: str, size: str, k: int, equal: bool = False) -> DataFrame:
    """Add ``part``: each batch's rows, by key, go one after the other to the lightest part.

    ``equal`` gives every part as many rows.  A task goes through its batches in order, many or
    large ones alike, and holds the k sums of one.
    """
    import pyarrow as pa

    def run(tables):
        now, rows, open_ = None, None, []  # no batch yet

        def end() -> None:
            if equal and rows is not None and rows % k:
                raise ValueError(f"{rows} rows do not divide into {k} parts")

        for table in tables:
            out = []
            for b, n in zip(table.column(0).to_pylist(), table.column(2).to_pylist()):
                if rows is None or b != now:
                    end()
                    # The lightest part comes first; where parts are to be equal, one with fewer rows before that.
                    now, rows, open_ = b, 0, [(0, 0, p) for p in range(k)]
                own, total, p = open_[0]
                heapq.heapreplace(open_, (own + equal, total + n, p))
                out.append(p)
                rows += 1
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(out, pa.int32())], [*table.schema.names, "part"])
        end()

    rows = df.select(batch, key, size)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(batch).sortWithinPartitions(batch, key).mapInArrow(run, f"{fields}, part int")


def inverse_permutation(permutation: DataFrame) -> DataFrame:
    """``row_id, new_id`` the other way round."""
    return permutation.select(F.col("new_id").alias("row_id"), F.col("row_id").alias("new_id"))


def rank_balanced_order(df: DataFrame, batch: str, key: str, size: str, ranks: int) -> DataFrame:
    """Add ``part`` and ``place``: rows of a batch so ordered that equal runs, one a rank, have nearly equal sums."""
    dealt = balance(df, batch, key, size, ranks)
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy(batch).orderBy("part", key)) - 1)

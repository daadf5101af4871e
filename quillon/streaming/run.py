"""Run a stream over what there is and read its result."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import scratch


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{scratch.root(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files at ``path``, a bounded number at a time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


#: Keyed state with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def available_now(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process what is there, to the end, and return the written rows.

    ``append`` writes Parquet; windows still open at the end stay unwritten.
    ``complete`` keeps the last whole result.  With a ``folder`` that an earlier call
    had, the stream goes on where that one ended, or was stopped, and all rows are returned.
    """
    spark = stream.sparkSession
    root = folder or shared_folder(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    with state_store(spark):
        if mode == "append":
            writer.format("parquet").option("path", f"{root}/out").outputMode("append").start().awaitTermination()
        else:
            # Each batch has the whole result: the last one replaces what is there.
            def replace(batch: DataFrame, _: int) -> None:
                batch.write.mode("overwrite").parquet(f"{root}/out")

            writer.foreachBatch(replace).outputMode("complete").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end at ``path``."""
    try:
        return not spark.read.schema("mark long").parquet(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def _mark(spark: SparkSession, path: str) -> None:
    spark.range(1).select(F.col("id").alias("mark")).coalesce(1).write.mode("overwrite").parquet(path)


class Ledger:
    """What the epochs of a stream have done, in a folder: a restart neither loses nor repeats a step.

    Spark runs the epoch that it had not finished again, with the same rows; each step
    of an epoch that is marked is left out then.  A step that ends before its mark is
    written runs twice: it gets its number, by which a sink can tell.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def once(self, epoch: int, step: str, action: Callable[[], None]) -> None:
        mark = f"{self.folder}/marks/{epoch}-{step}"
        if not _there(self.spark, mark):
            action()
            _mark(self.spark, mark)

    def table(self, epoch: int, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of an epoch, written by its first run and read by the others."""
        path = f"{self.folder}/{name}-{epoch}"
        df = make()
        self.once(epoch, name, lambda: df.write.mode("overwrite").parquet(path))
        return self.spark.read.schema(df.schema).parquet(path)


def micro_batches(stream: DataFrame, size: int, order: str | list[str], use: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    """Call ``use(batch, n)`` for every full group of ``size`` rows, by order within what has come.

    Groups are numbered from 0.  Rows short of a group wait in a written table for
    the next trigger; only what is short of one when the stream ends is left out.
    With a ``folder`` that an earlier call had, all goes on where that one ended or
    was stopped: rows that wait are kept, numbers go on, and a group that was used
    is not used again (one whose use had ended but was not yet marked is, with its number).

    Each group takes some jobs of its own; where there are many, see ``group_batches``.
    """

    def each(ledger: Ledger, epoch: int, kept: DataFrame, base: int, end: int) -> None:
        for n in range(base, end):
            ledger.once(epoch, f"use-{n}", lambda n=n: use(kept.filter(F.col("_n") == n).drop("_n"), n))

    _grouped(stream, size, order, each, folder, ["_n"])


def group_batches(stream: DataFrame, size: int, order: str | list[str], use: Callable[[DataFrame, int, int], None], folder: str | None = None) -> None:
    """The groups of ``micro_batches``, all that a trigger fills at once: ``use(rows, first, end)``.

    ``rows`` has the column ``group``, which runs from ``first`` to before ``end``; a trigger that
    fills no group hands on no rows.  Restarts are as there, by trigger instead of by group.
    """

    def each(ledger: Ledger, epoch: int, kept: DataFrame, base: int, end: int) -> None:
        ledger.once(epoch, "use", lambda: use(kept.filter(F.col("_n") < end).withColumnRenamed("_n", "group"), base, end))

    _grouped(stream, size, order, each, folder, [])


def _grouped(stream: DataFrame, size: int, order: str | list[str], each: Callable[[Ledger, int, DataFrame, int, int], None], folder: str | None, by: list[str]) -> None:
    """Number the groups of each trigger in a written table (in folders ``by``) and give it to ``each``."""
    from quillon.operators.batch import with_ordinal

    spark = stream.sparkSession
    root = folder or shared_folder(spark)
    ledger = Ledger(spark, root)
    order = [order] if isinstance(order, str) else order

    def assemble(batch: DataFrame, epoch: int) -> None:
        kind, path = batch.schema.add("_n", "long"), f"{root}/grouped-{epoch}"
        base = spark.read.schema("n long").parquet(f"{root}/next-{epoch - 1}").first().n if epoch else 0

        def group() -> None:
            rows = batch
            if epoch:  # the short last group of the epoch before has the next number
                left = spark.read.schema(kind).parquet(f"{root}/grouped-{epoch - 1}").filter(F.col("_n") == base)
                rows = batch.unionByName(left.drop("_n"))
            numbered = with_ordinal(rows, *order).withColumn("_n", F.floor(F.col("row_id") / size) + base).drop("row_id")
            numbered.write.mode("overwrite").partitionBy(*by).parquet(path)

        ledger.once(epoch, "grouped", group)
        kept = spark.read.schema(kind).parquet(path)
        end = base + kept.count() // size
        ledger.table(epoch, "next", lambda: spark.createDataFrame([(end,)], "n long"))
        scratch.remove(f"{root}/grouped-{epoch - 1}")
        each(ledger, epoch, kept, base, end)

    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(assemble).start().awaitTermination()


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], folder: str | None = None) -> None:
    """The same batches to several sinks, each computed once and given to each sink once, restarts included."""
    spark = stream.sparkSession
    root = folder or shared_folder(spark)
    ledger = Ledger(spark, root)

    def each(batch: DataFrame, epoch: int) -> None:
        same = ledger.table(epoch, "batch", lambda: batch)
        for i, sink in enumerate(sinks):
            ledger.once(epoch, f"sink-{i}", lambda sink=sink: sink(same, epoch))

    stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()

"""A table as a stream that begins again when it ends, until a number of rows is out.

The source says only which rows are next: its offset is (epoch, row), its rows are
runs of ordinals.  The runs of a trigger, one or two, are sent to the table, where the
rows find theirs, so a trigger of any size is work for all tasks and none sends the
table anywhere; a restart goes on after the last offset.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from quillon.operators.batch import ROW
from quillon.streaming.run import shared_folder


class _Runs(SimpleDataSourceStreamReader):
    def __init__(self, rows: int, each: int, steps: int):
        self.rows, self.each, self.steps = rows, each, steps

    def initialOffset(self) -> dict:
        return {"epoch": 0, "row": 0}

    def _out(self, offset: dict) -> int:
        return offset["epoch"] * self.rows + offset["row"]

    def _offset(self, out: int) -> dict:
        epoch, row = divmod(out, self.rows) if self.rows else (0, 0)
        return {"epoch": epoch, "row": row}

    def read(self, start: dict):
        end = min(self._out(start) + self.each, self.steps if self.rows else 0)
        return self.readBetweenOffsets(start, self._offset(end)), self._offset(end)

    def readBetweenOffsets(self, start: dict, end: dict):
        first, last, out = self._out(start), self._out(end), []
        while first < last:  # a run for each epoch that the trigger has rows of
            epoch, row = divmod(first, self.rows)
            n = min(last - first, self.rows - row)
            out.append((epoch, row, row + n - 1, first))
            first += n
        return iter(out)


class EpochSource(DataSource):
    """Options: ``rows`` of the table, ``rowsPerTrigger``, ``steps`` (rows in all)."""

    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self) -> str:
        return "epoch long, first long, last long, step long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Runs(int(self.options["rows"]), int(self.options["rowspertrigger"]), int(self.options["steps"]))


def feed(table: DataFrame, rows_per_trigger: int, steps: int, shuffle: bool = False) -> DataFrame:
    """A stream of ``steps`` rows of ``table(row_id, ...)``, epoch after epoch, with ``epoch`` and ``step`` (from 0).

    ``row_id`` counts from 0 without gaps.  ``shuffle`` takes the rows of each epoch in
    another order, the same in every run: a step of fixed width around the table.
    """
    spark = table.sparkSession
    n = table.count()
    spark.dataSource.register(EpochSource)
    runs = spark.readStream.format("epochs").options(rows=n, rowsPerTrigger=rows_per_trigger, steps=steps).load()
    at = F.col(ROW)
    if shuffle and n > 1:
        width = next(w for w in range(int(n * 0.618) + 1, 2 * n + 2) if gcd(w, n) == 1)
        # The row at place i of an epoch is i * width + its start, modulo n: so it has that place.
        at = F.pmod((at - F.xxhash64("epoch") % n) * pow(width, -1, n), F.lit(n))
    others = [c for c in table.columns if c != ROW]
    found = table.join(F.broadcast(runs), at.between(F.col("first"), F.col("last")))
    return found.select(ROW, "epoch", (F.col("step") + at - F.col("first")).alias("step"), *others)


def run_feed(stream: DataFrame, use: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    """Give each trigger's rows to ``use(batch, epoch_id)`` until the feed ends; with a
    ``folder`` that an earlier call had it goes on after what that one finished."""
    spark: SparkSession = stream.sparkSession
    root = folder or shared_folder(spark)
    query = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(use).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()

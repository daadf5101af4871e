"""Keyed state in streams: bounded queues, the latest row of a key, jobs that go stale.

State is the state store's, one key at a time and bounded by what each operator
says; a restart goes on from the checkpoint.  Results do not depend on how rows
are dealt to triggers, as long as none is later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, TimestampType


def _place(order: list[str]):
    """A sort key of rows: null before anything else."""
    return lambda row: tuple((row[c] is not None, row[c]) for c in order)


def _plain(df: DataFrame, key: list[str]) -> DataFrame:
    """Key columns first, and times as microseconds: rows and state hand them to Python in different zones."""
    columns = [*key, *[c for c in df.columns if c not in key]]
    return df.select(*[F.unix_micros(c).alias(c) if df.schema[c].dataType == TimestampType() else F.col(c) for c in columns])


def _with_times(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select(*[F.timestamp_micros(c).alias(c) if schema[c].dataType == TimestampType() else F.col(c) for c in df.columns])


class _Queue(StatefulProcessor):
    """Holds the newest ``capacity`` rows of a key; what falls out comes out."""

    def __init__(self, schema: StructType, order: list[str], capacity: int):
        self.schema, self.place, self.capacity = schema, _place(order), capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.schema.names
        held = [Row(*names)(*x) for x in self.held.get()] if self.held.exists() else []
        for row in rows:
            held.append(Row(*names)(*[row[c] for c in names]))
            if len(held) > 2 * self.capacity + 100:  # so that a trigger holds little more than the queue
                yield from self._cut(held)
        yield from self._cut(held)
        if held:
            self.held.put([tuple(x) for x in held])

    def _cut(self, held: list[Row]) -> list[Row]:
        held.sort(key=self.place)
        out = held[: max(0, len(held) - self.capacity)]
        del held[: len(out)]
        return out

    def close(self) -> None:
        pass


class _Latest(StatefulProcessor):
    """Holds the last row of a key; a later one comes out."""

    def __init__(self, schema: StructType, order: list[str]):
        self.schema, self.place = schema, _place(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.schema.names
        held = Row(*names)(*self.last.get()) if self.last.exists() else None
        best = max(rows, key=self.place)
        if held is None or self.place(best) > self.place(held):
            best = Row(*names)(*[best[c] for c in names])
            self.last.update(tuple(best))
            yield best

    def close(self) -> None:
        pass


def dropped_oldest(events: DataFrame, key: list[str], order: list[str], capacity: int) -> DataFrame:
    """The rows that a bounded first-in queue of each key loses: all but its newest ``capacity``.

    ``order`` must be total within a key.  State: ``capacity`` rows a key.
    """
    rows = _plain(events, key)
    return _with_times(rows.groupBy(*key).transformWithState(_Queue(rows.schema, order, capacity), rows.schema, "append", "none"), events.schema)


def latest(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Every row that is, when its trigger ends, the last of its key; the greatest by ``order`` is the state.

    State: a row a key.
    """
    rows = _plain(events, key)
    return _with_times(rows.groupBy(*key).transformWithState(_Latest(rows.schema, order), rows.schema, "append", "none"), events.schema)


def stale_to_error(events: DataFrame, key: str, id_: str, running: list[str], age_seconds: int, delay: str) -> DataFrame:
    """``key, id, at_ms``: running rows of ``events(key, id, ts, status)`` whose key has no later row within
    ``age_seconds``, once the watermark (``delay`` behind the last ``ts``) is past that.

    Times are whole milliseconds; rows of one time follow each other by id.  Rows of a key no more than
    ``age_seconds`` apart are a session, of which only the last row can be stale; the watermark ends it.
    State: the last row of each session of a key that is still open.
    """
    at, runs = F.timestamp_millis(F.unix_millis("ts")), F.coalesce(F.col("status").isin(running), F.lit(False))
    last = F.max(F.struct(F.unix_millis("_at").alias("ms"), F.col(id_).alias("id"), runs.alias("runs")))
    timed = events.withColumn("_at", at).withWatermark("_at", delay)
    sessions = timed.groupBy(key, F.session_window("_at", f"{age_seconds} seconds")).agg(last.alias("_last"))
    return sessions.filter("_last.runs").select(key, F.col("_last.id").alias(id_), (F.col("_last.ms") + age_seconds * 1000).alias("at_ms"))

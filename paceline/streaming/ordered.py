"""Keyed streams taken in event-time order, whatever the micro-batches are.

Rows wait in the state of their key until the watermark has passed them; a timer on
the event time then hands them on in order of time, together with a small state.  So
the result hangs on the rows alone, not on how they came in batches.  Rows behind the
watermark are dropped before.  A key without rows for `idle` (event time) has ended:
its state is removed, and rows that come later begin anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Step = Callable[[tuple, tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]
STORE = "spark.sql.streaming.stateStore.providerClass"


def session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that timers need; tables and streams read in it use that."""
    own = spark.newSession()
    own.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


def _pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed, then takes them in order of `order`, whose first column is the event time.

    `step(key, state, rows)` returns the new state (a tuple of `kinds`) and the rows
    to put out; its state is None at the beginning and after a pause of `idle_ms`.
    """

    def __init__(self, step: Step, kinds: str, order: list[str], idle_ms: int):
        self.step, self.kinds, self.order, self.idle_ms = step, kinds, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"last_ long, {self.kinds}")
        self.held = handle.getListState("held", "data binary")
        self.due = handle.getValueState("due", "at long")

    def _ms(self, rows: pd.DataFrame) -> pd.Series:
        return rows[self.order[0]].astype("datetime64[ms]").astype("int64")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                self.held.appendValue((_pack(part),))
                own = int(self._ms(part).min())
                first = own if first is None else min(first, own)
        if first is not None:
            due = self.due.get()[0] if self.due.exists() else None
            if due is None or first < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        parts = [_unpack(data) for (data,) in self.held.get()] if self.held.exists() else []
        self.held.clear()
        kept = self.kept.get() if self.kept.exists() else None
        out = []
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            ms = self._ms(rows)
            wait = rows[ms > now]
            taken = ms.min() if kept is None else kept[0]  # what is older than rows already taken comes too late
            rows = rows[(ms <= now) & (ms >= taken)].sort_values(self.order, kind="stable")
            for span in self._spans(rows, kept):
                at = self._ms(span)
                state = None if kept is None or int(at.iloc[0]) - kept[0] > self.idle_ms else tuple(kept[1:])
                state, result = self.step(key, state, span)
                kept = (int(at.iloc[-1]), *state)
                out.append(result)
            if kept is not None:
                self.kept.update(kept)
            if len(wait):
                self.held.appendValue((_pack(wait),))
                self._wake(int(self._ms(wait).min()))
                return iter([x for x in out if len(x)])
        if kept is not None and (parts or kept[0] + self.idle_ms > now):
            self._wake(kept[0] + self.idle_ms)
        else:
            self.kept.clear()
        return iter([x for x in out if len(x)])

    def _spans(self, rows: pd.DataFrame, kept: tuple | None) -> list[pd.DataFrame]:
        """The rows between pauses of more than idle_ms."""
        if not len(rows):
            return []
        cuts = (self._ms(rows).diff() > self.idle_ms).cumsum()
        return [span for _, span in rows.groupby(cuts, sort=True)]

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: list[str], step: Step, schema: str, kinds: str, order: list[str], idle: str) -> DataFrame:
    """`step` over the rows of each key in order of time; `rows` is a stream with a watermark on order[0], read in `session`.

    Rows without a key or a time are left out.
    """
    for name in (*keys, order[0]):
        rows = rows.where(F.col(name).isNotNull())
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy(*keys).transformWithStateInPandas(InOrder(step, kinds, order, idle_ms), schema, "Append", "EventTime")


def drain(rows: DataFrame, folder: str, checkpoint: str, after: Callable[[int], None] | None = None, timeout: int = 600) -> None:
    """Runs a stream until its input is used up, each micro-batch into a folder of its own below `folder`.

    A batch that runs again after a failure overwrites what it had written, so each
    row is there once; `checkpoint` holds how far the stream has come.  `after` is
    called with each batch's number once it is written.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if after:
            after(number)

    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    if query.isActive:
        query.stop()
        raise TimeoutError(f"the stream had not ended after {timeout} s")


def drained(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows that `drain` has written."""
    return spark.read.schema(schema).parquet(f"{folder}/batch=*")

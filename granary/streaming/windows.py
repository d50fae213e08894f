"""Marker-bounded windows of a stream, with keyed state and a timer (STR-03, STR-04).

A key's window holds what comes after its last start marker. The stream appends each row with the start that it follows, so
that a later start leaves the rows before it behind: they keep an older start than the key's last one, and readers pass
over them. State is a key's last start and those of its rows that a start which is still to come could take over, that is
rows not yet older than the watermark; a timer drops them when the watermark passes. For any cut of the rows into
micro-batches, in any order within the watermark's delay, and across restarts, what readers find is the window of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.streaming.events import last_window

#: State with timers is held by this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
START = ["start_at", "start_id"]
#: Rows of a key that are taken at a time.
ROWS = 10_000


class LastWindow(StatefulProcessor):
    """Rows (key, at, id, kind) of a key, at in microseconds, each with the start that it follows; kind is that of `start` at a marker."""

    def __init__(self, key: str, start: str) -> None:
        self.key, self.marker = key, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "at bigint, id bigint")
        self.open = handle.getListState("open", "at bigint, id bigint, kind string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        made = Row(self.key, "at", "id", "kind", *START)
        last = was = self._last()
        kept = had = self._open()
        while part := [(r.at, r.id, r.kind) for r in islice(rows, ROWS)]:  # each part is as good as a batch of its own
            new = [r for r in part if not last or r[:2] > last]
            starts = [r[:2] for r in new if r[2] == self.marker]
            if starts:
                last = max(starts)
                kept = new = [r for r in (*kept, *new) if r[:2] >= last]
            else:
                kept = [*kept, *new]
            for r in new:
                yield made(key[0], *r, *(last or (None, None)))
        if last != was:
            self.start.update(last)
        self._keep(kept, had, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        had = self._open()
        self._keep(had, had, timerValues)
        return iter(())

    def _last(self) -> tuple | None:
        found = self.start.get()
        return found and tuple(found)

    def _open(self) -> list[tuple]:
        return [tuple(r) for r in self.open.get()]

    def _keep(self, rows: list[tuple], had: list[tuple], timers) -> None:
        """Of what the state had and the rows that came since, rows that aren't older than the watermark stay, until a timer at the last of them.

        Each use of the state is a message to the JVM, so none is used that holds what it should.
        """
        over = timers.getCurrentWatermarkInMs() * 1000
        rows = [r for r in rows if r[0] >= over]
        if not rows:
            if had:
                self.open.clear()
            return
        if rows != had:
            self.open.put(rows)
        self.handle.registerTimer(max(r[0] for r in rows) // 1000 + 1)

    def close(self) -> None:
        pass


def windowed(stream: DataFrame, key: str, time: str, identity: str, kind: str, start: str, late: str) -> DataFrame:
    """(key, at, id, kind, start_at, start_id) of a stream's rows that follow their key's last start so far, and of the starts themselves.

    Rows may come in any order, but rows older than the latest time less `late` are dropped, as by any watermark. Rows of a
    key without a start have null starts. Null keys are a key; rows with a null time or id have no place and are left out.
    """
    rows = stream.where(F.col(time).isNotNull() & F.col(identity).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = rows.select(key, time, F.unix_micros(time).alias("at"), F.col(identity).cast("bigint").alias("id"), F.col(kind).alias("kind"))
    kept = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kept}, at bigint, id bigint, kind string, start_at bigint, start_id bigint"
    return rows.groupBy(key).transformWithState(LastWindow(key, start), schema, "Append", "EventTime")


def append(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Append what is there of windowed() to a Parquet table, and stop; the next call goes on from the checkpoint."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE[0], None)
    conf.set(*STORE)
    try:
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(STORE[0], before) if before else conf.unset(STORE[0])


def _latest(sink: DataFrame, key: str) -> DataFrame:
    """Rows under their key's last start, the start row too. The last starts are partial aggregates, one row a key."""
    start = F.struct(*START)
    last = sink.groupBy(F.col(key).alias("__key")).agg(F.max(F.when(F.col("start_at").isNotNull(), start)).alias("__last"))
    return sink.join(last, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__last").isNull() | (start == F.col("__last")))).drop("__key", "__last")


def read_windows(sink: DataFrame, key: str, stop: Column) -> DataFrame:
    """(key, at, id, kind) of each key's window, up to its first stop, markers left out (STR-03)."""
    inside = _latest(sink, key).where(F.col("start_at").isNull() | ~((F.col("at") == F.col("start_at")) & (F.col("id") == F.col("start_id"))))
    return last_window(inside.select(key, "at", "id", "kind"), key, ["at", "id"], F.lit(False), stop)


def read_gathered(sink: DataFrame, key: str) -> DataFrame:
    """(key, n, kinds): rows and kinds since each key's last start, the start included; keys without one have none (STR-04)."""
    return _latest(sink, key).where("start_at IS NOT NULL").groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds"))

"""Gaps in the records of a stream: state by station that ends, with timers on event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that such operators need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class GapProcessor(StatefulProcessor):
    """Holds how far a station's records reach, and those that the watermark has not passed yet.

    Records wait until the watermark passes their start, so that they are taken in the order of time however they
    come. One that starts more than the tolerance after what is reached ends a gap. Where nothing comes for
    ``expiry`` after the end that is reached, the station is told silent from there on and its state goes.
    """

    def __init__(self, by: list[str], tolerance_ms: int, expiry_ms: int):
        self.by, self.tolerance, self.expiry = by, tolerance_ms, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reached = handle.getValueState("reached", "ms long")
        self.waiting = handle.getListState("waiting", "start long, end long")

    def _silence(self, end: int) -> int:
        return end + self.expiry

    def _gap(self, key: Any, start: int, end: int | None) -> Row:
        return Row(**dict(zip(self.by, key)), start_ms=start, end_ms=end)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            self.waiting.appendValue((row["start_ms"], row["end_ms"]))
            self.handle.registerTimer(row["start_ms"])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        due, later = [w for w in waiting if w[0] <= now], [w for w in waiting if w[0] > now]
        reached = self.reached.get()[0] if self.reached.exists() else None
        old = reached
        for start, end in due:
            if reached is not None and start > reached + self.tolerance:
                yield self._gap(key, reached, start)
            reached = end if reached is None else max(reached, end)
        if due:
            self.waiting.clear()
            for w in later:
                self.waiting.appendValue(w)
        if reached is None:
            return
        if reached != old:
            if old is not None:
                self.handle.deleteTimer(self._silence(old))
            self.handle.registerTimer(max(self._silence(reached), now + 1))
            self.reached.update((reached,))
        elif not due and not later and now >= self._silence(reached):
            yield self._gap(key, reached, None)
            self.reached.clear()

    def close(self) -> None:
        pass


def stream_gaps(records: DataFrame, by: list[str], start: str, end: str, late: str, tolerance_ms: int = 0, expiry_ms: int = 7 * 86_400_000) -> DataFrame:
    """(by, gap_start, gap_end) of the records' intervals (timestamps), as soon as the watermark (``late`` behind the
    latest start) has passed a gap's end; gap_end is null where a station fell silent.

    Write it in append mode, with the RocksDB state store (:func:`use_rocksdb`). Times count in milliseconds. A record later than the
    watermark is dropped by Spark; a station that comes back after it was told silent begins anew.
    Records with a null time are left out.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    rows = records.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_at", F.col(start).cast("timestamp")).withWatermark("_at", late)
    rows = rows.select(*by, "_at", ms(start).alias("start_ms"), ms(end).alias("end_ms"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "start_ms long", "end_ms long"])
    found = rows.groupBy(*by).transformWithState(GapProcessor(by, tolerance_ms, expiry_ms), schema, "Append", "EventTime")
    return found.select(*by, F.timestamp_millis("start_ms").alias("gap_start"), F.timestamp_millis("end_ms").alias("gap_end"))


def stream_availability(records: DataFrame, by: list[str], start: str, end: str, chunk: str, late: str) -> DataFrame:
    """(chunk, by, seconds): how much of each chunk of time the records that start in it hold, once the watermark has
    passed; overlaps within a chunk count as they come. State ends with the chunk."""
    rows = records.withColumn("_at", F.col(start).cast("timestamp")).withWatermark("_at", late)
    length = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6
    return rows.groupBy(F.window("_at", chunk).alias("w"), *by).agg(F.sum(length).alias("seconds")).select(F.col("w.start").alias("chunk"), *by, "seconds")

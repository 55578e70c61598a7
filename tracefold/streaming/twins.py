"""Streaming twins of the batch operators: each takes and returns a streaming (or batch) DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_counts(events: DataFrame, ts: str, by: str, value: str, chunk: str, late: str) -> DataFrame:
    """Counts and sums over chunks of fixed length."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, chunk).alias("w"), by)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("chunk"), by, "n", "total")


def request_sessions(events: DataFrame, ts: str, by: str, gap: str, late: str) -> DataFrame:
    """Requests of a station that follow each other within the gap become one."""
    rows = events.withWatermark(ts, late).groupBy(by, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_records(records: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Each key's first record; repeats that come within the watermark are dropped."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def latest(records: DataFrame, ts: str, by: str) -> DataFrame:
    """The last time of every station, for latency; use it in update mode."""
    return records.groupBy(by).agg(F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))

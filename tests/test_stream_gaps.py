"""Gaps of a stream against those of all records at once."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tracefold.operators import aggregates as A
from tracefold.streaming import gaps as G

SCHEMA = "net string, sta int, s timestamp, e timestamp"
T0 = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, parts, **kwargs):
    """What the stream tells when the parts come one after the other."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    G.use_rocksdb(spark)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
        found = G.stream_gaps(stream, ["net", "sta"], "s", "e", "2 hours", **kwargs)
        name = f"gaps_{tmp_path.name}".replace("-", "_")
        q = found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def hours(*h):
    return tuple(T0 + dt.timedelta(hours=x) for x in h)


def test_gaps_equal_those_at_once(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for sta in range(3):
        t = 0.0
        for _ in range(12):
            t += rng.choice([0.5, 1.0, 3.0])
            rows.append(("N", sta, *hours(t, t + rng.choice([0.25, 1.0, 2.5]))))
    rows.sort(key=lambda r: r[2])
    parts = [rows[i : i + 8] for i in range(0, len(rows), 8)]
    for p in parts:
        rng.shuffle(p)
    for i in range(len(parts) - 1):  # some come a part late, but within the watermark
        if abs((parts[i][0][2] - parts[i + 1][0][2]).total_seconds()) < 7200:
            parts[i][0], parts[i + 1][0] = parts[i + 1][0], parts[i][0]
    end = [[("Z", 0, *hours(100, 101))], [("Z", 0, *hours(104, 105))]]  # carries the watermark past all others
    got = [r for r in run(spark, tmp_path, [*parts, *end]) if r[0] == "N"]
    df = spark.createDataFrame(rows, SCHEMA)
    merged = A.islands(df, ["net", "sta"], F.unix_millis("s"), F.unix_millis("e"), F.lit(0))
    want = A.gaps(merged, ["net", "sta"]).select("net", "sta", F.timestamp_millis("gap_start"), F.timestamp_millis("gap_end")).collect()
    assert len(want) > 5 and sorted(got) == sorted(map(tuple, want))


def test_silent_stations_end(spark, tmp_path):
    parts = [[("N", 1, *hours(0, 1)), ("N", 2, *hours(0, 1)), ("N", 3, None, None)], [("N", 2, *hours(5, 6))], [("N", 2, *hours(20, 21))], [("N", 2, *hours(24, 25))], [("N", 1, *hours(25, 26))], [("N", 2, *hours(40, 41))], [("N", 2, *hours(41, 42))]]
    got = run(spark, tmp_path, parts, expiry_ms=10 * 3_600_000)
    assert ("N", 1, *hours(1), None) in got  # silent; when it comes back it begins anew
    assert ("N", 2, *hours(1, 5)) in got and ("N", 2, *hours(21, 24)) in got
    assert not [r for r in got if r[1] == 1 and r[3] is not None] and not [r for r in got if r[1] == 3]


def test_availability(spark):
    df = spark.createDataFrame([("N", 1, *hours(0, 1)), ("N", 1, *hours(0.5, 0.75)), ("N", 1, *hours(30, 31))], SCHEMA)
    got = sorted((r.chunk, r.seconds) for r in G.stream_availability(df, ["net", "sta"], "s", "e", "1 day", "1 hour").collect())
    assert got == [(hours(0)[0], 4500.0), (hours(24)[0], 3600.0)]

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.sources import archive, fields, sinks, text
from tracefold.streaming import twins


def channel(net, sta, cha, az, dip, start="2000-01-01T00:00:00", end=""):
    return "|".join([net, sta, "", cha, "1.5", "2.5", "0", "0", str(az), str(dip), *[""] * 5, start, end])


def test_channels(spark, tmp_path):
    lines = ["# comment", channel("N", "S", "BHZ", 0, -90), channel("N", "S", "BHN", 355, 0), channel("N", "S", "BHE", 85, 0), channel("N", "S", "BH", 0, 0), channel("N", "S", "BHX", 0, 0, start=""), channel("N", "T", "BHZ", 0, 90, end="2001-01-01T00:00:00"), channel("N", "T", "BHN", 0, 0), channel("N", "T", "BHE", 5, 0)]
    (tmp_path / "c.txt").write_text("\n".join(lines))
    good, bad = text.read_channels(spark, str(tmp_path / "c.txt"))
    assert good.count() == 6 and bad.count() == 2
    assert good.filter("station = 'S'").first().endtime is None
    kept = sorted((r.station, r.channel) for r in text.valid_channels(good, ["network", "station"]).collect())
    assert kept == [("S", "BHE"), ("S", "BHN"), ("S", "BHZ"), ("T", "BHZ")]


def test_parameters_and_source(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# c\nNPROC = 4 # four\nMODEL= a b\n")
    assert text.read_parameters(spark, str(tmp_path / "p.txt")) == {"NPROC": "4", "MODEL": "a b"}
    body = "PDE 2000\nevent name: E1\ntime shift: 0\nhalf duration: 3.256\nlatitude: 10.5\nlongitude: -20\ndepth: -3\n" + "\n".join(f"{n}: {v}e+24" for n, v in zip(("Mrr", "Mtt", "Mpp", "Mrt", "Mrp", "Mtp"), (1, -1, 0, 2, 0, 0)))
    (tmp_path / "s.txt").write_text(body)
    src = text.read_source(spark, str(tmp_path / "s.txt"))
    row = src.first()
    assert row.id == "E1" and row.tau == pytest.approx(2.0) and row.depth == 0 and row.m0 == pytest.approx(5**0.5 * 1e17)
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "s.txt").write_text(sinks.source_text(src).first().value)
    again = text.read_source(spark, str(tmp_path / "again")).first()
    assert again.m0 == pytest.approx(row.m0) and again.latitude == row.latitude


def test_field_files(spark, tmp_path):
    want = {}
    for iproc in range(2):
        values = np.arange(250, dtype="f4") + 1000 * iproc
        (tmp_path / f"proc{iproc:06d}_reg1_vsv.bin").write_bytes(fields.encode_record(values))
        want |= {(iproc, i // 125, i % 125): float(v) for i, v in enumerate(values)}
    got = fields.read_field_files(spark, str(tmp_path), "vsv")
    assert {(r.iproc, r.ispec, r.igll): r.vsv for r in got.collect()} == want
    fields.write_field(got, str(tmp_path / "out"))
    with pytest.raises(Exception):
        fields.write_field(got, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        fields.decode_record(b"\x08\0\0\0abc")


def test_archive(spark, tmp_path):
    t = dt.datetime(2020, 12, 31, 23, 0)
    row = lambda h, payload, n=3600: ("N", "S", "", "BHZ", t + dt.timedelta(hours=h), 1.0, n, payload)
    schema = "network string, station string, location string, channel string, starttime timestamp_ntz, samp_rate double, npts int, payload binary"
    old = spark.createDataFrame([row(0, b"a"), row(1, b"b")], schema)
    both = archive.insert_records(old, spark.createDataFrame([row(1, b"other"), row(5, b"c"), row(5, b"c")], schema))
    assert sorted((r.starttime.hour, bytes(r.payload)) for r in both.collect()) == [(0, b"b"), (4, b"c"), (23, b"a")]
    archive.write_archive(both, str(tmp_path / "sds"))
    got = archive.read_archive(spark, str(tmp_path / "sds"), "2021-01-01 00:30:00", "2021-01-01 02:00:00", {"channel": "B?Z", "station": "*"})
    assert [bytes(r.payload) for r in got.collect()] == [b"b"]
    assert archive.catalog(spark, str(tmp_path / "sds")).count() == 1


def test_missing_intervals(spark):
    merged = spark.createDataFrame([("a", 10, 20), ("a", 30, 40)], "k string, start long, end long")
    asked = spark.createDataFrame([("a", 0, 50), ("a", 12, 18), ("a", 100, 110), ("b", 1, 2)], "k string, start long, end long")
    got = sorted((r.k, r.gap_start, r.gap_end) for r in archive.missing(asked, merged, ["k"]).collect())
    assert got == [("a", 0, 10), ("a", 20, 30), ("a", 40, 50), ("a", 100, 110), ("b", 1, 2)]


def test_streams_give_what_batches_give(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()), key=str)

    pick = lambda d: twins.latest(d, "ts", "user_id")
    assert run(pick(stream), "latest_t", "complete") == sorted(map(tuple, pick(events).collect()), key=str)
    once = lambda d: twins.first_records(d, "ts", ["event_id"], "40 days")
    assert len(run(once(stream.union(stream)), "first_t", "append")) == events.count()
    counts = run(twins.chunk_counts(stream, "ts", "event_type", "value", "1 day", "1 minute").select("event_type", "n"), "chunks_t", "append")
    assert counts and all(n > 0 for _, n in counts)

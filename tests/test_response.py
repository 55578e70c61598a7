"""Responses by poles and zeros, and inserts that rewrite only the days they touch."""

import datetime as dt

import numpy as np
import pytest

from tracefold.operators import response as R
from tracefold.sources import archive

T0 = dt.datetime(2024, 1, 1)
RECORDS = "sta string, cha string, starttime timestamp, rate double, samples array<double>, note string"
RESPONSES = f"sta string, cha string, starttime timestamp, endtime timestamp, poles {R.COMPLEX}, zeros {R.COMPLEX}, gain double, lowest double"


def butter(f, rate, order, low=None, high=None):
    w = np.tan(np.pi * np.minimum(f, rate / 2) / rate)
    with np.errstate(divide="ignore"):
        x = np.tan(np.pi * low / rate) / w if low else w / np.tan(np.pi * high / rate)
    return 1 / np.sqrt(1 + x ** (2 * order))


def one(x, rate, skip, n_new, low, order, poles, zeros, gain, rules):
    """A trace by itself, straight from the definition."""
    x = np.asarray(x)
    t = np.arange(len(x))
    x = x - np.polyval(np.polyfit(t, x, 1), t)
    pad = max(5, 2 * int(rate / low))
    size = len(x) + 2 * pad
    while any(rest > 1 for rest in [_strip(size)]):
        size += 1
    f = np.fft.rfftfreq(size, 1 / rate)
    s = 2j * np.pi * f
    with np.errstate(divide="ignore", invalid="ignore"):
        h = gain * np.prod([s - z for z in zeros] or [np.ones(len(s))], axis=0) / np.prod([s - p for p in poles] or [np.ones(len(s))], axis=0)
        if rules.output == "DISP":
            h = h * s
        y = np.fft.rfft(np.concatenate([[x.mean()] * pad, x, [x.mean()] * (size - len(x) - pad)])) * butter(f, rate, order, low=low) * butter(f, rate, rules.high_order, high=rules.high)
        y = np.where(np.abs(h) > 0, y / h, y)
    y[0] = 0
    y = np.fft.irfft(y, size)
    out = []
    for k in range(n_new):
        u = (skip + k / rules.new_rate) * rate + pad
        near = np.arange(int(np.floor(u)) - 19, int(np.floor(u)) + 21)
        near = near[(near >= 0) & (near < size)]
        out.append((y[near] * np.sinc(u - near) * np.sinc((u - near) / 20)).sum())
    return out


def _strip(n):
    for p in (2, 3, 5, 7, 11):
        while n % p == 0:
            n //= p
    return n


@pytest.mark.parametrize("output", ["VEL", "DISP"])
def test_remove_responses(spark, output):
    rng = np.random.default_rng(1)
    pair = lambda r: [(float(z.real), float(z.imag)) for z in r]
    paz = {"Z": ([-0.04 + 0.04j, -0.04 - 0.04j, -50 + 0j], [0j, 0j], 1500.0, None), "N": ([-0.4 + 0.4j, -0.4 - 0.4j], [0j], 3.0, 0.05)}
    later = T0 + dt.timedelta(days=10)
    responses = [("A", c, T0 - dt.timedelta(days=1), later, pair(p), pair(z), g, low) for c, (p, z, g, low) in paz.items()] + [("A", "Z", later, None, pair([-1 + 0j]), None, 7.0, None)]
    traces = {c: rng.normal(size=n).cumsum() for c, n in (("Z", 600), ("N", 640))}
    records = [("A", "Z", T0, 5.0, traces["Z"].tolist(), "z"), ("A", "N", T0 + dt.timedelta(seconds=2.3), 5.0, traces["N"].tolist(), "n"), ("A", "Q", T0, 5.0, [1.0] * 9, ""), ("B", "Z", T0, 5.0, [1.0] * 9, ""), ("A", "Z", T0, 5.0, None, ""), ("A", "Z", T0, 5.0, [], "")]
    rules = R.RemovalRules(low=0.02, high=0.8, output=output)
    got = R.remove_responses(spark.createDataFrame(records, RECORDS), spark.createDataFrame(responses, RESPONSES), ["sta", "cha"], ["sta"], rules=rules)
    rows = {r.cha: r for r in got.collect()}
    assert sorted(rows) == ["N", "Z"] and got.columns == ["sta", "cha", "note", "starttime", "rate", "samples"] and rows["N"].note == "n"
    n_new = int((119.8 - 2.3) * 2 + 1e-9)
    for c, r in rows.items():
        assert r.starttime == T0 + dt.timedelta(seconds=2.3) and r.rate == 2.0
        p, z, g, _ = paz[c]
        want = one(traces[c], 5.0, 2.3 if c == "Z" else 0.0, n_new, 0.05, 3 if output == "DISP" else 2, p, z, g, rules)
        assert len(r.samples) == n_new and np.allclose(r.samples, want, rtol=1e-6, atol=1e-9 * np.abs(want).max())
    assert R.remove_responses(spark.createDataFrame(records, RECORDS).limit(0), spark.createDataFrame(responses, RESPONSES), ["sta", "cha"], ["sta"]).count() == 0


def test_insert_rewrites_touched_days_only(spark, tmp_path):
    schema = "network string, station string, location string, channel string, starttime timestamp_ntz, samp_rate double, npts int, payload binary"
    row = lambda day, hour, payload, cha="BHZ": ("N", "S", "", cha, T0 + dt.timedelta(days=day, hours=hour), 1.0, 3600, payload)
    path = str(tmp_path / "archive")
    archive.write_archive(spark.createDataFrame([row(d, h, b"old") for d in range(4) for h in range(3)] + [row(0, 0, b"e", "BHE")], schema), path)
    files = lambda: {str(p.relative_to(path)): p.stat().st_mtime_ns for p in (tmp_path / "archive").rglob("*.parquet")}
    before = files()
    new = [row(1, 5, b"new"), row(1, 0, b"unlike"), row(2, 0, b"old"), row(7, 0, b"x"), row(7, 0, b"x"), row(3, 1, b"other")]
    added, differs = archive.insert_into_archive(spark.createDataFrame(new, schema), path)
    assert sorted((r.starttime.day, r.starttime.hour, bytes(r.payload)) for r in added.collect()) == [(2, 5, b"new"), (8, 0, b"x")]
    assert sorted((r.starttime.day, r.starttime.hour) for r in differs.collect()) == [(2, 0), (4, 1)]
    after = files()
    stayed = {f for f, t in before.items() if after.get(f) == t}
    assert {f.split("/")[-2] for f in before.keys() - stayed} == {"doy=2"} and len(stayed) == len(before) - 1
    whole = spark.read.parquet(path)
    assert whole.count() == 15 and whole.filter("payload = cast('unlike' as binary)").count() == 0
    again, none = archive.insert_into_archive(spark.createDataFrame(new[:1], schema), path)
    assert again.count() == 0 and none.count() == 0 and files() == after

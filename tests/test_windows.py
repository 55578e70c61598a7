"""Windows by rule, and their measurement against one window at a time and against finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.operators import windows as O


def ramp(t, a, b, c, d):
    return np.array([0.0 if x < a or x > d else 1.0 if b <= x <= c else 0.5 - 0.5 * np.cos(np.pi * ((x - a) / (b - a) if x < b else (d - x) / (d - c))) for x in t])


def butter(f, rate, order, low, high):
    w, a, b = (np.tan(np.pi * np.asarray(x) / rate) for x in (np.minimum(f, rate / 2), low, high))
    with np.errstate(divide="ignore"):
        return 1 / np.sqrt(1 + ((w * w - a * b) / (w * (b - a))) ** (2 * order))


def one_window(obs, syn, w, rate, noise_end, derive, tau, pre):
    """Measures of a window, straight from their definition; and its CC0 as a function of the synthetic."""
    n = obs.shape[1]
    pad = int(max(20.0, 2 / w["low"]) * rate)
    size = n + 2 * pad
    while any(size % p for p in [size]) or not smooth(size):
        size += 1
    freq = np.fft.rfftfreq(size, 1 / rate)
    gain = butter(freq, rate, w["order"], w["low"], w["high"])
    edges = ramp(np.arange(size), 0, pad, pad + n, size - 1)
    own = np.ones(len(freq), complex)
    if derive:
        own = own * 2j * np.pi * freq
    if tau:
        own = own * np.exp(-((np.pi * freq * tau) ** 2))
    t = np.arange(n) / rate
    width = (w["end"] - w["begin"]) * min(w["taper"], 0.4)
    win = ramp(t, w["begin"], w["begin"] + width, w["end"] - width, w["end"])
    matrix, _ = O.directions(np.array([w["component"]], object), np.array([w["azimuth"]]), np.array([w["dip"]]))

    def through(x, factor):
        wide = np.array([np.concatenate([[r[0]] * pad, r, [r[-1]] * (size - n - pad)]) for r in x]) * edges
        return matrix[0] @ np.fft.irfft(np.fft.rfft(wide) * gain * factor, size)[:, pad : pad + n]

    o, s = through(obs, 1.0), through(syn, own)
    quiet = (t >= 0.5 / w["low"]) & (t <= noise_end - 0.5 / w["low"])
    noise = np.sqrt((o[:, quiet] ** 2).sum(axis=0).max()) if quiet.any() else 0.0
    o, s = o * win, s * win
    amp = np.sqrt((o**2).sum(axis=0).max())
    cc0 = (o * s).sum() / np.sqrt((o**2).sum() * (s**2).sum())
    return {"obs_amp": amp, "noise_amp": noise, "snr": 20 * np.log10(amp / noise) if noise else 9999.0, "cc0": cc0, "ar0": (o * s).sum() / (o**2).sum()}


def smooth(n):
    for p in (2, 3, 5, 7, 11):
        while n % p == 0:
            n //= p
    return n == 1


RULES = O.TableRules(corners={"cc0": (-2, -1.5)})  # a weight that does not depend on the synthetic
KINDS = "obs_e array<double>, obs_n array<double>, obs_z array<double>, syn_e array<double>, syn_n array<double>, syn_z array<double>"
WINDOWS = "windows array<struct<id:string,component:string,azimuth:double,dip:double,order:int,low:double,high:double,begin:double,end:double,taper:double,weight:double>>"
SCHEMA = f"sta int, {KINDS}, rate double, noise_end double, derive boolean, tau double, pre array<struct<order:int,low:double,high:double>>, {WINDOWS}"


def bursts(rng, n):
    """Traces that are quiet at both ends."""
    t = np.arange(n)
    return np.array([np.exp(-(((t - n / 2) / (n / 10)) ** 2)) * rng.normal(size=n) for _ in range(3)])


def window(i, component, low, high, begin, end, order=2, weight=1.0, azimuth=30.0, dip=0.0):
    return (f"w{i}", component, azimuth, dip, order, low, high, begin, end, 0.3, weight)


def test_measures_and_adjoint(spark):
    rng = np.random.default_rng(4)
    stations = []
    for sta, (n, rate, derive, tau, pre) in enumerate([(200, 2.0, False, None, None), (240, 2.0, True, None, [(2, 0.01, 0.6)]), (200, 1.0, False, None, []), (200, 2.0, False, None, [])]):
        wins = [window(0, "Z", 0.1, 0.4, 20.0, 75.0, dip=-90.0), window(1, "R", 0.05, 0.3, 30.0, 70.0, 3, 2.0), window(2, "H", 0.1, 0.4, 25.0, 80.0), window(3, "F", 0.05, 0.3, 22.0, 71.0, 3)]
        stations.append([sta, *[r.tolist() for r in [*bursts(rng, n), *bursts(rng, n)]], rate, 12.0 + 20 * (sta == 0), derive, tau, pre, wins])
    base = O.measure_window_table(spark.createDataFrame(stations, SCHEMA).repartition(2), RULES).collect()
    assert len(base) == len(stations)
    for r in base:
        row = stations[r.sta]
        obs, syn = np.array(row[1:4]), np.array(row[4:7])
        names = WINDOWS.split("struct<")[1].replace(":", " ").split(",")
        for got, told in zip(r.windows, row[12]):
            w = dict(zip([x.split()[0] for x in names], told))
            for name, value in one_window(obs, syn, w, row[7], row[8], row[9], row[10], row[11]).items():
                assert got[name] == pytest.approx(value, rel=1e-9, abs=1e-12), (r.sta, w["id"], name)
            assert got.valid and got.weight == w["weight"] and got.cc_max >= got.cc0 - 1e-6
        # a small change of the synthetic changes the weighted CC0 as the adjoint source says; earlier bands act on the synthetic before
        change = 1e-4 * bursts(rng, len(row[1]))
        freq = np.fft.rfftfreq(4096, 1 / row[7])
        moved = np.fft.irfft(np.fft.rfft(change, 4096) * np.prod([butter(freq, row[7], *p) for p in row[11] or []], axis=0), 4096)[:, : len(row[1])]
        score = lambda s: sum(w[10] * one_window(obs, s, dict(zip([x.split()[0] for x in names], w)), row[7], row[8], row[9], row[10], row[11])["cc0"] for w in row[12])
        expected = score(syn + moved) - score(syn)
        got = (np.array([r.adj_e, r.adj_n, r.adj_z]) * change).sum()
        assert got == pytest.approx(expected, rel=0.05, abs=2e-8)


def test_source_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    traces = [r.tolist() for r in [*bursts(rng, 100), *bursts(rng, 100)]]
    w = [window(0, "Z", 0.1, 0.4, 10.0, 40.0, dip=-90.0)]
    zeros = [[0.0] * 100] * 3
    rows = [
        [0, *traces, 2.0, 8.0, False, 3.0, None, w], [1, *zeros, *traces[3:], 2.0, 8.0, None, None, None, w], [2, *traces, 2.0, 8.0, False, None, None, []],
        [3, None, *traces[1:], 2.0, 8.0, False, None, None, w], [4, *traces[:5], [1.0], 2.0, 8.0, False, None, None, w], [5, *traces, 2.0, 8.0, False, None, None, [window(0, "Q", 0.1, 0.4, 10.0, 40.0)]],
        [6, *traces, 2.0, 8.0, False, None, None, [(*w[0][:5], None, *w[0][6:])]], [7, *traces, 2.0, 8.0, False, None, None, w], [7, *traces, 2.0, 8.0, False, None, None, w],
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in O.measure_window_table(df.withColumn("cc", F.lit("kept"))).collect():
        got.setdefault(r.sta, []).append(r)
    assert got[0][0].cc == "kept" and len(got[7]) == 2 and got[7][0] == got[7][1]
    expected = one_window(np.array(traces[:3]), np.array(traces[3:]), dict(component="Z", azimuth=0.0, dip=-90.0, order=2, low=0.1, high=0.4, begin=10.0, end=40.0, taper=0.3), 2.0, 8.0, False, 3.0, None)
    assert got[0][0].windows[0].cc0 == pytest.approx(expected["cc0"])
    for sta in (1, 3, 4, 5, 6):
        assert [(x.cc0, x.valid, x.weight) for x in got[sta][0].windows] == [(None, False, 0.0)]
    assert got[3][0].adj_e is None and got[4][0].adj_e is None and got[2][0].windows == [] and set(got[2][0].adj_e) == {0.0}
    small = O.TableRules(block=1)
    assert O.window_rows(O.measure_window_table(df, small)).orderBy("sta").collect() == O.window_rows(O.measure_window_table(df)).orderBy("sta").collect()
    assert O.measure_window_table(df.limit(0)).count() == 0


def test_rules(spark):
    st = spark.createDataFrame([(1, -3.0, 30.0, 10.0, True, 0.0, 1e4), (2, 50.0, 30.0, 10.0, False, 0.0, 1e4), (3, 50.0, 30.0, 10.0, True, 0.0, 330.0)], "k int, depth double, distance double, back_azimuth double, horizontals boolean, first double, last double")
    ar = spark.createDataFrame([(1, "P", 300.0), (1, "P", 310.0), (2, "P", 300.0), (3, "P", 300.0), (1, "S", None)], "k int, phase string, time double")
    rules = [O.WindowRule("a", "body", "Z", (2, 0.1, 0.4), ("P", "pP"), twin=(-10, 60)), O.WindowRule("b", "Swin", "T", (2, 0.1, 0.4)), O.WindowRule("c", "body", "R", (2, 0.1, 0.4), ("pP",)), O.WindowRule("d", "surf", "H", (2, 0.1, 0.4), swin=(10, 20, 0), depth=(0, 10))]
    got = sorted((r.k, r.id, r.begin, r.end) for r in O.station_windows(st, ar, rules, ["k"]).collect())
    assert got == [(1, "a", 290.0, 370.0), (1, "d", 300.0, 600.0), (2, "a", 290.0, 360.0), (3, "a", 290.0, 330.0)]
    with pytest.raises(ValueError, match="differ"):
        O.station_windows(st, ar, rules[:1] * 2, ["k"])

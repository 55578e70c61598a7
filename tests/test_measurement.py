"""Measurement, mesh and search operators against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.functions import fields, geo, gll, tapers, waveform
from tracefold.functions import sources as src
from tracefold.operators import aggregates, checks, joins, lineage, mesh, optimize, records, smoothing
from tracefold.sources import archive, sinks, text


def one(df, *columns):
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()


def test_rotation_of_slanted_channels(spark):
    rng = np.random.default_rng(1)
    az, dip = [20.0, 130.0, 250.0], [30.0, 35.0, 40.0]
    p = np.array([[math.cos(math.radians(d)) * math.sin(math.radians(a)), math.cos(math.radians(d)) * math.cos(math.radians(a)), -math.sin(math.radians(d))] for a, d in zip(az, dip)])
    x = rng.normal(size=(3, 7))
    seen = p @ x
    df = spark.createDataFrame([tuple(r.tolist() for r in seen)], "a array<double>, b array<double>, c array<double>")
    out = waveform.rotate_to_enz([waveform.polarisation(F.lit(a), F.lit(d)) for a, d in zip(az, dip)], [F.col(c) for c in "abc"])
    assert np.allclose(np.array(list(one(df, *out)[0])), x)


def test_measures_of_a_shifted_trace(spark):
    rules = waveform.MeasureRules(signal=(20.0, 90.0), noise=(0.0, 15.0), largest_shift=4.0)
    t = np.arange(200) / 2.0
    pulse = lambda c: np.exp(-((t - c) ** 2) / 20) * np.cos((t - c) / 3)
    zero = [0.0] * 200
    obs, syn = (3 * pulse(56.5)).tolist(), pulse(55.0).tolist()
    schema = ", ".join(f"{c} array<double>" for c in (*waveform.OBSERVED, *waveform.SYNTHETIC)) + ", cmp string, weight double"
    df = spark.createDataFrame([(zero, zero, obs, zero, zero, syn, "Z", 2.0), (zero, zero, zero, zero, zero, syn, "F", 2.0), (zero, zero, obs, zero, zero, syn, "X", 1.0)], schema)
    df = df.withColumn("matrix", waveform.projection(F.col("cmp"), *waveform.component_direction(F.col("cmp"), F.lit(10.0))))
    z, dead, unknown = waveform.measure_windows(df, rules).collect()
    assert z.cc_shift == pytest.approx(1.5) and z.cc_max > 0.99 and z.ar_max == pytest.approx(1 / 3, rel=0.02) and z.valid and z.weight > 0
    assert dead.snr is None and dead.cc0 is None and not dead.valid and dead.weight == 0
    assert unknown.cc0 is None and unknown.weight == 0
    # the adjoint source is the gradient of cc0
    rng = np.random.default_rng(2)
    o, s, change = (rng.normal(size=(3, 60)) for _ in range(3))
    rules = waveform.MeasureRules(signal=(5.0, 25.0))
    rows = lambda k: tuple(map(list, o.tolist())) + tuple(map(list, (s + k * change).tolist())) + ("H", 1.0)
    df = spark.createDataFrame([rows(0), rows(1e-5), rows(-1e-5)], schema).withColumn("matrix", waveform.projection(F.col("cmp"), F.lit(0.0), F.lit(0.0)))
    cc = [r.cc0 for r in waveform.measure_windows(df, rules).collect()]
    adj = waveform.adjoint_source(df, rules).first()
    assert (np.array([adj.adj_e, adj.adj_n, adj.adj_z]) * change).sum() == pytest.approx((cc[1] - cc[2]) / 2e-5, rel=1e-4)


def test_response_removal(spark):
    n, rate = 256, 2.0
    t = np.arange(n) / rate
    x = np.sin(2 * np.pi * 0.1 * t) * np.hanning(n)
    f = np.linspace(0, 1, 200)
    df = spark.createDataFrame([((5 * x + 3).tolist(),), (None,)], "u array<double>")
    got = [r[0] for r in df.select(waveform.response_corrected(F.col("u"), rate, np.full(200, 5 + 0j), f, 0.01, 0.8)).collect()]
    assert np.abs(np.array(got[0]) - x)[40:-40].max() < 0.05 and got[1] is None


def test_windows_without_arrivals(spark):
    df = spark.createDataFrame([("body", None), ("surf", None), ("odd", 5.0)], "kind string, p double")
    f, p = F.lit, F.col("p")
    b, e = waveform.window_bounds(F.col("kind"), f(10.0), {"body": (p, p), "P": (p, p), "S": (p, p)}, (f(-1.0), f(2.0)), (f(3.0), f(4.0), f(30.0)), f(1.0), f(2.0))
    assert [tuple(r) for r in one(df, b, e)] == [(None, None), (20.0, 50.0), (None, None)]


def test_small_geometry(spark):
    df = spark.createDataFrame([(0.0,)], "x double")
    f = F.lit
    r, t, z, h = one(df, *[geo.component_azimuth(f(c), f(30.0)) for c in "RTZH"])[0]
    assert (r, t, z) == (210.0, 300.0, 0.0) and math.isnan(h)
    assert one(df, geo.azimuth_from_perpendicular(f(10.0), f(100.0)))[0][0] == pytest.approx(0, abs=1e-12)
    assert one(df, geo.in_rectangle(f(5.0), f(5.0), 0, 10, 0, 10), geo.in_ring(f(0.0), f(5.0), 0.0, 0.0, 4.0, 6.0), geo.in_ring(f(0.0), f(7.0), 0.0, 0.0, 4.0, 6.0))[0] == (True, True, False)
    e, n, u = one(df, *geo.to_enu(f(0.0), f(1.0), f(0.0), f(0.0), f(0.0)))[0]
    assert (e, n, u) == (pytest.approx(1.0), pytest.approx(0.0), pytest.approx(0.0))
    lat, lon, height = one(df, *geo.from_ecef(*geo.to_ecef(f(-52.0), f(17.0), f(-35000.0))))[0]
    assert (lat, lon, height) == (pytest.approx(-52, abs=1e-9), pytest.approx(17), pytest.approx(-35000, abs=1e-3))
    assert one(df, tapers.taper_width(f(10.0), f(0.7)), tapers.taper_width(f(10.0), f(0.1)))[0] == (4.0, 1.0)
    assert one(df, fields.floored_inverse(f(-2.0), f(5.0)), fields.speed_ratio_floor(f(6.0), f(5.0), 1.5), fields.speed_ratio_floor(f(9.0), f(5.0), 1.5))[0] == (0.2, 4.0, 5.0)
    m0, mw = one(df, *fields.moment(F.array(*[f(float(x)) for x in (1e18, 0, 0, 0, -1e18, 0, 0, 0, 0)])))[0]
    assert m0 == pytest.approx(1e18) and mw == pytest.approx((18 - 9.05) / 1.5)
    d = one(df, geo.geodesic()(f(0.0), f(0.0), f(0.0), f(1.0)), geo.geodesic()(f(10.0), f(20.0), f(10.0), f(20.0)))[0]
    assert d[0].distance == pytest.approx(111319.491, abs=1e-3) and d[0].azimuth == pytest.approx(90) and d[0].back == pytest.approx(270) and d[1].distance == 0


def test_gradients_kinds(spark):
    rng = np.random.default_rng(4)
    g, old, d = rng.normal(size=(3, 40))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(g, old, d)], "g double, old double, d double")
    for kind, beta in (("SD", 0.0), ("PR", -(g @ (g - old)) / (old @ old)), ("HS", (g @ (g - old)) / (d @ (g - old)))):
        want = g - beta * d
        want = g if want @ g <= 0 else want
        got = [r.direction for r in optimize.cg_direction(df, F.lit(1.0), F.col("g"), F.col("old"), F.col("d"), kind).collect()]
        assert np.allclose(got, want)


def test_spline_and_refined_search(spark):
    x = np.linspace(-1, 2, 6)
    fine = np.linspace(-1, 2, 50)
    cubic = lambda v: 2 * v**3 - v**2 + 3
    assert np.allclose(optimize.spline(x, cubic(x), fine), cubic(fine))  # a cubic is its own spline
    peak = lambda a, b: (np.exp(-((a[:, None] - 0.7) ** 2) - (b[None] - 1.2) ** 2), 1.0)
    a, b, top = optimize.refined_search(peak, {"a": (0.0, 2.0), "b": (1.0, 1.0)})
    assert a == pytest.approx(0.7, abs=0.02) and b == pytest.approx(1.2, abs=0.02) and top == pytest.approx(1, abs=0.01)
    # on traces: the observation is the synthetic with half of its change, one second late
    t = np.arange(128) / 2.0
    wave = lambda c, w: np.exp(-((t - c) ** 2) / w)
    obs = wave(31.0, 20) + 0.5 * wave(36.0, 9)
    df = spark.createDataFrame([(obs.tolist(), wave(30.0, 20).tolist(), wave(35.0, 9).tolist(), 2.0)], "obs array<double>, syn array<double>, change array<double>, weight double")
    a, b, top = optimize.refined_search(lambda x, y: optimize.shifted_sums(df, 2.0, x, y), {"dt0": (0.0, 3.0), "dxs": (1.0, 1.0)}, rounds=5)
    assert a == pytest.approx(1.0, abs=0.1) and b == pytest.approx(0.5, abs=0.1) and top > 0.999


def test_nearest_join_is_complete(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random((60, 3)), rng.random((5, 3)) * 100])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    got = {}
    for r in joins.nearest_join(df, df, "id", "id", ["x", "y", "z"], 4, 0.05).collect():
        got.setdefault(r.a_id, {})[r.rank] = r.b_id
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert all([got[i][k] for k in (1, 2, 3, 4)] == np.argsort(d[i], kind="stable")[:4].tolist() for i in range(len(p)))
    few = joins.nearest_join(df, df.filter("id < 2"), "id", "id", ["x", "y", "z"], 4, 0.05)
    assert few.count() == 2 * len(p)


def test_thinning_is_one_by_one(spark):
    rng = np.random.default_rng(6)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 40, (90, 2)) if a != b}
    left, want = set(pairs), set()
    while left:
        n = {}
        for a, b in left:
            n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
        worst = max(n, key=lambda k: (n[k], k))
        want.add(worst)
        left = {p for p in left if worst not in p}
    df = spark.createDataFrame(sorted(pairs), "a long, b long")
    assert {r.id for r in joins.thin_by_conflicts(df, lineage.cutter(spark, "t")).collect()} == want
    assert joins.thin_by_conflicts(df.limit(0), lineage.cutter(spark, "t")).count() == 0


def test_implicit_diffusion(spark):
    rng = np.random.default_rng(7)
    n, k = 12, {(i, i + 1): float(1 + i % 3) for i in range(11)}
    lap = np.zeros((n, n))
    for (a, b), c in k.items():
        lap[[a, b], [a, b]] -= c
        lap[a, b] += c
        lap[b, a] += c
    u = rng.normal(size=n)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(u)], "id long, u double")
    links = spark.createDataFrame([(a, b, c) for (a, b), c in k.items()], "a long, b long, k double")
    for implicit in (1.0, 0.5):
        want = np.linalg.solve(np.eye(n) - implicit * 0.7 * lap, u + (1 - implicit) * 0.7 * lap @ u)
        got = {r.id: r.u for r in smoothing.implicit_diffusion(df, links, "id", "u", "k", 0.7, lineage.cutter(spark, "d"), implicit=implicit, tolerance=1e-20).collect()}
        assert np.allclose([got[i] for i in range(n)], want)


def test_elements(spark):
    x, w = gll.nodes_and_weights(5)
    assert np.allclose(x, [-1, -math.sqrt(3 / 7), 0, math.sqrt(3 / 7), 1]) and np.allclose(w, [0.1, 49 / 90, 32 / 45, 49 / 90, 0.1])
    assert np.allclose(gll.derivative_matrix(5) @ x**4, 4 * x**3) and np.allclose(gll.lagrange(np.array([0.3]), x)[0] @ x**3, 0.027)
    assert gll.linear(np.array([-2.0, 0.0]), x)[0][0] == 1
    # two unit cubes of 5**3 points: volumes add up to what they are
    rows = [(e, i, j, k, 1) for e in range(2) for k in range(5) for j in range(5) for i in range(5)]
    df = spark.createDataFrame(rows, "ispec int, i int, j int, k int, iglob int").withColumn("iproc", F.lit(0))
    df = df.withColumns({"x": F.col("i") * 1.0 + F.col("ispec") * 10, "y": F.col("j") * 1.0, "z": F.col("k") * 1.0, "two": F.lit(2.0), "none": F.lit(0.0)})
    scan = mesh.mesh_scan(df, {f"{a}_{b}": "two" if i == j else "none" for i, a in enumerate(("xi", "eta", "gam")) for j, b in enumerate("xyz")})
    got = scan.groupBy("ispec").agg(F.sum("dvol").alias("v"), F.max("center_x").alias("c"), F.max("iglob").alias("g")).orderBy("ispec").collect()
    assert [(r.v, r.c, r.g) for r in got] == [(pytest.approx(1.0), 2.0, 0), (pytest.approx(1.0), 12.0, 0)]


def test_locate_points(spark):
    at = [-1.0, 0.0, 1.0]
    anchors = lambda cx: [v for w in at for y in at for x in at for v in (cx + x, y * 1.0, w * 1.0)]
    elements = spark.createDataFrame([(10, 0.0, 0.0, 0.0, anchors(0.0)), (11, 2.0, 0.0, 0.0, anchors(2.0)), (12, 9.0, 0.0, 0.0, anchors(9.0))], "element long, x double, y double, z double, anchors array<double>")
    points = spark.createDataFrame([(1, 0.5, 0.2, 0.1), (2, 2.5, -0.3, 0.0), (3, 3.05, 0.0, 0.0), (4, 5.0, 5.0, 5.0)], "point long, x double, y double, z double")
    got = {r.point: (r.element, r.status) for r in mesh.locate_points(points, elements, "point", "element", ["x", "y", "z"], "anchors", 2, 1.0, 0.1).collect()}
    assert got == {1: (10, 1), 2: (11, 1), 3: (11, 0)}


def test_grid_interpolation_of_a_plane(spark):
    t = spark.createDataFrame([(i, j, 2.0 * i + 3 * j) for i in range(4) for j in range(3)], "x int, y int, v double")
    p = spark.createDataFrame([(1, 0.5, 1.5), (2, -9.0, 0.0), (3, 99.0, 99.0), (4, 3.0, 2.0)], "id long, x double, y double")
    got = {r.id: r.out for r in mesh.grid_interpolate(p, "id", {"x": (0.0, 1.0, 4), "y": (0.0, 1.0, 3)}, t, "v", "out").collect()}
    assert got == {1: pytest.approx(5.5), 2: 0.0, 3: 12.0, 4: 12.0}


def test_groups_and_joins(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, None), ("b", 1.0, 2.0), ("b", 1.0, None)], "k string, lat double, lon double")
    good, bad = checks.consistent_groups(df, ["k"], ["lat", "lon"])
    assert good.count() == 2 and [r.k for r in bad.collect()] == ["b"]
    with pytest.raises(ValueError, match="'b'"):
        checks.require_consistent(df, ["k"], ["lat", "lon"])
    left = spark.createDataFrame([("a",), ("c",)], "k string")
    assert checks.match_report(left, df, ["k"])[1].first().k == "c"
    assert checks.exactly_one(left.filter("k = 'a'"), df.limit(1), ["k"]).count() == 1
    for wrong in (left, left.filter("k = 'a'")):
        with pytest.raises(Exception, match="not exactly one"):
            checks.exactly_one(wrong, df, ["k"]).collect()
    assert checks.exclude_globs(df, {"k": ["a*", "?x"]}).count() == 2 and checks.exclude_globs(df, {}).count() == 4
    h = spark.createDataFrame([("s", "BH1", 5.0), ("s", "BH2", 350.0), ("t", "BHE", 90.0), ("t", "BHN", 81.0), ("u", "BHE", 90.0)], "sta string, code string, az double")
    assert [(r.sta, r.first, r.second) for r in checks.oriented_pairs(h, ["sta"], "code", "az").collect()] == [("s", "1", "2")]


def test_station_scan(spark):
    row = lambda sta, ch, start=0.0, n=40: (sta, ch, start, 2.0, [float(i) for i in range(n)])
    rows = [row("a", c) for c in "ENZ"] + [row("b", c, 0.5 if c == "N" else 0.0) for c in "ENZ"] + [row("c", "Z")] + [row("d", c, n=40 if c == "Z" else 41) for c in "ENZ"] + [row("e", c) for c in "ENZ"]
    df = spark.createDataFrame(rows, "sta string, channel string, starttime double, rate double, samples array<double>")
    good, bad = records.three_components(df, ["sta"])
    assert {r.sta for r in good.collect()} == {"a", "e"} and {r.sta: r.reason for r in bad.collect()} == {"b": "starts differ", "c": "not three channels", "d": "lengths differ"}
    allow = spark.createDataFrame([("a",), ("b",)], "sta string")
    cut = records.event_waveforms(df, ["sta"], allow, F.lit(2.2), F.lit(10.0)).collect()
    assert [(r.sta, r.npts, r.starttime, r.trace1[0]) for r in cut] == [("a", 16, 2.0, 4.0)]
    assert records.event_waveforms(df, ["sta"], None, F.lit(2.0), F.lit(99.0)).count() == 0
    tapered = records.event_waveforms(df, ["sta"], allow, F.lit(0.0), F.lit(20.0), F.lit(4)).first()
    assert tapered.trace3[0] == tapered.trace3[-1] == 0 and tapered.trace3[20] == 20
    assert records.synthetic_difference(good, good, ["sta"]).first().trace1 == [0.0] * 40


def test_cartesian_source_files(spark, tmp_path):
    mt = [1e18, 2e17, 0.0, 2e17, -4e17, 1e17, 0.0, 1e17, -6e17]
    df = spark.createDataFrame([("PDE 2020 1 1", "E", 2.5, [6e6, 1e6, 2e6], mt)], "header string, id string, tau double, xs array<double>, mt array<double>")
    (tmp_path / "s.txt").write_text(sinks.ecef_source_text(df, "_dxs").first().value)
    r = text.read_source_ecef(spark, str(tmp_path / "s.txt")).first()
    assert (r.id, r.tau, r.x, r.mxy, r.mzz) == ("E_dxs", 2.5, 6e6, 2e17, -6e17) and r.header == "PDE 2020 1 1"
    assert r.mrr + r.mtt + r.mpp == pytest.approx(0, abs=1e9) and r.m0 == pytest.approx(math.sqrt(sum(x * x for x in mt) / 2))
    moved = one(df, src.scalar_moment(src.moved_tensor(F.col("mt"), F.reverse("mt"), F.lit(0.3))), src.scalar_moment(F.col("mt")))[0]
    assert moved[0] == pytest.approx(moved[1])
    dxs, dmt = one(df, *src.search_directions(F.col("xs"), F.col("mt"), F.array(*[F.lit(0.0)] * 3), F.reverse("mt"), 5.0, 0.1))[0]
    assert dxs == [0.0] * 3 and sum(a * b for a, b in zip(dmt, mt)) == pytest.approx(0, abs=1e22)


def test_text_tables_and_adjoint_lines(spark, tmp_path):
    (tmp_path / "st.txt").write_text("# c\n AAA  N  1.5 2.5   0 0\n\nBBB M -3 4 5 6\n")
    assert [(r.station, r.network, r.depth) for r in text.read_stations(spark, str(tmp_path / "st.txt")).collect()] == [("AAA", "N", 0.0), ("BBB", "M", 6.0)]
    (tmp_path / "w.txt").write_text("a, b ,,c\n#x\n")
    assert text.read_words(spark, str(tmp_path / "w.txt")).first().parts == ["a", "b", "c"]
    for i, extra in enumerate(("", ",z")):
        (tmp_path / f"{i}.csv").write_text(f"a,b{extra}\n1,2{',3' if extra else ''}\n")
    assert [(r.a, r.z) for r in text.read_statistics(spark, [str(tmp_path / f"{i}.csv") for i in (0, 1)]).orderBy("z").collect()] == [(1, None), (1, 3)]
    df = spark.createDataFrame([("N.S.Z", [0.0, 2.0, 4.0], 1.0, 2.0)], "name string, u array<double>, b double, r double")
    lines = sinks.adjoint_texts(df, "u", "b", "r", F.lit(0.75), 0.25, 5)
    assert [tuple(map(float, x.split())) for x in lines.first().value.split("\n")] == [(0.75, 0.0), (1.0, 0.0), (1.25, 1.0), (1.5, 2.0), (1.75, 3.0)]
    sinks.write_texts(lines, str(tmp_path / "adj"), "name")
    assert spark.read.text(str(tmp_path / "adj")).count() == 5


def test_archive_reads(spark):
    import datetime as dt

    t = dt.datetime(2020, 1, 1, 23, 59, 50)
    rows = [("N", "S", "", "Z", t, 1.0, 10, [float(i) for i in range(10)]), ("N", "S", "", "Z", t + dt.timedelta(seconds=10), 1.0, 5, [50.0] * 5), ("N", "S", "", "Z", t + dt.timedelta(seconds=40), 1.0, 3, [9.0] * 3)]
    df = spark.createDataFrame(rows, "network string, station string, location string, channel string, starttime timestamp_ntz, samp_rate double, npts int, samples array<double>")
    merged = sorted((r.starttime, r.npts) for r in archive.merge_adjacent(df).collect())
    assert merged == [(t, 15), (t + dt.timedelta(seconds=40), 3)]
    cut = archive.trim(df, "2020-01-01 23:59:53.5", "2020-01-02 00:00:01").orderBy("starttime").collect()
    assert [(r.npts, r.samples[0]) for r in cut] == [(6, 4.0), (2, 50.0)]
    ask = spark.createDataFrame([("N", "S", "", "Z", t + dt.timedelta(seconds=12), t + dt.timedelta(seconds=20)), ("N", "S", "", "Z", t + dt.timedelta(seconds=13), t + dt.timedelta(seconds=14))], "network string, station string, location string, channel string, start timestamp_ntz, end timestamp_ntz")
    assert [r.npts for r in archive.read_bulk(df, ask).collect()] == [5]
    have = spark.createDataFrame([("S", 10, 20), ("S", 30, 40)], "k string, start long, end long")
    want = spark.createDataFrame([("S", 5, 35), ("S", 15, 25), ("T", 1, 2), ("S", 50, 60), ("S", 60, 70)], "k string, start long, end long")
    assert sorted((r.k, r.gap_start, r.gap_end) for r in archive.missing(want, have, ["k"]).collect()) == [("S", 5, 10), ("S", 20, 30), ("S", 50, 70), ("T", 1, 2)]


def test_statistics(spark):
    rng = np.random.default_rng(8)
    x, w = rng.normal(size=(50, 3)), rng.random(50)
    df = spark.createDataFrame([(v.tolist(), float(a)) for v, a in zip(x, w)] + [(None, 1.0)], "v array<double>, w double").repartition(3)
    got = {(r.i, r.j): r.cov for r in aggregates.covariance(df, "v", "w").collect()}
    want = np.cov(x.T, aweights=w, bias=True)
    assert all(c == pytest.approx(want[k]) for k, c in got.items()) and len(got) == 6
    assert aggregates.covariance(df.limit(0), "v", "w").count() == 0
    parts = spark.createDataFrame([("a", 1e16), ("a", 1.0), ("a", -1e16)], "k string, x double")
    assert parts.agg(aggregates.exact_sum(F.col("x"))).first()[0] == 1.0
    edges = aggregates.geometric_edges(100.0, 4)
    assert edges[:2] == [-1.0, 0.0] and edges[-1] == pytest.approx(100)
    knots = spark.createDataFrame([(5.0, 1.0), (0.0, 3.0)], "kx double, ky double")
    p = spark.createDataFrame([(-1.0,), (2.5,), (9.0,), (None,)], "x double")
    assert [r.y for r in joins.interpolate_1d(p, "x", knots, "kx", "ky", "y").collect()] == [3.0, 2.0, 1.0, None]
    with pytest.raises(ValueError):
        joins.interpolate_1d(p, "x", spark.range(10_001).selectExpr("id AS kx", "id AS ky"), "kx", "ky", "y").collect()
    line = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 3.0)], "k string, a int, b double")
    assert aggregates.availability(line.selectExpr("k", "a AS start", "a + 1 AS end"), ["k"], F.lit(0), F.lit(4)).first().share == pytest.approx(0.5)

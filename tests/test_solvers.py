"""Location, sections, relocation, Hessians and spacing against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.operators import locate as L
from tracefold.operators import relocate as R
from tracefold.operators import spacing as P
from tracefold.operators import windows as O

from test_windows import KINDS, WINDOWS, bursts, one_window, window


def box(element, low, size, kind):
    """27 anchors of a cube."""
    return (element, kind, [float(low[d] + size * p[d]) for c in (0, 0.5, 1) for b in (0, 0.5, 1) for a in (0, 0.5, 1) for p in [(a, b, c)] for d in range(3)])


def test_locate_by_boxes(spark):
    rng = np.random.default_rng(0)
    cubes = [(np.array([i, j, k]) * 1.0, 1.0, (i + j) % 2) for i in range(3) for j in range(3) for k in range(3)]
    cubes += [(np.array([3.0, 0.0, 0.0]), 3.0, 0), (np.array([0.4, 0.4, 3.0]), 0.125, 1)]  # one large, one small
    elements = spark.createDataFrame([box(i, *c) for i, c in enumerate(cubes)] + [(99, 0, [1.0] * 81), (98, 0, None)], "element int, kind int, anchors array<double>")
    points = [(i, *map(float, p), -1) for i, p in enumerate(rng.uniform(-0.3, 6.2, (300, 3)))]
    points += [(1000, 0.45, 0.45, 3.05, -1), (1001, 0.5, 0.5, 0.5, 1), (1002, 0.5, 0.5, 0.5, 0), (1003, None, 0.0, 0.0, -1), (1004, -0.05, 0.5, 0.5, -1)]
    df = spark.createDataFrame(points, "point int, x double, y double, z double, kind int")
    got = {r.point: r for r in L.locate_by_boxes(df, elements, "point", "element", ["x", "y", "z"], "anchors", 0.1, same="kind").collect()}
    for i, x, y, z, kind in points:
        holders = [] if x is None else [e for e, (low, size, k) in enumerate(cubes) if kind in (-1, k) and (low <= [x, y, z]).all() and ([x, y, z] <= low + size).all()]
        if holders:
            assert got[i].status == 1 and got[i].element in holders
            low, size, _ = cubes[got[i].element]
            assert np.allclose([got[i].local1, got[i].local2, got[i].local3], (np.array([x, y, z]) - low) / size * 2 - 1)
        elif i in got:
            assert got[i].status == 0 and got[i].misloc <= 0.1
    assert got[1000].element == 28 and 1001 not in got and got[1002].element == 0 and 1003 not in got
    assert got[1004].status == 0 and got[1004].element == 0 and got[1004].misloc == pytest.approx(0.05)
    assert L.locate_by_boxes(df.limit(0), elements, "point", "element", ["x", "y", "z"], "anchors", 0.1).count() == 0
    assert L.locate_by_boxes(df, elements.limit(0), "point", "element", ["x", "y", "z"], "anchors", 0.1).count() == 0


def test_sections(spark):
    for df in (L.great_circle_section(spark, 10.0, 20.0, 75.0, (0.0, 90.0, 4), (2.0, 3.0, 2)), L.vertical_section(spark, (10.0, 20.0), (-40.0, 80.0), 4, (2.0, 3.0, 2))):
        rows = df.orderBy("point").collect()
        assert len(rows) == 8
        p = np.array([[r.x, r.y, r.z] for r in rows])
        assert np.allclose(np.linalg.norm(p, axis=1), [r.radius for r in rows])
        normal = np.cross(p[0], p[2])
        assert np.allclose(p @ normal / np.linalg.norm(normal), 0, atol=1e-9)  # all in one plane through the centre
        cosine = (p[0] @ p[6]) / np.linalg.norm(p[0]) / np.linalg.norm(p[6])
        assert np.degrees(np.arccos(cosine)) == pytest.approx(rows[6].angle)
    small = np.array([[r.x, r.y, r.z] for r in L.small_circle_section(spark, (90.0, 0.0), (30.0, 0.0), (0.0, 90.0, 2), (1.0, 1.0, 1)).orderBy("point").collect()])
    assert np.allclose(small, [[np.sqrt(0.75), 0, 0.5], [0, np.sqrt(0.75), 0.5]])


def test_relocation_without_enough_rays(spark):
    rays = [(1, 10.0 * i, 30.0, 500.0, 2.0, 1.0) for i in range(8)] + [(2, 0.0, 30.0, 500.0, 1.5, 1.0), (3, None, 30.0, 500.0, 1.0, 1.0)]
    df = spark.createDataFrame(rays, "ev int, az double, to double, p double, s double, w double")
    c, f = F.col, F.lit
    got = {r.ev: r for r in R.relocate(df, ["ev"], c("az"), c("to"), c("p"), c("s"), c("w"), f(10.0), f(20.0), f(100.0)).collect()}
    # one takeoff angle does not tell depth from time; all shifts are explained
    assert sorted(got) == [1, 2] and got[1].rank == 3 and got[2].rank == 1
    for r in got.values():
        assert r.residual_mean == pytest.approx(0, abs=1e-9) and r.residual_std == pytest.approx(0, abs=1e-9)
    still = R.relocate(df.withColumn("s", f(0.0)), ["ev"], c("az"), c("to"), c("p"), c("s"), c("w"), f(10.0), f(20.0), f(100.0)).filter("ev = 1").first()
    assert (still.latitude, still.longitude, still.depth) == (pytest.approx(10.0), pytest.approx(20.0), pytest.approx(100.0))
    assert R.relocate(df.limit(0), ["ev"], c("az"), c("to"), c("p"), c("s"), c("w"), f(10.0), f(20.0), f(100.0)).count() == 0


def test_hessian(spark):
    rng = np.random.default_rng(6)
    n, rate = 200, 2.0
    freq = np.fft.rfftfreq(4096, 1 / rate)
    slow = lambda x: np.fft.irfft(np.fft.rfft(x, 4096) * (freq < 0.45), 4096)[:, :n]
    obs, syn, change = bursts(rng, n), bursts(rng, n), [slow(bursts(rng, n)), slow(bursts(rng, n))]
    w = [window(0, "F", 0.05, 0.3, 22.0, 71.0, 3), window(1, "R", 0.1, 0.4, 30.0, 70.0)]
    row = [0, *[r.tolist() for r in [*obs, *syn]], rate, w, [np.concatenate(c).tolist() for c in change], 2.0]
    schema = f"sta int, {KINDS}, rate double, {WINDOWS}, derivatives array<array<double>>, tau double"
    df = spark.createDataFrame([row, [1, *row[1:9], [[1.0]], 2.0]], schema)
    got = {r.sta: r.windows for r in O.source_hessian(df, source_terms=True).collect()}
    assert [x.hessian for x in got[1]] == [None, None]
    names = [c.split(":")[0] for c in WINDOWS.split("struct<")[1].rstrip(">").split(",")]

    def score(v, told):
        """CC0 with the synthetic moved to second order in none but the trace changes: the parameters act linearly."""
        s0 = np.fft.irfft(np.fft.rfft(syn, 4096) * (-2j * np.pi * freq) * v[2] + np.fft.rfft(syn, 4096) * (-2 * (np.pi * freq) ** 2 * 2.0) * v[3], 4096)[:, :n]
        # the source's own changes pass its spectrum, those of the other parameters do not
        return one_window(obs, syn + s0 + unsourced(v[0] * change[0] + v[1] * change[1]), dict(zip(names, told)), rate, 8.0, False, 2.0, None)["cc0"]

    def unsourced(x):
        gauss = np.exp(-((np.pi * freq * 2.0) ** 2))
        return np.fft.irfft(np.fft.rfft(x, 4096) * np.where(freq < 0.45, 1 / gauss, 0), 4096)[:, :n]

    h = 1e-3
    for told, r in zip(w, got[0]):
        found = np.array(r.hessian).reshape(4, 4)
        assert np.allclose(found, found.T)
        for i, j in ((0, 0), (0, 1), (2, 2), (0, 3), (2, 3)):
            e = np.eye(4) * h
            if i == j:
                numeric = (score(e[i], told) - 2 * score(e[i] * 0, told) + score(-e[i], told)) / h**2
            else:
                numeric = (score(e[i] + e[j], told) - score(e[i] - e[j], told) - score(e[j] - e[i], told) + score(-e[i] - e[j], told)) / (4 * h * h)
            assert found[i, j] == pytest.approx(numeric, rel=0.05, abs=0.02), (told[0], i, j)


def one_by_one(points, existing, least):
    d = {i: min(np.linalg.norm(p - e) for e in existing) for i, p in points.items()}
    out = {}
    while d := {i: v for i, v in d.items() if v >= least}:
        best = min(d, key=lambda i: (-d[i], i))
        out[best] = d.pop(best)
        d = {i: min(v, np.linalg.norm(points[i] - points[best])) for i, v in d.items()}
    return out


def test_farthest_first(spark):
    rng = np.random.default_rng(2)
    places = np.concatenate([rng.normal(size=(30, 3)), rng.normal(size=(20, 3)) * 0.05 + 4, np.repeat(rng.normal(size=(3, 3)), 3, axis=0), [[i, 8.0, 0.0] for i in range(8)]])
    points = dict(enumerate(places))
    existing = [np.zeros(3), np.array([1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in points.items()] + [(500, None, 0.0, 0.0)], "id long, x double, y double, z double")
    old = spark.createDataFrame([tuple(map(float, e)) for e in existing], "x double, y double, z double")
    got = {r.id: r.distance for r in P.farthest_first(df, old, "id", ["x", "y", "z"], 0.7).collect()}
    assert got == pytest.approx(one_by_one(points, existing, 0.7))
    assert P.farthest_first(df, old.limit(0), "id", ["x", "y", "z"], 0.7).count() == 0
    with pytest.raises(ValueError):
        P.farthest_first(df, old, "id", ["x", "y", "z"], 0.0)

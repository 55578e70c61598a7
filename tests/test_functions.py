import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.functions import fields, signal, tapers
from tracefold.operators import aggregates, joins, optimize, smoothing


def test_taper_corners(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (12.5,), (15.0,), (None,)], "x double")
    got = [r[0] for r in df.select(tapers.cosine_taper(F.col("x"), [10, 15])).collect()]
    assert got[:2] == [0, 0] and got[2] == pytest.approx(0.5) and got[3] == 1 and got[4] is None
    right = [r[0] for r in df.select(tapers.cosine_taper(F.col("x"), [15, 10])).collect()]
    assert right[:2] == [1, 1] and right[2] == pytest.approx(0.5) and right[3] == 0
    for bad in ([1, 1], [1, 2, 2, 3], [1, 2, 3]):
        with pytest.raises(ValueError):
            tapers.cosine_taper(F.col("x"), bad)


def test_expression_allow_list(spark):
    df = spark.createDataFrame([(4.0, 3.0)], "a double, b double")
    assert df.select(fields.field_expression("sqrt(a) + b * 2", df.columns)).first()[0] == 8.0
    for bad in ("c + 1", "java_method('x')", "a; b", "reflect(a)", "`a`"):
        with pytest.raises(ValueError):
            fields.field_expression(bad, df.columns)


def test_filter_response():
    f = np.array([0.0, 0.01, 0.03, 0.9])
    h = signal.band_response(f, 2.0, 4, 0.01, 0.03)
    assert h[0] == 0 and h[1] ** 2 == pytest.approx(0.5) and h[2] ** 2 == pytest.approx(0.5) and h[3] < 1e-6


def test_lag_search(spark):
    n, shift = 256, 7
    t = np.arange(n)
    pulse = lambda c: np.exp(-((t - c) ** 2) / 50.0)
    df = spark.createDataFrame([(pulse(100 + shift).tolist(), pulse(100).tolist()), ([0.0] * 8, [1.0] * 8)], "u array<double>, v array<double>")
    rows = df.select(signal.cc_lag_search(2.0, 20.0)("u", "v").alias("b")).select("b.*").collect()
    assert rows[0].lag == pytest.approx(shift / 2.0) and rows[0].cc == pytest.approx(1.0, abs=1e-6)
    assert rows[1].lag is None


def test_resample_keeps_a_slow_wave(spark):
    x = np.sin(2 * np.pi * 0.05 * np.arange(200) / 2.0)
    df = spark.createDataFrame([(x.tolist(),)], "u array<double>")
    y = np.array(df.select(signal.lanczos_resample(2.0, 4.0)("u")).first()[0])
    want = np.sin(2 * np.pi * 0.05 * np.arange(len(y)) / 4.0)
    assert np.abs(y - want)[60:-60].max() < 1e-3


def test_islands_with_a_nested_interval(spark):
    df = spark.createDataFrame([("a", 0, 100), ("a", 10, 20), ("a", 101, 120), ("a", 200, 210)], "k string, s long, e long")
    got = aggregates.islands(df, ["k"], F.col("s"), F.col("e"), F.lit(1))
    assert sorted((r.start, r.end, r.members) for r in got.collect()) == [(0, 120, 3), (200, 210, 1)]
    assert [(r.gap_start, r.gap_end) for r in aggregates.gaps(got, ["k"]).collect()] == [(120, 200)]


def test_radius_join_is_complete(spark):
    rng = np.random.default_rng(3)
    p = rng.random((120, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    got = {(r.a_id, r.b_id) for r in joins.radius_join(df, df, "id", "id", ["x", "y", "z"], 0.2).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert got == {(int(a), int(b)) for a, b in np.argwhere(d <= 0.2)}


def test_rule_list_is_checked(spark):
    with pytest.raises(ValueError):
        joins.short_list(spark.range(20), limit=10)


def test_lbfgs_solves_a_quadratic(spark):
    """Two steps of a two-dimensional quadratic give the exact direction to its top."""
    h = np.diag([2.0, 5.0])
    s = np.array([[1.0, 0.3], [0.2, 1.0]])
    y = s @ h
    g = np.array([1.0, 2.0])
    rows = [(float(g[i]), float(s[0, i]), float(y[0, i]), float(s[1, i]), float(y[1, i])) for i in range(2)]
    df = spark.createDataFrame(rows, "g double, s0 double, y0 double, s1 double, y1 double")
    out = optimize.lbfgs_direction(df, F.lit(1.0), F.col("g"), [(F.col("s0"), F.col("y0")), (F.col("s1"), F.col("y1"))])
    got = np.array([r.direction for r in out.collect()])
    # the same recursion in numpy
    q, al = g.copy(), []
    for k in range(2):
        rho = 1 / (y[k] @ s[k])
        a = rho * (s[k] @ q)
        q = q - a * y[k]
        al.append((rho, a, k))
    q = q * (s[0] @ y[0]) / (y[0] @ y[0])
    for rho, a, k in reversed(al):
        q = q + s[k] * (a - rho * (y[k] @ q))
    assert np.allclose(got, q)


def test_diffusion_keeps_the_sum(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 2.0), (3, 7.0)], "id long, u double")
    links = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5)], "a long, b long, k double")
    got = {r.id: r.u for r in smoothing.diffusion_step(df, links, "id", "u", "k", 0.1).collect()}
    assert math.isclose(sum(got.values()), 15.0) and got[3] == 7.0 and got[0] == pytest.approx(1.4)

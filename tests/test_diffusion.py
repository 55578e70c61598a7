"""Smoothing on a mesh against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.functions import gll
from tracefold.operators import diffusion as D

N, SIDE = 3, 2


def bent(u, v, w):
    """Where the lattice place (u, v, w) lies: a sheared and slightly curved block away from the origin."""
    return np.array([u + 0.1 * v * w, v + 0.05 * u * u, 4 + w + 0.1 * u])


def mesh():
    """2 x 2 x 2 elements of 27 points: (block, element, nodes, anchors), a block for each layer."""
    width = SIDE * (N - 1) + 1
    rows = []
    for k in range(SIDE):
        for j in range(SIDE):
            for i in range(SIDE):
                nodes = [((k * (N - 1) + c) * width + j * (N - 1) + b) * width + i * (N - 1) + a for c in range(N) for b in range(N) for a in range(N)]
                anchors = [x for c in (0, 0.5, 1) for b in (0, 0.5, 1) for a in (0, 0.5, 1) for x in bent(i + a, j + b, k + c)]
                rows.append((k, (k * SIDE + j) * SIDE + i, nodes, [float(x) for x in anchors]))
    return rows


def dense(rows, kh, kv):
    """Mass and stiffness, from the gradients of the basis functions at every point."""
    size = max(max(r[2]) for r in rows) + 1
    mass, stiff = np.zeros((size, size)), np.zeros((size, size))
    x, w = gll.nodes_and_weights(N)
    for _, _, nodes, anchors in rows:
        for c in range(N):
            for b in range(N):
                for a in range(N):
                    place, jac = gll.hexahedron(np.array([[x[a], x[b], x[c]]]), np.array(anchors).reshape(1, 27, 3))
                    volume = abs(np.linalg.det(jac[0])) * w[a] * w[b] * w[c]
                    la, lb, lc = (np.eye(N)[q] for q in (a, b, c))
                    d = gll.derivative_matrix(N)
                    local = np.array([[d[a][i] * lb[j] * lc[k], la[i] * d[b][j] * lc[k], la[i] * lb[j] * d[c][k]] for k in range(N) for j in range(N) for i in range(N)])
                    grad = local @ np.linalg.inv(jac[0])
                    up = place[0] / np.linalg.norm(place[0])
                    tensor = kh * np.eye(3) + (kv - kh) * np.outer(up, up)
                    stiff[np.ix_(nodes, nodes)] += volume * grad @ tensor @ grad.T
                    mass[nodes[(c * N + b) * N + a], nodes[(c * N + b) * N + a]] += volume
    return mass, stiff


@pytest.mark.parametrize("kind,sigma,vertical,steps,implicit", [("gauss", 0.5, 0.2, 1, 0.5), ("bessel", 0.5, None, 1, 1.0)])
def test_smooth_mesh(spark, kind, sigma, vertical, steps, implicit):
    rows = mesh()
    elements = spark.createDataFrame(rows, "block long, element long, nodes array<long>, anchors array<double>").repartition(3)
    mass, stiff = dense(rows, sigma**2 / 2, (vertical or sigma) ** 2 / 2)
    u = np.random.default_rng(1).normal(size=len(mass))
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(u)] + [(9999, 5.0)], "node long, v double")
    got = {r.node: r.v for r in D.smooth_mesh(elements, values, "node", "v", F.lit(sigma), None if vertical is None else F.lit(vertical), kind, steps, 0.5, implicit, N, tolerance=1e-13).collect()}
    want = u
    for dt in D.step_lengths(steps, 0.5):
        want = np.linalg.solve(mass + implicit * dt * stiff, (mass - (1 - implicit) * dt * stiff) @ want)
    assert sorted(got) == list(range(len(u)))
    assert np.allclose([got[i] for i in range(len(u))], want, atol=1e-5)
    assert mass.diagonal() @ [got[i] for i in range(len(u))] == pytest.approx(mass.diagonal() @ u, abs=1e-5)


def test_variable_width_and_odd_meshes(spark):
    rows = mesh()
    schema = "block long, element long, nodes array<long>, anchors array<double>"
    elements = spark.createDataFrame(rows, schema)
    values = spark.createDataFrame([(i, float(i % 7)) for i in range(125)], "node long, v double")
    plain = {r.node: r.v for r in D.smooth_mesh(elements, values, "node", "v", F.lit(0.4), n=N, steps=1).collect()}
    same = {r.node: r.v for r in D.smooth_mesh(elements, values, "node", "v", F.array_repeat(F.lit(0.4), N**3), kind="bessel", n=N).collect()}
    assert plain == pytest.approx(same)
    still = {r.node: r.v for r in D.smooth_mesh(elements, values, "node", "v", F.lit(0.0), kind="bessel", n=N).collect()}
    assert still == pytest.approx({i: float(i % 7) for i in range(125)})
    assert D.smooth_mesh(elements.limit(0), values, "node", "v", F.lit(0.4), kind="bessel", n=N).count() == 0
    back = D.apply_mesh(elements, spark.createDataFrame(list(plain.items()), "node long, v double"), "node", "v", F.lit(0.4), n=N)
    assert {r.node: r.v for r in back.collect()} == pytest.approx({i: float(i % 7) for i in range(125)}, abs=1e-3)
    assert sum(D.step_lengths(5, 0.25)) == pytest.approx(1) and D.step_lengths(5, 0.25)[0] == pytest.approx(D.step_lengths(5, 0.25)[-1] / 4)
    with pytest.raises(ValueError):
        D.smooth_mesh(elements, values, "node", "v", F.lit(0.4), kind="box")


def test_partitions_grow_with_the_mesh(spark, monkeypatch):
    """A partition is a batch as a whole, so it holds few blocks however many there are; the result does not depend on it."""
    monkeypatch.setattr(D, "PART", 6000, raising=False)
    copies, rows = 4, [(r[1], *r[1:]) for r in mesh()]  # a block for each element
    many = [(b + 8 * k, e + 8 * k, [n + 125 * k for n in nodes], anchors) for k in range(copies) for b, e, nodes, anchors in rows]
    elements = spark.createDataFrame(many, "block long, element long, nodes array<long>, anchors array<double>").repartition(2)
    u = np.arange(125.0) % 7
    values = spark.createDataFrame([(i, float(u[i % 125])) for i in range(125 * copies)], "node long, v double")
    op = D.MeshOperator(elements, F.lit(0.08), n=N)
    vector = op.vector(values, "node", "v")
    for df in (op.static, vector, op.local(vector, "x", 1.0)):
        held = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == 8 * copies and max(held) <= 7
    op.close()
    mass, stiff = dense(rows, 0.08, 0.08)
    got = {r.node: r.v for r in D.smooth_mesh(elements, values, "node", "v", F.lit(0.4), kind="bessel", n=N).collect()}
    assert np.allclose([got.pop(i) for i in range(125 * copies)], np.tile(np.linalg.solve(mass + stiff, mass @ u), copies), atol=1e-4) and not got

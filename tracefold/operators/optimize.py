"""Search and update directions over sharded fields: all dot products of a step in one aggregate."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import stacked


def dots(df: DataFrame, volume: Column, pairs: dict[str, tuple[Column, Column]]) -> dict[str, float]:
    """Volume-weighted inner products, by name."""
    row = df.agg(*[F.sum(volume * a * b).alias(n) for n, (a, b) in pairs.items()]).first()
    return {n: row[n] or 0.0 for n in pairs}


def cg_direction(df: DataFrame, volume: Column, new: Column, old: Column, direction: Column, kind: str = "HS", precondition: Column | None = None, out: str = "direction") -> DataFrame:
    """Ascent direction of nonlinear conjugate gradients: Pg+ - beta d; HS, PR or SD.

    With y = g+ - g, beta is <Pg+, y> / <d, y> for HS and -<Pg+, y> / <g, g> for PR, whose
    denominator has the other sign when climbing. A direction that does not climb falls back to Pg+.
    """
    p = F.lit(1.0) if precondition is None else precondition
    y = new - old
    d = dots(df, volume, {"py": (p * new, y), "dy": (direction, y), "gg": (old, old), "pg": (p * new, new), "dg": (direction, new)})
    beta = {"HS": d["py"] / d["dy"] if d["dy"] else 0.0, "PR": -d["py"] / d["gg"] if d["gg"] else 0.0, "SD": 0.0}[kind]
    if d["pg"] - beta * d["dg"] <= 0:
        beta = 0.0
    return df.withColumn(out, p * new - beta * direction)


def steepest_descent(df: DataFrame, gradients: list[Column], scale: float, mask: Column | None = None) -> DataFrame:
    """``df`` with dmodel0, …: each gradient times the mask and the scale."""
    m = F.lit(float(scale)) if mask is None else mask * scale
    return df.withColumns({f"dmodel{i}": m * g for i, g in enumerate(gradients)})


def lbfgs_direction(df: DataFrame, volume: Column, gradient: Column, steps: list[tuple[Column, Column]], out: str = "direction", mask: Column | None = None) -> DataFrame:
    """Two-loop recursion over (model difference, gradient difference), newest first.

    The result is a combination of the columns given. Their inner products are taken once, in
    one aggregate, and the loops run over those few numbers on the driver. A ``mask`` is applied to the
    first guess of the Hessian, between the loops, which doubles the columns.
    """
    basis = [gradient, *[c for s, y in steps for c in (s, y)]]
    n = len(basis)
    pairs = {f"{i}_{j}": (basis[i], basis[j]) for i in range(n) for j in range(i, n)}
    if mask is not None:
        pairs |= {f"{i}_{n + j}": (basis[i], mask * basis[j]) for i in range(n) for j in range(n)}
        basis = basis + [mask * b for b in basis]
    got = dots(df, volume, pairs)
    ip = lambda a, b: sum(x * z * got[f"{min(i, j)}_{max(i, j)}"] for i, x in enumerate(a) for j, z in enumerate(b) if x and z)
    unit = lambda k: [float(i == k) for i in range(len(basis))]
    q, alphas = unit(0), []
    for k in range(len(steps)):
        s, y = unit(1 + 2 * k), unit(2 + 2 * k)
        rho = 1 / ip(y, s)
        a = rho * ip(s, q)
        q = [u - a * v for u, v in zip(q, y)]
        alphas.append((rho, a, s, y))
    if steps:
        s, y = unit(1), unit(2)
        gamma = ip(s, y) / ip(y, y)
        q = [gamma * u for u in q]
    if mask is not None:
        q = [0.0] * n + q[:n]
    for rho, a, s, y in reversed(alphas):
        b = rho * ip(y, q)
        q = [u + (a - b) * v for u, v in zip(q, s)]
    total = sum(F.lit(c) * col for c, col in zip(q, basis))
    return df.withColumn(out, total)


def rescale(df: DataFrame, columns: list[str], target: float) -> DataFrame:
    """Scale the columns together so that their largest amplitude is the target."""
    tops = df.agg(*[F.max(F.abs(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    top = max((t for t in tops if t is not None), default=0.0) or 1.0
    return df.withColumns({c: F.col(c) * (target / top) for c in columns})


def argmax(df: DataFrame, value: str, axes: list[str]) -> DataFrame:
    """The axes of the largest value; of equal ones the first in the order of the axes."""
    best = F.max_by(F.struct(*axes, value), F.struct(value, *[(-F.col(a)).alias(f"_{a}") for a in axes]))
    return df.agg(best.alias("b")).select("b.*")


def spline(x: np.ndarray, y: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """The cubic spline through (x, y) along the first axis, with a continuous third derivative at the
    second and the last but one knot, at the places ``fine``."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, h = len(x), np.diff(x)
    a, r = np.zeros((n, n)), np.zeros_like(y)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, r.reshape(n, -1)).reshape(r.shape)  # second derivatives
    i = np.clip(np.searchsorted(x, fine, "right") - 1, 0, n - 2)
    shape = (-1,) + (1,) * (y.ndim - 1)
    w, v, g = (fine - x[i]).reshape(shape), (x[i + 1] - fine).reshape(shape), h[i].reshape(shape)
    return (m[i] * v**3 + m[i + 1] * w**3) / (6 * g) + (y[i] / g - m[i] * g / 6) * v + (y[i + 1] / g - m[i + 1] * g / 6) * w


def shifted_sums(rows: DataFrame, rate: float, shifts: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, float]:
    """(weighted sums of similarity by shift and step, sum of weights) over rows (obs, syn, change, weight).

    The synthetic syn + step·change is moved by a phase shift. A task sends on one number per cell.
    """
    shifts, steps = np.asarray(shifts, float), np.asarray(steps, float)

    @F.pandas_udf("array<double>")
    def cells(obs: pd.Series, syn: pd.Series, change: pd.Series, weight: pd.Series) -> pd.Series:
        out = [None] * len(obs)
        for at, o, u, v in stacked(obs, syn, change):
            n = 1 << int(np.ceil(np.log2(2 * o.shape[1])))
            turn = np.exp(-2j * np.pi * np.fft.rfftfreq(n, 1 / rate)[None] * shifts[:, None])
            moved = lambda x: np.fft.irfft(np.fft.rfft(x, n)[:, None] * turn, n)[:, :, : x.shape[1]]
            with np.errstate(divide="ignore", invalid="ignore"):
                ou, ov = (np.einsum("rt,rst->rs", o, moved(x)) for x in (u, v))
                uu, uv, vv = ((a * b).sum(axis=1)[:, None, None] for a, b in ((u, u), (u, v), (v, v)))
                size = np.sqrt((o * o).sum(axis=1))[:, None, None] * np.sqrt(uu + 2 * steps * uv + steps * steps * vv)
                cc = (ou[:, :, None] + steps * ov[:, :, None]) / size
            for i, row in zip(at.tolist(), np.nan_to_num(cc).reshape(len(at), -1)):
                out[i] = row * weight.iloc[i]
        return pd.Series(out)

    told = rows.select(cells("obs", "syn", "change", "weight").alias("c"), "weight")
    sums = told.select(*[F.get("c", F.lit(i)).alias(f"c{i}") for i in range(len(shifts) * len(steps))], "weight")
    one = sums.agg(*[F.sum(c) for c in sums.columns]).first()
    return np.array([x or 0.0 for x in one[:-1]]).reshape(len(shifts), len(steps)), one[-1] or 0.0


def refined_search(
    sums: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float]], box: dict[str, tuple[float, float]],
    rounds: int = 5, coarse: int = 5, fine: int = 100, shrink: float = 0.618,
) -> tuple[float, float, float]:
    """(first, second, mean similarity) at the best of two parameters given as (start, half width).

    Each round sums a coarse grid in one job, refines it by splines both ways on the driver (a few numbers),
    moves to the best cell (the first of equal ones) and shrinks the box.
    """
    (a, ra), (b, rb) = box.values()
    top = 0.0
    for _ in range(rounds):
        x, y = np.linspace(a - ra, a + ra, coarse), np.linspace(b - rb, b + rb, coarse)
        values, weight = sums(x, y)
        fx, fy = np.linspace(x[0], x[-1], fine), np.linspace(y[0], y[-1], fine)
        smooth = spline(y, spline(x, values, fx).T, fy).T
        i, j = np.unravel_index(np.argmax(smooth), smooth.shape)
        a, b, top = fx[i], fy[j], smooth[i, j] / weight if weight else 0.0
        ra, rb = shrink * ra, shrink * rb
    return a, b, top

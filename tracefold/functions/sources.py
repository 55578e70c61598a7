"""Source parameters: tensors, search directions and updates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scalar_moment(tensor: Column) -> Column:
    return F.sqrt(inner(tensor, tensor) / 2)


def rtp_to_xyz(m: list[Column], x: Column, y: Column, z: Column, inverse: bool = False) -> list[Column]:
    """(11, 22, 33, 12, 13, 23) of a symmetric tensor from the r, theta, phi frame of a place to x, y, z (or back)."""
    r, h = F.sqrt(x * x + y * y + z * z), F.sqrt(x * x + y * y)
    st, ct, sp, cp = h / r, z / r, y / h, x / h
    zero = F.lit(0.0)
    a = [[st * cp, ct * cp, -sp], [st * sp, ct * sp, cp], [ct, -st, zero]]
    if inverse:
        a = [list(c) for c in zip(*a)]
    full = [[m[0], m[3], m[4]], [m[3], m[1], m[5]], [m[4], m[5], m[2]]]
    out = lambda i, j: sum(a[i][k] * full[k][n] * a[j][n] for k in range(3) for n in range(3))
    return [out(i, j) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))]


def search_directions(xs: Column, mt: Column, grad_xs: Column, grad_mt: Column, dxs_norm: float, dmt_ratio: float) -> tuple[Column, Column]:
    """Steps from gradients: of the place scaled to a length, of the tensor (nine numbers) made orthogonal
    to it and scaled to a share of its scalar moment. A gradient of zeros gives a step of zeros."""
    top = lambda g: F.array_max(F.transform(g, lambda x: F.abs(x)))
    scaled = lambda g, by: F.transform(g, lambda x: F.coalesce(F.try_divide(x.cast("double"), by.cast("double")), F.lit(0.0)))
    gx, gm = scaled(grad_xs, top(grad_xs)), scaled(grad_mt, top(grad_mt))
    dxs = F.transform(scaled(gx, F.sqrt(inner(gx, gx))), lambda x: x * dxs_norm)
    along = inner(gm, mt) / inner(mt, mt)
    across = F.zip_with(gm, mt, lambda g, m: g - m * along)
    dmt = F.transform(scaled(across, scalar_moment(across)), lambda x: x * dmt_ratio * scalar_moment(mt))
    return dxs, dmt


def moved_tensor(mt: Column, dmt: Column, step: Column) -> Column:
    """mt + step·dmt with the scalar moment of mt."""
    new = F.zip_with(mt, dmt, lambda a, b: a + step * b)
    return F.transform(new, lambda x: x * scalar_moment(mt) / scalar_moment(new))


def updated_source(xs: Column, mt: Column, t0: Column, tau: Column, dxs: Column, dmt: Column, steps: dict[str, Column]) -> dict[str, Column]:
    """The source after steps xs, mt (along its directions), t0 and tau (seconds); the origin time is rounded to milliseconds."""
    late = F.unix_micros(t0.cast("timestamp")) + F.round(steps["t0"] * 1_000_000).cast("long")
    return {
        "xs": F.zip_with(xs, dxs, lambda a, b: a + steps["xs"] * b), "mt": moved_tensor(mt, dmt, steps["mt"]),
        "t0": F.timestamp_micros(F.round(late / 1000).cast("long") * 1000).cast("timestamp_ntz"), "tau": tau + steps["tau"],
    }

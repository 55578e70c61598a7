"""Relocation of sources by weighted linear least squares over the time shifts of windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G

#: Radius of the sphere to which ray parameters refer (km).
SPHERE_KM = 6371.0
UNKNOWNS = ("north", "east", "down", "time")


def ray_rows(azimuth: Column, takeoff: Column, ray_param: Column, depth: Column, fixed_depth: bool) -> list[Column]:
    """How the arrival time changes as the source moves north, east and down (s/km) and as it is later.

    A negative takeoff angle counts from the other side; ``ray_param`` is in s/rad.
    """
    slowness = ray_param / (SPHERE_KM - depth)
    t = F.radians(takeoff + F.when(takeoff < 0, 180.0).otherwise(0.0))
    a = F.radians(azimuth)
    return [-F.cos(a) * F.sin(t) * slowness, -F.sin(a) * F.sin(t) * slowness, F.lit(0.0) if fixed_depth else -F.cos(t) * slowness, F.lit(1.0)]


def normal_equations(rays: DataFrame, by: list[str], row: list[Column], shift: Column, weight: Column) -> DataFrame:
    """(by, n, g_ij for i <= j, d_i): the sums of the weighted normal equations in one aggregate."""
    w = weight * weight
    sums = {f"g{i}{j}": w * row[i] * row[j] for i in range(4) for j in range(i, 4)} | {f"d{i}": w * row[i] * shift for i in range(4)}
    return rays.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def solved(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, north, east, down, time, rank): the least solution of each group's equations (unknowns that nothing tells of are 0)."""
    schema = ", ".join([*[f"`{c}` {t}" for c, t in sums.select(*by, "n").dtypes], *[f"{u} double" for u in UNKNOWNS], "rank int"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            g = np.zeros((batch.num_rows, 4, 4))
            for i in range(4):
                for j in range(i, 4):
                    g[:, i, j] = g[:, j, i] = number(f"g{i}{j}")
            d = np.stack([number(f"d{i}") for i in range(4)], axis=1)
            # unknowns of unlike units are brought to one scale before small pivots are told from none
            size = np.sqrt(np.maximum(np.einsum("rii->ri", g), 0))
            scale = np.where(size > 0, 1 / np.where(size > 0, size, 1), 0.0)
            value, vector = np.linalg.eigh(g * scale[:, :, None] * scale[:, None, :])
            kept = value > 1e-12 * np.maximum(value.max(axis=1, initial=0.0), 1e-300)[:, None]
            inverse = np.where(kept, 1 / np.where(kept, value, 1), 0.0)
            m = scale * np.einsum("rij,rj,rkj,rk->ri", vector, inverse, vector, d * scale)
            names = [*by, "n"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *map(pa.array, m.T), pa.array(kept.sum(axis=1).astype(np.int32))], names=[*names, *UNKNOWNS, "rank"])

    return sums.mapInArrow(work, schema)


def relocate(
    rays: DataFrame, by: list[str], azimuth: Column, takeoff: Column, ray_param: Column, shift: Column, weight: Column,
    lat: Column, lon: Column, depth: Column, fixed_depth: bool = False,
) -> DataFrame:
    """A row per source: n, the moves (km; time in s), rank, the new place, and mean and deviation of the
    weighted shifts before (data_*) and after (residual_*).

    ``lat``, ``lon`` (geodetic, degrees) and ``depth`` (km) are the source's, alike in all its rows. One aggregate makes the
    normal equations of all sources, 4 x 4 systems are solved in batches, and a second pass over the rays tells the residuals.

    Cases: rays with a null in any of these are left out; a source without others has no row. Where the rays do not tell all
    unknowns apart (``rank`` under 4) the least move is taken; with ``fixed_depth`` the depth stays.
    """
    row = ray_rows(azimuth, takeoff, ray_param, depth, fixed_depth)
    told = rays.select(*by, *[c.alias(f"_r{i}") for i, c in enumerate(row)], shift.alias("_s"), weight.alias("_w"), lat.alias("_lat"), lon.alias("_lon"), depth.alias("_depth")).dropna()
    rows = [F.col(f"_r{i}") for i in range(4)]
    moves = solved(normal_equations(told, by, rows, F.col("_s"), F.col("_w")), by)
    before = F.col("_w") * F.col("_s")
    met = told.join(moves, by)
    after = before - F.col("_w") * sum(r * F.col(u) for r, u in zip(rows, UNKNOWNS))
    first = lambda c: F.min(c).alias(c)
    found = met.groupBy(*by).agg(
        *[first(c) for c in ("n", *UNKNOWNS, "rank", "_lat", "_lon", "_depth")],
        F.avg(before).alias("data_mean"), F.stddev_pop(before).alias("data_std"), F.avg(after).alias("residual_mean"), F.stddev_pop(after).alias("residual_std"),
    )
    a, b = F.radians("_lat"), F.radians("_lon")
    north = [-F.sin(a) * F.cos(b), -F.sin(a) * F.sin(b), F.cos(a)]
    east = [-F.sin(b), F.cos(b), F.lit(0.0)]
    down = [-F.cos(a) * F.cos(b), -F.cos(a) * F.sin(b), -F.sin(a)]
    old = G.to_ecef(F.col("_lat"), F.col("_lon"), -1000 * F.col("_depth"))
    new = [p + 1000 * (F.col("north") * n + F.col("east") * e + F.col("down") * d) for p, n, e, d in zip(old, north, east, down)]
    found = found.withColumns(dict(zip(("_x", "_y", "_z"), new)))
    place = G.from_ecef(F.col("_x"), F.col("_y"), F.col("_z"))
    return found.select(
        *by, "n", *UNKNOWNS, "rank", place[0].alias("latitude"), place[1].alias("longitude"), (-place[2] / 1000).alias("depth"), "data_mean", "data_std", "residual_mean", "residual_std")

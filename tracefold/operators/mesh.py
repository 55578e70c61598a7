"""Meshes of spectral elements: geometry, interpolation, location, weak operators and grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gll
from .joins import best_location, nearest_join


def jacobian(d: dict[str, Column]) -> Column:
    """Volume per local volume, from the nine derivatives <xi|eta|gam>_<x|y|z> of local coordinates by place."""
    g = lambda a, b: d[f"{a}_{b}"]
    det = (
        g("xi", "x") * (g("eta", "y") * g("gam", "z") - g("eta", "z") * g("gam", "y"))
        - g("xi", "y") * (g("eta", "x") * g("gam", "z") - g("eta", "z") * g("gam", "x"))
        + g("xi", "z") * (g("eta", "x") * g("gam", "y") - g("eta", "y") * g("gam", "x"))
    )
    return F.try_divide(F.lit(1.0), det)


def point_volume(jac: Column, i: Column, j: Column, k: Column, n: int = 5) -> Column:
    """Jacobian times the quadrature weights of a point's three (0-based) places in its element."""
    _, w = gll.nodes_and_weights(n)
    weight = F.array(*[F.lit(float(x)) for x in w])
    return jac * F.get(weight, i) * F.get(weight, j) * F.get(weight, k)


def mesh_scan(points: DataFrame, derivatives: dict[str, str], n: int = 5) -> DataFrame:
    """Points (iproc, ispec, i, j, k, iglob 1-based, x, y, z, derivatives) with jacobian, dvol, their element's
    centre (its middle point) and 0-based iglob. A row is not moved: the centre comes by a window over the element."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("iproc", "ispec")
    middle = (F.col("i") == n // 2) & (F.col("j") == n // 2) & (F.col("k") == n // 2)
    out = points.withColumn("jacobian", jacobian({a: F.col(c) for a, c in derivatives.items()}))
    out = out.withColumn("dvol", point_volume(F.col("jacobian"), F.col("i"), F.col("j"), F.col("k"), n)).withColumn("iglob", F.col("iglob") - 1)
    return out.withColumns({f"center_{c}": F.max(F.when(middle, F.col(c))).over(w) for c in "xyz"})


def grid(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)


def interpolate_located(df: DataFrame, values: str, local: list[str], out: str, n: int = 5, method: str = "linear") -> DataFrame:
    """Values at local coordinates of an element's points (array of n³, first coordinate fastest): ``linear`` or ``gll``."""
    nodes, _ = gll.nodes_and_weights(n)
    basis = {"linear": gll.linear, "gll": gll.lagrange}[method]
    kept = [c for c in df.columns if c != values]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = (basis(batch.column(x).to_numpy(zero_copy_only=False), nodes) for x in local)
            found = np.einsum("rk,rj,ri,rkji->r", c, b, a, grid(batch.column(values), n, n, n))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in kept], pa.array(found)], names=[*kept, out])

    return df.mapInArrow(work, ", ".join([*[f"`{x}` {t}" for x, t in df.select(*kept).dtypes], f"`{out}` double"]))


def locate_in_elements(df: DataFrame, xyz: list[str], anchors: str, max_misloc: float) -> DataFrame:
    """``df`` (a place and 27 anchors of 3 numbers a row) with local1..3, status (1 inside, 0 near, -1 neither) and misloc."""
    kept = [c for c in df.columns if c != anchors]
    names = ["local1", "local2", "local3", "misloc"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in xyz], axis=1).astype(float)
            local, inside, misloc = gll.locate(places, grid(batch.column(anchors), 27, 3)) if batch.num_rows else (np.zeros((0, 3)), np.zeros(0, bool), np.zeros(0))
            status = np.where(inside, 1, np.where(misloc <= max_misloc, 0, -1)).astype(np.int32)
            numbers = [pa.array(c) for c in (*local.T, misloc)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *numbers, pa.array(status)], names=[*kept, *names, "status"])

    return df.mapInArrow(work, ", ".join([*[f"`{x}` {t}" for x, t in df.select(*kept).dtypes], *[f"{x} double" for x in names], "status int"]))


def locate_points(points: DataFrame, elements: DataFrame, point: str, element: str, xyz: list[str], anchors: str, k: int, radius: float, max_misloc: float) -> DataFrame:
    """The element of every point: its k nearest centres are tried by the inverse map; inside beats near,
    then the least misfit. Points that lie near no element have no row."""
    near = nearest_join(points, elements, point, element, xyz, k, radius).select(F.col("a_id").alias(point), F.col("b_id").alias(element))
    tried = near.join(points.select(point, *xyz), point).join(elements.select(element, anchors), element)
    return best_location(locate_in_elements(tried, xyz, anchors, max_misloc), point, "status", "misloc", element).drop(*xyz)


def weak_laplacian(df: DataFrame, values: str, metric: str, out: str, n: int = 5) -> DataFrame:
    """Element contributions of the integral of grad v · K grad u, an array of n³ by point.

    ``metric``: the nine numbers of W J (G K Gᵀ) for every point (n³ x 9; W quadrature weight, J Jacobian,
    G derivatives of local coordinates by place, K the conductivity), so isotropic, variable and
    anisotropic cases differ in it alone. Contributions of shared nodes are summed afterwards.
    """
    d = gll.derivative_matrix(n)
    kept = [c for c in df.columns if c not in (values, metric)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, m = grid(batch.column(values), n, n, n), grid(batch.column(metric), n, n, n, 3, 3)
            slope = np.stack([np.einsum("ia,rkja->rkji", d, u), np.einsum("ja,rkai->rkji", d, u), np.einsum("ka,raji->rkji", d, u)], -1)
            flux = np.einsum("rkjiab,rkjib->rkjia", m, slope)
            total = np.einsum("ai,rkja->rkji", d, flux[..., 0]) + np.einsum("aj,rkai->rkji", d, flux[..., 1]) + np.einsum("ak,raji->rkji", d, flux[..., 2])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * n**3, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in kept], lists], names=[*kept, out])

    return df.mapInArrow(work, ", ".join([*[f"`{x}` {t}" for x, t in df.select(*kept).dtypes], f"`{out}` array<double>"]))


def assemble(df: DataFrame, node: str, rank: str, value: str, out: str) -> DataFrame:
    """Sums over shared nodes in the order of ``rank``, so that they are the same bit by bit however rows
    are dealt. A node is shared by a handful of shards."""
    ordered = F.sort_array(F.collect_list(F.struct(rank, F.col(value).alias("v"))))
    return df.groupBy(node).agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["v"]).alias(out))


def grid_interpolate(points: DataFrame, point: str, coords: dict[str, tuple[float, float, int]], table: DataFrame, value: str, out: str, by: list[str] = []) -> DataFrame:
    """Multilinear interpolation in a regular grid, clamped outside.

    ``coords``: column -> (origin, spacing, number of knots); ``table`` has the 0-based knot number under
    the same names, the keys ``by`` (a phase, a layer) and the value. A point meets its corners by
    an equi-join on knot numbers. Points whose corners are not all in the table get null.
    """
    rows = points.select(point, *by, *coords)
    corners = [F.struct(F.lit(1.0).alias("w"))]
    for c, (origin, spacing, n) in coords.items():
        at = F.least(F.lit(float(n - 1)), F.greatest(F.lit(0.0), (F.col(c) - origin) / spacing))
        rows = rows.withColumn(f"_{c}", at).withColumn(f"_i{c}", F.least(F.floor(at), F.lit(n - 2)).cast("int"))
        share = F.col(f"_{c}") - F.col(f"_i{c}")
        corners = [F.struct(*[x[p].alias(p) for p in list(coords)[: list(coords).index(c)]], (F.col(f"_i{c}") + s).alias(c), (x["w"] * (share if s else 1 - share)).alias("w")) for x in corners for s in (0, 1)]
    met = rows.select(F.col(point), *by, F.explode(F.array(*corners)).alias("k")).select(point, *by, "k.*")
    near = met.join(table.select(*by, *coords, F.col(value).alias("_v")), [*by, *coords], "left")
    whole = F.count("_v") == 2 ** len(coords)
    return near.groupBy(point, *by).agg(F.when(whole, F.sum(F.col("w") * F.col("_v"))).alias(out))


def courant_number(points: DataFrame, element: list[str], xyz: list[str], speed: Column, dt: float) -> DataFrame:
    """(element, courant): dt times the largest speed of an element over the least distance of any two of its points.

    An element's points (some hundred) come together in one row; distances are taken in batches of elements of one size. Null
    for an element of one point, or with two points at one place; points with a null coordinate do not count.
    """
    place = F.array(*[F.col(c).cast("double") for c in xyz])
    known = F.when(sum((F.col(c).isNull().cast("int") for c in xyz), F.lit(0)) == 0, place)
    rows = points.groupBy(*element).agg(F.flatten(F.collect_list(known)).alias("_p"), F.max(speed).cast("double").alias("_v"))
    d = len(xyz)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, out = batch.column("_p"), np.full(batch.num_rows, np.nan)
            sizes = np.asarray(held.value_lengths()) // d
            for n in np.unique(sizes[sizes > 1]):
                at = np.flatnonzero(sizes == n)
                few = max(1, (1 << 22) // int(n * n))
                for first in range(0, len(at), few):
                    some = at[first : first + few]
                    x = held.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), n, d)
                    d2 = sum((x[:, :, None, k] - x[:, None, :, k]) ** 2 for k in range(d))
                    d2[:, np.arange(n), np.arange(n)] = np.inf
                    out[some] = np.sqrt(d2.min(axis=(1, 2)))
            speeds = np.asarray(batch.column("_v").fill_null(np.nan).to_numpy(zero_copy_only=False), float)
            with np.errstate(divide="ignore", invalid="ignore"):
                found = dt * speeds / out
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in element], pa.array(found, mask=~np.isfinite(found))], names=[*element, "courant"])

    return rows.mapInArrow(work, ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*element).dtypes], "courant double"]))

"""Diffusion smoothing on a mesh of spectral elements, by matrix-free conjugate gradients.

A mesh is dealt in blocks of neighbouring elements. What does not change (geometry, conductivity, local numbers of the
nodes) is one row a block, which stays in its partition; vectors travel as one small row a block. A
product with the stiffness is worked out inside blocks; of it only nodes on faces between blocks are sent, and
two sums an iteration reach the driver. There are as many partitions as keep one of them (a batch of Arrow, a file's
batch of columns) within a size, however large the mesh. Vectors are written after every iteration, so a
lost executor costs little; tables that are no longer read are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import gll
from .lineage import tables

NUMBERS = "array<double>"

#: Bytes of a partition, about; elements whose geometry is worked out at once.
PART, FEW = 16 << 20, 128


def element_geometry(anchors: np.ndarray, kh: np.ndarray, kv: np.ndarray, n: int, up: tuple[float, float, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """W J (G K Gᵀ) and W J at the n³ points of elements (rows x 27 x 3 anchors).

    K is ``kv`` along the vertical and ``kh`` across it (values at the points); the vertical is ``up``, or away from the origin.
    """
    x, w = gll.nodes_and_weights(n)
    c, b, a = (g.ravel() for g in np.meshgrid(x, x, x, indexing="ij"))
    local = np.stack([a, b, c], axis=1)
    weights = (w[:, None, None] * w[:, None] * w).ravel()
    many = np.repeat(anchors, n**3, axis=0)
    places, jacobian = gll.hexahedron(np.tile(local, (len(anchors), 1)), many)
    volume = np.abs(np.linalg.det(jacobian)) * np.tile(weights, len(anchors))
    slopes = np.linalg.inv(jacobian)  # local by place
    if up is None:
        with np.errstate(divide="ignore", invalid="ignore"):
            vertical = np.nan_to_num(places / np.linalg.norm(places, axis=1)[:, None])
    else:
        vertical = np.tile(np.asarray(up, float) / np.linalg.norm(up), (len(places), 1))
    along = np.einsum("pij,pj->pi", slopes, vertical)
    kh, kv = kh.ravel()[:, None, None], kv.ravel()[:, None, None]
    metric = kh * (slopes @ slopes.transpose(0, 2, 1)) + (kv - kh) * along[:, :, None] * along[:, None, :]
    return (metric * volume[:, None, None]).reshape(len(anchors), -1), volume.reshape(len(anchors), -1)


def stiffness(u: np.ndarray, metric: np.ndarray, n: int) -> np.ndarray:
    """The weak Laplacian of element values (rows x n³): grad v · K grad u over each element."""
    d = gll.derivative_matrix(n)
    u, m = u.reshape(-1, n, n, n), metric.reshape(-1, n, n, n, 3, 3)
    slope = np.stack([u @ d.T, np.einsum("ja,rkai->rkji", d, u), np.einsum("ka,raji->rkji", d, u)], -1)
    flux = np.einsum("rkjiab,rkjib->rkjia", m, slope)
    out = flux[..., 0] @ d + np.einsum("aj,rkai->rkji", d, flux[..., 1]) + np.einsum("ak,raji->rkji", d, flux[..., 2])
    return out.reshape(len(u), -1)


def numbers(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return batch.column(column)[i].values.to_numpy(zero_copy_only=False)


def by_row(df: DataFrame, schema: str, work) -> DataFrame:
    """``work`` makes a dict of each row of a batch; blocks are few and large, so they come one at a time."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), NUMBERS: pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = work(batch, i)
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(names, types)], names=names)

    return df.mapInArrow(run, schema)


class MeshOperator:
    """(M + by K) on a mesh, and what it takes to apply it: static blocks, faces between them, sums over nodes.

    ``elements``: block (long; neighbouring elements in one, as many as fit a task), element, nodes (array of n³ ids,
    first coordinate fastest), anchors (27 places of 3 numbers, first coordinate fastest). ``kh`` and ``kv`` are the
    conductivities across and along the vertical: numbers, or arrays of n³ for the points.
    """

    def __init__(self, elements: DataFrame, kh: Column, kv: Column | None = None, n: int = 5, up: tuple[float, float, float] | None = None):
        spark = elements.sparkSession
        self.n = n
        self.scope = tables(spark, "mesh")
        point = lambda c: c if elements.select(c.alias("c")).schema["c"].dataType.typeName() == "array" else F.array_repeat(c.cast("double"), n**3)
        kv = kh if kv is None else kv
        #: What is known of a point while a step is worked on is about 13 numbers; a partition is a batch as a whole.
        self.n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-elements.count() * n**3 * 13 * 8 // PART))
        rows = elements.select(
            F.col("block").cast("long").alias("block"), F.col("element"), F.col("nodes").cast("array<long>").alias("nodes"), F.col("anchors").cast(NUMBERS).alias("anchors"),
            point(kh).cast(NUMBERS).alias("kh"), point(kv).cast(NUMBERS).alias("kv"),
        )
        gathered = self.deal(rows).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("element", "nodes", "anchors", "kh", "kv"))).alias("e"))
        flat = gathered.select("block", *[F.flatten(F.col(f"e.{c}")).alias(c) for c in ("nodes", "anchors", "kh", "kv")])

        def build(batch: pa.RecordBatch, i: int) -> dict:
            ids, places = np.unique(numbers(batch, "nodes", i), return_inverse=True)
            each = [numbers(batch, c, i).reshape(s) for c, s in (("anchors", (-1, 27, 3)), ("kh", (-1, n**3)), ("kv", (-1, n**3)))]
            metric, volume = (np.concatenate(x) for x in zip(*(element_geometry(*(e[j : j + FEW] for e in each), n, up) for j in range(0, len(each[0]), FEW))))
            mass = np.bincount(places, volume.ravel(), len(ids))
            return {"block": batch.column("block")[i].as_py(), "ids": ids, "places": places.astype(np.int32), "metric": metric.ravel(), "local_mass": mass}

        blocks = self.scope.cut(by_row(flat, f"block long, ids array<long>, places array<int>, metric {NUMBERS}, local_mass {NUMBERS}", build))
        # each node's blocks, the first of which owns it, and its whole mass
        spread = blocks.select("block", F.posexplode(F.arrays_zip("ids", "local_mass")).alias("at", "x")).select("block", "at", F.col("x.ids").alias("node"), F.col("x.local_mass").alias("m"))
        sharing = self.deal(spread, "node").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("block", "at", "m"))).alias("s"))
        told = sharing.select("node", F.size("s").alias("n"), F.col("s")[0]["block"].alias("owner"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x["m"]).alias("mass"), F.explode("s").alias("x"))
        per_block = self.deal(told.select(F.col("x.block").alias("block"), F.struct(
            F.col("x.at").alias("at"), F.col("mass"), F.when(F.col("owner") == F.col("x.block"), 1.0).otherwise(0.0).alias("own"), (F.col("n") > 1).alias("shared")).alias("p"))).groupBy("block").agg(F.array_sort(F.collect_list("p")).alias("p"))
        static = blocks.join(per_block, "block").select(
            *blocks.columns, F.col("p.mass").alias("mass"), F.col("p.own").alias("own"), F.transform(F.filter("p", lambda x: x["shared"]), lambda x: x["at"]).alias("edge"))
        #: Stays where it is between iterations; a lost partition is made again from the written table.
        self.static = self.deal(static).persist(StorageLevel.DISK_ONLY)

    def deal(self, df: DataFrame, by: str = "block") -> DataFrame:
        return df.repartition(self.n_parts, by)

    def close(self) -> None:
        self.static.unpersist()
        self.scope.close()

    def vector(self, values: DataFrame, node: str, value: str) -> DataFrame:
        """(block, x) of a table of nodes; nodes that it lacks are 0."""
        spread = self.static.select("block", F.posexplode("ids").alias("at", "node"))
        met = spread.join(values.select(F.col(node).alias("node"), F.col(value).cast("double").alias("v")), "node", "left")
        return self.deal(met.select("block", "at", "v")).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("v", F.lit(0.0)).alias("v"))))["v"].alias("x"))

    def nodes(self, vector: DataFrame, x: str, node: str, value: str) -> DataFrame:
        """(node, value) of a vector, each node once."""
        zipped = F.arrays_zip(F.col("ids").alias("i"), F.col(x).alias("v"), F.col("own").alias("o"))
        return self.static.select("block", "ids", "own").join(vector.select("block", x), "block").select(F.explode(zipped).alias("z")).filter("z.o = 1").select(
            F.col("z.i").alias(node), F.col("z.v").alias(value))

    def local(self, df: DataFrame, x: str, by: float) -> DataFrame:
        """``df`` (block, arrays) with q: what each block adds to (M + by K) x, and x·q."""
        n, kept = self.n, [c for c in df.columns if c != "block"]

        def apply(batch: pa.RecordBatch, i: int) -> dict:
            u, places = numbers(batch, x, i), numbers(batch, "places", i)
            q = numbers(batch, "local_mass", i) * u
            if by:
                q = q + by * np.bincount(places, stiffness(u[places].reshape(-1, n**3), numbers(batch, "metric", i), n).ravel(), len(u))
            return {"block": batch.column("block")[i].as_py(), "q": q, "xq": float(u @ q), **{c: numbers(batch, c, i) for c in kept}}

        joined = self.static.select("block", "places", "metric", "local_mass").join(df, "block")
        return by_row(joined, ", ".join(["block long", f"q {NUMBERS}", "xq double", *[f"{c} {NUMBERS}" for c in kept]]), apply)

    def with_sums(self, df: DataFrame, q: str) -> DataFrame:
        """``df`` with _at and _v: the places of a block's shared nodes, and q there summed in the order of the blocks. Only such nodes are sent."""
        sent = self.static.select("block", "ids", "edge").join(df.select("block", q), "block").select(
            "block", F.explode(F.transform("edge", lambda p: F.struct(F.get("ids", p).alias("node"), p.alias("at"), F.get(F.col(q), p).alias("v")))).alias("x"))
        sums = sent.groupBy("x.node").agg(F.array_sort(F.collect_list(F.struct("block", F.col("x.at").alias("at"), F.col("x.v").alias("v")))).alias("s"))
        told = sums.select(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["v"]).alias("v"), F.explode("s").alias("y")).select(F.col("y.block").alias("block"), F.struct(F.col("y.at").alias("at"), "v").alias("p"))
        back = self.deal(told).groupBy("block").agg(F.collect_list("p").alias("_p"))  # dealt as blocks are, so that the join keeps their partitions
        return df.join(back, "block", "left").withColumns({"_at": F.coalesce(F.col("_p.at"), F.array().cast("array<int>")), "_v": F.coalesce(F.col("_p.v"), F.array().cast(NUMBERS))}).drop("_p")

    def whole(self, df: DataFrame, q: str) -> DataFrame:
        """``df`` with q summed over the blocks that share a node."""
        patched = self.with_sums(df, q)
        kept = [c for c, t in df.dtypes if c not in ("block", q) and t == NUMBERS]

        def patch(batch: pa.RecordBatch, i: int) -> dict:
            out = numbers(batch, q, i).copy()
            out[numbers(batch, "_at", i)] = numbers(batch, "_v", i)
            return {"block": batch.column("block")[i].as_py(), q: out, **{c: numbers(batch, c, i) for c in kept}}

        return by_row(patched.select("block", q, *kept, "_at", "_v"), ", ".join(["block long", f"{q} {NUMBERS}", *[f"{c} {NUMBERS}" for c in kept]]), patch)

    def solve(self, vector: DataFrame, by: float, tolerance: float, max_iter: int, explicit: float = 0.0) -> DataFrame:
        """(block, x) with (M + by K) x = (M - explicit K) b for the vector b, until the squared residual (over the
        mass) is ``tolerance`` of the right side's. Conjugate gradients, with the mass as preconditioner."""
        cut, drop, n = self.scope.cut, self.scope.drop, self.n
        fixed = self.static.select("block", "own", "mass", "places", "metric", "local_mass")
        schema = f"block long, x {NUMBERS}, r {NUMBERS}, p {NUMBERS}, s {NUMBERS}, q {NUMBERS}, rr double, uq double, bb double"

        def sums(df: DataFrame, *what: str) -> list[float]:
            return [v or 0.0 for v in df.agg(*[F.sum(c) for c in what]).first()]

        def row(batch: pa.RecordBatch, i: int, x, r, p, s, bb: float) -> dict:
            """A block's vectors, with q: what it adds to (M + by K) u for u = r over the mass, and its parts of r·u and u·q."""
            mass, places = numbers(batch, "mass", i), numbers(batch, "places", i)
            u = r / mass
            q = numbers(batch, "local_mass", i) * u + by * np.bincount(places, stiffness(u[places].reshape(-1, n**3), numbers(batch, "metric", i), n).ravel(), len(u))
            return {"block": batch.column("block")[i].as_py(), "x": x, "r": r, "p": p, "s": s, "q": q, "rr": float((numbers(batch, "own", i) * r * u).sum()), "uq": float(u @ q), "bb": bb}

        def start(batch: pa.RecordBatch, i: int) -> dict:
            x, b, mass, held = (numbers(batch, c, i) for c in ("x", "b", "mass", "own"))
            return row(batch, i, x, b - numbers(batch, "q", i), x * 0, x * 0, float((held * b * b / mass).sum()))

        vector = vector.select("block", "x")
        right = self.whole(self.local(vector, "x", -explicit), "q").withColumnRenamed("q", "b")
        first = self.whole(self.local(right.select("block", "x", "b"), "x", by), "q")
        state = cut(by_row(fixed.join(first, "block"), schema, start))
        rr, uq, bb = sums(state, "rr", "uq", "bb")
        least, alpha, beta = tolerance * bb, 1.0, 0.0

        def step(batch: pa.RecordBatch, i: int) -> dict:
            x, r, p, s, mass = (numbers(batch, c, i) for c in ("x", "r", "p", "s", "mass"))
            w = numbers(batch, "q", i).copy()
            w[numbers(batch, "_at", i)] = numbers(batch, "_v", i)
            p, s = r / mass + beta * p, w + beta * s
            return row(batch, i, x + alpha * p, r - alpha * s, p, s, 0.0)

        # both sums of an iteration come of one table (Chronopoulos and Gear), so vectors are written and sent once
        for _ in range(max_iter):
            if rr <= least:
                break
            alpha = rr / (uq - beta * rr / alpha)
            old, state = state, cut(by_row(fixed.join(self.with_sums(state.drop("rr", "uq", "bb"), "q"), "block"), schema, step))
            drop(old)
            last = rr
            rr, uq = sums(state, "rr", "uq")
            beta = rr / last
        return state.select("block", "x")


def step_lengths(n: int, ratio: float = 1.0) -> list[float]:
    """n steps that add up to 1 and grow evenly; the first is ``ratio`` of the last."""
    if n == 1:
        return [1.0]
    first = 2 * ratio / (1 + ratio) / n
    return [first + i * 2 * (1 - ratio) / (1 + ratio) / (n * (n - 1)) for i in range(n)]


def smooth_mesh(
    elements: DataFrame, values: DataFrame, node: str, value: str, sigma: Column, sigma_vertical: Column | None = None, kind: str = "gauss", steps: int = 10, ratio: float = 1.0,
    implicit: float = 1.0, n: int = 5, up: tuple[float, float, float] | None = None, tolerance: float = 1e-10, max_iter: int = 200,
) -> DataFrame:
    """(node, value) smoothed over the mesh (``elements`` as for :class:`MeshOperator`); the sum of mass times value is kept.

    ``gauss``: diffusion over a unit of time with conductivity σ²/2, whose kernel is nearly a Gaussian of width σ, by backward
    Euler steps or Crank-Nicolson (``implicit`` 0.5). ``bessel``: one implicit step, whose kernel falls off
    exponentially. ``sigma`` and ``sigma_vertical`` are numbers or arrays by point, so isotropic,
    variable and vertical-transverse kinds differ in them alone.

    Cases: nodes without a value count as 0; values of nodes that no element has are left out. σ of 0 changes nothing. Empty
    elements give no rows. A repeated element counts twice, so elements must be distinct.
    """
    if kind not in ("gauss", "bessel"):
        raise ValueError(kind)
    squared = lambda s: F.transform(s, lambda x: x * x / 2) if elements.select(s.alias("c")).schema["c"].dataType.typeName() == "array" else s * s / 2
    mesh = MeshOperator(elements, squared(sigma), None if sigma_vertical is None else squared(sigma_vertical), n, up)
    u = mesh.scope.cut(mesh.vector(values, node, value))
    for dt in step_lengths(steps, ratio) if kind == "gauss" else [1.0]:
        theta = implicit if kind == "gauss" else 1.0
        u = mesh.solve(u, theta * dt, tolerance, max_iter, (1 - theta) * dt)
    out = mesh.scope.keep(mesh.nodes(u, "x", node, value))
    mesh.close()
    return out


def apply_mesh(elements: DataFrame, values: DataFrame, node: str, value: str, sigma: Column, sigma_vertical: Column | None = None, by: float = 1.0, n: int = 5, up: tuple[float, float, float] | None = None) -> DataFrame:
    """(node, value): M⁻¹ (M + by K) of the values, which undoes an implicit step of the length ``by``."""
    mesh = MeshOperator(elements, sigma * sigma / 2, None if sigma_vertical is None else sigma_vertical * sigma_vertical / 2, n, up)
    q = mesh.whole(mesh.local(mesh.vector(values, node, value), "x", by), "q")
    scaled = mesh.static.select("block", "mass").join(q, "block").select("block", F.zip_with("q", "mass", lambda a, m: a / m).alias("x"))
    out = mesh.scope.keep(mesh.nodes(scaled, "x", node, value))
    mesh.close()
    return out

"""Neighbourhood smoothing and diffusion over scattered points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import pairs_within, short_list


def gaussian_smooth(
    df: DataFrame, point: str, xyz: list[str], value: str, volume: str, sigma: float | tuple[float, float], reach: float = 5.0,
    own_sigma: str | None = None, same: str | None = None,
) -> DataFrame:
    """(point, smooth): means weighted by volume and exp(-d²/2σ²) over points within reach·σ.

    ``sigma``: one, or (horizontal, vertical), where vertical is along the line from the origin through
    the point. ``own_sigma``: a column with each point's own σ, of which ``sigma`` is then the largest.
    ``same``: a class that both points must share.
    """
    h, v = sigma if isinstance(sigma, tuple) else (sigma, sigma)
    columns = df.select(F.col(point).alias("id"), *xyz, F.col(value).cast("double").alias("value"), F.col(volume).cast("double").alias("volume"), *[c for c in (own_sigma, same) if c])
    pairs = pairs_within(columns, columns, xyz, reach * max(h, v))
    if same:
        pairs = pairs.filter(F.col(f"a_{same}") == F.col(f"b_{same}"))
    d2 = F.col("distance") * F.col("distance")
    if own_sigma:
        s = F.col(f"a_{own_sigma}")
        pairs, power = pairs.filter(F.col("distance") <= reach * s), d2 / (2 * s * s)
    elif h == v:
        power = d2 / (2 * h * h)
    else:
        along = sum((F.col(f"b_{c}") - F.col(f"a_{c}")) * F.col(f"a_{c}") for c in xyz)
        up2 = F.coalesce(F.try_divide(along * along, sum(F.col(f"a_{c}") * F.col(f"a_{c}") for c in xyz)), F.lit(0.0))
        power = (d2 - up2) / (2 * h * h) + up2 / (2 * v * v)
    w = F.col("b_volume") * F.exp(-power)
    return pairs.groupBy(F.col("a_id").alias(point)).agg((F.sum(w * F.col("b_value")) / F.sum(w)).alias("smooth"))


def cap_smooth(df: DataFrame, point: str, unit: list[str], radius: str, value: str, volume: str, arc: float, depth: float, reach: float = 5.0) -> DataFrame:
    """(point, smooth): Gaussian weights by the angle between unit vectors (σ ``arc``, radians) and by the
    difference of radii (σ ``depth``). Chords find the neighbours; the angle weighs them."""
    columns = df.select(F.col(point).alias("id"), *unit, F.col(radius).alias("r"), F.col(value).cast("double").alias("value"), F.col(volume).cast("double").alias("volume"))
    pairs = pairs_within(columns, columns, unit, min(reach * arc, 2.0))
    angle = 2 * F.asin(F.least(F.lit(1.0), F.col("distance") / 2))
    gap = F.col("a_r") - F.col("b_r")
    w = F.col("b_volume") * F.exp(-angle * angle / (2 * arc * arc) - gap * gap / (2 * depth * depth))
    return pairs.filter(F.abs(gap) <= reach * depth).groupBy(F.col("a_id").alias(point)).agg((F.sum(w * F.col("b_value")) / F.sum(w)).alias("smooth"))


def flow(df: DataFrame, links: DataFrame, point: str, value: str, conductance: str) -> DataFrame:
    """(point, _flow): what comes in over links (a, b, conductance), the sum of conductance times difference."""
    both = links.select("a", "b", conductance).union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), conductance))
    near = both.join(df.select(F.col(point).alias("b"), F.col(value).alias("_near")), "b")
    met = near.join(df.select(F.col(point).alias("a"), F.col(value).alias("_own")), "a")
    return met.groupBy(F.col("a").alias(point)).agg(F.sum(F.col(conductance) * (F.col("_near") - F.col("_own"))).alias("_flow"))


def diffusion_step(df: DataFrame, links: DataFrame, point: str, value: str, conductance: str, step: float) -> DataFrame:
    """An explicit step of u' = div(k grad u) on a link table (a, b, conductance): the sum of u is kept."""
    return df.join(flow(df, links, point, value, conductance), point, "left").withColumn(value, F.col(value) + step * F.coalesce("_flow", F.lit(0.0))).drop("_flow")


def implicit_diffusion(
    df: DataFrame, links: DataFrame, point: str, value: str, conductance: str, step: float, cut: Callable[[DataFrame], DataFrame],
    steps: int = 1, implicit: float = 1.0, tolerance: float = 1e-10, max_iter: int = 200,
) -> DataFrame:
    """Steps of u' = div(k grad u) that are stable at any size: backward Euler, or Crank-Nicolson with ``implicit`` 0.5.

    Each step solves (1 - implicit·step·L) u = (1 + (1 - implicit)·step·L) u by conjugate gradients until
    the squared residual is ``tolerance`` of the right side. Vectors are columns of one table, which
    ``cut`` writes once an iteration; only two dot products of it reach the driver. Conductances may
    vary by link and direction, which makes the variable and anisotropic kinds.
    """
    u = df.select(point, F.col(value).cast("double").alias("x"))
    times = lambda t, c, by: t.join(flow(t, links, point, c, conductance), point, "left").withColumn("_a", F.col(c) - by * F.coalesce("_flow", F.lit(0.0))).drop("_flow")
    for _ in range(steps):
        right = times(u, "x", -(1 - implicit) * step).select(point, "x", F.col("_a").alias("rhs"))
        state = cut(times(right, "x", implicit * step).select(point, "x", (F.col("rhs") - F.col("_a")).alias("r")).withColumn("p", F.col("r")))
        rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
        least = tolerance * (right.agg(F.sum(F.col("rhs") * F.col("rhs"))).first()[0] or 0.0)
        for _ in range(max_iter):
            if rr <= least:
                break
            moved = cut(times(state, "p", implicit * step))
            alpha = rr / moved.agg(F.sum(F.col("p") * F.col("_a"))).first()[0]
            moved = moved.select(point, (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("_a")).alias("r"), "p")
            new = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
            state, rr = cut(moved.withColumn("p", F.col("r") + new / rr * F.col("p"))), new
        u = state.select(point, "x")
    return df.drop(value).join(u.withColumnRenamed("x", value), point)


def centers_of(centers: DataFrame, names: list[str]) -> list[tuple[float, ...]]:
    """A short list of places (checked), for expressions."""
    return [tuple(r) for r in short_list(centers.select(*names), 1000).collect()]


def product_mask(xyz: list[Column], centers: list[tuple[float, ...]], sigma: float) -> Column:
    """The product of 1 - exp(-d²/2σ²) over a short list of centers; 0 at a center."""
    out = F.lit(1.0)
    for c in centers:
        out = out * (1 - F.exp(-sum((x - v) * (x - v) for x, v in zip(xyz, c)) / (2 * sigma * sigma)))
    return out


def sum_mask(xyz: list[Column], centers: list[tuple[float, ...]], sigma: float) -> Column:
    """1 less the sum of exp(-d²/2σ²) over the centers, not under 0."""
    return F.greatest(F.lit(0.0), 1 - sum(F.exp(-sum((x - v) * (x - v) for x, v in zip(xyz, c)) / (2 * sigma * sigma)) for c in centers))

"""Temporal, rule, pattern and spatial joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .nearest import nearest_join  # noqa: F401  the spatial joins are found in one place


def epoch_join(data: DataFrame, epochs: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Rows with the epochs of the same keys that hold the time strictly inside; a null end is open."""
    d, e = data.alias("d"), epochs.alias("e")
    same = [F.col(f"d.{k}") == F.col(f"e.{k}") for k in keys]
    inside = (F.col(f"e.{start}") < F.col(f"d.{at}")) & (F.col(f"e.{end}").isNull() | (F.col(f"e.{end}") > F.col(f"d.{at}")))
    rest = [F.col(f"e.{c}") for c in epochs.columns if c not in keys]
    return d.join(e, reduce(Column.__and__, [*same, inside]), how).select("d.*", *rest)


def first_match(data: DataFrame, lookup: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Left join with one row of the lookup per key (the first in order); without one the values given stay."""
    one = lookup.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    named = one.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
    return data.join(named, keys, "left").select(
        *[c for c in data.columns if c not in values], *[F.coalesce(F.col(f"_{c}"), own).alias(c) for c, own in values.items()]
    )


def short_list(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """A list that is written by hand; its size is checked, so that it may be broadcast."""
    if len(df.take(limit + 1)) > limit:
        raise ValueError(f"more than {limit} rows: join them on a key instead")
    return df


def rule_join(data: DataFrame, rules: DataFrame, conditions: list[Column]) -> DataFrame:
    """θ-join with a short list of rules."""
    return data.join(F.broadcast(short_list(rules)), reduce(Column.__and__, conditions))


def priority_patterns(df: DataFrame, text: Column, patterns: list[str], by: list[str]) -> DataFrame:
    """Per group, all rows that match the first of the patterns (with * and ?) that matches any row."""
    def regex(p: str) -> str:
        return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in p) + "$"

    rank = F.coalesce(*[F.when(text.rlike(regex(p)), i) for i, p in enumerate(patterns)])
    ranked = df.withColumn("_rank", rank).filter("_rank is not null")
    return ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy(*by))).filter("_rank = _best").withColumnRenamed("_rank", "pattern_rank").drop("_best")


def interpolate_1d(points: DataFrame, x: str, knots: DataFrame, knot_x: str, knot_y: str, out: str) -> DataFrame:
    """Linear interpolation between the knots around each point, clamped outside.

    The knots (a model of a few thousand at most, whose number is checked) go to the tasks by broadcast and are
    searched by halves for whole batches. Nothing is shuffled. A null x stays null; without knots all are null.
    """
    model = sorted((r.x, r.y) for r in short_list(knots.select(F.col(knot_x).cast("double").alias("x"), F.col(knot_y).cast("double").alias("y")).dropna()).collect())
    sent = points.sparkSession.sparkContext.broadcast(np.array(model, float).reshape(-1, 2))

    @F.pandas_udf("double")
    def interpolated(at: pd.Series) -> pd.Series:
        xs, ys = sent.value.T
        values = at.to_numpy(dtype=float, na_value=np.nan)
        return pd.Series(np.interp(values, xs, ys) if len(xs) else np.full(len(values), np.nan)).where(~np.isnan(values), None)

    return points.withColumn(out, F.nanvl(interpolated(F.col(x).cast("double")), F.lit(None).cast("double")))


def pairs_within(a: DataFrame, b: DataFrame, xyz: list[str], radius: float) -> DataFrame:
    """Pairs of rows within the radius: all columns of both as a_<name> and b_<name>, and the distance.

    Space is cut into cubes of the radius; b is dealt to its cube and the 26 around it, a to its
    own, and they meet by an equi-join. Spark splits a crowded cube (adaptive skew join).
    """
    steps = F.explode(F.array(*[F.lit(s) for s in (-1, 0, 1)]))
    cell = lambda p, c: F.floor(F.col(f"{p}_{c}").cast("double") / radius).cast("long")
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    left = left.withColumns({f"_c{i}": cell("a", c) for i, c in enumerate(xyz)})
    for i, c in enumerate(xyz):
        right = right.withColumn("_s", steps).withColumn(f"_c{i}", cell("b", c) + F.col("_s")).drop("_s")
    gap = [F.col(f"a_{c}").cast("double") - F.col(f"b_{c}").cast("double") for c in xyz]
    keys = [f"_c{i}" for i in range(len(xyz))]
    return left.join(right, keys).drop(*keys).withColumn("distance", F.sqrt(sum(g * g for g in gap))).filter(F.col("distance") <= radius)


def radius_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, xyz: list[str], radius: float) -> DataFrame:
    """Pairs (a_id, b_id, distance) within the radius."""
    met = pairs_within(a.select(F.col(a_id).alias("id"), *xyz), b.select(F.col(b_id).alias("id"), *xyz), xyz, radius)
    return met.select("a_id", "b_id", "distance")


def best_location(found: DataFrame, point: str, status: str, misloc: str, *last: str) -> DataFrame:
    """Merge candidates of a point: inside (1) beats near (0), then the least misfit, then the least of the
    ``last`` columns; -1 never counts."""
    w = Window.partitionBy(point).orderBy(F.col(status).desc(), misloc, *last)
    return found.filter(F.col(status) != -1).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def thin_by_conflicts(pairs: DataFrame, cut) -> DataFrame:
    """Points to drop (id) until no pair (a, b) is left, always the one in the most pairs (of equal ones the greatest id).

    All points that are ahead of each of their neighbours go in one round: no neighbour could go before
    them, so the rounds drop what one by one would. ``cut`` writes a table and rereads it.
    """
    both = cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    dropped = None
    while not both.isEmpty():
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        rival = both.join(degree.select(F.col("a").alias("b"), F.struct("n", F.col("a").alias("id")).alias("_r")), "b").groupBy("a").agg(F.max("_r").alias("_r"))
        ahead = cut(degree.join(rival, "a").filter(F.struct(F.col("n").alias("n"), F.col("a").alias("id")) > F.col("_r")).select(F.col("a").alias("id")))
        dropped = ahead if dropped is None else dropped.union(ahead)
        left = both.join(ahead.withColumnRenamed("id", "a"), "a", "left_anti").join(ahead.withColumnRenamed("id", "b"), "b", "left_anti")
        both = cut(left.select("a", "b"))
    return dropped if dropped is not None else both.select(F.col("a").alias("id"))

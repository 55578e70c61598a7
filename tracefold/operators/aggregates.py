"""Weighted statistics, histograms, profiles, islands and metadata merges."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_mean(df: DataFrame, by: list[str], weight: Column, value: Column, name: str = "wcc0") -> DataFrame:
    """weight_sum, <name>_sum and <name>_avg per group; the mean of no weight is null."""
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight_sum"), F.sum(weight * value).alias(f"{name}_sum"))
    return sums.withColumn(f"{name}_avg", F.try_divide(f"{name}_sum", "weight_sum"))


def station_statistics(df: DataFrame, station: str, component: str, components: list[str], measures: dict[str, Column]) -> DataFrame:
    """Counts, means and population deviations per station, a column for each component."""
    aggregates = []
    for c in components:
        own = F.col(component) == c
        aggregates.append(F.count(F.when(own, 1)).alias(f"nwin_{c}"))
        for name, m in measures.items():
            aggregates += [F.avg(F.when(own, m)).alias(f"mean_{name}_{c}"), F.stddev_pop(F.when(own, m)).alias(f"std_{name}_{c}")]
    return df.groupBy(station).agg(*aggregates)


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, by: str) -> DataFrame:
    """Counts in equal bins over low to high, of everything (a null group) and per group, in one pass."""
    binned = df.withColumn("bin", F.least(F.lit(bins - 1), F.floor((value - low) / ((high - low) / bins)).cast("int")))
    return binned.filter(value.between(low, high)).groupingSets([[F.col("bin")], [F.col(by), F.col("bin")]], F.col(by), F.col("bin")).agg(F.count(F.lit(1)).alias("n"))


def moments(df: DataFrame, value: Column, low: float, high: float, by: str) -> DataFrame:
    """Count, mean and population deviation over low to high, of everything (a null group) and per group, in one pass."""
    rows = df.filter(value.between(low, high)).withColumn("_v", value)
    return rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))


def exact_sum(value: Column, digits: int = 10) -> Column:
    """A sum that no order of rows changes: of decimals with so many digits after the point."""
    return F.sum(value.cast(f"decimal(28, {digits})")).cast("double")


def exact_percentile(df: DataFrame, value: Column, share: float, bins: int = 4096, few: int = 10_000) -> float | None:
    """The least value whose share of rows, with all lesser ones, is ``share`` at least; null values do not count.

    A histogram of equal bins tells the bin that holds it, and inside that bin another one, until so ``few`` values are
    left that their order decides. Only the bins' counts reach the driver, and no task holds more than its rows.
    None without values; ``share`` is over 0 and at most 1.
    """
    if not 0 < share <= 1:
        raise ValueError("the share must lie in (0, 1]")
    rows = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("v")).first()
    rank = math.ceil(share * n - 1e-9)
    inside = F.lit(True)
    while n and low < high and n > few:
        width = (high - low) / bins
        at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - low) / width))).cast("int")
        told = rows.filter(inside).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()
        for r in told:
            if rank <= r.n:
                break
            rank -= r.n
        low, high, n = r.low, r.high, r.n
        inside = F.col("v").between(low, high)
    if not n:
        return None
    if low == high:
        return low
    return rows.filter(inside).orderBy("v").limit(rank).agg(F.max("v")).first()[0]


def filtered_statistics(
    df: DataFrame, station: str, component: str, components: list[str], measures: dict[str, Column], snr: Column, least_snr: float, phase: Column | None = None,
    phases: tuple[str, ...] = (), band: Column | None = None, highest: float | None = None,
) -> DataFrame:
    """:func:`station_statistics` over windows of a least SNR, of some phases, and whose band (an array of
    frequencies) ends at ``highest`` or lower. Every station has a row; a component without such windows has count 0 and nulls."""
    good = snr >= least_snr
    if phase is not None and phases:
        good = good & phase.isin(*phases)
    if band is not None and highest is not None:
        good = good & (F.array_max(band) <= highest)
    kept = {name: F.when(good, m) for name, m in measures.items()}
    own = F.when(good, F.col(component))
    return station_statistics(df.withColumn("_component", own), station, "_component", components, kept)


def layer_means(
    df: DataFrame, by: list[str], radius: str, center: str, values: dict[str, Column], least_gap: float, discontinuities: list[float] = [], order: list[str] = [],
) -> DataFrame:
    """(by, layer, side, radius, n, means) of points whose radii follow each other within ``least_gap``.

    A layer whose mean radius is within ``least_gap`` of a discontinuity is split: points of elements whose ``center`` lies
    below it are side -1, those above it 1 (one exactly at it is in neither); other layers have side 0.
    """
    w = Window.partitionBy(*by).orderBy(radius, *order)
    fresh = F.when(F.col(radius) - F.lag(radius).over(w) > least_gap, 1).otherwise(0)
    rows = df.withColumn("_f", fresh).withColumn("layer", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")
    mean = F.avg(radius).over(Window.partitionBy(*by, "layer"))
    near = F.coalesce(*[F.when(F.abs(F.col("_m") - d) < least_gap, F.lit(float(d))) for d in discontinuities], F.lit(None).cast("double"))
    rows = rows.withColumn("_m", mean).withColumn("_d", near)
    side = F.when(F.col("_d").isNull(), 0).when(F.col(center) < F.col("_d"), -1).when(F.col(center) > F.col("_d"), 1)
    rows = rows.withColumn("side", side).filter("side is not null")
    return rows.groupBy(*by, "layer", "side").agg(F.avg(radius).alias("radius"), F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(name) for name, c in values.items()])


def sum_cubes(cubes: DataFrame, event: str, axes: list[str], value: Column, weight: Column, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cells: axes, wcc_sum, weight_sum, events; unlike: event, cells): the cubes of all events added up cell by cell.

    All events must have the same cells. What most events have (of equally many the lesser digest) is the rule; events with other cells, or
    with a cell twice, are unlike and are left out of the sums. With ``strict`` there being any is an error.
    """
    cell = F.xxhash64(*axes).cast("decimal(38,0)")
    own = cubes.groupBy(event).agg(F.count(F.lit(1)).alias("cells"), F.count_distinct(*axes).alias("_distinct"), F.sum(cell).alias("_axes"))
    shape = own.groupBy("cells", "_axes").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("_distinct") == F.col("cells")).alias("_once"))
    rule = shape.filter("_once").agg(F.max_by(F.struct("cells", "_axes"), F.struct("_n", (-F.col("_axes")).alias("first"))).alias("r")).select("r.*")
    alike = own.filter(F.col("_distinct") == F.col("cells")).join(F.broadcast(rule), ["cells", "_axes"], "left_semi").select(event)
    unlike = own.join(alike, event, "left_anti").select(event, "cells")
    if strict and (bad := unlike.orderBy(event).first()):
        raise ValueError(f"{event} {bad[0]} has other axes ({bad[1]} cells)")
    sums = cubes.join(alike, event, "left_semi").groupBy(*axes).agg(F.sum(value).alias("wcc_sum"), F.sum(weight).alias("weight_sum"), F.count(F.lit(1)).alias("events"))
    return sums, unlike


def range_pdf(df: DataFrame, x: Column, low: float, high: float, bins: int, weight: Column) -> DataFrame:
    """Share of weight in equal bins [low, high) of a fixed range (a depth)."""
    at = F.floor((x - low) / ((high - low) / bins)).cast("int")
    sums = df.filter((x >= low) & (x < high)).groupBy(at.alias("bin")).agg(F.sum(weight).alias("weight"))
    return sums.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy()))  # one row per bin


def amplitude_pdf(df: DataFrame, value: Column, volume: Column, bins: int, signed: bool = False) -> DataFrame:
    """Share of volume times |value| in equal bins [low, high) from 0 to the largest amplitude (``signed``: from
    minus it); the largest value itself is in none."""
    top = df.agg(F.max(F.abs(value)).alias("_top"))
    at = (value + F.col("_top")) / (2 * F.col("_top") / bins) if signed else F.abs(value) / (F.col("_top") / bins)
    placed = df.crossJoin(F.broadcast(top)).withColumn("bin", F.floor(at).cast("int"))
    sums = placed.groupBy("bin").agg(F.sum(volume * F.abs(value)).alias("weight")).filter(F.col("bin") < bins)
    return sums.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def geometric_edges(top: float, bins: int) -> list[float]:
    """-1, 0 and edges that grow by a factor up to the largest amplitude."""
    return [-1.0, *[(top + 1) ** (i / bins) - 1 for i in range(bins + 1)]]


def volume_cdf(df: DataFrame, value: Column, volume: Column, edges: list[float]) -> DataFrame:
    """Cumulative share of volume in bins (low, high]; the first edge is -1, so zeros count."""
    at = sum(F.when(F.abs(value) > e, 1).otherwise(0) for e in edges) if edges else F.lit(0)
    sums = df.groupBy(at.cast("int").alias("bin")).agg(F.sum(volume).alias("volume"))
    upto = Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row per bin
    return sums.withColumn("cdf", F.sum("volume").over(upto) / F.sum("volume").over(Window.partitionBy()))


def threshold_of(cdf: Column, bin_: Column, edges: list[float], share: float) -> Column:
    """Upper edge of the first bin whose cumulative share reaches ``share``, beside every bin of :func:`volume_cdf`."""
    edge = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.least(bin_ + 1, F.lit(len(edges))))
    return F.min(F.when(cdf >= share, edge)).over(Window.partitionBy())  # one row per bin


def triangular_profile(df: DataFrame, x: Column, centers: list[float], half: float, volume: Column, value: Column) -> DataFrame:
    """Weighted mean around each center with weights falling linearly to 0 at ``half``.

    A row is dealt to the few centers it reaches, so nothing is crossed.
    """
    reach = F.filter(F.array(*[F.lit(float(c)) for c in centers]), lambda c: F.abs(x - c) < half)
    near = df.withColumn("center", F.explode(reach))
    w = (1 - F.abs(x - F.col("center")) / half) * volume
    return near.groupBy("center").agg(F.sum(w).alias("weight_sum"), F.try_divide(F.sum(w * value), F.sum(w)).alias("mean"))


def islands(df: DataFrame, by: list[str], start: Column, end: Column, tolerance: Column) -> DataFrame:
    """Merge intervals of a group that touch within the tolerance: start, end and members of each island.

    The end reached so far is a running maximum, so an interval nested in an earlier one does no harm.
    """
    w = Window.partitionBy(*by).orderBy("_s", "_e")
    rows = df.select(*by, start.alias("_s"), end.alias("_e"), tolerance.alias("_t"))
    reached = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reached.isNull() | (F.col("_s") > reached + F.col("_t")), 1).otherwise(0)
    return (
        rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "island").agg(F.min("_s").alias("start"), F.max("_e").alias("end"), F.count(F.lit(1)).alias("members"))
    )


def gaps(merged: DataFrame, by: list[str]) -> DataFrame:
    """What lies between the islands of a group."""
    after = F.lead("start").over(Window.partitionBy(*by).orderBy("start"))
    return merged.select(*by, F.col("end").alias("gap_start"), after.alias("gap_end")).filter("gap_end is not null")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def merge_metadata(df: DataFrame, content: list[str], start: str, end: str, open_wins: bool) -> DataFrame:
    """Rows of equal content become one: earliest start, latest end; an open (null) end wins or is ignored."""
    last = F.max(end)
    last = F.when(F.count(F.when(F.col(end).isNull(), 1)) > 0, None).otherwise(last) if open_wins else last
    return df.groupBy(*content).agg(F.min(start).alias(start), last.alias(end))


def covariance(df: DataFrame, vector: str, weight: str) -> DataFrame:
    """Weighted means and covariances (i, j, mean_i, mean_j, cov; i <= j) of the numbers of a vector.

    Every task adds up its vectors as a matrix product; what is shuffled is one row of sums per task
    and pair. Vectors of one length; nulls and rows without weight do not count.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(weight).cast("double").alias("w")).filter("v is not null and w is not null")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                w = batch.column("w").to_numpy(zero_copy_only=False)
                part = np.concatenate([[w.sum()], w @ x, ((x * w[:, None]).T @ x).ravel()])
                total = part if total is None else total + part
        if total is not None:
            n = round(np.sqrt(len(total) - 0.75) - 0.5)
            i, j = np.triu_indices(n)
            mean, product = total[1 : n + 1], total[n + 1 :].reshape(n, n)
            columns = [i.astype(np.int32), j.astype(np.int32), np.full(len(i), total[0]), mean[i], mean[j], product[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "w", "si", "sj", "p"])

    parts = rows.mapInArrow(sums, "i int, j int, w double, si double, sj double, p double")
    found = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("w", "si", "sj", "p")])
    mean = lambda c: F.col(c) / F.col("w")
    return found.select("i", "j", mean("si").alias("mean_i"), mean("sj").alias("mean_j"), (mean("p") - mean("si") * mean("sj")).alias("cov"))


def node_average(df: DataFrame, node: str, value: Column, volume: Column, out: str) -> DataFrame:
    """Every row gets the volume-weighted mean of its node."""
    means = df.groupBy(node).agg(F.try_divide(F.sum(value * volume), F.sum(volume)).alias(out))
    return df.join(means, node)


def min_gap_layout(df: DataFrame, by: list[str], x: Column, gap: float, out: str, tie: list[str]) -> DataFrame:
    """Spread positions so that neighbours are ``gap`` apart: out[i] = max(x[i], out[i-1] + gap), in closed form."""
    w = Window.partitionBy(*by).orderBy("_x", *tie)
    i = F.row_number().over(w)
    moved = F.max(F.col("_x") - F.col("_i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i") * gap
    return df.withColumn("_x", x).withColumn("_i", i).withColumn(out, moved).drop("_x", "_i")


def availability(merged: DataFrame, by: list[str], begin: Column, end: Column) -> DataFrame:
    """Share of [begin, end] that the islands of a group cover, and the number of gaps in it (at its ends too)."""
    s, e = F.greatest(F.col("start"), begin), F.least(F.col("end"), end)
    inside = F.when(e > s, e - s)
    open_ends = F.when(F.min(F.when(e > s, s)) > begin, 1).otherwise(0) + F.when(F.max(F.when(e > s, e)) < end, 1).otherwise(0)
    n = F.count(inside)
    return merged.groupBy(*by).agg((F.coalesce(F.sum(inside), F.lit(0)) / (end - begin)).alias("share"), F.when(n == 0, 1).otherwise(n - 1 + open_ends).alias("n_gaps"))

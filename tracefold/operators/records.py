"""Scans of recorded and computed traces from tables of single channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import slice_by_time

EQUAL = ("starttime", "rate")


def three_components(records: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stations with three channels of one start, rate and length, the other stations with their reason).

    ``records``: by, channel, starttime (seconds), rate and samples, a row per channel. A station's
    traces come in the order of their channel codes.
    """
    agg = [F.count(F.lit(1)).alias("n")]
    for c in EQUAL:
        agg += [F.min(c).alias(c), F.max(c).alias(f"_{c}")]
    agg += [F.min(F.size("samples")).alias("npts"), F.max(F.size("samples")).alias("_npts"), F.sort_array(F.collect_list(F.struct("channel", "samples"))).alias("_c")]
    rows = records.groupBy(*by).agg(*agg)
    # more channels than three are not gathered for long: a station has a handful
    reason = F.when(F.col("n") != 3, "not three channels").when(F.abs(F.col("starttime") - F.col("_starttime")) > 1e-6, "starts differ")
    reason = reason.when(F.col("rate") != F.col("_rate"), "rates differ").when(F.col("npts") != F.col("_npts"), "lengths differ")
    told = rows.withColumn("reason", reason)
    traces = [F.get("_c", F.lit(i))["samples"].alias(f"trace{i + 1}") for i in range(3)]
    channels = F.transform("_c", lambda c: c["channel"]).alias("channels")
    good = told.filter("reason is null").select(*by, *EQUAL, "npts", channels, *traces)
    return good, told.filter("reason is not null").select(*by, "reason")


def edge_taper(trace: Column, width: Column) -> Column:
    """The first and last ``width`` samples fall to zero along half cosines."""
    n = F.size(trace)
    share = lambda i: F.least(F.lit(1.0), (F.least(i, n - 1 - i) / width).cast("double"))
    return F.transform(trace, lambda x, i: F.when(width > 0, x * (0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * share(i)))).otherwise(x))


def event_waveforms(records: DataFrame, by: list[str], allow: DataFrame | None, begin: Column, end: Column, taper: Column | None = None) -> DataFrame:
    """Stations of the allow-list whose three traces cover [begin, end), cut to it and tapered at the edges.

    ``begin`` and ``end`` (seconds) may use the columns of ``by``. Traces that do not reach that far are left out.
    """
    rows = records if allow is None else records.join(allow, allow.columns, "left_semi")
    good, _ = three_components(rows, by)
    good = good.withColumns({"_b": begin, "_e": end})
    good = good.filter((F.col("starttime") <= F.col("_b")) & (F.col("starttime") + F.col("npts") / F.col("rate") >= F.col("_e")))
    cut = lambda c: slice_by_time(F.col(c), F.col("starttime"), F.col("rate"), F.col("_b"), F.col("_e"))
    traces = {f"trace{i}": cut(f"trace{i}") for i in (1, 2, 3)}
    if taper is not None:
        good = good.withColumns(traces)
        traces = {n: edge_taper(F.col(n), taper) for n in traces}
    first = F.col("starttime") + F.floor((F.col("_b") - F.col("starttime")) * F.col("rate")) / F.col("rate")
    return good.withColumns(traces).withColumn("starttime", first).withColumn("npts", F.size("trace1")).drop("_b", "_e")


def synthetic_difference(new: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """Traces of ``new`` minus those of ``base`` (the difference mode): stations in both, of one start, rate and length."""
    b = base.select(*by, *[F.col(c).alias(f"_{c}") for c in (*EQUAL, "npts", "trace1", "trace2", "trace3")])
    same = reduce(Column.__and__, [F.abs(F.col("starttime") - F.col("_starttime")) <= 1e-6, F.col("rate") == F.col("_rate"), F.col("npts") == F.col("_npts")])
    met = new.join(b, by).filter(same)
    return met.withColumns({f"trace{i}": F.zip_with(f"trace{i}", f"_trace{i}", lambda x, y: x - y) for i in (1, 2, 3)}).select(*new.columns)

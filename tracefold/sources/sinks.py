"""Text sinks: tables with fixed decimals, and source parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DYNE_CM, HALF_DURATION


def write_csv(df: DataFrame, path: str, decimals: int = 4, mode: str = "error") -> None:
    """CSV with a header; doubles are rounded here and nowhere before."""
    columns = [F.format_string(f"%.{decimals}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def source_text(sources: DataFrame) -> DataFrame:
    """(id, value): each source as a parameter file that read_source reads back."""
    names = ("Mrr", "Mtt", "Mpp", "Mrt", "Mrp", "Mtp")
    lines = [
        F.format_string("event name: %s", F.col("id")), F.format_string("half duration: %.4f", F.col("tau") * HALF_DURATION),
        *[F.format_string(f"{n}: %.6f", F.col(n)) for n in ("latitude", "longitude", "depth")],
        *[F.format_string(f"{n}: %.8e", F.col(n.lower()) / DYNE_CM) for n in names],
    ]
    return sources.select("id", F.concat_ws("\n", *lines).alias("value"))


def ecef_source_text(sources: DataFrame, suffix: str = "") -> DataFrame:
    """(id, value): each source (header, id, tau, xs of 3, mt of 9 numbers) as a Cartesian file that
    read_source_ecef reads back; for perturbed and updated sources."""
    line = lambda name, form, c: F.format_string(f"%-18s {form}", F.lit(name), c)
    tensor = (("Mxx", 0), ("Myy", 4), ("Mzz", 8), ("Mxy", 1), ("Mxz", 2), ("Myz", 5))
    lines = [
        F.col("header"), line("event name:", "%s", F.concat("id", F.lit(suffix))), line("t0(s):", "%+15.8E", F.lit(0.0)), line("tau(s):", "%+15.8E", F.col("tau")),
        *[line(f"{c}(m):", "%+.3f", F.get("xs", F.lit(i))) for i, c in enumerate("xyz")], *[line(f"{n}(N*m):", "%+15.8E", F.get("mt", F.lit(i))) for n, i in tensor],
    ]
    return sources.select(F.concat("id", F.lit(suffix)).alias("id"), F.concat_ws("\n", *lines).alias("value"))


def write_texts(texts: DataFrame, path: str, name: str, mode: str = "error") -> None:
    """One text under <name>=<its name>/ for every row (name, value)."""
    texts.select(name, "value").repartition(name).write.mode(mode).partitionBy(name).text(path)


def adjoint_texts(df: DataFrame, trace: str, begin: str, rate: str, solver_begin: Column, solver_dt: float, solver_nt: int) -> DataFrame:
    """``df`` with ``value``: the trace on the solver's times (linear between samples, 0 outside) as lines of time and value."""
    at = lambda i: (solver_begin + i * solver_dt - F.col(begin)) * F.col(rate)

    def sample(i: Column) -> Column:
        low = F.floor(at(i)).cast("int")
        share = at(i) - low
        known = lambda k: F.when(k >= 0, F.coalesce(F.get(trace, k), F.lit(0.0))).otherwise(0.0)
        return F.format_string("%16.9E %16.9E", (solver_begin + i * solver_dt).cast("double"), known(low) * (1 - share) + known(low + 1) * share)

    lines = F.transform(F.sequence(F.lit(0), F.lit(solver_nt - 1)), sample)
    return df.withColumn("value", F.array_join(lines, "\n"))


def write_window_version(df: DataFrame, path: str, event: str, stage: str, iteration: int) -> None:
    """A measured table is a new version under event, stage and iteration: versions are never changed in place."""
    keyed = df.withColumns({"event": F.lit(event), "stage": F.lit(stage), "iter": F.lit(iteration)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event", "stage", "iter").parquet(path)

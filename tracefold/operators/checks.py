"""Consistency, coverage and orientation checks of groups, and joins that report what they do not match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def glob_pattern(glob: str) -> str:
    """A pattern for the whole text: * any characters, ? one."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() else "\\" + c for c in glob) + "$"


def exclude_globs(df: DataFrame, globs: dict[str, list[str]]) -> DataFrame:
    """Rows of which no column matches one of its globs; null matches none."""
    hit = [F.coalesce(F.col(c).rlike(glob_pattern(g)), F.lit(False)) for c, gs in globs.items() for g in gs]
    return df.filter(~reduce(Column.__or__, hit)) if hit else df


def covers(first: Column, last: Column, begin: Column, end: Column) -> Column:
    """Whether the data reach from begin to end."""
    return (first <= begin) & (last >= end)


def consistent_groups(df: DataFrame, by: list[str], same: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of groups in which the columns ``same`` agree, keys of the other groups). Null is a value."""
    told = [F.struct(*same)]
    w = Window.partitionBy(*by)
    marked = df.withColumn("_low", F.min(told[0]).over(w)).withColumn("_high", F.max(told[0]).over(w))
    agree = F.col("_low").eqNullSafe(F.col("_high"))
    return marked.filter(agree).drop("_low", "_high"), marked.filter(~agree).select(*by).distinct()


def require_consistent(df: DataFrame, by: list[str], same: list[str]) -> DataFrame:
    """``df``, if the columns agree in every group; otherwise an error that names some of the groups."""
    bad = df.groupBy(*by).agg(F.min(F.struct(*same)).alias("a"), F.max(F.struct(*same)).alias("b")).filter("not (a <=> b)").select(*by).take(5)
    if bad:
        raise ValueError(f"{same} differ within {[tuple(r) for r in bad]}")
    return df


def oriented_pairs(df: DataFrame, by: list[str], code: str, azimuth: str, least: float = 10.0) -> DataFrame:
    """Groups with two horizontals, named 1 and 2 or E and N, that do not look nearly the same way:
    (by, first, second, azimuth1, azimuth2). The angle is taken from the second to the first, mod 360."""
    last = F.substring(code, -1, 1)
    pick = lambda a, b: F.first(F.when(last.isin(a, b), F.col(azimuth)), ignorenulls=True)
    names = F.sort_array(F.collect_set(F.when(last.isin("1", "2", "E", "N"), last)))
    rows = df.groupBy(*by).agg(names.alias("names"), pick("1", "E").alias("azimuth1"), pick("2", "N").alias("azimuth2"), F.count(F.when(last.isin("1", "2", "E", "N"), 1)).alias("n"))
    pair = F.col("names").isin(F.array(F.lit("1"), F.lit("2")), F.array(F.lit("E"), F.lit("N")))
    good = rows.filter(pair & (F.col("n") == 2) & (F.pmod(F.col("azimuth1") - F.col("azimuth2"), F.lit(360.0)) >= least))
    return good.select(*by, F.get("names", F.lit(0)).alias("first"), F.get("names", F.lit(1)).alias("second"), "azimuth1", "azimuth2")


def passband(df: DataFrame, by: list[str], freq: str, gain: str, reference: float) -> DataFrame:
    """Corners of a tabulated response: the frequencies next to the reference, below and above, where the
    gain first falls 3 dB under that nearest the reference; null where it does not fall."""
    near = df.groupBy(*by).agg(F.min_by(gain, F.struct(F.abs(F.col(freq) - reference), F.col(freq))).alias("_at"))
    under = F.col(gain) < F.col("_at") * 10 ** (-3 / 20)
    return df.join(near, by).groupBy(*by).agg(
        F.max(F.when(under & (F.col(freq) < reference), F.col(freq))).alias("low_corner"),
        F.min(F.when(under & (F.col(freq) > reference), F.col(freq))).alias("high_corner"),
    )


def band_reaches(low_corner: Column, high_corner: Column, most_low: float, least_high: float) -> Column:
    """Whether a passband (null: open) begins low and ends high enough."""
    return (F.coalesce(low_corner, F.lit(0.0)) <= most_low) & (F.coalesce(high_corner, F.lit(float("inf"))) >= least_high)


def keep_old_where(status: Column, old: Column, new: Column, missing: int = -1) -> Column:
    """A masked write: where nothing was found the old value stays."""
    return F.when(status == missing, old).otherwise(new)


def match_report(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inner join, rows of the left without a partner), so that what is skipped can be told."""
    return left.join(right, keys), left.join(right.select(*keys).distinct(), keys, "left_anti")


def all_present(base: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows of ``base`` joined with one table after the other; a key that one of them lacks is skipped.
    Columns of a part are named <part>_<column>."""
    out = base
    for name, part in parts.items():
        out = out.join(part.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c not in keys]), keys)
    return out


def exactly_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of the left with its one partner; the check that there is exactly one is made where the rows meet."""
    rest = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    wrong = F.raise_error(F.concat(F.lit("not exactly one row for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    joined = left.join(one, keys, "left")
    return joined.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(wrong.cast("boolean"))).drop("_n")

"""Text sources: channel tables, source parameters, key=value files, point lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a channel line, in order.
CHANNEL_COLUMNS = ("network", "station", "location", "channel", "latitude", "longitude", "elevation", "depth", "azimuth", "dip")
CHANNEL_START, CHANNEL_END = 15, 16
#: Half duration to source time constant, and dyne cm to N m.
HALF_DURATION, DYNE_CM = 1.628, 1e-7


def read_channels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(channels, rejected lines) of ``|``-separated lines; ``#`` starts a comment line.

    Rejected are lines whose channel code has not three letters or whose start is empty; an
    empty end is open (null).
    """
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = lines.withColumn("p", F.transform(F.split("value", r"\|"), lambda x: F.trim(x)))
    field = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(""))
    time = lambda i: F.when(field(i) != "", F.to_timestamp(field(i)).cast("timestamp_ntz"))
    good = (F.length(field(3)) == 3) & (field(CHANNEL_START) != "")
    columns = [field(i).alias(c) if i < 4 else F.expr(f"try_cast(get(p, {i}) AS double)").alias(c) for i, c in enumerate(CHANNEL_COLUMNS)]
    return parts.filter(good).select(*columns, time(CHANNEL_START).alias("starttime"), time(CHANNEL_END).alias("endtime")), parts.filter(~good).select("value")


def valid_channels(channels: DataFrame, by: list[str]) -> DataFrame:
    """Groups with one vertical (|dip| 90) and two perpendicular horizontals; of others only the vertical."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by)
    vertical, flat = F.abs("dip") == 90, F.col("dip") == 0
    n_z, n_h = F.count(F.when(vertical, 1)).over(w), F.count(F.when(flat, 1)).over(w)
    az = F.sort_array(F.collect_list(F.when(flat, F.col("azimuth"))).over(w))
    perpendicular = F.abs(F.cos(F.radians(F.get(az, F.lit(1)) - F.get(az, F.lit(0))))) <= 0.1
    marked = channels.withColumns({"_z": n_z, "_ok": (n_h == 2) & F.coalesce(perpendicular, F.lit(False))})
    return marked.filter((F.col("_z") == 1) & (vertical | (F.col("_ok") & flat))).drop("_z", "_ok")


def read_parameters(spark: SparkSession, path: str) -> dict[str, str]:
    """A key = value file (a few hundred lines) as a dict; # starts a comment."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).filter(F.col("v").contains("="))
    pairs = lines.select(F.regexp_extract("v", r"^([^=]*?)\s*=", 1).alias("k"), F.regexp_extract("v", r"=\s*(.*)$", 1).alias("x"))
    return {r.k: r.x for r in pairs.collect()}


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """One row per source file in the geodetic dialect: tau from the half duration, tensor in N m, magnitude."""
    lines = spark.read.text(path, wholetext=True)
    number = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    value = lambda name: F.regexp_extract("value", rf"(?im)^\s*{name}\s*:\s*{number}", 1).cast("double")
    names = ("Mrr", "Mtt", "Mpp", "Mrt", "Mrp", "Mtp")
    rows = lines.select(
        F.regexp_extract("value", r"(?im)^\s*event name\s*:\s*(\S+)", 1).alias("id"), (value("half duration") / HALF_DURATION).alias("tau"),
        value("latitude").alias("latitude"), value("longitude").alias("longitude"), F.greatest(F.lit(0.0), value("depth")).alias("depth"),
        *[(value(n) * DYNE_CM).alias(n.lower()) for n in names],
    )
    full = F.col("mrr") ** 2 + F.col("mtt") ** 2 + F.col("mpp") ** 2 + 2 * (F.col("mrt") ** 2 + F.col("mrp") ** 2 + F.col("mtp") ** 2)
    return rows.withColumn("m0", F.sqrt(full / 2)).withColumn("mw", (F.log10("m0") - 9.05) / 1.5)


def read_source_ecef(spark: SparkSession, path: str) -> DataFrame:
    """One row per source file in the Cartesian dialect: place (m) and tensor (N m) in x, y, z as they are, with
    latitude, longitude, depth (km, not over the ground), the tensor in the r, theta, phi frame and the magnitude.

    Lines are ``name(unit): value``; the header line comes first.
    """
    from ..functions.geo import from_ecef
    from ..functions.sources import rtp_to_xyz

    lines = spark.read.text(path, wholetext=True)
    number = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    value = lambda name: F.regexp_extract("value", rf"(?im)^\s*{name}\([^)]*\)\s*:\s*{number}", 1).cast("double")
    names = ("Mxx", "Myy", "Mzz", "Mxy", "Mxz", "Myz")
    rows = lines.select(
        F.regexp_extract("value", r"^([^\n]*)", 1).alias("header"), F.regexp_extract("value", r"(?im)^\s*event name\s*:\s*(\S+)", 1).alias("id"),
        value("tau").alias("tau"), *[value(c).alias(c) for c in "xyz"], *[value(n).alias(n.lower()) for n in names],
    )
    lat, lon, height = from_ecef(F.col("x"), F.col("y"), F.col("z"))
    m = [F.col(n.lower()) for n in names]
    turned = rtp_to_xyz(m, F.col("x"), F.col("y"), F.col("z"), inverse=True)
    full = m[0] * m[0] + m[1] * m[1] + m[2] * m[2] + 2 * (m[3] * m[3] + m[4] * m[4] + m[5] * m[5])
    return rows.select(
        "*", lat.alias("latitude"), lon.alias("longitude"), F.greatest(F.lit(0.0), -height / 1000).alias("depth"),
        *[c.alias(n) for c, n in zip(turned, ("mrr", "mtt", "mpp", "mrt", "mrp", "mtp"))],
    ).withColumn("m0", F.sqrt(full / 2)).withColumn("mw", (F.log10("m0") - 9.05) / 1.5)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations separated by white space: station, network, latitude, longitude, elevation, depth; ``#`` starts a comment line."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v")).filter((F.col("v") != "") & ~F.col("v").startswith("#"))
    part = lambda i: F.get(F.split("v", " "), F.lit(i))
    return lines.select(part(0).alias("station"), part(1).alias("network"), *[part(i + 2).cast("double").alias(c) for i, c in enumerate(("latitude", "longitude", "elevation", "depth"))])


def read_statistics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Statistics tables with a header, of several runs, as one; columns that some lack are null there."""
    one = [spark.read.csv(p, header=True, inferSchema=True) for p in paths]
    out = one[0]
    for more in one[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def read_words(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(value, parts): the lines of a list, without comments and empty ones, and what stands between delimiters."""
    import re

    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    return lines.withColumn("parts", F.filter(F.transform(F.split("value", re.escape(delimiter)), lambda x: F.trim(x)), lambda x: x != ""))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``|``-separated points: name, country, region, setting, latitude, longitude, elevation."""
    schema = "name string, country string, region string, setting string, latitude double, longitude double, elevation double"
    return spark.read.csv(path, sep="|", comment="#", schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    schema = "central_lat double, central_lon double, rotation_angle double, depth_km double, width_xi double, width_eta double"
    return spark.read.csv(path, header=True, schema=schema)

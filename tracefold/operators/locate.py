"""Places in a mesh: which element holds each point, and a field there.

Elements are dealt to the cells of a grid that the ball around them covers. The grid is as coarse as the
element is large (a level for each power of two), so an element is in eight cells at most and a crowded
cell comes of crowded elements alone. What a point meets in its cells is ranked by distance over size; the
inverse map is tried from the nearest on, in rounds that double, and only for points not yet inside one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import tables
from .mesh import interpolate_located, locate_in_elements

#: Class of a point that may lie in elements of any class.
ANY_CLASS = -1


def with_size(elements: DataFrame, anchors: str) -> DataFrame:
    """``elements`` with centre (_cx, _cy, _cz: the middle one of the 27 anchors) and half size (the farthest anchor from it)."""
    a = F.col(anchors).cast("array<double>")
    centre = [F.get(a, F.lit(3 * 13 + i)) for i in range(3)]
    far = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(26)), lambda k: sum((F.get(a, 3 * k + i) - centre[i]) * (F.get(a, 3 * k + i) - centre[i]) for i in range(3))))
    return elements.withColumns({**dict(zip(("_cx", "_cy", "_cz"), centre)), "_half": F.sqrt(far)})


def box_candidates(
    points: DataFrame, elements: DataFrame, point: str, element: str, xyz: list[str], anchors: str, ratio: float = 2.0, same: str | None = None,
) -> DataFrame:
    """(point, element, x, y, z, ratio): the elements whose centre is nearer than ``ratio`` half sizes, at most once each.

    ``same``: a class that both must share, unless the point's is ANY_CLASS. Elements of no size and
    points or anchors with nulls meet nothing.
    """
    kinds = [same] if same else []
    sized = with_size(elements.select(element, anchors, *kinds), anchors).filter(F.col("_half") > 0)
    sized = sized.select(F.col(element).alias("_e"), *[F.col(s).alias("_class") for s in kinds], "_cx", "_cy", "_cz", "_half").withColumn("_level", F.ceil(F.log2("_half")).cast("int"))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())  # powers of two of a double: some at most
    width = lambda: 2 * ratio * F.pow(F.lit(2.0), F.col("_level"))
    cells = ("_x", "_y", "_z")
    dealt = sized
    for c, cell in zip(("_cx", "_cy", "_cz"), cells):
        low, high = (F.floor((F.col(c) + s * ratio * F.col("_half")) / width()) for s in (-1, 1))
        dealt = dealt.withColumn(cell, F.explode(F.sequence(low, high)))
    asked = points.select(F.col(point).alias(point), *xyz, *kinds).withColumn("_level", F.explode(F.array(*[F.lit(level) for level in levels]).cast("array<int>")))
    asked = asked.withColumns({cell: F.floor(F.col(c).cast("double") / width()) for c, cell in zip(xyz, cells)})
    met = asked.join(dealt, ["_level", *cells])
    gaps = [F.col(c).cast("double") - F.col(f"_c{a}") for c, a in zip(xyz, "xyz")]
    met = met.withColumn("ratio", F.sqrt(sum(g * g for g in gaps)) / F.col("_half")).filter(F.col("ratio") < ratio)
    if same:
        met = met.filter((F.col(same) == F.col("_class")) | (F.col(same) == ANY_CLASS))
    return met.select(point, F.col("_e").alias(element), *xyz, "ratio")


def locate_by_boxes(
    points: DataFrame, elements: DataFrame, point: str, element: str, xyz: list[str], anchors: str, max_misloc: float, ratio: float = 2.0, same: str | None = None,
) -> DataFrame:
    """(point, element, local1..3, status, misloc) of every point that lies in an element (1) or near one (0).

    Of the elements that hold a point the one whose centre is nearest for its size; if none holds it, the one with the
    least misfit, if that is ``max_misloc`` at most. Equal ones: the lesser element. Points and elements
    are told apart by their ids, which must be distinct. The result is a table that was written.

    Cases: points with a null coordinate, or near no element, have no row. Without points or elements there are none.
    """
    scope = tables(points.sparkSession, "locate")
    order = Window.partitionBy(point).orderBy("ratio", element)
    shapes = scope.cut(elements.select(element, F.col(anchors).cast("array<double>").alias("_anchors"), *([same] if same else [])))  # every round reads them
    left = scope.cut(box_candidates(points, shapes, point, element, xyz, "_anchors", ratio, same).withColumn("rank", F.row_number().over(order)))
    shapes = shapes.select(element, "_anchors")
    tried, last = [], 1
    while not left.isEmpty():
        now = left.filter(F.col("rank") <= last).join(shapes, element)
        found = scope.cut(locate_in_elements(now, xyz, "_anchors", max_misloc).drop(*xyz))
        tried.append(found)
        rest = left.filter(F.col("rank") > last).join(found.filter("status = 1").select(point).distinct(), point, "left_anti")
        left, last = scope.cut(rest), 2 * last + 1
    if not tried:
        tried = [locate_in_elements(left.join(shapes, element), xyz, "_anchors", max_misloc).drop(*xyz)]
    # inside: the first by rank; near: the least misfit
    best = Window.partitionBy(point).orderBy(F.col("status").desc(), F.when(F.col("status") == 1, 0.0).otherwise(F.col("misloc")), "rank")
    one = reduce(DataFrame.union, tried).filter("status <> -1").withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    out = scope.keep(one.select(point, element, "local1", "local2", "local3", "status", "misloc"))
    scope.close()
    return out


def interpolate_mesh(
    points: DataFrame, elements: DataFrame, point: str, element: str, xyz: list[str], anchors: str, values: str, max_misloc: float, n: int = 5,
    method: str = "gll", ratio: float = 2.0, same: str | None = None, fill: Column | None = None,
) -> DataFrame:
    """All points with value, status (-1: in no element) and misloc: the field ``values`` (array of n³ by element) where
    they lie. ``fill`` is the value of points that lie nowhere (null if it is not given)."""
    at = locate_by_boxes(points, elements, point, element, xyz, anchors, max_misloc, ratio, same)
    held = at.join(elements.select(element, F.col(values).cast("array<double>").alias("_v")), element)
    found = interpolate_located(held, "_v", ["local1", "local2", "local3"], "value", n, method).select(point, element, "status", "misloc", "value")
    met = points.join(found, point, "left")
    return met.withColumns({"status": F.coalesce("status", F.lit(-1)), "value": F.coalesce("value", fill) if fill is not None else F.col("value")})


def rotated(v: list[Column], pole: list[Column], angle: Column) -> list[Column]:
    """A place turned about a unit vector by an angle (radians, right-handed)."""
    along = sum(a * b for a, b in zip(v, pole))
    cross = [pole[(i + 1) % 3] * v[(i + 2) % 3] - pole[(i + 2) % 3] * v[(i + 1) % 3] for i in range(3)]
    return [v[i] * F.cos(angle) + cross[i] * F.sin(angle) + pole[i] * along * (1 - F.cos(angle)) for i in range(3)]


def direction(lat: Column, lon: Column) -> list[Column]:
    """Unit vector of a geocentric latitude and longitude (degrees)."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def sheet(spark, angles: tuple[float, float, int], radii: tuple[float, float, int]) -> DataFrame:
    """All angles at all radii, numbered (point), angle by angle."""
    n = radii[2]
    low, high = ((b - a) / (k - 1) if k > 1 else 0.0 for a, b, k in (angles, radii))
    i, k = F.floor(F.col("id") / n), F.col("id") % n
    return spark.range(angles[2] * n).select(F.col("id").alias("point"), (angles[0] + low * i).alias("angle"), (radii[0] + high * k).alias("radius"))


def placed(df: DataFrame, v: list[Column]) -> DataFrame:
    return df.withColumns({c: F.col("radius") * x for c, x in zip("xyz", v)})


def great_circle_section(spark, lat: float, lon: float, azimuth: float, angles: tuple[float, float, int], radii: tuple[float, float, int]) -> DataFrame:
    """(point, angle, radius, x, y, z) along a great circle from a place towards an azimuth (degrees), at all radii."""
    f, a = F.lit, F.radians(F.lit(azimuth))
    up, north = direction(f(lat), f(lon)), direction(f(lat + 90.0), f(lon))
    east = [-F.sin(F.radians(f(lon))), F.cos(F.radians(f(lon))), f(0.0)]
    ahead = [F.cos(a) * n + F.sin(a) * e for n, e in zip(north, east)]
    pole = [up[(i + 1) % 3] * ahead[(i + 2) % 3] - up[(i + 2) % 3] * ahead[(i + 1) % 3] for i in range(3)]
    return placed(df := sheet(spark, angles, radii), rotated(up, pole, F.radians(df["angle"])))


def small_circle_section(spark, pole: tuple[float, float], start: tuple[float, float], angles: tuple[float, float, int], radii: tuple[float, float, int]) -> DataFrame:
    """(point, angle, radius, x, y, z) along the circle of a place (lat, lon) about a pole (lat, lon), at all radii."""
    f = F.lit
    return placed(df := sheet(spark, angles, radii), rotated(direction(f(start[0]), f(start[1])), direction(f(pole[0]), f(pole[1])), F.radians(df["angle"])))


def vertical_section(spark, start: tuple[float, float], end: tuple[float, float], n: int, radii: tuple[float, float, int]) -> DataFrame:
    """(point, angle, radius, x, y, z) between two places (lat, lon), evenly along their great circle, at all radii."""
    f = F.lit
    a, b = direction(f(start[0]), f(start[1])), direction(f(end[0]), f(end[1]))
    whole = F.acos(F.greatest(f(-1.0), F.least(f(1.0), sum(x * y for x, y in zip(a, b)))))
    df = sheet(spark, (0.0, 1.0, n), radii).withColumn("angle", F.degrees(whole) * F.col("angle"))
    part = F.radians(F.col("angle"))
    along = [(F.sin(whole - part) * x + F.sin(part) * y) / F.sin(whole) for x, y in zip(a, b)]
    return placed(df, along)


def sphere_section(spark, lats: tuple[float, float, int], lons: tuple[float, float, int], radius: float) -> DataFrame:
    """(point, lat, lon, radius, x, y, z) of a grid on a sphere; longitudes past 180 come round."""
    df = sheet(spark, lats, lons).select("point", F.col("angle").alias("lat"), (F.pmod(F.col("radius") + 180, F.lit(360.0)) - 180).alias("lon"), F.lit(float(radius)).alias("radius"))
    return placed(df, direction(F.col("lat"), F.col("lon")))

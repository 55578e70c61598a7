"""Solvers over a connected mesh, sections through it, relocation and spacing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffusion as D
from ..functions import geo as G
from ..operators import locate as L
from ..operators import relocate as R
from ..operators import spacing as P
from .mesh import N, basis_sql
from .registry import query, table

#: The lattice of elements: so many side by side; so many layers of them are a block.
SIDE, LAYERS = 8, 16
WIDTH = SIDE * (N - 1) + 1
PLACE = "vec_id % {s} AS i, vec_id // {s} % {s} AS j, vec_id // {s2} AS k".format(s=SIDE, s2=SIDE * SIDE)


def node_id(i, j, k, a: int, b: int, c: int):
    return ((k * (N - 1) + c) * WIDTH + j * (N - 1) + b) * WIDTH + i * (N - 1) + a


def lattice(spark, sf_dir):
    """Vectors as elements of 64 points, side by side: (block, element, nodes, anchors), and their values."""
    v = F.col("vec_id").cast("long")
    t = table(spark, sf_dir, "embeddings").select(
        v.alias("element"), (v % SIDE).alias("i"), (F.floor(v / SIDE) % SIDE).alias("j"), F.floor(v / SIDE**2).alias("k"), F.col("embedding").cast("array<double>").alias("u"))
    i, j, k = (F.col(c) for c in "ijk")
    each = [(a, b, c) for c in range(N) for b in range(N) for a in range(N)]
    places = [p for c in (0, 0.5, 1) for b in (0, 0.5, 1) for a in (0, 0.5, 1) for p in (i + a, 1.1 * (j + b), 0.9 * (k + c) + 0.05 * (i + a))]
    return t.select(
        F.floor(k / LAYERS).alias("block"), "element", F.array(*[node_id(i, j, k, *p) for p in each]).alias("nodes"), F.array(*[p.cast("double") for p in places]).alias("anchors"), "u")


@query(f"""
WITH e AS (SELECT {PLACE}, embedding FROM embeddings), p AS (SELECT i, j, k, unnest(embedding)::DOUBLE AS u, unnest(range({N**3})) AS x FROM e)
SELECT CAST(((k * {N - 1} + x // {N * N}) * {WIDTH} + j * {N - 1} + x // {N} % {N}) * {WIDTH} + i * {N - 1} + x % {N} AS BIGINT) AS node, round(avg(u), 4) AS value FROM p GROUP BY 1""")
def mesh_diffusion_roundtrip(spark, sf_dir):
    """An implicit step of diffusion over one connected mesh, and the operator that undoes it: the nodes' means again."""
    mesh = lattice(spark, sf_dir)
    elements = mesh.drop("u")
    points = mesh.select(F.explode(F.arrays_zip("nodes", "u")).alias("x")).groupBy(F.col("x.nodes").alias("node")).agg(F.avg("x.u").alias("value"))
    smooth = D.smooth_mesh(elements, points, "node", "value", F.lit(0.1), F.lit(0.05), "bessel", n=N, up=(0.0, 0.0, 1.0), tolerance=1e-24)
    back = D.apply_mesh(elements, smooth, "node", "value", F.lit(0.1), F.lit(0.05), n=N, up=(0.0, 0.0, 1.0))
    return back.select("node", (F.round("value", 4) + F.lit(0.0)).alias("value"))


#: Where the lattice begins, so that the origin lies inside and no section runs along a face.
SHIFT = (-4.03, -4.41, -3.57)


def around_origin(spark, sf_dir):
    """The lattice with the origin in its middle."""
    move = F.flatten(F.array_repeat(F.array(*[F.lit(s) for s in SHIFT]), 27))
    return lattice(spark, sf_dir).withColumn("anchors", F.zip_with("anchors", move, lambda a, b: a + b))


def section_sql(points: str) -> str:
    """The field at the points (CTE s: point, x, y, z): the lattice is a linear map of its numbers, which is undone."""
    return f"""
WITH {points},
q AS (SELECT point, x, y, z, x - ({SHIFT[0]}) AS p, (y - ({SHIFT[1]})) / 1.1 AS q, (z - ({SHIFT[2]}) - 0.05 * (x - ({SHIFT[0]}))) / 0.9 AS r FROM s),
o AS (SELECT *, 2 * (p - floor(p)) - 1 AS a, 2 * (q - floor(q)) - 1 AS b, 2 * (r - floor(r)) - 1 AS c FROM q),
e AS (SELECT {PLACE}, list_transform(embedding, lambda v: v::DOUBLE) AS u FROM embeddings),
m AS (SELECT o.*, u, {basis_sql("a")} AS la, {basis_sql("b")} AS lb, {basis_sql("c")} AS lc FROM o LEFT JOIN e ON i = floor(p) AND j = floor(q) AND k = floor(r))
SELECT point, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CAST(u IS NOT NULL AS INTEGER) * 2 - 1 AS status,
  round(list_sum(list_transform(range({N**3}), lambda n: u[n + 1] * la[n % {N} + 1] * lb[(n // {N}) % {N} + 1] * lc[n // {N * N} + 1])), 5) AS value FROM m"""


def section(spark, sf_dir, points):
    found = L.interpolate_mesh(points, around_origin(spark, sf_dir), "point", "element", ["x", "y", "z"], "anchors", "u", 1e-6, N)
    return found.select("point", *[F.round(c, 6).alias(c) for c in "xyz"], "status", F.round("value", 5).alias("value"))


def turn_sql(v: str, pole: str, angle: str) -> str:
    """x, y, z of radius times v turned about the pole (lists of three)."""
    cross = lambda i: f"({pole}[{(i + 1) % 3 + 1}] * {v}[{(i + 2) % 3 + 1}] - {pole}[{(i + 2) % 3 + 1}] * {v}[{(i + 1) % 3 + 1}])"
    return ", ".join(f"radius * ({v}[{i + 1}] * cos({angle}) + {cross(i)} * sin({angle}) + {pole}[{i + 1}] * list_inner_product({v}, {pole}) * (1 - cos({angle}))) AS {c}" for i, c in enumerate("xyz"))


def unit_sql(lat: float, lon: float) -> str:
    return f"[cos(radians({lat})) * cos(radians({lon})), cos(radians({lat})) * sin(radians({lon})), sin(radians({lat}))]"


def sheet_sql(angles: tuple, radii: tuple) -> str:
    (a0, a1, n), (r0, r1, m) = angles, radii
    return f"g AS (SELECT i * {m} + k AS point, {a0} + {a1 - a0} / {n - 1}.0::DOUBLE * i AS angle, {r0} + {r1 - r0} / {m - 1}.0::DOUBLE * k AS radius FROM (SELECT unnest(range({n})) AS i), (SELECT unnest(range({m})) AS k))"


ANGLES, RADII = (-170.0, 175.0, 70), (0.4, 4.6, 9)


@query(section_sql(f"{sheet_sql(ANGLES, RADII)}, h AS (SELECT *, {unit_sql(20.0, 30.0)} AS up, [-sin(radians(20)) * cos(radians(30)), -sin(radians(20)) * sin(radians(30)), cos(radians(20))] AS n, [-sin(radians(30)), cos(radians(30)), 0.0] AS e FROM g), "
    "s AS (SELECT point, " + ", ".join(f"radius * (cos(radians(angle)) * up[{i}] + sin(radians(angle)) * (cos(radians(65)) * n[{i}] + sin(radians(65)) * e[{i}])) AS {c}" for i, c in enumerate("xyz", 1)) + " FROM h)"))
def section_great_circle(spark, sf_dir):
    """A field along a great circle through the mesh, at many depths; outside the mesh there is none."""
    return section(spark, sf_dir, L.great_circle_section(spark, 20.0, 30.0, 65.0, ANGLES, RADII))


@query(section_sql(f"{sheet_sql(ANGLES, RADII)}, s AS (SELECT point, {turn_sql(unit_sql(10.0, 50.0), unit_sql(55.0, -20.0), 'radians(angle)')} FROM g)"))
def section_small_circle(spark, sf_dir):
    """A field along a small circle about a pole."""
    return section(spark, sf_dir, L.small_circle_section(spark, (55.0, -20.0), (10.0, 50.0), ANGLES, RADII))


@query(section_sql(f"{sheet_sql((0.0, 1.0, 40), RADII)}, w AS (SELECT *, acos(list_inner_product({unit_sql(-35.0, 10.0)}, {unit_sql(40.0, 100.0)})) AS w, {unit_sql(-35.0, 10.0)} AS a, {unit_sql(40.0, 100.0)} AS b FROM g), "
    "s AS (SELECT point, " + ", ".join(f"radius * (sin(w - w * angle) * a[{i}] + sin(w * angle) * b[{i}]) / sin(w) AS {c}" for i, c in enumerate("xyz", 1)) + " FROM w)"))
def section_vertical(spark, sf_dir):
    """A field under the line between two places."""
    return section(spark, sf_dir, L.vertical_section(spark, (-35.0, 10.0), (40.0, 100.0), 40, RADII))


@query(section_sql(f"{sheet_sql((-85.0, 85.0, 18), (100.0, 420.0, 33))}, s AS (SELECT point, " + ", ".join(f"3.3 * {t} AS {c}" for t, c in zip(
    ("cos(radians(angle)) * cos(radians(radius))", "cos(radians(angle)) * sin(radians(radius))", "sin(radians(angle))"), "xyz")) + " FROM g)"))
def section_sphere(spark, sf_dir):
    """A field on a sphere: a grid of latitudes and of longitudes that come round past 180."""
    return section(spark, sf_dir, L.sphere_section(spark, (-85.0, 85.0, 18), (100.0, 420.0, 33), 3.3))


RAYS = """
WITH w AS (SELECT l_suppkey, ((l_suppkey * 37) % 120 - 60)::DOUBLE AS lat, ((l_suppkey * 91) % 360 - 180)::DOUBLE AS lon, (5 + l_suppkey % 300)::DOUBLE AS depth,
  radians((l_orderkey * 7 + l_linenumber * 50) % 360) AS az, (l_partkey % 140 - 70)::DOUBLE AS takeoff, 300.0 + 10 * l_quantity::DOUBLE AS p, 1 - 4 * l_discount::DOUBLE AS w,
  (l_tax::DOUBLE * 50 - 2) + sin(l_orderkey) AS shift FROM lineitem),
t AS (SELECT *, radians(takeoff + CASE WHEN takeoff < 0 THEN 180 ELSE 0 END) AS t, p / (6371.0 - depth) AS s FROM w),
r AS (SELECT *, -cos(az) * sin(t) * s AS r0, -sin(az) * sin(t) * s AS r1, -cos(t) * s AS r2, 1.0 AS r3 FROM t)"""


def elimination(fixed: tuple[int, ...] = ()) -> str:
    """SELECT list that solves the symmetric system g, d by elimination, column by column."""
    free = [i for i in range(4) if i not in fixed]
    out, g = [], {(i, j): f"g{min(i, j)}{max(i, j)}" for i in free for j in free}
    d = {i: f"d{i}" for i in free}
    for n, p in enumerate(free):
        for i in free[n + 1:]:
            for j in free[n + 1:]:
                out.append(f"{g[i, j]} - {g[i, p]} * {g[p, j]} / {g[p, p]} AS e{n}{i}{j}")
            out.append(f"{d[i]} - {g[i, p]} * {d[p]} / {g[p, p]} AS f{n}{i}")
        for i in free[n + 1:]:
            d[i] = f"f{n}{i}"
            for j in free[n + 1:]:
                g[i, j] = f"e{n}{i}{j}"
    for i in reversed(free):
        rest = "".join(f" - {g[i, j]} * m{j}" for j in free if j > i)
        out.append(f"({d[i]}{rest}) / {g[i, i]} AS m{i}")
    return ", ".join([*out, *[f"0.0 AS m{i}" for i in fixed]])


def relocation_sql(fixed: tuple[int, ...] = ()) -> str:
    sums = ", ".join([*[f"sum(w * w * r{i} * r{j}) AS g{i}{j}" for i in range(4) for j in range(i, 4)], *[f"sum(w * w * r{i} * shift) AS d{i}" for i in range(4)]])
    a, e2 = G.WGS84_A, G.WGS84_E2
    return RAYS + f""", q AS (SELECT l_suppkey, count(*) AS n, min(lat) AS lat, min(lon) AS lon, min(depth) AS depth, {sums} FROM r GROUP BY 1),
v AS (SELECT *, {elimination(fixed)} FROM q),
s2 AS (SELECT r.l_suppkey, avg(w * shift) AS data_mean, stddev_pop(w * shift) AS data_std, avg(w * (shift - m0 * r0 - m1 * r1 - m2 * r2 - m3)) AS residual_mean, stddev_pop(w * (shift - m0 * r0 - m1 * r1 - m2 * r2 - m3)) AS residual_std
  FROM r JOIN v ON r.l_suppkey = v.l_suppkey GROUP BY 1),
x AS (SELECT *, {a} / sqrt(1 - {e2} * sin(radians(lat)) * sin(radians(lat))) AS nn FROM v),
y AS (SELECT *, (nn - 1000 * depth) * cos(radians(lat)) * cos(radians(lon)) + 1000 * (-m0 * sin(radians(lat)) * cos(radians(lon)) - m1 * sin(radians(lon)) - m2 * cos(radians(lat)) * cos(radians(lon))) AS x,
  (nn - 1000 * depth) * cos(radians(lat)) * sin(radians(lon)) + 1000 * (-m0 * sin(radians(lat)) * sin(radians(lon)) + m1 * cos(radians(lon)) - m2 * cos(radians(lat)) * sin(radians(lon))) AS y,
  (nn * (1 - {e2}) - 1000 * depth) * sin(radians(lat)) + 1000 * (m0 * cos(radians(lat)) - m2 * sin(radians(lat))) AS z FROM x)
SELECT y.l_suppkey, n, round(m0, 5) AS north, round(m1, 5) AS east, round(m2, 5) + 0.0 AS down, round(m3, 6) AS time, {4 - len(fixed)} AS rank, round(degrees(atan2(y, x)), 5) AS longitude, round(sqrt(x * x + y * y + z * z) / 1000, 5) AS radius,
  round(data_mean, 6) AS data_mean, round(data_std, 6) AS data_std, round(residual_mean, 6) AS residual_mean, round(residual_std, 6) AS residual_std FROM y JOIN s2 ON y.l_suppkey = s2.l_suppkey"""


def relocated(spark, sf_dir, fixed_depth: bool):
    c, f = F.col, F.lit
    rays = table(spark, sf_dir, "lineitem")
    got = R.relocate(
        rays, ["l_suppkey"], ((c("l_orderkey") * 7 + c("l_linenumber") * 50) % 360).cast("double"), (c("l_partkey") % 140 - 70).cast("double"), 300.0 + 10 * c("l_quantity").cast("double"),
        c("l_tax").cast("double") * 50 - 2 + F.sin("l_orderkey"), 1 - 4 * c("l_discount").cast("double"),
        ((c("l_suppkey") * 37) % 120 - 60).cast("double"), ((c("l_suppkey") * 91) % 360 - 180).cast("double"), (5 + c("l_suppkey") % 300).cast("double"), fixed_depth)
    x, y, z = G.to_ecef(c("latitude"), c("longitude"), -1000 * c("depth"))
    digits = {"north": 5, "east": 5, "down": 5, "time": 6, "longitude": 5, "radius": 5, "data_mean": 6, "data_std": 6, "residual_mean": 6, "residual_std": 6}
    return got.withColumn("radius", F.sqrt(x * x + y * y + z * z) / 1000).select("l_suppkey", "n", "rank", *[(F.round(k, d) + f(0.0)).alias(k) for k, d in digits.items()])


@query(relocation_sql())
def relocation(spark, sf_dir):
    """Sources moved by the time shifts of their windows."""
    return relocated(spark, sf_dir, False)


@query(relocation_sql((2,)))
def relocation_fixed_depth(spark, sf_dir):
    """The same where the depth is known."""
    return relocated(spark, sf_dir, True)


SPOT = "cos(radians({k} * 7919 % 1700 / 10.0 - 85)) * cos(radians({k} * 104729 % 3600 / 10.0)) AS x, cos(radians({k} * 7919 % 1700 / 10.0 - 85)) * sin(radians({k} * 104729 % 3600 / 10.0)) AS y, sin(radians({k} * 7919 % 1700 / 10.0 - 85)) AS z"


@query(f"""
WITH RECURSIVE e AS (SELECT {SPOT.format(k="(s_suppkey * 13 + 5)")} FROM supplier), c AS (SELECT c_custkey AS id, {SPOT.format(k="c_custkey")} FROM customer),
d AS (SELECT id, c.x, c.y, c.z, min(sqrt((c.x - e.x) ** 2 + (c.y - e.y) ** 2 + (c.z - e.z) ** 2)) AS d FROM c, e GROUP BY ALL),
r AS (SELECT 0 AS step, id, x, y, z, d FROM d WHERE d >= 0.25 UNION ALL
  SELECT step + 1, id, x, y, z, now FROM (SELECT *, least(d, sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2)) AS now FROM (
    SELECT *, row_number() OVER w AS n, first_value(x) OVER w AS px, first_value(y) OVER w AS py, first_value(z) OVER w AS pz FROM r WINDOW w AS (ORDER BY d DESC, id))) WHERE n > 1 AND now >= 0.25)
SELECT id AS c_custkey, round(d, 7) AS distance FROM r QUALIFY row_number() OVER (PARTITION BY step ORDER BY d DESC, id) = 1""")
def farthest_first(spark, sf_dir):
    """Stations added to the existing ones, farthest first, while a least distance is kept."""
    def spots(name: str, key):
        lat, lon = F.radians(key * 7919 % 1700 / 10 - 85), F.radians(key * 104729 % 3600 / 10)
        return table(spark, sf_dir, name).select("*", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))

    found = P.farthest_first(spots("customer", F.col("c_custkey")), spots("supplier", F.col("s_suppkey") * 13 + 5), "c_custkey", ["x", "y", "z"], 0.25)
    return found.select("c_custkey", F.round("distance", 7).alias("distance"))

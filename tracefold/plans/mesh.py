"""Meshes and models: elements, grids, profiles, kernels, smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import geo as G
from ..functions import gll
from ..operators import aggregates as A
from ..operators import lineage
from ..operators import mesh as M
from ..operators import smoothing as S
from ..operators import spacing as P
from .joins import XYZ, places
from .models import KEY
from .registry import query, table

N = 4
NODES, WEIGHTS = (x.tolist() for x in gll.nodes_and_weights(N))
W = f"{WEIGHTS}::DOUBLE[]"
SLOPES = gll.derivative_matrix(N).tolist()


def e(i: int):
    return F.get("embedding", F.lit(i)).cast("double")


def lagrange_sql(x: str, a: int) -> str:
    return " * ".join(f"(({x} - ({n})) / ({NODES[a] - n}))" for m, n in enumerate(NODES) if m != a)


def basis_sql(x: str) -> str:
    return "[" + ", ".join(lagrange_sql(x, a) for a in range(N)) + "]"


LOCAL = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS u, (vec_id % 19) / 9.5 - 0.95 AS a, (vec_id % 17) / 8.5 - 0.95 AS b, (vec_id % 13) / 6.5 - 0.95 AS c FROM embeddings)"


def located(spark, sf_dir):
    """Elements of 64 points with a place inside."""
    at = lambda n, h: (F.col("vec_id") % n) / h - 0.95
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"), at(19, 9.5).alias("a"), at(17, 8.5).alias("b"), at(13, 6.5).alias("c"))


@query(LOCAL + f""", w AS (SELECT vec_id, u, {basis_sql("a")} AS la, {basis_sql("b")} AS lb, {basis_sql("c")} AS lc FROM v)
SELECT vec_id, round(list_sum(list_transform(range({N**3}), lambda i: u[i + 1] * la[i % {N} + 1] * lb[(i // {N}) % {N} + 1] * lc[i // {N * N} + 1])), 6) AS value FROM w""")
def interpolate_gll(spark, sf_dir):
    """A field at a place in each element, by the Lagrange polynomials of its nodes."""
    return M.interpolate_located(located(spark, sf_dir), "u", ["a", "b", "c"], "value", N, "gll").select("vec_id", F.round("value", 6).alias("value"))


def linear_sql(x: str) -> str:
    parts = []
    for a in range(N):
        up = f"WHEN {x} BETWEEN {NODES[a - 1]} AND {NODES[a]} THEN ({x} - ({NODES[a - 1]})) / {NODES[a] - NODES[a - 1]}" if a else ""
        down = f"WHEN {x} BETWEEN {NODES[a]} AND {NODES[a + 1]} THEN ({NODES[a + 1]} - {x}) / {NODES[a + 1] - NODES[a]}" if a < N - 1 else ""
        parts.append(f"CASE {up} {down} ELSE 0.0 END")
    return "[" + ", ".join(parts) + "]"


@query(LOCAL + f""", w AS (SELECT vec_id, u, {linear_sql("a")} AS la, {linear_sql("b")} AS lb, {linear_sql("c")} AS lc FROM v)
SELECT vec_id, round(list_sum(list_transform(range({N**3}), lambda i: u[i + 1] * la[i % {N} + 1] * lb[(i // {N}) % {N} + 1] * lc[i // {N * N} + 1])), 6) AS value FROM w""")
def interpolate_linear(spark, sf_dir):
    return M.interpolate_located(located(spark, sf_dir), "u", ["a", "b", "c"], "value", N, "linear").select("vec_id", F.round("value", 6).alias("value"))


def slope_sql(axis: int) -> str:
    step = N**axis
    at = f"(i - ((i // {step}) % {N}) * {step} + m * {step} + 1)"
    d = "[" + ", ".join("[" + ", ".join(map(str, row)) + "]" for row in SLOPES) + "]::DOUBLE[][]"
    return f"list_transform(range({N**3}), lambda i: list_sum(list_transform(range({N}), lambda m: ({d})[(i // {step}) % {N} + 1][m + 1] * u[{at}])))"


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS u, [1.0 + vec_id % 3, 1.0, 0.5 + vec_id % 2] AS k FROM embeddings),
g AS (SELECT vec_id, u, k, {", ".join(f"{slope_sql(i)} AS g{i}" for i in range(3))}, list_transform(range({N**3}), lambda i: ({W})[i % {N} + 1] * ({W})[(i // {N}) % {N} + 1] * ({W})[i // {N * N} + 1]) AS w FROM v)
SELECT vec_id, round(list_sum(list_transform(range(1, {N**3 + 1}), lambda i: w[i] * (k[1] * g0[i] * g0[i] + k[2] * g1[i] * g1[i] + k[3] * g2[i] * g2[i]))), 4) AS energy, 0.0::DOUBLE AS total FROM g""")
def weak_laplacian(spark, sf_dir):
    """Element integrals of grad v · K grad u: with v = u the energy; their sum is 0, for a constant has no gradient."""
    k = [1.0 + F.col("vec_id") % 3, F.lit(1.0), 0.5 + F.col("vec_id") % 2]
    weights = [WEIGHTS[i % N] * WEIGHTS[i // N % N] * WEIGHTS[i // N // N] for i in range(N**3)]
    metric = F.flatten(F.transform(F.array(*[F.lit(w) for w in weights]), lambda w: F.array(*[w * k[a] if a == b else F.lit(0.0) for a in range(3) for b in range(3)])))
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"), F.col("embedding").cast("array<double>").alias("v"), metric.alias("m"))
    found = M.weak_laplacian(df, "u", "m", "ku", N)
    energy = F.aggregate(F.zip_with("v", "ku", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate("ku", F.lit(0.0), lambda a, x: a + x)
    return found.select("vec_id", F.round(energy, 4).alias("energy"), (F.round(total, 6) + F.lit(0.0)).alias("total"))


@query("SELECT vec_id, round((vec_id % 19) / 9.5 - 0.95, 5) AS a, round((vec_id % 17) / 8.5 - 0.95, 5) AS b, round((vec_id % 13) / 6.5 - 0.95, 5) AS c, 1 AS status FROM embeddings")
def locate_in_element(spark, sf_dir):
    """Places of known local coordinates in bent elements, found again by the inverse map."""
    df = located(spark, sf_dir)
    x = [F.col(c) for c in "abc"]
    bend = [0.1 * F.get("u", F.lit(i)) for i in range(3)]
    # a map that is quadratic in each coordinate, as the shape functions are
    place = lambda c: [c[0] * 10 + bend[0] * c[1] * c[1], c[1] * 12 + bend[1] * c[2] * c[2], c[2] * 8 + bend[2] * c[0] * c[1]]
    anchors = [y for w in (-1.0, 0.0, 1.0) for v in (-1.0, 0.0, 1.0) for u in (-1.0, 0.0, 1.0) for y in place([F.lit(u), F.lit(v), F.lit(w)])]
    df = df.select("vec_id", *[c.alias(n) for c, n in zip(place(x), "xyz")], F.array(*anchors).alias("anchors"))
    found = M.locate_in_elements(df, ["x", "y", "z"], "anchors", 0.1)
    return found.select("vec_id", *[F.round(f"local{i + 1}", 5).alias(n) for i, n in enumerate("abc")], "status")


KNOTS = "g AS (SELECT i % 6 AS x, (i // 6) % 6 AS y, i // 36 AS z, ((i * 7) % 11)::DOUBLE AS v FROM (SELECT unnest(range(216)) AS i))"


@query(XYZ.rsplit(", d AS", 1)[0] + f""", {KNOTS}, a AS (SELECT vec_id, least(5.0, greatest(0.0, (x + 0.5) / 0.2)) AS x, least(5.0, greatest(0.0, (y + 0.5) / 0.2)) AS y, least(5.0, greatest(0.0, (z + 0.5) / 0.2)) AS z FROM p),
b AS (SELECT vec_id, x, y, z, least(4, floor(x)) AS i, least(4, floor(y)) AS j, least(4, floor(z)) AS k FROM a)
SELECT vec_id, round(sum((1 - abs(b.x - g.x)) * (1 - abs(b.y - g.y)) * (1 - abs(b.z - g.z)) * v), 6) AS value FROM b JOIN g ON g.x - i IN (0, 1) AND g.y - j IN (0, 1) AND g.z - k IN (0, 1) GROUP BY 1""")
def grid_interpolation(spark, sf_dir):
    """A regular three-dimensional grid at scattered places, clamped outside."""
    i = F.col("id").cast("int")
    g = spark.range(216).select((i % 6).alias("x"), (F.floor(i / 6) % 6).cast("int").alias("y"), F.floor(i / 36).cast("int").alias("z"), ((i * 7) % 11).cast("double").alias("v"))
    found = M.grid_interpolate(places(spark, sf_dir), "vec_id", {c: (-0.5, 0.2, 6) for c in "xyz"}, g, "v", "value")
    return found.select("vec_id", F.round("value", 6).alias("value"))


@query("""
WITH q AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE 'S' END AS phase, least(4.0, greatest(0.0, o_totalprice / 100000)) AS d, least(3.0, greatest(0.0, o_custkey % 700 / 200.0)) AS h FROM orders),
c AS (SELECT *, least(3, floor(d)) AS i, least(2, floor(h)) AS j FROM q), t AS (SELECT p.phase, i AS d, j AS h, f * sqrt(i * 100.0 + 10 * j + 1) AS time FROM (SELECT unnest(['P', 'S']) AS phase, unnest([6.0, 10.5]) AS f) p, (SELECT unnest(range(5)) AS i), (SELECT unnest(range(4)) AS j))
SELECT o_orderkey, c.phase, round(sum((1 - abs(c.d - t.d)) * (1 - abs(c.h - t.h)) * time), 6) AS time FROM c JOIN t ON c.phase = t.phase AND t.d - i IN (0, 1) AND t.h - j IN (0, 1) GROUP BY 1, 2""")
def travel_times(spark, sf_dir):
    """Arrival times from a table by phase, distance and depth."""
    i, two = F.col("id").cast("int"), spark.createDataFrame([("P", 6.0), ("S", 10.5)], "phase string, f double")
    knots = spark.range(20).select((i % 5).alias("d"), F.floor(i / 5).cast("int").alias("h")).crossJoin(F.broadcast(two))
    times = knots.select("phase", "d", "h", (F.col("f") * F.sqrt(F.col("d") * 100.0 + 10 * F.col("h") + 1)).alias("time"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "P").otherwise("S").alias("phase"), F.col("o_totalprice").alias("d"), (F.col("o_custkey") % 700).cast("double").alias("h"))
    found = M.grid_interpolate(rows, "o_orderkey", {"d": (0.0, 100000.0, 5), "h": (0.0, 200.0, 4)}, times, "time", "time", ["phase"])
    return found.select("o_orderkey", "phase", F.round("time", 6).alias("time"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 10 + 1 AS a, l_discount AS b, l_tax + 0.5 AS c, l_suppkey FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey - 1 AS iglob, round(1 / (a * (c * 2 - b * 0.1) - b * (0.2 * 2 - b * 0.3) + 0.1 * (0.2 * 0.1 - c * 0.3)), 6) AS jacobian FROM d""")
def mesh_jacobian(spark, sf_dir):
    """Jacobians from nine derivatives, and 0-based node numbers."""
    q, d, t = F.col("l_quantity") / 10 + 1, F.col("l_discount"), F.col("l_tax") + 0.5
    rows = {"xi": (q, d, F.lit(0.1)), "eta": (F.lit(0.2), t, d), "gam": (F.lit(0.3), F.lit(0.1), F.lit(2.0))}
    jac = M.jacobian({f"{a}_{x}": c for a, cs in rows.items() for x, c in zip("xyz", cs)})
    return table(spark, sf_dir, "lineitem").select(*KEY, (F.col("l_partkey") - 1).alias("iglob"), F.round(jac, 6).alias("jacobian"))


@query("""
WITH p AS (SELECT row_number() OVER () AS r, l_orderkey, l_extendedprice::DOUBLE / 1000 AS x, l_quantity::DOUBLE AS y, l_discount::DOUBLE * 100 AS z, l_quantity::DOUBLE AS v FROM lineitem),
d AS (SELECT a.l_orderkey, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d2 FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.r < b.r GROUP BY 1)
SELECT p.l_orderkey, round(CASE WHEN min(d2) > 0 THEN 0.5 * max(v) / sqrt(min(d2)) END, 9) AS courant FROM p LEFT JOIN d ON p.l_orderkey = d.l_orderkey GROUP BY 1""")
def courant_number(spark, sf_dir):
    """Over all pairs of an element's points."""
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", *[(F.col(c).cast("double") * f).alias(n) for n, c, f in (("x", "l_extendedprice", 0.001), ("y", "l_quantity", 1.0), ("z", "l_discount", 100.0))])
    found = M.courant_number(points, ["l_orderkey"], ["x", "y", "z"], F.col("y"), 0.5)
    return found.select("l_orderkey", F.round("courant", 9).alias("courant"))


@query("SELECT l_partkey, round(sum(l_extendedprice), 4) AS total FROM lineitem GROUP BY 1")
def ordered_assembly(spark, sf_dir):
    """Sums of shared nodes in the order of their shards: the same bits at every run."""
    rows = table(spark, sf_dir, "lineitem").withColumn("rank", F.struct("l_suppkey", *KEY))
    return M.assemble(rows, "l_partkey", "rank", "l_extendedprice", "total").select("l_partkey", F.round("total", 4).alias("total"))


@query("SELECT l_returnflag, round(CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(38, 10))) AS DOUBLE), 6) AS total FROM lineitem GROUP BY 1")
def exact_inner_product(spark, sf_dir):
    """A sum of decimals, which does not depend on the order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(A.exact_sum(F.col("l_extendedprice") * F.col("l_discount")), 6).alias("total"))


K = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"SELECT vec_id, round(list_sum(list_transform({K}[1:16], lambda x: x * x)) * 2.5 * 2.5, 8) AS diagonal FROM embeddings")
def hessian_diagonal(spark, sf_dir):
    k = F.slice(F.col("embedding").cast("array<double>"), 1, 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.hessian_diagonal(k, F.lit(2.5)), 8).alias("diagonal"))


@query(f"""
WITH k AS (SELECT vec_id, {K} AS c, 0.01 * (vec_id % 5) AS alpha, -0.01 * (vec_id % 3) AS beta, 0.02 * (vec_id % 4) AS phi, 0.03 * (vec_id % 2) AS xi, 0.9 AS eta, 3.3 AS rho, 8.0 AS vp0, 4.5 AS vs0 FROM embeddings),
n AS (SELECT *, c[1] AS c11, c[2] AS c12, c[3] AS c13, c[7] AS c22, c[8] AS c23, c[12] AS c33, c[16] AS c44, c[19] AS c55, c[21] AS c66, c[22] AS kr, (1 + alpha) * vp0 AS vp, (1 + beta) * vs0 AS vs FROM k)
SELECT vec_id, round(2 * rho * vp0 * vp0 * (1 + alpha) * ((c11 + c22 + c12) * (1 + phi) + c33 * (1 - phi) + (c13 + c23) * (1 + phi) * eta), 4) AS alpha,
  round(2 * rho * vs0 * vs0 * (1 + beta) * (-2 * c12 * (1 + xi) - 2 * eta * (1 - xi) * (c13 + c23) + (c44 + c55) * (1 - xi) + c66 * (1 + xi)), 4) AS beta,
  round(rho * vp * vp * (c11 + c22 + c12 - c33 + (c13 + c23) * eta), 4) AS phi, round(rho * vs * vs * (c66 - c44 - c55 - 2 * c12 + 2 * eta * (c13 + c23)), 4) AS xi,
  round(rho * (c13 + c23) * (vp * vp * (1 + phi) - 2 * vs * vs * (1 - xi)), 4) AS eta,
  round(1000 * kr + vp * vp * (1 + phi) * (c11 + c22) + vp * vp * (1 - phi) * c33 + c12 * (vp * vp * (1 + phi) - 2 * vs * vs * (1 + xi)) + (c13 + c23) * eta * (vp * vp * (1 + phi) - 2 * vs * vs * (1 - xi)) + (c44 + c55) * vs * vs * (1 - xi) + c66 * vs * vs * (1 + xi), 4) AS rho FROM n""")
def kernel_chain_rule(spark, sf_dir):
    """Kernels of 21 elastic moduli and density as kernels of a transversely isotropic model's parameters."""
    v = F.col("vec_id")
    model = {"alpha": 0.01 * (v % 5), "beta": -0.01 * (v % 3), "phi": 0.02 * (v % 4), "xi": 0.03 * (v % 2), "eta": F.lit(0.9), "rho": F.lit(3.3)}
    found = X.kernels_of_parameters(F.col("embedding").cast("array<double>"), e(21), model, F.lit(8.0), F.lit(4.5))
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 4).alias(n) for n, c in found.items()])


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 10000 + 1 AS vpv, l_extendedprice / 9000 + 1 AS vph, l_quantity / 20 + 1 AS vsv, l_quantity / 25 + 1 AS vsh FROM lineitem),
y AS (SELECT *, sqrt((vpv * vpv + vph * vph) / 2) AS vp, sqrt((vsv * vsv + vsh * vsh) / 2) AS vs FROM x)
SELECT l_orderkey, l_linenumber, round(vp / 8 - 1, 9) AS alpha, round(vs / 4.5 - 1, 9) AS beta, round((vph * vph - vpv * vpv) / (2 * vp * vp), 9) AS phi, round((vsh * vsh - vsv * vsv) / (2 * vs * vs), 9) AS xi, round(vp / vs, 9) AS kappa,
  round(vpv, 6) AS vpv, round(vph, 6) AS vph, round(vsv, 6) AS vsv, round(vsh, 6) AS vsh, round(ln(vph / 8), 9) AS dln,
  round((vph * vph - vpv * vpv) / (2 * vpv * vpv), 9) AS epsilon, round((vsh * vsh - vsv * vsv) / (2 * vsv * vsv), 9) AS gamma FROM y""")
def relative_model_roundtrip(spark, sf_dir):
    """Velocities relative to a reference, their ratios and anisotropies, and back."""
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    v = {"vpv": p / 10000 + 1, "vph": p / 9000 + 1, "vsv": q / 20 + 1, "vsh": q / 25 + 1}
    rel = X.relative_from_velocities(*v.values(), F.lit(8.0), F.lit(4.5))
    thomsen = X.thomsen(*v.values())
    df = table(spark, sf_dir, "lineitem").select(*KEY, *[c.alias(n) for n, c in rel.items()], F.ln(v["vph"] / 8).alias("dln"), thomsen["epsilon"].alias("epsilon"), thomsen["gamma"].alias("gamma"))
    c = {n: F.col(n) for n in rel}
    back = X.velocities_from_relative(c["alpha"], c["beta"], c["phi"], c["xi"], F.lit(8.0), F.lit(4.5))
    again = X.velocities_from_ratio(c["beta"], c["kappa"], c["phi"], c["xi"], F.lit(4.5))
    return df.select(*KEY, *[F.round(n, 9).alias(n) for n in (*rel, "dln", "epsilon", "gamma")], *[F.round((back[n] + again[n]) / 2, 6).alias(n) for n in back])


@query(f"""
WITH s AS (SELECT quantile_disc(abs(l_extendedprice), 0.1) AS z FROM lineitem) SELECT l_orderkey, l_linenumber, round(1 / greatest(abs(l_extendedprice), z), 12) AS inverse FROM lineitem, s""")
def percentile_floored_inverse(spark, sf_dir):
    """The inverse of a diagonal, no smaller than its lowest tenth: the tenth is found by histograms that narrow."""
    df = table(spark, sf_dir, "lineitem").select(*KEY, F.abs("l_extendedprice").alias("h"))
    floor = A.exact_percentile(df, F.col("h"), 0.1)
    return df.select(*KEY, F.round(X.floored_inverse(F.col("h"), F.lit(floor)), 12).alias("inverse"))


CENTERS = [(0.0, 0.0, 0.0), (0.1, -0.1, 0.05), (-0.2, 0.1, 0.0)]


@query(XYZ + f""", s(sx, sy, sz) AS (VALUES {', '.join(map(str, CENTERS))}), m AS (SELECT vec_id, sum(exp(-((x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz)) / (2 * 0.01))) AS t FROM p, s GROUP BY 1)
SELECT vec_id, round(greatest(0.0, 1 - t), 8) AS mask FROM m""")
def gaussian_mask_sum(spark, sf_dir):
    return places(spark, sf_dir).select("vec_id", F.round(S.sum_mask([F.col(c) for c in "xyz"], CENTERS, 0.1), 8).alias("mask"))


@query("""SELECT p_partkey, round(CASE WHEN p_size <= 10 THEN 0.0 WHEN p_size >= 30 THEN 1.0 ELSE (p_size - 10) / 20.0 END, 9) AS "linear", round(CASE WHEN p_size <= 10 THEN 0.0 WHEN p_size >= 30 THEN 1.0 ELSE 0.5 - 0.5 * cos(pi() * (p_size - 10) / 20.0) END, 9) AS cosine FROM part""")
def depth_mask(spark, sf_dir):
    d = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.depth_mask(d, 10.0, 30.0, "linear"), 9).alias("linear"), F.round(X.depth_mask(d, 10.0, 30.0, "cosine"), 9).alias("cosine"))


@query("""
WITH c AS (SELECT n_nationkey, radians(n_nationkey * 2.0 + 5) AS la, radians(n_nationkey * 1.5 - 20) AS lo, radians(20.0) AS la0, radians(-5.0) AS lo0, radians(30.0) AS g FROM nation),
t AS (SELECT *, pi() / 2 - atan(power(1 - 1 / 298.257223563, 2) * tan(la)) AS th, pi() / 2 - atan(power(1 - 1 / 298.257223563, 2) * tan(la0)) AS th0 FROM c),
v AS (SELECT *, sin(th) * cos(lo) AS x, sin(th) * sin(lo) AS y, cos(th) AS z FROM t),
l AS (SELECT *, x * sin(th0) * cos(lo0) + y * sin(th0) * sin(lo0) + z * cos(th0) AS r, -x * sin(lo0) + y * cos(lo0) AS e, -x * cos(th0) * cos(lo0) - y * cos(th0) * sin(lo0) + z * sin(th0) AS n FROM v)
SELECT n_nationkey, round(degrees(atan2(cos(g) * e + sin(g) * n, r)), 7) AS xi, round(degrees(atan2(-sin(g) * e + cos(g) * n, r)), 7) AS eta, round(n_nationkey * 2.0 + 5, 6) AS lat, round(n_nationkey * 1.5 - 20, 6) AS lon,
  least(20 - abs(degrees(atan2(cos(g) * e + sin(g) * n, r))), 15 - abs(degrees(atan2(-sin(g) * e + cos(g) * n, r)))) >= 0 AS inside FROM l""")
def chunk_coordinates(spark, sf_dir):
    """Coordinates of places in a turned chunk, back again, and whether they lie inside it."""
    chunk = G.Chunk(20.0, -5.0, 30.0)
    df = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 2.0 + 5).alias("la"), (F.col("n_nationkey") * 1.5 - 20).alias("lo"))
    xi, eta = chunk.coordinates(F.col("la"), F.col("lo"))
    df = df.select("n_nationkey", xi.alias("xi"), eta.alias("eta"))
    lat, lon = chunk.place(F.col("xi"), F.col("eta"))
    inside = G.edge_distance(F.col("xi"), F.col("eta"), 40.0, 30.0) >= 0
    return df.select("n_nationkey", F.round("xi", 7).alias("xi"), F.round("eta", 7).alias("eta"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), inside.alias("inside"))


def geodesic_sql() -> str:
    f = 1 / 298.257223563
    steps = ["g0 AS (SELECT *, atan((1 - F) * tan(a)) AS u, atan((1 - F) * tan(b)) AS w, l AS lam FROM x)"]
    for i in range(1, 9):
        steps.append(f"""a{i} AS (SELECT n_nationkey, a, b, l, u, w, lam, sqrt(power(cos(w) * sin(lam), 2) + power(cos(u) * sin(w) - sin(u) * cos(w) * cos(lam), 2)) AS ss, sin(u) * sin(w) + cos(u) * cos(w) * cos(lam) AS cs FROM g{i - 1}),
b{i} AS (SELECT *, atan2(ss, cs) AS s, cos(u) * cos(w) * sin(lam) / ss AS sa FROM a{i}), c{i} AS (SELECT *, 1 - sa * sa AS c2, cs - 2 * sin(u) * sin(w) / (1 - sa * sa) AS cm FROM b{i}),
g{i} AS (SELECT * REPLACE (l + (1 - F / 16 * c2 * (4 + F * (4 - 3 * c2))) * F * sa * (s + F / 16 * c2 * (4 + F * (4 - 3 * c2)) * ss * (cm + F / 16 * c2 * (4 + F * (4 - 3 * c2)) * cs * (2 * cm * cm - 1))) AS lam) FROM c{i})""")
    text = ", ".join(steps).replace("F /", f"{f!r} /").replace("F *", f"{f!r} *").replace("- F)", f"- {f!r})")
    return f"""WITH x AS (SELECT n_nationkey, radians(n_nationkey * 6.5 - 80) AS a, radians(40.0) AS b, radians(10 - (n_nationkey * 13.0 - 150)) AS l FROM nation), {text},
k AS (SELECT *, c2 * (1 / power(1 - {f!r}, 2) - 1) AS q FROM g8), h AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS aa, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS bb FROM k)
SELECT n_nationkey, round(6378137.0 * (1 - {f!r}) * aa * (s - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 2) AS distance,
  round((degrees(atan2(cos(w) * sin(lam), cos(u) * sin(w) - sin(u) * cos(w) * cos(lam))) + 360) % 360, 5) AS azimuth, round((degrees(atan2(cos(u) * sin(lam), -sin(u) * cos(w) + cos(u) * sin(w) * cos(lam))) + 540) % 360, 5) AS back FROM h"""


@query(geodesic_sql())
def ellipsoidal_distance(spark, sf_dir):
    """Distance, azimuth and back azimuth on the ellipsoid."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 6.5 - 80).alias("la"), (F.col("n_nationkey") * 13.0 - 150).alias("lo"))
    g = G.geodesic()(F.col("la"), F.col("lo"), F.lit(40.0), F.lit(10.0))
    return df.select("n_nationkey", g.alias("g")).select("n_nationkey", F.round("g.distance", 2).alias("distance"), F.round("g.azimuth", 5).alias("azimuth"), F.round("g.back", 5).alias("back"))


@query(XYZ + """, w AS (SELECT d.a_id, b.label + 1 AS v, d.distance AS r, (a.x * (b.x - a.x) + a.y * (b.y - a.y) + a.z * (b.z - a.z)) / sqrt(a.x * a.x + a.y * a.y + a.z * a.z) AS up FROM d JOIN p a ON d.a_id = a.vec_id JOIN p b ON d.b_id = b.vec_id WHERE distance <= 0.1),
e AS (SELECT a_id, v, exp(-(r * r - up * up) / (2 * 0.02 * 0.02) - up * up / (2 * 0.01 * 0.01)) AS w FROM w) SELECT a_id AS vec_id, round(sum(w * v) / sum(w), 6) AS smooth FROM e GROUP BY 1""")
def smooth_horizontal_vertical(spark, sf_dir):
    p = places(spark, sf_dir).withColumns({"value": F.col("label") + 1, "volume": F.lit(1.0)})
    return S.gaussian_smooth(p, "vec_id", ["x", "y", "z"], "value", "volume", (0.02, 0.01)).select("vec_id", F.round("smooth", 6).alias("smooth"))


@query(XYZ + """, w AS (SELECT d.a_id, b.label + 1 AS v, d.distance AS r, 0.005 * (1 + a.label % 4) AS s FROM d JOIN p a ON d.a_id = a.vec_id JOIN p b ON d.b_id = b.vec_id WHERE distance <= 0.1 AND a.label % 3 = b.label % 3)
SELECT a_id AS vec_id, round(sum(exp(-r * r / (2 * s * s)) * v) / sum(exp(-r * r / (2 * s * s))), 6) AS smooth FROM w WHERE r <= 5 * s GROUP BY 1""")
def smooth_variable_width(spark, sf_dir):
    """Each point's own width; only points of the same class count."""
    p = places(spark, sf_dir).withColumns({"value": F.col("label") + 1, "volume": F.lit(1.0), "s": 0.005 * (1 + F.col("label") % 4), "kind": F.col("label") % 3})
    return S.gaussian_smooth(p, "vec_id", ["x", "y", "z"], "value", "volume", 0.02, own_sigma="s", same="kind").select("vec_id", F.round("smooth", 6).alias("smooth"))


@query("""
WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, 6300 + (label % 7) * 10.0 AS r FROM embeddings), u AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM p),
v AS (SELECT vec_id, label, r, x / n AS x, y / n AS y, z / n AS z FROM u),
d AS (SELECT a.vec_id, b.label + 1 AS v, 2 * asin(least(1.0, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) / 2)) AS t, a.r - b.r AS g FROM v a, v b WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 0.01 AND abs(a.r - b.r) <= 50)
SELECT vec_id, round(sum(exp(-t * t / (2 * 0.0004) - g * g / 200) * v) / sum(exp(-t * t / (2 * 0.0004) - g * g / 200)), 6) AS smooth FROM d GROUP BY 1""")
def smooth_spherical_cap(spark, sf_dir):
    n = F.sqrt(sum(F.col(c) * F.col(c) for c in "xyz"))
    p = places(spark, sf_dir).select("vec_id", *[(F.col(c) / n).alias(c) for c in "xyz"], (6300 + (F.col("label") % 7) * 10.0).alias("r"), (F.col("label") + 1).alias("value"), F.lit(1.0).alias("volume"))
    return S.cap_smooth(p, "vec_id", ["x", "y", "z"], "r", "value", "volume", 0.02, 10.0).select("vec_id", F.round("smooth", 6).alias("smooth"))


@query("""
WITH a AS (SELECT vec_id, label + 1.0 AS u, vec_id // 2 AS pair, 0.5 + (vec_id // 2) % 3 AS k FROM embeddings), b AS (SELECT x.vec_id, x.u, y.u AS v, x.k FROM a x LEFT JOIN a y ON x.pair = y.pair AND x.vec_id <> y.vec_id)
SELECT vec_id, round(CASE WHEN v IS NULL THEN u ELSE ((1 + k) * u + k * v) / (1 + 2 * k) END, 6) AS u FROM b""")
def implicit_diffusion(spark, sf_dir):
    """One backward step on a graph of pairs, by conjugate gradients."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") + 1.0).alias("u"))
    half = F.floor(F.col("vec_id") / 2)
    even = v.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (0.5 + half % 3).alias("k"))
    found = S.implicit_diffusion(v, even, "vec_id", "u", "k", 1.0, lineage.cutter(spark, "diffusion"), tolerance=1e-18)
    return found.select("vec_id", F.round("u", 6).alias("u"))


@query()
def greedy_spacing(spark, sf_dir):
    """Points to drop so that no two are nearer than 0.05: always the one in the most conflicts."""
    return P.thin_by_distance(places(spark, sf_dir), "vec_id", ["x", "y", "z"], 0.05)


@query()
def random_perturbation(spark, sf_dir):
    """Uniform changes of at most a tenth, from a seed."""
    return table(spark, sf_dir, "part").select("p_partkey", X.random_perturb(F.col("p_retailprice"), 0.1, 7, F.col("p_partkey")).alias("value"))


@query("""
WITH t AS (SELECT max(abs(l_extendedprice - 40000)) AS top FROM lineitem), b AS (SELECT CAST(floor((l_extendedprice - 40000 + top) / (2 * top / 20)) AS INTEGER) AS bin, sum(l_quantity * abs(l_extendedprice - 40000)) AS weight FROM lineitem, t GROUP BY 1)
SELECT bin, round(weight, 2) AS weight, round(weight / sum(weight) OVER (), 9) AS share FROM b WHERE bin < 20""")
def amplitude_pdf_signed(spark, sf_dir):
    found = A.amplitude_pdf(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice") - 40000, F.col("l_quantity"), 20, signed=True)
    return found.select("bin", F.round("weight", 2).alias("weight"), F.round("share", 9).alias("share"))


@query("""
WITH b AS (SELECT CAST(floor(p_size / 5.0) AS INTEGER) AS bin, sum(abs(p_retailprice)) AS weight FROM part WHERE p_size >= 0 AND p_size < 50 GROUP BY 1) SELECT bin, round(weight, 4) AS weight, round(weight / sum(weight) OVER (), 9) AS share FROM b""")
def depth_pdf(spark, sf_dir):
    found = A.range_pdf(table(spark, sf_dir, "part"), F.col("p_size"), 0.0, 50.0, 10, F.abs("p_retailprice"))
    return found.select("bin", F.round("weight", 4).alias("weight"), F.round("share", 9).alias("share"))


GEOMETRIC = A.geometric_edges(1000.0, 12)


@query(f"""
WITH b AS (SELECT CAST({' + '.join(f'(abs(p_retailprice - 1000) > {x!r})::INT' for x in GEOMETRIC)} AS INTEGER) AS bin, count(*)::DOUBLE AS volume FROM part GROUP BY 1)
SELECT bin, volume, round(sum(volume) OVER (ORDER BY bin) / sum(volume) OVER (), 9) AS cdf FROM b""")
def cdf_geometric_edges(spark, sf_dir):
    found = A.volume_cdf(table(spark, sf_dir, "part"), F.col("p_retailprice") - 1000, F.lit(1.0), GEOMETRIC)
    return found.select("bin", "volume", F.round("cdf", 9).alias("cdf"))


@query("SELECT p_size AS depth, round(avg(p_retailprice), 6) AS mean, count(*) AS n FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1")
def located_depth_mean(spark, sf_dir):
    """Plain means by depth over the points that were located."""
    parts = table(spark, sf_dir, "part").withColumn("status", F.when(F.col("p_partkey") % 7 == 0, -1).otherwise(1))
    found = parts.filter("status <> -1").groupBy(F.col("p_size").alias("depth")).agg(F.avg("p_retailprice").alias("mean"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("mean", F.round("mean", 6))

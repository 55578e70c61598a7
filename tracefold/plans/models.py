"""Fields of a model: element-wise algebra, conversions, inner products and directions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import geo as G
from ..operators import optimize as O
from .registry import query, table

KEY = ["l_orderkey", "l_linenumber"]


def points(spark, sf_dir):
    """Points of a sharded field: two values and a volume per line."""
    return table(spark, sf_dir, "lineitem").select(*KEY, "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("a"), (F.col("l_discount") + 0.5).alias("b"), F.col("l_quantity").alias("vol"))


A, B = "l_extendedprice", "(l_discount + 0.5)"


@query(f"""SELECT l_orderkey, l_linenumber, round({A} + {B}, 6) AS "add", round({A} - {B}, 6) AS "sub", round({A} * {B}, 6) AS "mul", round({A} / {B}, 6) AS "div",
round({A} / {B} - 1, 6) AS rdiff, round(({A} + 1) * {B}, 6) AS radd, round(ln({A} / {B}), 9) AS divlog, round(exp({B}) * {A}, 5) AS expmul FROM lineitem""")
def field_math_binary(spark, sf_dir):
    df, a, b = points(spark, sf_dir), F.col("a"), F.col("b")
    digits = {"divlog": 9, "expmul": 5}
    return df.select(*KEY, *[F.round(f(b, a) if n == "expmul" else f(a, b), digits.get(n, 6)).alias(n) for n, f in X.BINARY.items()])


@query(f"SELECT l_orderkey, l_linenumber, round(abs(50000 - {A}), 6) AS abs, round(sqrt({A}), 9) AS sqrt, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one FROM lineitem")
def field_math_unary(spark, sf_dir):
    df = points(spark, sf_dir)
    return df.select(*KEY, F.round(X.UNARY["abs"](50000 - F.col("a")), 6).alias("abs"), F.round(X.UNARY["sqrt"](F.col("a")), 9).alias("sqrt"), X.UNARY["zero"](F.col("a")).alias("zero"), X.UNARY["one"](F.col("a")).alias("one"))


@query(f"SELECT l_orderkey, l_linenumber, round(sqrt({A}) * ({B} - 0.25) / (1 + {B}), 9) AS value FROM lineitem")
def field_expr(spark, sf_dir):
    df = points(spark, sf_dir)
    return df.select(*KEY, F.round(X.field_expression("sqrt(a) * (b - 0.25) / (1 + b)", df.columns), 9).alias("value"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_discount - 0.05 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(d) > 0.02 THEN d * 1.5 * 0.02 / (abs(d) + 0.5 * 0.02) ELSE d END, 9) AS soft,
round(CASE WHEN d < -0.03 THEN -0.03 WHEN d > 0.03 THEN 0.03 ELSE d END, 9) AS hard FROM x""")
def soft_clip(spark, sf_dir):
    d = F.col("l_discount") - 0.05
    return table(spark, sf_dir, "lineitem").select(*KEY, F.round(X.soft_clip(d, 0.02, 0.5), 9).alias("soft"), F.round(X.clip(d, F.lit(-0.03), F.lit(0.03)), 9).alias("hard"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS m, l_tax AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(2.0, least(45.0, m + d)), 9) AS absolute, round(greatest(2.0, least(45.0, m * (1 + d))), 9) AS relative,
round(m * exp(d), 9) AS exponential FROM x""")
def perturb_methods(spark, sf_dir):
    m, d = F.col("l_quantity"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(*KEY, *[F.round(X.perturb(m, d, k, *lim), 9).alias(k) for k, lim in (("absolute", (2.0, 45.0)), ("relative", (2.0, 45.0)), ("exponential", ()))])


@query(f"SELECT round(sum(l_quantity * {A} * {B}), 2) AS ab, round(sum(l_quantity * {A} * {A}), 0) AS aa, round(sum(l_quantity * {B} * {B}), 4) AS bb FROM lineitem")
def volume_inner_product(spark, sf_dir):
    v, a, b = F.col("vol"), F.col("a"), F.col("b")
    return points(spark, sf_dir).agg(F.round(F.sum(v * a * b), 2).alias("ab"), F.round(F.sum(v * a * a), 0).alias("aa"), F.round(F.sum(v * b * b), 4).alias("bb"))


G_NEW, G_OLD, DIR = "(l_discount - 0.05)", "(l_tax - 0.04)", "(l_quantity / 50.0)"


@query(f"""
WITH s AS (SELECT sum(l_quantity * {G_NEW} * ({G_NEW} - {G_OLD})) / sum(l_quantity * {DIR} * ({G_NEW} - {G_OLD})) AS beta,
  sum(l_quantity * {G_NEW} * {G_NEW}) AS gg, sum(l_quantity * {DIR} * {G_NEW}) AS dg FROM lineitem),
t AS (SELECT CASE WHEN gg - beta * dg <= 0 THEN 0 ELSE beta END AS beta FROM s)
SELECT l_orderkey, l_linenumber, round({G_NEW} - beta * {DIR}, 7) AS direction FROM lineitem, t""")
def cg_direction(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    new, old, d = F.col("l_discount") - 0.05, F.col("l_tax") - 0.04, F.col("l_quantity") / 50.0
    return O.cg_direction(df, F.col("l_quantity"), new, old, d).select(*KEY, F.round("direction", 7).alias("direction"))


S_, Y_ = "(l_quantity / 50.0)", "(l_discount + l_tax + 0.01)"


@query(f"""
WITH k AS (SELECT 1 / sum(l_quantity * {Y_} * {S_}) AS rho, sum(l_quantity * {S_} * {G_NEW}) AS sg, sum(l_quantity * {Y_} * {Y_}) AS yy,
  sum(l_quantity * {S_} * {Y_}) AS sy, sum(l_quantity * {Y_} * {G_NEW}) AS yg FROM lineitem),
c AS (SELECT rho, rho * sg AS alpha, sy / yy AS gamma, rho * (sy / yy) * (yg - rho * sg * yy) AS beta FROM k)
SELECT l_orderkey, l_linenumber, round(gamma * ({G_NEW} - alpha * {Y_}) + (alpha - beta) * {S_}, 7) AS direction FROM lineitem, c""")
def lbfgs_direction(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    s, y = F.col("l_quantity") / 50.0, F.col("l_discount") + F.col("l_tax") + 0.01
    return O.lbfgs_direction(df, F.col("l_quantity"), F.col("l_discount") - 0.05, [(s, y)]).select(*KEY, F.round("direction", 7).alias("direction"))


@query(f"SELECT l_orderkey, l_linenumber, round({A} * 0.05 / (SELECT max(abs({A})) FROM lineitem), 9) AS scaled FROM lineitem")
def max_amplitude_rescale(spark, sf_dir):
    return O.rescale(points(spark, sf_dir), ["a"], 0.05).select(*KEY, F.round("a", 9).alias("scaled"))


@query(f"SELECT l_orderkey, l_linenumber, round({B} * 0.1 / ({A} / (SELECT max({A}) FROM lineitem) + 0.1), 9) AS value FROM lineitem")
def water_level_precondition(spark, sf_dir):
    df = points(spark, sf_dir)
    top = df.agg(F.max("a").alias("top"))
    return df.crossJoin(F.broadcast(top)).select(*KEY, F.round(X.water_level(F.col("b"), F.col("a"), F.col("top"), 0.1), 9).alias("value"))


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 10000 + 1 AS vpv, l_extendedprice / 9000 + 1 AS vph, l_quantity / 20 + 1 AS vsv, l_quantity / 25 + 1 AS vsh FROM lineitem)
SELECT l_orderkey, l_linenumber, round(sqrt((vpv * vpv + 4 * vph * vph) / 5), 9) AS alpha, round(sqrt((2 * vsv * vsv + vsh * vsh) / 3), 9) AS beta,
round(vpv * vpv / (vph * vph), 9) AS phi, round(vsh * vsh / (vsv * vsv), 9) AS xi, round(vpv, 6) AS vpv, round(vph, 6) AS vph, round(vsv, 6) AS vsv, round(vsh, 6) AS vsh FROM x""")
def model_reparam_roundtrip(spark, sf_dir):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    there = X.voigt_from_anisotropic(p / 10000 + 1, p / 9000 + 1, q / 20 + 1, q / 25 + 1)
    df = table(spark, sf_dir, "lineitem").select(*KEY, *[c.alias(n) for n, c in there.items()])
    back = X.anisotropic_from_voigt(*[F.col(n) for n in there])
    return df.select(*KEY, *[F.round(n, 9).alias(n) for n in there], *[F.round(c, 6).alias(n) for n, c in back.items()])


@query("""
WITH x AS (SELECT n_nationkey, n_nationkey * 6.5 - 80 AS lat, n_nationkey * 13.0 - 170 AS lon FROM nation)
SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(degrees(acos(greatest(-1.0, least(1.0, sin(radians(a.lat)) * sin(radians(b.lat))
  + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))))), 5) AS gcarc
FROM x a JOIN x b ON a.n_nationkey < b.n_nationkey""")
def great_circle_distance(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 6.5 - 80).alias("lat"), (F.col("n_nationkey") * 13.0 - 170).alias("lon"))
    a, b = df.alias("a"), df.alias("b")
    arc = F.degrees(G.great_circle(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")))
    return a.join(b, F.col("a.n_nationkey") < F.col("b.n_nationkey")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.round(arc, 5).alias("gcarc"))


@query("SELECT n_nationkey, round(n_nationkey * 6.5 - 80, 7) AS lat, round(n_nationkey * 13.0 - 170, 7) AS lon FROM nation")
def ecef_roundtrip(spark, sf_dir):
    lat, lon = F.col("n_nationkey") * 6.5 - 80, F.col("n_nationkey") * 13.0 - 170
    back = G.from_ecef_surface(*G.to_ecef(lat, lon, F.lit(0.0)))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(back[0], 7).alias("lat"), F.round(back[1], 7).alias("lon"))

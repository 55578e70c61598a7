"""Statistics under filters, layers, checked sums, domains, tapers, masked directions and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import tapers as T
from ..operators import aggregates as A
from ..operators import optimize as O
from ..operators import response as R
from .models import G_NEW, KEY, S_, Y_
from .registry import query, table

TYPES = ["click", "purchase", "view"]


@query("""
WITH e AS (SELECT user_id, value, event_type AS c, value / 4 AS snr, CASE event_id % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'S' ELSE 'ScS' END AS phase, event_id % 10 / 20.0 + 0.05 AS fmax FROM events),
g AS (SELECT *, snr >= 5 AND phase IN ('P', 'S') AND fmax <= 0.4 AS good FROM e)
SELECT user_id, """ + ", ".join(
    f"count(*) FILTER (good AND c = '{c}') AS nwin_{c}, round(avg(value) FILTER (good AND c = '{c}'), 6) AS mean_value_{c}, round(stddev_pop(value) FILTER (good AND c = '{c}'), 6) AS std_value_{c}" for c in TYPES) + " FROM g GROUP BY user_id")
def filtered_station_stats(spark, sf_dir):
    """Station statistics over windows of a least SNR, of some phases, in bands that end low enough."""
    i = F.col("event_id")
    phase = F.element_at(F.array(*[F.lit(p) for p in ("P", "S", "ScS")]), (i % 3 + 1).cast("int"))
    found = A.filtered_statistics(
        table(spark, sf_dir, "events"), "user_id", "event_type", TYPES, {"value": F.col("value")}, F.col("value") / 4, 5.0, phase, ("P", "S"), F.array(F.lit(0.01), i % 10 / 20 + 0.05), 0.4)
    return found.select(*[F.round(c, 6).alias(c) if c[:4] in ("mean", "std_") else c for c in found.columns])


JUMPS = [1000.0, 1400.0]


@query(f"""
WITH r AS (SELECT p_brand, p_retailprice::DOUBLE AS r, p_retailprice::DOUBLE + (p_size - 25) AS center, p_size, p_partkey, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) > 8 THEN 1 ELSE 0 END AS fresh FROM part),
l AS (SELECT *, sum(fresh) OVER (PARTITION BY p_brand ORDER BY r, p_partkey ROWS UNBOUNDED PRECEDING) AS layer FROM r),
m AS (SELECT *, avg(r) OVER (PARTITION BY p_brand, layer) AS mean FROM l),
d AS (SELECT *, CASE {" ".join(f"WHEN abs(mean - {j}) < 8 THEN {j}" for j in JUMPS)} END AS d FROM m),
s AS (SELECT *, CASE WHEN d IS NULL THEN 0 WHEN center < d THEN -1 WHEN center > d THEN 1 END AS side FROM d)
SELECT p_brand, CAST(layer AS BIGINT) AS layer, side, round(avg(r), 6) AS radius, count(*) AS n, round(avg(p_size), 6) AS size FROM s WHERE side IS NOT NULL GROUP BY 1, 2, 3""")
def layer_means_split(spark, sf_dir):
    """Layers of nearly equal radius, split where a discontinuity runs through them."""
    parts = table(spark, sf_dir, "part").withColumn("r", F.col("p_retailprice").cast("double")).withColumn("center", F.col("r") + (F.col("p_size") - 25))
    found = A.layer_means(parts, ["p_brand"], "r", "center", {"size": F.col("p_size")}, 8.0, JUMPS, ["p_partkey"])
    return found.select("p_brand", "layer", "side", F.round("radius", 6).alias("radius"), "n", F.round("size", 6).alias("size"))


CUBES = """
WITH c AS (SELECT l_suppkey AS event, l_linenumber AS a, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS b, sum(l_quantity)::DOUBLE AS wcc, count(*) AS weight FROM lineitem WHERE l_suppkey % 7 <> 3 OR l_linenumber < 6 GROUP BY 1, 2, 3),
s AS (SELECT event, count(*) AS n, list(struct_pack(a := a, b := b) ORDER BY a, b) AS axes FROM c GROUP BY 1),
f AS (SELECT axes, count(*) AS events FROM s GROUP BY 1), g AS (SELECT axes FROM f ORDER BY events DESC LIMIT 1)"""


def cubes(spark, sf_dir):
    b = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = table(spark, sf_dir, "lineitem").withColumn("whole", (F.col("l_suppkey") % 7 != 3) | (F.col("l_linenumber") < 6)).filter("whole")
    return rows.groupBy(F.col("l_suppkey").alias("event"), F.col("l_linenumber").alias("a"), b.alias("b")).agg(F.sum("l_quantity").alias("wcc"), F.count(F.lit(1)).alias("weight"))


@query(CUBES + " SELECT a, b, round(sum(wcc), 4) AS wcc_sum, CAST(sum(weight) AS BIGINT) AS weight_sum, count(*) AS events FROM c JOIN s ON c.event = s.event JOIN g ON s.axes = g.axes GROUP BY 1, 2")
def sum_event_cubes_checked(spark, sf_dir):
    """Cubes of all events that have the same axes, added up."""
    sums, _ = A.sum_cubes(cubes(spark, sf_dir), "event", ["a", "b"], F.col("wcc"), F.col("weight"), strict=False)
    return sums.withColumn("wcc_sum", F.round("wcc_sum", 4))


@query(CUBES + " SELECT event, n AS cells FROM s WHERE axes NOT IN (SELECT axes FROM g)")
def unlike_event_cubes(spark, sf_dir):
    """Events whose axes are not those of the others."""
    return A.sum_cubes(cubes(spark, sf_dir), "event", ["a", "b"], F.col("wcc"), F.col("weight"), strict=False)[1]


@query("""
WITH p AS (SELECT c_custkey, c_custkey * 7919 % 1700 / 10.0 - 85 AS lat, c_custkey * 104729 % 3600 / 10.0 - 180 AS lon FROM customer),
d AS (SELECT *, degrees(acos(greatest(-1, least(1, sin(radians(lat)) * sin(radians(20)) + cos(radians(lat)) * cos(radians(20)) * cos(radians(-60 - lon)))))) AS far FROM p)
SELECT c_custkey, lat BETWEEN -30 AND 45 AND lon BETWEEN -20 AND 90 AS rectangle, far BETWEEN 15 AND 70 AS ring FROM d""")
def spatial_domains(spark, sf_dir):
    """Stations in a rectangle, and in a ring around a place."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", (k * 7919 % 1700 / 10 - 85).alias("lat"), (k * 104729 % 3600 / 10 - 180).alias("lon"))
    lat, lon = F.col("lat"), F.col("lon")
    return p.select("c_custkey", G.in_rectangle(lat, lon, -30.0, 45.0, -20.0, 90.0).alias("rectangle"), G.in_ring(lat, lon, 20.0, -60.0, 15.0, 70.0).alias("ring"))


@query("""SELECT p_partkey, round(CASE WHEN p_size BETWEEN 15 AND 30 THEN 1.0 WHEN p_size < 15 THEN 0.1 + 0.9 * exp(ln(0.02) * power((15 - p_size) / 10.0, 2)) ELSE 0.1 + 0.9 * exp(ln(0.02) * power((p_size - 30) / 15.0, 2)) END, 9) AS both,
  round(CASE WHEN p_size >= 20 THEN 1.0 ELSE exp(ln(0.01) * power((20 - p_size) / 12.0, 2)) END, 9) AS low, round(CASE WHEN p_size <= 20 THEN 1.0 ELSE exp(ln(0.01) * power((p_size - 20) / 12.0, 2)) END, 9) AS high FROM part""")
def exponential_taper(spark, sf_dir):
    x = F.col("p_size").cast("double")
    both = T.exponential_taper(x, [5, 15, 30, 45], 0.02, 0.1)
    one = [T.exponential_taper(x, [end, 20]) for end in (8, 32)]
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 9).alias(n) for c, n in zip((both, *one), ("both", "low", "high"))])


MASK = "CASE WHEN l_linenumber < 3 THEN 0.0 WHEN l_linenumber < 5 THEN 0.5 ELSE 1.0 END"


@query(f"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity AS w, {MASK} AS m, {G_NEW} AS g, {S_} AS s1, {Y_} AS y1, l_tax + 0.02 AS s2, 0.5 * l_tax + l_discount / 4 + 0.01 AS y2 FROM lineitem),
a AS (SELECT 1 / sum(w * y1 * s1) AS r1, 1 / sum(w * y2 * s2) AS r2, sum(w * y1 * y1) AS yy FROM v),
b AS (SELECT v.*, r1, r2, yy, r1 * sum(w * s1 * g) OVER () AS a1 FROM v, a), c AS (SELECT *, g - a1 * y1 AS q1 FROM b),
d AS (SELECT *, r2 * sum(w * s2 * q1) OVER () AS a2 FROM c), e AS (SELECT *, m * (q1 - a2 * y2) / r1 / yy AS q2 FROM d),
f AS (SELECT *, r2 * sum(w * y2 * q2) OVER () AS b2 FROM e), h AS (SELECT *, q2 + (a2 - b2) * s2 AS q3 FROM f),
i AS (SELECT *, r1 * sum(w * y1 * q3) OVER () AS b1 FROM h)
SELECT l_orderkey, l_linenumber, round(q3 + (a1 - b1) * s1, 6) AS direction FROM i""")
def lbfgs_masked(spark, sf_dir):
    """Two steps of memory, and a mask on the first guess of the Hessian."""
    n = F.col("l_linenumber")
    mask = F.when(n < 3, 0.0).when(n < 5, 0.5).otherwise(1.0)
    d, t = F.col("l_discount"), F.col("l_tax")
    steps = [(F.col("l_quantity") / 50.0, d + t + 0.01), (t + 0.02, 0.5 * t + d / 4 + 0.01)]
    found = O.lbfgs_direction(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), d - 0.05, steps, mask=mask)
    return found.select(*KEY, F.round("direction", 6).alias("direction"))


@query(f"SELECT l_orderkey, l_linenumber, round(0.3 * {MASK} * l_discount, 9) AS dmodel0, round(0.3 * {MASK} * (l_tax - 0.04), 9) AS dmodel1 FROM lineitem")
def steepest_descent(spark, sf_dir):
    n = F.col("l_linenumber")
    mask = F.when(n < 3, 0.0).when(n < 5, 0.5).otherwise(1.0)
    found = O.steepest_descent(table(spark, sf_dir, "lineitem"), [F.col("l_discount"), F.col("l_tax") - 0.04], 0.3, mask)
    return found.select(*KEY, *[(F.round(f"dmodel{i}", 9) + F.lit(0.0)).alias(f"dmodel{i}") for i in (0, 1)])


@query("""
WITH p AS (SELECT p_partkey, 2 * pi() * p_size / 20.0 AS w, 1.0 + p_partkey % 5 AS a, 0.5 + p_partkey % 3 AS b, p_size % 7 + 0.25 AS c, p_retailprice::DOUBLE AS g, p_partkey % 4 <> 0 AS third FROM part),
n AS (SELECT *, -w * w AS nr, w * c AS ni, a * a + b * b - w * w AS dr, 2 * a * w AS di FROM p),
q AS (SELECT *, (nr * dr + ni * di) / (dr * dr + di * di) AS qr, (ni * dr - nr * di) / (dr * dr + di * di) AS qi FROM n),
t AS (SELECT *, CASE WHEN third THEN (qr * 3 + qi * w) / (9 + w * w) ELSE qr END AS tr, CASE WHEN third THEN (qi * 3 - qr * w) / (9 + w * w) ELSE qi END AS ti FROM q)
SELECT p_partkey, round(g * tr, 6) AS response_re, round(g * ti, 6) AS response_im FROM t""")
def pole_zero_response(spark, sf_dir):
    """Responses of unlike poles and zeros, each at its own frequency."""
    k, f = F.col("p_partkey"), F.lit
    z = lambda re, im: F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))
    a, b, c = -1.0 - k % 5, 0.5 + k % 3, F.col("p_size") % 7 + 0.25
    pair = F.array(z(a, b), z(a, -b))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") / 20).alias("f"), F.when(k % 4 != 0, F.array_append(pair, z(f(-3.0), f(0.0)))).otherwise(pair).alias("poles"),
        F.array(z(f(0.0), f(0.0)), z(-c, f(0.0))).alias("zeros"), F.col("p_retailprice").alias("gain"))
    return R.response_at(rows, "f", "poles", "zeros", "gain").select("p_partkey", *[(F.round(x, 6) + f(0.0)).alias(x) for x in ("response_re", "response_im")])

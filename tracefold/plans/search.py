"""Step-length searches: a cube of sums over windows, then the best cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as G
from ..operators import optimize as O
from .registry import query, table
from .traces import PAIRS, pairs

STEPS = [0.1 * i for i in range(21)]
CUBE = PAIRS + f""", s AS (SELECT unnest({STEPS}) AS step),
w AS (SELECT vec_id, step, list_transform(u, lambda x, i: x + step * v[i]) AS m, u FROM t, s),
c AS (SELECT step, (vec_id % 5 + 1.0) AS weight, list_inner_product(m, list_reverse(u)) / (sqrt(list_inner_product(m, m)) * sqrt(list_inner_product(u, u))) AS cc FROM w),
q AS (SELECT step, sum(weight * cc) AS wcc_sum, sum(weight) AS weight_sum FROM c GROUP BY step)"""


def cube(spark, sf_dir):
    """Per step of a linearised trace u + step·v: weighted sums of its similarity to the reversed trace.

    A trace sends on six dot products, whatever the number of steps.
    """
    t = pairs(spark, sf_dir).select((F.col("vec_id") % 5 + 1.0).alias("w"), G.search_dots()(F.reverse("u"), "u", "v").alias("d"))
    steps = t.withColumn("step", F.explode(F.array(*[F.lit(s) for s in STEPS])))
    return steps.groupBy("step").agg(F.sum(F.col("w") * G.stepped_cc(F.col("d"), F.col("step"))).alias("wcc_sum"), F.sum("w").alias("weight_sum"))


@query(CUBE + " SELECT step, round(wcc_sum, 5) AS wcc_sum, weight_sum FROM q")
def linearized_step_search(spark, sf_dir):
    return cube(spark, sf_dir).select("step", F.round("wcc_sum", 5).alias("wcc_sum"), "weight_sum")


@query(CUBE + " SELECT arg_max(step, round(wcc_sum, 5)) AS step, round(max(wcc_sum), 5) AS wcc_sum FROM q")
def grid_search_argmax(spark, sf_dir):
    return O.argmax(cube(spark, sf_dir).select("step", F.round("wcc_sum", 5).alias("wcc_sum")), "wcc_sum", ["step"])


@query("""
SELECT p_size AS a, CAST(l_linenumber AS INTEGER) AS b, count(DISTINCT l_suppkey) AS events, round(sum(l_quantity * l_discount), 4) AS wcc_sum, sum(l_quantity) AS weight_sum
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def sum_event_cubes(spark, sf_dir):
    """Cubes of all events summed cell by cell, with the number of events that reached the cell."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    w = F.col("l_quantity")
    return rows.groupBy(F.col("p_size").alias("a"), F.col("l_linenumber").cast("int").alias("b")).agg(
        F.count_distinct("l_suppkey").alias("events"), F.round(F.sum(w * F.col("l_discount")), 4).alias("wcc_sum"), F.sum(w).alias("weight_sum"))


@query(PAIRS + """, g AS (SELECT unnest(range(20)) * 4 / 19.0 AS s), h AS (SELECT unnest(range(20)) * 4 / 19.0 AS r),
d AS (SELECT list_inner_product(u, u) AS uu, list_inner_product(u, v) AS uv, list_inner_product(v, v) AS vv, list_inner_product(u, list_reverse(u)) AS ou, list_inner_product(v, list_reverse(u)) AS ov FROM t)
SELECT round(s, 9) AS vp, round(r, 9) AS vs, round(sum((ou * (1 - r / 8) + s * ov) / (sqrt(uu) * sqrt((1 - r / 8) * (1 - r / 8) * uu + 2 * s * (1 - r / 8) * uv + s * s * vv))), 5) AS wcc_sum, count(*) AS weight_sum FROM d, g, h GROUP BY s, r""")
def structure_search(spark, sf_dir):
    """A full grid of two model steps: 400 cells from the same dot products."""
    t = pairs(spark, sf_dir).select(G.search_dots()(F.reverse("u"), "u", "v").alias("d"))
    axis = F.array(*[F.lit(i * 4 / 19) for i in range(20)])
    cells = t.withColumn("vp", F.explode(axis)).withColumn("vs", F.explode(axis))
    keep = 1 - F.col("vs") / 8  # the second step takes from the synthetic what the first adds
    cc = G.stepped_cc(F.col("d"), F.col("vp") / keep)
    found = cells.groupBy("vp", "vs").agg(F.sum(cc).alias("wcc_sum"), F.count(F.lit(1)).alias("weight_sum"))
    return found.select(F.round("vp", 9).alias("vp"), F.round("vs", 9).alias("vs"), F.round("wcc_sum", 5).alias("wcc_sum"), "weight_sum")


@query()
def refined_search(spark, sf_dir):
    """Shift and step searched together on a coarse grid refined by splines, in boxes that shrink; then the best."""
    rows = pairs(spark, sf_dir).select(F.reverse("u").alias("obs"), F.col("u").alias("syn"), F.col("v").alias("change"), (F.col("vec_id") % 5 + 1.0).alias("weight"))
    best = O.refined_search(lambda a, b: O.shifted_sums(rows, 2.0, a, b), {"dt0": (0.0, 2.0), "dxs": (1.0, 1.0)}, rounds=2)
    return spark.createDataFrame([tuple(map(float, best))], "dt0 double, dxs double, wcc double")

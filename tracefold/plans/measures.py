"""Measurement tables: weights, means, histograms, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tapers import cosine_taper, window_weight
from ..operators import aggregates as A
from .registry import query, table

TAPER = "CASE WHEN {x} <= {a} THEN 0.0 WHEN {x} >= {b} THEN 1.0 ELSE 0.5 - 0.5 * cos(pi() * ({x} - {a}) / ({b} - {a})) END"


@query(f"""
WITH w AS (SELECT l_returnflag || l_linestatus AS id, l_discount AS cc0,
  l_quantity * ({TAPER.format(x='(l_tax * 1000)', a=10.0, b=15.0)}) AS weight FROM lineitem WHERE l_quantity > 0)
SELECT id, count(*) AS n, round(sum(weight), 4) AS weight_sum, round(sum(weight * cc0), 4) AS wcc0_sum,
  round(sum(weight * cc0) / nullif(sum(weight), 0), 6) AS wcc0_avg FROM w GROUP BY id""")
def weighted_misfit_by_window(spark, sf_dir):
    """Flagship: valid windows, weights by tapered SNR, weighted mean similarity per window id."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    w = window_weight(F.col("l_quantity"), {"snr": (F.col("l_tax") * 1000, [10, 15])})
    rows = rows.select(F.concat("l_returnflag", "l_linestatus").alias("id"), w.alias("weight"), F.col("l_discount").alias("cc0"))
    found = A.weighted_mean(rows, ["id"], F.col("weight"), F.col("cc0"))
    return found.select("id", "n", F.round("weight_sum", 4).alias("weight_sum"), F.round("wcc0_sum", 4).alias("wcc0_sum"), F.round("wcc0_avg", 6).alias("wcc0_avg"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(
    f"count(*) FILTER (event_type = '{c}') AS nwin_{c}, round(avg(value) FILTER (event_type = '{c}'), 6) AS mean_value_{c}, "
    f"round(stddev_pop(value) FILTER (event_type = '{c}'), 6) AS std_value_{c}" for c in TYPES) + " FROM events GROUP BY user_id")
def station_component_stats(spark, sf_dir):
    found = A.station_statistics(table(spark, sf_dir, "events"), "user_id", "event_type", TYPES, {"value": F.col("value")})
    return found.select(*[F.round(c, 6).alias(c) if c[:4] in ("mean", "std_") else c for c in found.columns])


@query("""
WITH b AS (SELECT event_type, CAST(least(9, floor(value / 20.0)) AS INTEGER) AS bin FROM events WHERE value BETWEEN 0 AND 200)
SELECT event_type, bin, count(*) AS n FROM b GROUP BY GROUPING SETS ((bin), (event_type, bin))""")
def misfit_histogram_overall_and_by_id(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "events"), F.col("value"), 0.0, 200.0, 10, "event_type")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events WHERE value BETWEEN 0 AND 200 GROUP BY GROUPING SETS ((), (event_type))")
def misfit_moments_overall_and_by_id(spark, sf_dir):
    found = A.moments(table(spark, sf_dir, "events"), F.col("value"), 0.0, 200.0, "event_type")
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""
SELECT event_id, round({TAPER.format(x='value', a=10.0, b=50.0)}, 9) AS two,
  round(CASE WHEN value <= 5 OR value >= 200 THEN 0.0 WHEN value BETWEEN 20 AND 80 THEN 1.0
    WHEN value < 20 THEN 0.5 - 0.5 * cos(pi() * (value - 5.0) / 15.0) ELSE 0.5 - 0.5 * cos(pi() * (value - 200.0) / -120.0) END, 9) AS four
FROM events""")
def cosine_taper_weights(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(cosine_taper(v, [10, 50]), 9).alias("two"), F.round(cosine_taper(v, [5, 20, 80, 200]), 9).alias("four"))


@query("""
WITH t AS (SELECT max(abs(l_extendedprice)) AS top FROM lineitem),
b AS (SELECT CAST(floor(abs(l_extendedprice) / (top / 20)) AS INTEGER) AS bin, sum(l_quantity * abs(l_extendedprice)) AS weight FROM lineitem, t GROUP BY 1)
SELECT bin, round(weight, 2) AS weight, round(weight / sum(weight) OVER (), 9) AS share FROM b WHERE bin < 20""")
def amplitude_pdf(spark, sf_dir):
    found = A.amplitude_pdf(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity"), 20)
    return found.select("bin", F.round("weight", 2).alias("weight"), F.round("share", 9).alias("share"))


EDGES = [-1.0, *[5000.0 * i for i in range(1, 24)]]


@query(f"""
WITH b AS (SELECT CAST({' + '.join(f'(abs(l_extendedprice) > {e})::INT' for e in EDGES)} AS INTEGER) AS bin, sum(l_quantity) AS volume FROM lineitem GROUP BY 1),
c AS (SELECT bin, volume, sum(volume) OVER (ORDER BY bin) / sum(volume) OVER () AS cdf FROM b)
SELECT bin, volume, round(cdf, 9) AS cdf, (SELECT min({EDGES}[least(bin + 1, {len(EDGES)})]) FROM c WHERE cdf >= 0.9) AS threshold FROM c""")
def volume_cdf_threshold(spark, sf_dir):
    cdf = A.volume_cdf(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity"), EDGES)
    return cdf.select("bin", "volume", F.round("cdf", 9).alias("cdf"), A.threshold_of(F.col("cdf"), F.col("bin"), EDGES, 0.9).alias("threshold"))


CENTERS = [5.0, 15.0, 25.0, 35.0, 45.0]


@query(f"""
WITH c AS (SELECT unnest({CENTERS}) AS center)
SELECT center, round(sum(1 - abs(p_size - center) / 10.0), 6) AS weight_sum,
  round(sum((1 - abs(p_size - center) / 10.0) * p_retailprice) / nullif(sum(1 - abs(p_size - center) / 10.0), 0), 6) AS mean
FROM part JOIN c ON abs(p_size - center) < 10.0 GROUP BY center""")
def depth_triangular_profile(spark, sf_dir):
    found = A.triangular_profile(table(spark, sf_dir, "part"), F.col("p_size"), CENTERS, 10.0, F.lit(1.0), F.col("p_retailprice"))
    return found.select("center", F.round("weight_sum", 6).alias("weight_sum"), F.round("mean", 6).alias("mean"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_extendedprice * l_quantity) OVER (PARTITION BY l_partkey)
  / sum(l_quantity) OVER (PARTITION BY l_partkey), 4) AS node_mean FROM lineitem""")
def shared_node_average(spark, sf_dir):
    found = A.node_average(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"), "l_partkey", F.col("l_extendedprice"), F.col("l_quantity"), "node_mean")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.round("node_mean", 4).alias("node_mean"))


@query("""
WITH d AS (SELECT vec_id, 1.0 + label % 3 AS w, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT a.i, b.i AS j, round(sum(a.w * a.x) / sum(a.w), 6) AS mean_i, round(sum(a.w * b.x) / sum(a.w), 6) AS mean_j,
  round(sum(a.w * a.x * b.x) / sum(a.w) - sum(a.w * a.x) / sum(a.w) * sum(a.w * b.x) / sum(a.w), 6) AS cov
FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""")
def covariance_matrix(spark, sf_dir):
    """All dimensions of the vectors, weighted."""
    found = A.covariance(table(spark, sf_dir, "embeddings").select("embedding", (1.0 + F.col("label") % 3).alias("w")), "embedding", "w")
    return found.select("i", "j", *[F.round(c, 6).alias(c) for c in ("mean_i", "mean_j", "cov")])


@query("""
SELECT p_partkey AS point, round(sum(l_extendedprice * (l_discount > 0.02)::INT), 4) AS kernel, count(*) AS events
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def masked_event_kernel_sum(spark, sf_dir):
    """Sum of event fields per point, each under its event's mask."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    mask = F.when(F.col("l_discount") > 0.02, 1).otherwise(0)
    return rows.groupBy(F.col("p_partkey").alias("point")).agg(F.round(F.sum(F.col("l_extendedprice") * mask), 4).alias("kernel"), F.count(F.lit(1)).alias("events"))


@query("""
SELECT l_suppkey % 10 AS shard, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
  round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS std FROM lineitem GROUP BY 1""")
def shard_summary(spark, sf_dir):
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"))


@query("""
WITH d AS (SELECT event_type AS id, date_trunc('day', ts) AS iter, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT id, iter, round(total, 4) AS total, round(total - lag(total) OVER (PARTITION BY id ORDER BY iter), 4) AS change FROM d""")
def iteration_trend(spark, sf_dir):
    from pyspark.sql.window import Window

    days = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("iter")).agg(F.sum("value").alias("total"))
    before = F.lag("total").over(Window.partitionBy("id").orderBy("iter"))
    return days.select("id", "iter", F.round("total", 4).alias("total"), F.round(F.col("total") - before, 4).alias("change"))

"""Checks of groups and joins with a report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from .registry import query, table


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE NOT (p_type LIKE 'PROMO%' OR p_type LIKE '%BRASS' OR p_brand LIKE 'Brand#1_')")
def glob_exclusion(spark, sf_dir):
    return C.exclude_globs(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), {"p_type": ["PROMO*", "*BRASS"], "p_brand": ["Brand#1?"]})


@query("""
WITH u AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2)
SELECT user_id, event_type, a <= TIMESTAMP '2024-01-01 12:00:00' AND b >= TIMESTAMP '2024-01-29 12:00:00' AS covered FROM u""")
def coverage_predicate(spark, sf_dir):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    u = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return u.select("user_id", "event_type", C.covers(F.col("a"), F.col("b"), t("2024-01-01 12:00:00"), t("2024-01-29 12:00:00")).alias("covered"))


@query("""
WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag || l_linestatus) AS kinds FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem JOIN g USING (l_orderkey) WHERE kinds = 1""")
def consistent_channel_groups(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return C.consistent_groups(df, ["l_orderkey"], ["l_returnflag", "l_linestatus"])[0]


@query("""
WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag || l_linestatus) AS kinds FROM lineitem GROUP BY 1) SELECT l_orderkey FROM g WHERE kinds > 1""")
def inconsistent_channel_groups(spark, sf_dir):
    return C.consistent_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])[1]


@query("""
WITH c AS (SELECT l_orderkey, ['1', '2', 'E', 'N', 'Z'][l_linenumber % 5 + 1] AS code, l_partkey % 360 + 0.0 AS az FROM lineitem),
h AS (SELECT l_orderkey, list_sort(list_distinct(list(code) FILTER (code <> 'Z'))) AS names, count(*) FILTER (code <> 'Z') AS n,
  min(az) FILTER (code IN ('1', 'E')) AS a1, min(az) FILTER (code IN ('2', 'N')) AS a2 FROM c GROUP BY 1)
SELECT l_orderkey, names[1] AS "first", names[2] AS "second", a1::DOUBLE AS azimuth1, a2::DOUBLE AS azimuth2 FROM h WHERE n = 2 AND names IN (['1', '2'], ['E', 'N']) AND ((a1 - a2) % 360 + 360) % 360 >= 10""")
def oriented_horizontals(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(x) for x in "12ENZ"]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", code.alias("code"), (F.col("l_partkey") % 360).cast("double").alias("az"))
    return C.oriented_pairs(df, ["l_orderkey"], "code", "az")


@query("""
WITH t AS (SELECT l_partkey, l_quantity AS f, min(l_extendedprice) AS gain FROM lineitem GROUP BY 1, 2),
n AS (SELECT l_partkey, arg_min(gain, struct_pack(d := abs(f - 25), f := f)) AS top FROM t GROUP BY 1),
c AS (SELECT t.l_partkey, max(f) FILTER (gain < top * power(10, -3 / 20.0) AND f < 25) AS low_corner, min(f) FILTER (gain < top * power(10, -3 / 20.0) AND f > 25) AS high_corner
  FROM t JOIN n ON t.l_partkey = n.l_partkey GROUP BY 1)
SELECT l_partkey, low_corner, high_corner, coalesce(low_corner, 0.0) <= 15 AND coalesce(high_corner, 1e300) >= 30 AS reaches FROM c""")
def response_passband(spark, sf_dir):
    """The lines of a part as its response: the least price at each quantity is the gain at a frequency."""
    tabled = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_quantity").agg(F.min("l_extendedprice").alias("gain"))
    found = C.passband(tabled, ["l_partkey"], "l_quantity", "gain", 25.0)
    return found.withColumn("reaches", C.band_reaches(F.col("low_corner"), F.col("high_corner"), 15.0, 30.0))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 = 0 THEN l_extendedprice ELSE l_quantity END AS value FROM lineitem")
def masked_write(spark, sf_dir):
    status = F.when(F.col("l_suppkey") % 4 == 0, -1).otherwise(1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.keep_old_where(status, F.col("l_extendedprice"), F.col("l_quantity")).alias("value"))


@query("""
WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), w AS (SELECT o_custkey AS k, o_orderkey FROM orders)
SELECT s.k AS c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'unmatched' ELSE 'matched' END AS state FROM s LEFT JOIN w ON s.k = w.k""")
def station_window_join(spark, sf_dir):
    """Stations with their windows, and those that have none."""
    stations = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    windows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    met, alone = C.match_report(stations, windows, ["c_custkey"])
    return met.withColumn("state", F.lit("matched")).unionByName(alone.withColumns({"o_orderkey": F.lit(None).cast("long"), "state": F.lit("unmatched")}))


@query("""
WITH k AS (SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS obs, max(l_quantity) FILTER (l_linenumber = 2) AS syn, max(l_quantity) FILTER (l_linenumber = 3) AS dxs, max(l_quantity) FILTER (l_linenumber = 4) AS dmt FROM lineitem GROUP BY 1)
SELECT l_orderkey, obs, syn AS syn_value, dxs AS dxs_value, dmt AS dmt_value FROM k WHERE obs IS NOT NULL AND syn IS NOT NULL AND dxs IS NOT NULL AND dmt IS NOT NULL""")
def observation_synthetic_series(spark, sf_dir):
    """An observation with its synthetic and two perturbation series: all must exist."""
    lines = table(spark, sf_dir, "lineitem")
    one = lambda n, name: lines.filter(F.col("l_linenumber") == n).groupBy("l_orderkey").agg(F.max("l_quantity").alias(name))
    return C.all_present(one(1, "obs"), {"syn": one(2, "value"), "dxs": one(3, "value"), "dmt": one(4, "value")}, ["l_orderkey"])


@query("SELECT o_custkey, count(*) AS n, c_nationkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 3, 4")
def statistics_with_coordinates(spark, sf_dir):
    stats = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return C.exactly_one(stats, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal"), ["o_custkey"])


@query("""
SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey""")
def station_sort(spark, sf_dir):
    """Three keys, nulls first: network, then value downward, then station."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return df.orderBy(F.asc_nulls_first("c_nationkey"), F.desc_nulls_first("c_acctbal"), F.asc_nulls_first("c_custkey"))


@query("""
WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS windows, count(DISTINCT event_type) AS n FROM events GROUP BY 1) SELECT user_id, array_to_string(windows, ',') AS windows, n FROM s""")
def distinct_window_lists(spark, sf_dir):
    names = F.sort_array(F.collect_set("event_type"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(names, ",").alias("windows"), F.size(names).cast("long").alias("n"))


@query("""
WITH o AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), f AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(o.o_custkey, f.o_custkey) AS o_custkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), '|') AS comments FROM o FULL JOIN f ON o.o_custkey = f.o_custkey""")
def comment_union(spark, sf_dir):
    """The union of the comments of two inventories."""
    o = table(spark, sf_dir, "orders")
    part = lambda s, n: o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias(n))
    both = part("O", "a").join(part("F", "b"), "o_custkey", "full")
    union = F.array_union(F.coalesce("a", F.array().cast("array<string>")), F.coalesce("b", F.array().cast("array<string>")))
    return both.select("o_custkey", F.array_join(F.sort_array(union), "|").alias("comments"))

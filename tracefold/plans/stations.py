"""Stations, archives and requests: coverage, islands, gaps, dedupe and merges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as A
from .registry import query, table


def seconds(column: str) -> F.Column:
    """Microseconds of a time without zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS coverage FROM events GROUP BY 1, 2)
SELECT user_id, event_type, coverage FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coverage DESC, event_type DESC) = 1""")
def best_coverage_channel(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("coverage"))
    return A.first_wins(c, ["user_id"], [F.col("coverage").desc(), F.col("event_type").desc()])


HOUR = 3_600_000_000
ISLANDS = f"""
WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + {2 * HOUR} + CAST(floor(value) AS BIGINT) * 60000000 AS e FROM events),
f AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w + {HOUR} THEN 1 ELSE 0 END AS fresh FROM i
  WINDOW w AS (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT user_id, island, min(s) AS "start", max(e) AS "end", count(*) AS members FROM g GROUP BY 1, 2)"""


def covered(spark, sf_dir):
    s = seconds("ts")
    return A.islands(table(spark, sf_dir, "events"), ["user_id"], s, s + 2 * HOUR + F.floor("value") * 60_000_000, F.lit(HOUR))


@query(ISLANDS + ' SELECT user_id, "start", "end", members FROM m')
def coalesce_requests(spark, sf_dir):
    return covered(spark, sf_dir).select("user_id", "start", "end", "members")


@query(ISLANDS + ' SELECT user_id, "end" AS gap_start, lead("start") OVER (PARTITION BY user_id ORDER BY "start") AS gap_end FROM m QUALIFY gap_end IS NOT NULL')
def availability_gaps(spark, sf_dir):
    return A.gaps(covered(spark, sf_dir), ["user_id"])


SPAN = (1_704_412_800_000_000, 1_705_276_800_000_000)  # from 2024-01-05 to 2024-01-15, microseconds


@query(ISLANDS + f""", c AS (SELECT user_id, greatest("start", {SPAN[0]}) AS s, least("end", {SPAN[1]}) AS e FROM m),
h AS (SELECT user_id, count(*) FILTER (e > s) AS n, coalesce(sum(e - s) FILTER (e > s), 0) AS total, min(s) FILTER (e > s) AS a, max(e) FILTER (e > s) AS b FROM c GROUP BY 1)
SELECT user_id, round(total / {SPAN[1] - SPAN[0]}.0, 9) AS share, CAST(CASE WHEN n = 0 THEN 1 ELSE n - 1 + CASE WHEN a > {SPAN[0]} THEN 1 ELSE 0 END + CASE WHEN b < {SPAN[1]} THEN 1 ELSE 0 END END AS BIGINT) AS n_gaps FROM h""")
def availability_share(spark, sf_dir):
    """How much of a span there are data for, and in how many gaps there are none."""
    found = A.availability(covered(spark, sf_dir), ["user_id"], F.lit(SPAN[0]), F.lit(SPAN[1]))
    return found.select("user_id", F.round("share", 9).alias("share"), F.col("n_gaps").cast("long").alias("n_gaps"))


@query("""
WITH r AS (SELECT p_brand, p_retailprice AS r, p_size, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) > 5 THEN 1 ELSE 0 END AS fresh, p_partkey FROM part),
l AS (SELECT *, sum(fresh) OVER (PARTITION BY p_brand ORDER BY r, p_partkey ROWS UNBOUNDED PRECEDING) AS layer FROM r)
SELECT p_brand, CAST(layer AS BIGINT) AS layer, round(avg(r), 6) AS radius, round(avg(p_size), 6) AS mean, count(*) AS n FROM l GROUP BY 1, 2""")
def layer_islands(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    fresh = F.when(F.col("p_retailprice") - F.lag("p_retailprice").over(w) > 5, 1).otherwise(0)
    rows = table(spark, sf_dir, "part").withColumn("fresh", fresh).withColumn("layer", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("p_brand", "layer").agg(F.round(F.avg("p_retailprice"), 6).alias("radius"), F.round(F.avg("p_size"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""
WITH u AS (SELECT 'first' AS event, event_id, user_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT 'second', event_id, user_id, value FROM events WHERE event_type = 'view')
SELECT event, event_id, user_id, value FROM u""")
def union_misfit_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    one = e.filter("event_type = 'click'").drop("event_type").withColumn("event", F.lit("first"))
    return one.unionByName(e.filter("event_type = 'view'").drop("event_type").withColumn("event", F.lit("second")))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_wins_station(spark, sf_dir):
    return A.first_wins(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""
WITH n AS (SELECT event_id, user_id, date_trunc('hour', ts) AS t, value, CASE WHEN ts < TIMESTAMP '2024-01-15' OR event_type IN ('click', 'view') THEN 0 ELSE 1 END AS age FROM events)
SELECT user_id, t, event_id, value, CAST(age AS INTEGER) AS age FROM n QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY age, event_id) = 1""")
def archive_insert_dedupe(spark, sf_dir):
    """Insert new records into an archive: of equal keys (station, hour) the archived, then the first, is kept."""
    old = (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")) | F.col("event_type").isin("click", "view")
    e = table(spark, sf_dir, "events").withColumn("age", F.when(old, 0).otherwise(1)).select("event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"), "value", "age")
    archived, new = e.filter("age = 0"), e.filter("age = 1")
    return A.first_wins(archived.unionByName(new), ["user_id", "t"], [F.col("age"), F.col("event_id")]).select("user_id", "t", "event_id", "value", "age")


@query("""
WITH m AS (SELECT s_nationkey AS net, s_suppkey % 4 AS content, s_acctbal AS s, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal + 100 END AS e FROM supplier)
SELECT net, content, min(s) AS s, CASE WHEN count(*) FILTER (e IS NULL) > 0 THEN NULL ELSE max(e) END AS e FROM m GROUP BY 1, 2""")
def metadata_merge(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("net"), (F.col("s_suppkey") % 4).alias("content"), F.col("s_acctbal").alias("s"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") + 100).alias("e"))
    return A.merge_metadata(m, ["net", "content"], "s", "e", open_wins=True)


@query("""
WITH x AS (SELECT p_partkey, p_brand, p_size::DOUBLE AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS i FROM part)
SELECT p_partkey, p_brand, round(max(x - i * 2.0) OVER (PARTITION BY p_brand ORDER BY x, p_partkey ROWS UNBOUNDED PRECEDING) + i * 2.0, 9) AS place FROM x""")
def min_gap_layout(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    found = A.min_gap_layout(parts, ["p_brand"], F.col("p_size").cast("double"), 2.0, "place", ["p_partkey"])
    return found.select("p_partkey", "p_brand", F.round("place", 9).alias("place"))


@query("SELECT date_trunc('hour', ts) AS chunk, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def chunk_tumbling(spark, sf_dir):
    chunk = F.window(F.col("ts").cast("timestamp"), "1 hour").getField("start").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(chunk.alias("chunk"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH f AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, s""")
def session_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n")


@query("""
WITH r AS (SELECT user_id, CAST(count(*) AS BIGINT) AS n, max(ts) AS last FROM events GROUP BY 1)
SELECT user_id, n, (SELECT max(epoch_us(ts)) FROM events) - epoch_us(last) AS latency_us FROM r""")
def archive_latency(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max(seconds("ts")).alias("now"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(seconds("ts")).alias("last")).crossJoin(F.broadcast(now)).select("user_id", "n", (F.col("now") - F.col("last")).alias("latency_us"))

"""A partitioned archive of records: scans that prune, inserts that keep the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import first_wins, gaps, islands
from ..operators.lineage import tables

#: The partition columns of an archive, outermost first.
PARTITIONS = ("year", "network", "station", "channel", "doy")
KEY = ("network", "station", "location", "channel", "starttime", "samp_rate", "npts")


def insert_records(archived: DataFrame | None, new: DataFrame) -> DataFrame:
    """The archive with new records: of records equal in key the archived, then the first new, is kept."""
    new = new.withColumn("_age", F.lit(1))
    both = new if archived is None else archived.select(*[c for c in new.columns if c != "_age"]).withColumn("_age", F.lit(0)).unionByName(new)
    return first_wins(both, list(KEY), [F.col("_age"), F.sha2("payload", 256)]).drop("_age")


def write_archive(records: DataFrame, path: str, mode: str = "error") -> None:
    """Write under year, network, station, channel and day of year, sorted by start."""
    days = with_days(records)
    days.repartition(*PARTITIONS).sortWithinPartitions(*PARTITIONS, "starttime").write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def with_days(records: DataFrame) -> DataFrame:
    return records.withColumns({"year": F.year("starttime"), "doy": F.dayofyear("starttime")})


def insert_into_archive(new: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Insert new records into the archive at ``path``: (what was added, what differs).

    Only days of channels that new records fall in are read, and of these only those that gain a record are written
    again; the files of all others stay. Of records equal in key the archived stays, then the first new. Added: the
    new records that are now there. Differs: keys for which unlike bytes came (a payload that is neither kept nor equal to the kept),
    with both hashes. The days are written to the shared folder first, for a table cannot be read and replaced at once.
    """
    spark = new.sparkSession
    scope = tables(spark, "archive")
    days = scope.cut(with_days(new))
    at = [F.col(f"a.{c}").cast("string") == F.col(f"d.{c}").cast("string") for c in PARTITIONS]
    touched = days.select(*PARTITIONS).distinct()
    old = spark.read.parquet(path)
    old = old.alias("a").join(touched.alias("d"), at, "left_semi").select(*[F.col(c).cast(days.schema[c].dataType).alias(c) for c in days.columns])
    ranked = scope.cut(old.withColumn("_age", F.lit(0)).unionByName(days.withColumn("_age", F.lit(1))).withColumn("_hash", F.sha2("payload", 256)))
    kept = first_wins(ranked, list(KEY), [F.col("_age"), F.col("_hash")])
    grown = kept.filter("_age = 1").select(*PARTITIONS).distinct()
    whole = scope.cut(kept.join(grown, list(PARTITIONS), "left_semi"))
    out = whole.drop("_age", "_hash").repartition(*PARTITIONS).sortWithinPartitions(*PARTITIONS, "starttime")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    added = scope.keep(whole.filter("_age = 1").select(*new.columns))
    mine = kept.select(*KEY, F.col("_hash").alias("kept_sha256"))
    differs = scope.keep(ranked.select(*KEY, F.col("_hash").alias("other_sha256")).join(mine, list(KEY)).filter("other_sha256 <> kept_sha256").distinct())
    scope.close()
    return added, differs


def read_archive(spark: SparkSession, path: str, start: str, end: str, like: dict[str, str] | None = None, border_days: int = 1) -> DataFrame:
    """Records that overlap [start, end]; years and days (with a border) and names (with * and ?) prune partitions."""
    t0, t1 = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    rows = spark.read.parquet(path)
    day = F.make_date("year", F.lit(1), F.lit(1)) + (F.col("doy") - 1)
    rows = rows.filter(F.col("year").between(F.year(F.date_sub(t0, border_days)), F.year(F.date_add(t1, border_days))))
    rows = rows.filter(day.between(F.date_sub(t0, border_days), F.date_add(t1, border_days)))
    for name, glob in (like or {}).items():
        pattern = glob.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
        rows = rows.filter(F.col(name).cast("string").like(pattern))
    return rows.filter((F.col("starttime") <= t1) & (stop_time() >= t0))


def read_bulk(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records that overlap any of the requests (network, station, location, channel, start, end), each once.

    Requests and records meet by the codes and the days that a request spans.
    """
    codes = ["network", "station", "location", "channel"]
    r = requests.select(*codes, F.col("start").alias("_r0"), F.col("end").alias("_r1"))
    r = r.withColumn("_day", F.explode(F.sequence(F.date_sub(F.to_date("_r0"), 1), F.to_date("_r1"))))
    rows = records.withColumn("_stop", stop_time()).withColumn("_day", F.to_date("starttime"))
    met = rows.join(r, [*codes, "_day"], "left_semi")  # cheap first; the times decide below
    a, b = met.alias("a"), r.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*codes, "_day")] + [F.col("a.starttime") <= F.col("b._r1"), F.col("a._stop") >= F.col("b._r0")]
    return a.join(b, same, "left_semi").select(*[F.col(f"a.{c}") for c in records.columns])


def stop_time() -> Column:
    """When a record's last sample ends."""
    micros = F.unix_micros(F.col("starttime").cast("timestamp")) + (F.col("npts") / F.col("samp_rate") * 1_000_000).cast("long")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def trim(records: DataFrame, start: str, end: str, samples: str = "samples") -> DataFrame:
    """Records cut to the samples whose times lie in [start, end]; those without one are left out."""
    t0, t1 = (F.unix_micros(F.lit(t).cast("timestamp_ntz").cast("timestamp")) for t in (start, end))
    own, step = F.unix_micros(F.col("starttime").cast("timestamp")), 1_000_000 / F.col("samp_rate")
    first = F.greatest(F.lit(0), F.ceil((t0 - own) / step)).cast("int")
    last = F.least(F.col("npts") - 1, F.floor((t1 - own) / step)).cast("int")
    cut = records.withColumns({"_a": first, "_n": last - first + 1}).filter("_n > 0")
    begin = F.timestamp_micros(own + (F.col("_a") * step).cast("long")).cast("timestamp_ntz")
    return cut.withColumns({samples: F.slice(samples, F.col("_a") + 1, F.col("_n")), "starttime": begin, "npts": F.col("_n")}).drop("_a", "_n")


def merge_adjacent(records: DataFrame, samples: str = "samples") -> DataFrame:
    """Records of a channel and rate that follow each other without gap or overlap (within half a sample) become one.
    Others stay as they are, as do equal overlaps: nothing is interpolated or thrown away."""
    from pyspark.sql.window import Window

    keys = ["network", "station", "location", "channel", "samp_rate"]
    w = Window.partitionBy(*keys).orderBy("_s", "npts")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = records.withColumn("_s", micros(F.col("starttime"))).withColumn("_e", F.col("_s") + F.col("npts") / F.col("samp_rate") * 1_000_000)
    apart = F.abs(F.col("_s") - F.lag("_e").over(w)) > 500_000 / F.col("samp_rate")
    rows = rows.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("_s", F.col(samples).alias("v"))))
    merged = rows.groupBy(*keys, "_run").agg(F.min("starttime").alias("starttime"), F.flatten(F.transform(parts, lambda p: p["v"])).alias(samples))
    return merged.withColumn("npts", F.size(samples)).drop("_run")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("network", "station", "location", "channel").distinct()


def coverage(records: DataFrame, by: list[str], start: Column, end: Column, tolerance: Column) -> tuple[DataFrame, DataFrame]:
    """(islands, gaps) of the records' intervals."""
    merged = islands(records, by, start, end, tolerance)
    return merged, gaps(merged, by)


def missing(requests: DataFrame, merged: DataFrame, by: list[str]) -> DataFrame:
    """Interval difference: the times that requests (start, end) ask for and no island covers. Overlapping requests count once."""
    from pyspark.sql.window import Window

    r = requests.select(*by, F.col("start").alias("r0"), F.col("end").alias("r1")).distinct()
    # requests and islands become marks on one time line of their station: where no island is open, a request's time is missing
    key = Window.partitionBy(*by).orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mark = lambda df, a, b, c: df.select(*by, F.col(a).alias("t"), F.lit(1).alias(c)).unionByName(df.select(*by, F.col(b).alias("t"), F.lit(-1).alias(c)))
    m = merged.select(*by, F.col("start").alias("m0"), F.col("end").alias("m1")).filter("m1 > m0")
    marks = mark(r.filter("r1 > r0"), "r0", "r1", "asked").unionByName(mark(m, "m0", "m1", "held"), allowMissingColumns=True)
    sums = marks.groupBy(*by, "t").agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"), F.coalesce(F.sum("held"), F.lit(0)).alias("held"))
    line = sums.select(*by, "t", F.sum("asked").over(key).alias("asked"), F.sum("held").over(key).alias("held"))
    spans = line.withColumn("next", F.lead("t").over(Window.partitionBy(*by).orderBy("t"))).filter("asked > 0 and held = 0 and next > t")
    # neighbouring parts of one gap (another request begins in it) are joined
    before = Window.partitionBy(*by).orderBy("t")
    fresh = F.coalesce(F.col("t") != F.lag("next").over(before), F.lit(True)).cast("int")
    grouped = spans.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "_g").agg(F.min("t").alias("gap_start"), F.max("next").alias("gap_end")).drop("_g")

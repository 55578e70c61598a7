"""Traces: similarity, amplitudes, lags and spectra. The 64 numbers of a vector serve as a trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as G
from .registry import query, table

PAIRS = "WITH t AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS u, list_transform(b.embedding, lambda x: x::DOUBLE) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) "
DOT = "list_inner_product({}, {})"


def pairs(spark, sf_dir):
    """Every trace with the next: an observation and its synthetic."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v"))
    return a.join(b, "vec_id")


@query(PAIRS + "SELECT vec_id, round(list_inner_product(u, v) / (sqrt(list_inner_product(u, u)) * sqrt(list_inner_product(v, v))), 6) AS cc0 FROM t")
def zero_lag_cc(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.round(G.zero_lag_cc(F.col("u"), F.col("v")), 6).alias("cc0"))


@query(PAIRS + "SELECT vec_id, round(list_inner_product(u, v) / list_inner_product(u, u), 6) AS ar0 FROM t")
def amplitude_ratio(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.round(G.amplitude_ratio(F.col("u"), F.col("v")), 6).alias("ar0"))


ONE = "WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS u FROM embeddings) "


def single(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"))


@query(ONE + """, s AS (SELECT vec_id, list_max(list_transform(u[17:64], lambda x: abs(x))) AS s, list_max(list_transform(u[1:16], lambda x: abs(x))) AS n FROM t)
SELECT vec_id, round(CASE WHEN s = 0 THEN NULL WHEN n = 0 THEN 9999 ELSE 20 * log10(s / n) END, 6) AS snr FROM s""")
def snr_db(spark, sf_dir):
    return single(spark, sf_dir).select("vec_id", F.round(G.snr_db(F.slice("u", 17, 48), F.slice("u", 1, 16)), 6).alias("snr"))


@query("SELECT vec_id, CAST(len(s) AS INTEGER) AS n, round(list_sum(list_transform(s, lambda x: x::DOUBLE)), 6) AS total FROM (SELECT vec_id, embedding[11:40] AS s FROM embeddings)")
def trace_slice_by_time(spark, sf_dir):
    """Half-open slice in seconds: at 2 Hz from time -1, [4.25, 19.3) is samples 10 to 39."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"))
    cut = G.slice_by_time(F.col("u"), F.lit(-1.0), F.lit(2.0), F.lit(4.25), F.lit(19.3))
    return t.select("vec_id", cut.alias("s")).select("vec_id", F.size("s").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


LAGS = range(-8, 9)
#: Sums over a trace's samples stand for spectra: what a filter does is a circular convolution with its response.
FINE = 8


@query(PAIRS + """, l AS (SELECT unnest(range(-8, 9)) AS lag),
c AS (SELECT vec_id, lag, list_inner_product(CASE WHEN lag >= 0 THEN u[lag + 1:64] ELSE u[1:64 + lag] END, CASE WHEN lag >= 0 THEN v[1:64 - lag] ELSE v[1 - lag:64] END)
  / (sqrt(list_inner_product(u, u)) * sqrt(list_inner_product(v, v))) AS cc FROM t, l)
SELECT vec_id, CAST(arg_max(lag, cc) AS INTEGER) AS lag, round(max(cc), 6) AS cc FROM c GROUP BY 1""")
def cc_lag_search(spark, sf_dir):
    """The best whole lag, of all traces of a batch at once."""
    best = pairs(spark, sf_dir).select("vec_id", G.best_lag(8)("u", "v").alias("b"))
    return best.select("vec_id", "b.lag", F.round("b.cc", 6).alias("cc"))


@query(PAIRS + f""", c AS (SELECT vec_id, sqrt(list_inner_product(u, u) * list_inner_product(v, v)) AS size, list_transform(range(-63, 64), lambda k: list_inner_product(CASE WHEN k >= 0 THEN u[k + 1:64] ELSE u[1:64 + k] END, CASE WHEN k >= 0 THEN v[1:64 - k] ELSE v[1 - k:64] END)) AS cc FROM t),
f AS (SELECT *, unnest(range(-64, 65)) / {FINE}.0 AS x FROM c),
g AS (SELECT vec_id, x / 2 AS lag, list_sum(list_transform(range(-63, 64), lambda k: cc[k + 64] * CASE WHEN x = k THEN 1.0 ELSE sin(pi() * (x - k)) / (128 * tan(pi() * (x - k) / 128)) END)) / size AS cc FROM f)
SELECT vec_id, arg_max(lag, struct_pack(c := round(cc, 9), l := -lag)) AS lag, round(max(cc), 6) AS cc FROM g GROUP BY 1""")
def cc_lag_refined(spark, sf_dir):
    """Lag between samples, by FFT and spectral interpolation."""
    found = pairs(spark, sf_dir).select("vec_id", G.cc_lag_search(2.0, 4.0, FINE)("u", "v").alias("b"))
    return found.select("vec_id", "b.lag", F.round("b.cc", 6).alias("cc"))


BANDPASS = [float(x) for x in G.impulse_response(96, 2.0, 2, 0.05, 0.4)]


@query(ONE + f""", p AS (SELECT vec_id, list_concat(list_transform(range(16), lambda i: u[1]), u, list_transform(range(16), lambda i: u[64])) AS x FROM t)
SELECT vec_id, round(list_sum(list_transform(range(96), lambda j: x[j + 1] * {BANDPASS}[(16 - j + 96) % 96 + 1])), 6) AS "first", round(list_sum(list_transform(range(96), lambda j: x[j + 1] * {BANDPASS}[(48 - j + 96) % 96 + 1])), 6) AS middle FROM p""")
def zero_phase_bandpass(spark, sf_dir):
    """A filter of magnitudes only; the trace's ends are repeated on both sides."""
    y = G.zero_phase_filter(2.0, 2, 0.05, 0.4, pad=16)("u")
    return single(spark, sf_dir).select("vec_id", y.alias("y")).select("vec_id", F.round(F.get("y", F.lit(0)), 6).alias("first"), F.round(F.get("y", F.lit(32)), 6).alias("middle"))


@query(ONE + """ SELECT vec_id, round(2 * pi() / 64 * 2 * list_sum(list_transform(range(1, 64), lambda m: u[(9 - m + 64) % 64 + 1] * CASE WHEN m % 2 = 0 THEN 0.5 ELSE -0.5 END / tan(pi() * m / 64))), 5) AS ninth FROM t""")
def trace_derivative(spark, sf_dir):
    """The derivative of the trigonometric interpolation, at the tenth sample."""
    found = single(spark, sf_dir).select("vec_id", G.derivative(2.0)("u").alias("y"))
    return found.select("vec_id", F.round(F.get("y", F.lit(9)), 5).alias("ninth"))


KERNEL = "CASE WHEN x = k THEN 1.0 WHEN abs(x - k) >= 20 THEN 0.0 ELSE sin(pi() * (x - k)) / (pi() * (x - k)) * sin(pi() * (x - k) / 20) / (pi() * (x - k) / 20) END"


@query(ONE + f""", s AS (SELECT vec_id, u, unnest(range(158)) * 2.0 / 5.0 AS x FROM t), y AS (SELECT vec_id, x, list_sum(list_transform(range(64), lambda k: u[k + 1] * {KERNEL})) AS y FROM s)
SELECT vec_id, CAST(count(*) AS INTEGER) AS n, round(sum(y), 6) AS total, round(sum(y * x), 4) AS moment FROM y GROUP BY 1""")
def lanczos_resample(spark, sf_dir):
    found = single(spark, sf_dir).select("vec_id", G.lanczos_resample(2.0, 5.0)("u").alias("y"))
    total = lambda f: F.aggregate(F.transform("y", f), F.lit(0.0), lambda a, x: a + x)
    return found.select("vec_id", F.size("y").alias("n"), F.round(total(lambda x, i: x), 6).alias("total"), F.round(total(lambda x, i: x * i * 0.4), 4).alias("moment"))

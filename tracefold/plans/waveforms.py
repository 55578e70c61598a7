"""Measured windows over three-component traces, scans of channels, and source updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sources as S
from ..functions import waveform as W
from ..operators import records as R
from .registry import query, table
from .traces import PAIRS, pairs

#: Channels 1 and 2 look to 30 and 120 degrees, the third up. 20 samples each.
AZIMUTHS, N = (30.0, 120.0), 20
RULES = W.MeasureRules(snr=(-10, 5), cc0=(-0.6, 0.6), cc_max=(0.0, 0.5), shift=(-3, -1, 1, 3))


def three(spark, sf_dir):
    """Pairs of vectors as observed and computed traces: east, north, up, a component by number, a back azimuth."""
    t = pairs(spark, sf_dir)
    d = [W.polarisation(F.lit(a), F.lit(0.0)) for a in AZIMUTHS] + [W.polarisation(F.lit(0.0), F.lit(-90.0))]
    out = t.select("vec_id", *[F.slice(c, N * i + 1, N).alias(f"{c}{i}") for c in "uv" for i in range(3)])
    out = out.withColumn("cmp", F.element_at(F.array(*[F.lit(c) for c in "ZRTHF"]), (F.col("vec_id") % 5 + 1).cast("int"))).withColumn("baz", (F.col("vec_id") * 7 % 360).cast("double"))
    names = dict(zip("uv", (W.OBSERVED, W.SYNTHETIC)))
    for c, own in names.items():
        out = out.withColumns(dict(zip(own, W.rotate_to_enz(d, [F.col(f"{c}{i}") for i in range(3)]))))
    return out.withColumn("matrix", W.projection(F.col("cmp"), *W.component_direction(F.col("cmp"), F.col("baz")))).drop(*[f"{c}{i}" for c in "uv" for i in range(3)])


def enz(c: str) -> str:
    s, k = [f"sin(radians({a}))" for a in AZIMUTHS], [f"cos(radians({a}))" for a in AZIMUTHS]
    turn = lambda f: f"list_transform({c}[1:{N}], lambda x, i: x * {f[0]} + {c}[i + {N}] * {f[1]})"
    return f"{turn(s)} AS {c}e, {turn(k)} AS {c}n, {c}[{2 * N + 1}:{3 * N}] AS {c}z"


def projected(c: str) -> str:
    along = f"(ne * {c}e[i] + nn * {c}n[i] + nz * {c}z[i])"
    one = lambda d: f"list_transform(range(1, {N + 1}), lambda i: CASE cmp WHEN 'H' THEN {'0.0' if d == 'z' else f'{c}{d}[i]'} WHEN 'F' THEN {c}{d}[i] ELSE n{d} * {along} END)"
    return ", ".join(f"{one(d)} AS {c}p{d}" for d in "enz")


def dots(a: str, b: str) -> str:
    return "(" + " + ".join(f"list_inner_product({a}{d}, {b}{d})" for d in "enz") + ")"


def largest(a: str) -> str:
    return f"sqrt(list_max(list_transform(range(1, len({a}e) + 1), lambda i: {a}e[i] * {a}e[i] + {a}n[i] * {a}n[i] + {a}z[i] * {a}z[i])))"


SIGNAL = PAIRS + f""", c AS (SELECT vec_id, ['Z', 'R', 'T', 'H', 'F'][vec_id % 5 + 1] AS cmp, (vec_id * 7 % 360)::DOUBLE AS baz, {enz("u")}, {enz("v")} FROM t),
n AS (SELECT *, CASE cmp WHEN 'R' THEN sin(radians(baz + 180)) WHEN 'T' THEN sin(radians(baz - 90)) ELSE 0.0 END AS ne,
  CASE cmp WHEN 'R' THEN cos(radians(baz + 180)) WHEN 'T' THEN cos(radians(baz - 90)) ELSE 0.0 END AS nn, CASE cmp WHEN 'Z' THEN 1.0 ELSE 0.0 END AS nz,
  list_transform(range({N}), lambda k: CASE WHEN k / 2.0 < 2 OR k / 2.0 > 9.5 THEN 0.0 WHEN k / 2.0 < 3.5 THEN 0.5 - 0.5 * cos(pi() * (k / 2.0 - 2) / 1.5) WHEN k / 2.0 > 8 THEN 0.5 - 0.5 * cos(pi() * (9.5 - k / 2.0) / 1.5) ELSE 1.0 END) AS w FROM c),
p AS (SELECT vec_id, cmp, ne, nn, nz, w, {projected("u")}, {projected("v")} FROM n),
s AS (SELECT *, {", ".join(f"list_transform({c}p{d}, lambda x, i: x * w[i]) AS {a}{d}" for c, a in (("u", "ob"), ("v", "s")) for d in "enz")}, {", ".join(f"up{d}[1:4] AS q{d}" for d in "enz")} FROM p)"""

LAG = f"list_transform(range({1 - N}, {N}), lambda k: " + " + ".join(
    f"list_inner_product(CASE WHEN k >= 0 THEN ob{d}[k + 1:{N}] ELSE ob{d}[1:{N} + k] END, CASE WHEN k >= 0 THEN s{d}[1:{N} - k] ELSE s{d}[1 - k:{N}] END)" for d in "enz") + ")"


def taper_sql(x: str, corners: tuple) -> str:
    if len(corners) == 2:
        a, b = corners
        return f"CASE WHEN {x} <= {a} THEN 0.0 WHEN {x} >= {b} THEN 1.0 ELSE 0.5 - 0.5 * cos(pi() * ({x} - ({a})) / ({b} - ({a}))) END"
    a, b, c, d = corners
    return f"CASE WHEN {x} <= {a} OR {x} >= {d} THEN 0.0 WHEN {x} BETWEEN {b} AND {c} THEN 1.0 WHEN {x} < {b} THEN 0.5 - 0.5 * cos(pi() * ({x} - ({a})) / ({b} - ({a}))) ELSE 0.5 - 0.5 * cos(pi() * ({x} - ({d})) / ({c} - ({d}))) END"


@query(SIGNAL + f""", m AS (SELECT vec_id, cmp, {largest("ob")} AS obs_amp, {largest("s")} AS syn_amp, {largest("q")} AS noise_amp, sqrt({dots("ob", "ob")}) AS a, sqrt({dots("s", "s")}) AS b, {dots("ob", "s")} AS ab, {LAG} AS lags FROM s),
f AS (SELECT *, unnest(range(-16, 17)) AS j FROM m),
g AS (SELECT vec_id, j / 8.0 AS tau, round(list_sum(list_transform(range({1 - N}, {N}), lambda k: lags[k + {N}] * CASE WHEN j / 4.0 = k THEN 1.0 WHEN abs(j / 4.0 - k) >= 20 THEN 0.0
  ELSE sin(pi() * (j / 4.0 - k)) / (pi() * (j / 4.0 - k)) * sin(pi() * (j / 4.0 - k) / 20) / (pi() * (j / 4.0 - k) / 20) END)) / (a * b), 9) AS cc FROM f),
h AS (SELECT vec_id, arg_max(tau, struct_pack(c := cc, t := -tau)) AS cc_shift, max(cc) AS cc_max FROM g GROUP BY 1),
r AS (SELECT m.*, cc_shift, cc_max, 20 * log10(obs_amp / noise_amp) AS snr, ab / (a * b) AS cc0, b / a AS ratio FROM m JOIN h ON m.vec_id = h.vec_id)
SELECT vec_id, cmp, round(obs_amp, 6) AS obs_amp, round(syn_amp, 6) AS syn_amp, round(noise_amp, 6) AS noise_amp, round(snr, 5) AS snr, round(cc0, 6) AS cc0, round(cc0 * ratio, 5) AS ar0,
  cc_shift, round(cc_max, 6) AS cc_max, round(cc_max * ratio, 5) AS ar_max, round((1 + vec_id % 3) * ({taper_sql("snr", RULES.snr)}) * ({taper_sql("cc0", RULES.cc0)}) * ({taper_sql("cc_max", RULES.cc_max)}) * ({taper_sql("cc_shift", RULES.shift)}), 5) AS weight FROM r""")
def measure_windows(spark, sf_dir):
    """Rotation, projection, taper, amplitudes, similarity, lag and weight of every window."""
    t = three(spark, sf_dir).withColumn("weight", 1.0 + F.col("vec_id") % 3)
    found = W.measure_windows(t, RULES)
    digits = {"snr": 5, "ar0": 5, "ar_max": 5, "cc_shift": 9, "weight": 5}
    return found.select("vec_id", "cmp", *[F.round(c, digits.get(c, 6)).alias(c) for c in (*W.MEASURES, "weight")])


@query(SIGNAL + f""", m AS (SELECT *, {dots("ob", "s")} / {dots("s", "s")} AS big, sqrt({dots("ob", "ob")} * {dots("s", "s")}) AS nw FROM s),
d AS (SELECT vec_id, cmp, ne, nn, nz, {", ".join(f"list_transform(ob{d}, lambda x, i: (x - big * s{d}[i]) * w[i] / nw) AS d{d}" for d in "enz")} FROM m),
b AS (SELECT vec_id, {projected("d")} FROM d)
SELECT vec_id, {", ".join(f"round(sqrt(list_inner_product(dp{d}, dp{d})), 6) AS size_{d}" for d in "enz")}, round(dpe[9] + dpn[9] + dpz[9], 6) AS middle FROM b""")
def adjoint_source(spark, sf_dir):
    """How the similarity changes with each sample of the synthetic."""
    a = W.adjoint_source(three(spark, sf_dir), RULES)
    size = lambda c: F.round(F.sqrt(S.inner(F.col(c), F.col(c))), 6)
    return a.select("vec_id", *[size(f"adj_{c}").alias(f"size_{c}") for c in "enz"], F.round(sum(F.get(f"adj_{c}", F.lit(8)) for c in "enz"), 6).alias("middle"))


KINDS = ["body", "Pwin", "Swin", "surf", "full"]


@query(f"""
WITH k AS (SELECT unnest({KINDS}) AS kind), o AS (SELECT o_orderkey, o_totalprice / 5000 AS d, 10 * sqrt(o_totalprice / 5000) AS p, 18 * sqrt(o_totalprice / 5000) AS s FROM orders),
w AS (SELECT o_orderkey, kind, CASE kind WHEN 'body' THEN p - 10 WHEN 'Pwin' THEN p - 10 WHEN 'Swin' THEN s - 10 WHEN 'surf' THEN d * 1.5 - greatest(0, (60 - d) / 2) ELSE p - 10 END AS b,
  CASE kind WHEN 'body' THEN p + 4 + 25 WHEN 'Pwin' THEN greatest(p + 25, s + 5) WHEN 'Swin' THEN greatest(s + 25, d * 2.2) WHEN 'surf' THEN d * 2.5 + greatest(0, (60 - d) / 2) ELSE greatest(p + 25, d * 2.2) END AS e FROM o, k)
SELECT o_orderkey, kind, round(greatest(b, 20), 6) AS begin, round(least(e, 150), 6) AS "end", least(e, 150) - greatest(b, 20) >= (e - b) / 2 AS ok FROM w""")
def window_bounds(spark, sf_dir):
    """Begin and end of windows of all types, cut to the data there are."""
    d = F.col("o_totalprice") / 5000
    p, s, f = 10 * F.sqrt(d), 18 * F.sqrt(d), F.lit
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.explode(F.array(*[f(k) for k in KINDS])).alias("kind"))
    b, e = W.window_bounds(F.col("kind"), d, {"body": (p, p + 4), "P": (p, p), "S": (s, s)}, (f(-10.0), f(25.0)), (f(1.5), f(2.5), f(60.0)), f(5.0), f(2.2))
    rows = rows.select("o_orderkey", "kind", b.alias("b"), e.alias("e"))
    begin, end, ok = W.within_data(F.col("b"), F.col("e"), f(20.0), f(150.0))
    return rows.select("o_orderkey", "kind", F.round(begin, 6).alias("begin"), F.round(end, 6).alias("end"), ok.alias("ok"))


def channels(spark, sf_dir):
    """Vectors as single channels: three to a station; some of them start late."""
    late = F.when(F.col("label") % 4 == 0, 0.5).otherwise(0.0)
    code = F.element_at(F.array(*[F.lit(c) for c in "ENZ"]), (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 3).alias("sta"), code.alias("channel"), late.alias("starttime"), F.lit(2.0).alias("rate"), F.col("embedding").cast("array<double>").alias("samples"))


CHANNELS = """
WITH r AS (SELECT CAST(floor(vec_id / 3) AS BIGINT) AS sta, vec_id % 3 AS c, CASE WHEN label % 4 = 0 THEN 0.5 ELSE 0.0 END AS s, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
g AS (SELECT sta, count(*) AS n, min(s) AS a, max(s) AS b, list(v ORDER BY c) AS t FROM r GROUP BY 1)"""


@query(CHANNELS + " SELECT sta, CASE WHEN n <> 3 THEN 'not three channels' ELSE 'starts differ' END AS reason FROM g WHERE n <> 3 OR a <> b")
def incomplete_stations(spark, sf_dir):
    return R.three_components(channels(spark, sf_dir), ["sta"])[1]


def tapered_sum(k: int) -> str:
    share = "least(1.0, least(i - 1, 40 - i) / 8.0)"
    return f"round(list_sum(list_transform(t[{k}][CAST((4 - a) * 2 AS INTEGER) + 1:CAST((24 - a) * 2 AS INTEGER)], lambda x, i: x * (0.5 - 0.5 * cos(pi() * {share})))), 6) AS total{k}"


@query(CHANNELS + f" SELECT sta, 4.0::DOUBLE AS s, 40 AS npts, {', '.join(map(tapered_sum, (1, 2, 3)))} FROM g WHERE n = 3 AND a = b AND sta % 4 <> 0")
def event_waveform_scan(spark, sf_dir):
    """Stations of an allow-list with three even traces, cut to a time window and tapered at the edges."""
    c = channels(spark, sf_dir)
    allow = c.select("sta").filter("sta % 4 <> 0").distinct()
    found = R.event_waveforms(c, ["sta"], allow, F.lit(4.0), F.lit(24.0), F.lit(8))
    total = lambda i: F.round(F.aggregate(f"trace{i}", F.lit(0.0), lambda a, x: a + x), 6).alias(f"total{i}")
    return found.select("sta", F.col("starttime").alias("s"), "npts", *[total(i) for i in (1, 2, 3)])


SOURCE = "WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, v[1:3] AS xs, v[4:6] AS gx, v[7:15] AS mt, v[16:24] AS gm FROM d), " \
    "n AS (SELECT vec_id, xs, mt, list_transform(gx, lambda x: x / list_max(list_transform(gx, lambda y: abs(y)))) AS gx, list_transform(gm, lambda x: x / list_max(list_transform(gm, lambda y: abs(y)))) AS gm FROM s), " \
    "o AS (SELECT *, list_transform(gm, lambda g, i: g - mt[i] * list_inner_product(gm, mt) / list_inner_product(mt, mt)) AS ac FROM n), " \
    "q AS (SELECT *, list_transform(gx, lambda x: 1000 * x / sqrt(list_inner_product(gx, gx))) AS dxs, list_transform(ac, lambda x: x / sqrt(list_inner_product(ac, ac)) * 0.1 * sqrt(list_inner_product(mt, mt))) AS dmt FROM o)"


def source(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(v, 1, 3).alias("xs"), F.slice(v, 4, 3).alias("gx"), F.slice(v, 7, 9).alias("mt"), F.slice(v, 16, 9).alias("gm"))
    dxs, dmt = S.search_directions(F.col("xs"), F.col("mt"), F.col("gx"), F.col("gm"), 1000.0, 0.1)
    return t.select("vec_id", "xs", "mt", dxs.alias("dxs"), dmt.alias("dmt"))


@query(SOURCE + " SELECT vec_id, " + ", ".join(f"round(dxs[{i}], 5) AS dxs{i}" for i in (1, 2, 3)) + ", " + ", ".join(f"round(dmt[{i}], 7) AS dmt{i}" for i in range(1, 10)) + " FROM q")
def source_search_directions(spark, sf_dir):
    return source(spark, sf_dir).select("vec_id", *[F.round(F.get("dxs", F.lit(i)), 5).alias(f"dxs{i + 1}") for i in range(3)], *[F.round(F.get("dmt", F.lit(i)), 7).alias(f"dmt{i + 1}") for i in range(9)])


@query(SOURCE + """, u AS (SELECT vec_id, list_transform(xs, lambda x, i: x + 0.5 * dxs[i]) AS xs1, list_transform(mt, lambda x, i: x + 2.0 * dmt[i]) AS m, mt FROM q)
SELECT vec_id, """ + ", ".join(f"round(xs1[{i}], 5) AS xs{i}" for i in (1, 2, 3)) + ", " + ", ".join(f"round(m[{i}] * sqrt(list_inner_product(mt, mt)) / sqrt(list_inner_product(m, m)), 7) AS mt{i}" for i in (1, 5, 9)) + """,
TIMESTAMP '2024-01-01 00:00:00.123' + INTERVAL 1500 MILLISECOND AS t0, 4.25::DOUBLE AS tau FROM u""")
def source_update(spark, sf_dir):
    """Steps along the directions: the tensor keeps its scalar moment."""
    t0 = F.lit("2024-01-01 00:00:00.123").cast("timestamp_ntz")
    new = S.updated_source(F.col("xs"), F.col("mt"), t0, F.lit(4.0), F.col("dxs"), F.col("dmt"), {"xs": F.lit(0.5), "mt": F.lit(2.0), "t0": F.lit(1.5), "tau": F.lit(0.25)})
    return source(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in new.items()]).select(
        "vec_id", *[F.round(F.get("xs", F.lit(i)), 5).alias(f"xs{i + 1}") for i in range(3)], *[F.round(F.get("mt", F.lit(i)), 7).alias(f"mt{i + 1}") for i in (0, 4, 8)], "t0", "tau")


@query("""
SELECT p_partkey, round(exp(-pi() * pi() * p_size * p_size / 10000.0 * 9), 9) AS amplitude, round(-2 * pi() * p_size / 100.0 * 0.5, 9) AS phase,
  round(-2 * pi() * pi() * p_size * p_size / 10000.0 * 3, 9) AS by_tau, round(-2 * pi() * p_size / 100.0, 9) AS by_t0 FROM part""")
def source_spectrum(spark, sf_dir):
    found = W.source_spectrum(F.col("p_size") / 100, F.lit(3.0), F.lit(0.5))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 9).alias(n) for n, c in found.items()])


@query("""
WITH x AS (SELECT vec_id, embedding[1]::DOUBLE * 1e6 + 7e6 AS x, embedding[2]::DOUBLE * 1e6 + 1e5 AS y, embedding[3]::DOUBLE * 1e6 AS z, list_transform(embedding[4:9], lambda v: v::DOUBLE) AS m FROM embeddings)
SELECT vec_id, """ + ", ".join(f"round(m[{i + 1}], 7) AS m{i}" for i in range(6)) + """, round(m[1] + m[2] + m[3], 7) AS trace,
  round(sqrt((m[1] * m[1] + m[2] * m[2] + m[3] * m[3] + 2 * (m[4] * m[4] + m[5] * m[5] + m[6] * m[6])) / 2), 7) AS moment FROM x""")
def tensor_rotation_roundtrip(spark, sf_dir):
    """A tensor to the x, y, z frame and back: itself again; trace and scalar moment are those of the turned one."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    xyz = [e(0) * 1e6 + 7e6, e(1) * 1e6 + 1e5, e(2) * 1e6]
    t = table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(n) for c, n in zip(xyz, "xyz")], *[e(3 + i).alias(f"r{i}") for i in range(6)])
    place = [F.col(c) for c in "xyz"]
    t = t.select("vec_id", *"xyz", *[c.alias(f"c{i}") for i, c in enumerate(S.rtp_to_xyz([F.col(f"r{i}") for i in range(6)], *place))])
    c = [F.col(f"c{i}") for i in range(6)]
    m0 = F.sqrt((c[0] * c[0] + c[1] * c[1] + c[2] * c[2] + 2 * (c[3] * c[3] + c[4] * c[4] + c[5] * c[5])) / 2)
    return t.select("vec_id", *[F.round(x, 7).alias(f"m{i}") for i, x in enumerate(S.rtp_to_xyz(c, *place, inverse=True))], F.round(c[0] + c[1] + c[2], 7).alias("trace"), F.round(m0, 7).alias("moment"))

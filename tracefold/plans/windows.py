"""Windows by rule, measured each by its own band and span, and the adjoint source of every station."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sources as S
from ..functions import waveform as W
from ..operators import windows as O
from .registry import query, table
from .waveforms import N, dots, enz, largest, projected, taper_sql, three
from .traces import PAIRS

RULES = [
    O.WindowRule("p_body", "body", "Z", (2, 0.02, 0.1), ("P", "Pdiff", "pP"), distance=(10.0, 120.0), twin=(-20.0, 60.0)),
    O.WindowRule("deep_pp", "body", "R", (2, 0.02, 0.05), ("pP",), depth=(100.0, 700.0), twin=(-15.0, 45.0), weight=2.0),
    O.WindowRule("core", "body", "T", (3, 0.02, 0.08), ("ScS",), distance=(0.0, 65.0), twin=(-30.0, 50.0)),
    O.WindowRule("p_all", "Pwin", "Z", (2, 0.03, 0.1), twin=(-25.0, 90.0), after_s=-20.0, distance=(0.0, 90.0)),
    O.WindowRule("s_all", "Swin", "T", (2, 0.01, 0.04), twin=(-25.0, 120.0), slowness=21.0),
    O.WindowRule("surface", "surf", "H", (2, 0.01, 0.025), swin=(22.0, 40.0, 300.0), depth=(0.0, 150.0), weight=0.5),
    O.WindowRule("whole", "full", "F", (2, 0.01, 0.03), twin=(-60.0, 200.0), slowness=25.0, distance=(30.0, 180.0)),
]


def rules_sql(rules: list[O.WindowRule]) -> str:
    """The rules as the rows of a CTE r."""
    rows = ", ".join(
        f"('{r.id}', '{r.kind}', '{r.component}', {r.band[0]}, {r.band[1]}, {r.band[2]}, {list(r.phases)}::VARCHAR[], {r.depth[0]}, {r.depth[1]}, {r.distance[0]}, {r.distance[1]}, "
        f"{r.twin[0]}, {r.twin[1]}, {r.swin[0]}, {r.swin[1]}, {r.swin[2]}, {r.after_s}, {r.slowness}, {r.taper}, {r.weight})"
        for r in rules
    )
    return f"r(id, kind, cmp, butter_n, low, high, phases, z0, z1, d0, d1, t0, t1, s0, s1, least, dts, slw, taper, rule_weight) AS (VALUES {rows})"


def windows_sql(key: str) -> str:
    """CTEs bw (all spans) and w (windows) of stations st and arrivals ar; every arrival meets the rule on its own."""
    return f"""x AS (SELECT {key}, id, min(time) FILTER (list_contains(phases, phase)) AS b0, max(time) FILTER (list_contains(phases, phase)) AS b1,
  min(time) FILTER (phase IN ('p', 'P', 'Pdiff', 'PKIKP')) AS p, min(time) FILTER (phase IN ('s', 'S', 'Sdiff', 'SKIKS')) AS s FROM ar, r GROUP BY ALL),
j AS (SELECT st.*, r.*, x.b0, x.b1, x.p, x.s FROM st JOIN r ON greatest(depth, 0) BETWEEN z0 AND z1 AND distance BETWEEN d0 AND d1 AND (horizontals OR cmp = 'Z')
  LEFT JOIN x ON x.{key} = st.{key} AND x.id = r.id),
bw AS (SELECT *, CASE kind WHEN 'body' THEN b0 + t0 WHEN 'Pwin' THEN p + t0 WHEN 'Swin' THEN s + t0 WHEN 'surf' THEN distance * s0 - greatest(0, (least - distance * (s1 - s0)) / 2) ELSE p + t0 END AS wb,
  CASE kind WHEN 'body' THEN b1 + t1 WHEN 'Pwin' THEN CASE WHEN s IS NULL THEN NULL ELSE greatest(p + t1, s + dts) END WHEN 'Swin' THEN greatest(s + t1, distance * slw)
    WHEN 'surf' THEN distance * s1 + greatest(0, (least - distance * (s1 - s0)) / 2) ELSE greatest(p + t1, distance * slw) END AS we FROM j),
w AS (SELECT *, greatest(wb, first) AS b, least(we, last) AS e FROM bw WHERE wb IS NOT NULL AND we IS NOT NULL AND least(we, last) - greatest(wb, first) >= (we - wb) / 2)"""


def arrival(name: str, time: Column, where: Column) -> Column:
    return F.when(where, F.struct(F.lit(name).alias("phase"), time.cast("double").alias("time")))


def arrivals_of(stations, key: str, told: list[Column]):
    """The arrivals of each station as rows; which there are depends on depth and distance."""
    return stations.select(key, F.explode(F.array(*told)).alias("a")).filter("a is not null").select(key, "a.phase", "a.time")


@query(f"""
WITH {rules_sql(RULES)}, st AS (SELECT c_custkey, c_acctbal::DOUBLE / 15 AS depth, (c_custkey * 37 % 1700) / 10.0::DOUBLE AS distance, (c_custkey * 13 % 360)::DOUBLE AS baz,
  c_custkey % 7 <> 0 AS horizontals, (c_custkey % 5) * 40.0 - 50 AS first, 900.0 + (c_custkey % 11) * 200 AS last FROM customer),
ar AS (SELECT c_custkey, 'P' AS phase, 13 * distance - distance * distance / 20 AS time FROM st WHERE distance < 98 UNION ALL SELECT c_custkey, 'Pdiff', 340 + 4.5 * distance FROM st WHERE distance >= 98 AND distance < 140
  UNION ALL SELECT c_custkey, 'pP', 13 * distance - distance * distance / 20 + depth / 4 FROM st WHERE distance BETWEEN 20 AND 98 AND depth > 30
  UNION ALL SELECT c_custkey, 'S', 23 * distance - distance * distance / 12 FROM st WHERE distance < 100 UNION ALL SELECT c_custkey, 'Sdiff', 630 + 8.4 * distance FROM st WHERE distance >= 100 AND distance < 140
  UNION ALL SELECT c_custkey, 'ScS', 940 + 2.5 * distance FROM st WHERE distance < 80 UNION ALL SELECT c_custkey, 'ScS', 955 + 2.2 * distance FROM st WHERE distance BETWEEN 40 AND 80),
{windows_sql("c_custkey")}
SELECT c_custkey, id, kind, cmp AS component, CASE cmp WHEN 'Z' THEN 0.0 WHEN 'R' THEN (baz + 180) % 360 WHEN 'T' THEN (baz + 270) % 360 END AS azimuth,
  CASE cmp WHEN 'Z' THEN -90.0 WHEN 'F' THEN NULL ELSE 0.0 END AS dip, butter_n AS "order", low, high, taper, rule_weight AS weight, round(b, 6) AS begin, round(e, 6) AS "end" FROM w""")
def station_windows(spark, sf_dir):
    """Windows of every station: rules meet depth, distance, components and the phases that arrive."""
    k, f = F.col("c_custkey"), F.lit
    st = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal").cast("double") / 15).alias("depth"), (k * 37 % 1700 / 10).alias("distance"), (k * 13 % 360).cast("double").alias("back_azimuth"),
        (k % 7 != 0).alias("horizontals"), ((k % 5) * 40.0 - 50).alias("first"), (900.0 + (k % 11) * 200).alias("last"))
    d, z = F.col("distance"), F.col("depth")
    p = 13 * d - d * d / 20
    ar = arrivals_of(st, "c_custkey", [
        arrival("P", p, d < 98), arrival("Pdiff", 340 + 4.5 * d, (d >= 98) & (d < 140)), arrival("pP", p + z / 4, d.between(20, 98) & (z > 30)),
        arrival("S", 23 * d - d * d / 12, d < 100), arrival("Sdiff", 630 + 8.4 * d, (d >= 100) & (d < 140)),
        arrival("ScS", 940 + 2.5 * d, d < 80), arrival("ScS", 955 + 2.2 * d, d.between(40, 80)),
    ])
    found = O.station_windows(st, ar, RULES, ["c_custkey"])
    number = lambda c: F.nanvl(c, f(None).cast("double")).alias(c)
    return found.select(
        "c_custkey", "id", "kind", "component", number("azimuth"), number("dip"), "order", "low", "high", "taper", "weight", F.round("begin", 6).alias("begin"), F.round("end", 6).alias("end"))


#: Five kinds of windows in two bands, for traces of ten seconds at 2 Hz.
SHORT = [
    O.WindowRule("body", "body", "Z", (2, 0.4, 0.8), ("P", "pP"), twin=(-1.0, 2.5)),
    O.WindowRule("pwin", "Pwin", "R", (3, 0.25, 0.7), twin=(-0.5, 2.0), after_s=0.5, weight=2.0),
    O.WindowRule("swin", "Swin", "T", (2, 0.4, 0.8), twin=(-1.0, 2.0), slowness=1.5, taper=0.6),
    O.WindowRule("surf", "surf", "H", (3, 0.25, 0.7), swin=(1.2, 1.9, 3.0), weight=0.5),
    O.WindowRule("full", "full", "F", (2, 0.4, 0.8), twin=(-1.0, 4.0), slowness=2.0, distance=(1.0, 90.0), taper=0.1),
]
MEASURE = O.TableRules(corners={"snr": (-20, 5), "cc0": (-0.6, 0.6), "cc_max": (0.0, 0.5), "cc_shift": (-3, -1, 1, 3)})
RATE, LAST, PAD, SIZE = 2.0, 9.5, 40, 100

GAIN = f"CASE WHEN k = 0 THEN 0.0 ELSE 1 / sqrt(1 + power((tan(pi() * k / {SIZE}) * tan(pi() * k / {SIZE}) - e0 * e1) / (tan(pi() * k / {SIZE}) * (e1 - e0)), 2 * butter_n)) END"
PADDED = f"list_transform(range({SIZE}), lambda i: {{0}}[greatest(1, least({N}, i - {PAD} + 1))] * CASE WHEN i <= {PAD} THEN 0.5 - 0.5 * cos(pi() * i / {PAD}) WHEN i > {PAD + N} THEN 0.5 - 0.5 * cos(pi() * ({SIZE - 1} - i) / ({SIZE - 1 - PAD - N})) ELSE 1.0 END)"
TRACES = [f"{c}{d}" for c in "uv" for d in "enz"]
FILTERED = ", ".join(f"list_transform(turns, lambda h: list_inner_product({PADDED.format(t)}, h)) AS {t}" for t in TRACES)
TABLE = PAIRS + f""", {rules_sql(SHORT)},
st AS (SELECT vec_id, 10.0::DOUBLE AS depth, (vec_id % 40) / 10.0::DOUBLE AS distance, TRUE AS horizontals, 0.0::DOUBLE AS first, {LAST}::DOUBLE AS last FROM t),
ar AS (SELECT vec_id, 'P' AS phase, 1.5 + distance / 2 AS time FROM st UNION ALL SELECT vec_id, 'pP', 2.5 + distance / 2 FROM st WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, 'S', 3 + 0.9 * distance FROM st WHERE vec_id % 4 <> 0),
{windows_sql("vec_id")},
f AS (SELECT DISTINCT butter_n, low, high, tan(pi() * low / {RATE}) AS e0, tan(pi() * high / {RATE}) AS e1 FROM r),
g AS (SELECT butter_n, low, high, list_transform(range({SIZE // 2 + 1}), lambda k: {GAIN}) AS gain FROM f),
h AS (SELECT butter_n, low, high, list_transform(range({SIZE}), lambda i: list_sum(list_transform(range({SIZE // 2 + 1}), lambda k: CASE WHEN k IN (0, {SIZE // 2}) THEN 1 ELSE 2 END * gain[k + 1] * cos(2 * pi() * k * i / {SIZE}))) / {SIZE}) AS h FROM g),
hh AS (SELECT butter_n, low, high, h, list_transform(range({N}), lambda s: list_transform(range({SIZE}), lambda i: h[((i - s - {PAD}) % {SIZE} + {SIZE}) % {SIZE} + 1])) AS turns FROM h),
c AS (SELECT vec_id, ['Z', 'R', 'T', 'H', 'F'][vec_id % 5 + 1] AS own, (vec_id * 7 % 360)::DOUBLE AS baz, {enz("u")}, {enz("v")} FROM t),
fl AS (SELECT c.vec_id, baz, butter_n, low, high, h, {FILTERED} FROM c, hh),
n AS (SELECT fl.*, w.id, w.cmp, w.b, w.e, w.taper, w.rule_weight, 1.5 + w.distance / 2 AS noise_end,
  CASE cmp WHEN 'R' THEN sin(radians(baz + 180)) WHEN 'T' THEN sin(radians(baz - 90)) ELSE 0.0 END AS ne,
  CASE cmp WHEN 'R' THEN cos(radians(baz + 180)) WHEN 'T' THEN cos(radians(baz - 90)) ELSE 0.0 END AS nn, CASE cmp WHEN 'Z' THEN 1.0 ELSE 0.0 END AS nz
  FROM w JOIN fl ON w.vec_id = fl.vec_id AND w.butter_n = fl.butter_n AND w.low = fl.low),
k AS (SELECT *, (e - b) * least(taper, 0.4) AS wd FROM n),
p AS (SELECT vec_id, id, cmp, ne, nn, nz, b, e, h, rule_weight, list_transform(range({N}), lambda i: CASE WHEN i / {RATE} < b OR i / {RATE} > e THEN 0.0 WHEN i / {RATE} < b + wd THEN 0.5 - 0.5 * cos(pi() * (i / {RATE} - b) / wd)
  WHEN i / {RATE} > e - wd THEN 0.5 - 0.5 * cos(pi() * (e - i / {RATE}) / wd) ELSE 1.0 END) AS w, list_transform(range({N}), lambda i: CASE WHEN i / {RATE} >= 0.5 / low AND i / {RATE} <= noise_end - 0.5 / low THEN 1.0 ELSE 0.0 END) AS quiet,
  {projected("u")}, {projected("v")} FROM k),
s AS (SELECT *, {", ".join(f"list_transform({c}p{d}, lambda x, i: x * w[i]) AS {a}{d}" for c, a in (("u", "ob"), ("v", "s")) for d in "enz")}, {", ".join(f"list_transform(up{d}, lambda x, i: x * quiet[i]) AS q{d}" for d in "enz")} FROM p),
lg AS (SELECT *, {largest("ob")} AS obs_amp, {largest("s")} AS syn_amp, {largest("q")} AS noise_amp, sqrt({dots("ob", "ob")}) AS oo, sqrt({dots("s", "s")}) AS ss, {dots("ob", "s")} AS os, list_transform(range({1 - N}, {N}), lambda k: """ + " + ".join(
    f"list_inner_product(CASE WHEN k >= 0 THEN ob{d}[k + 1:{N}] ELSE ob{d}[1:{N} + k] END, CASE WHEN k >= 0 THEN s{d}[1:{N} - k] ELSE s{d}[1 - k:{N}] END)" for d in "enz") + f""") AS lags FROM s),
fj AS (SELECT vec_id, id, oo, ss, lags, unnest(range(-CAST(floor((e - b) / 2 / 0.1 + 1e-9) AS BIGINT), CAST(floor((e - b) / 2 / 0.1 + 1e-9) AS BIGINT) + 1)) AS j FROM lg),
fc AS (SELECT vec_id, id, j * 0.1::DOUBLE AS tau, list_sum(list_transform(range({1 - N}, {N}), lambda k: lags[k + {N}] * CASE WHEN abs(j / 5.0 - k) < 1e-9 THEN 1.0 WHEN abs(j / 5.0 - k) >= 20 THEN 0.0
  ELSE sin(pi() * (j / 5.0 - k)) / (pi() * (j / 5.0 - k)) * sin(pi() * (j / 5.0 - k) / 20) / (pi() * (j / 5.0 - k) / 20) END)) / (oo * ss) AS cc FROM fj),
best AS (SELECT vec_id, id, arg_max(tau, struct_pack(c := round(cc, 9), t := -tau)) AS cc_shift, max(cc) AS cc_max FROM fc GROUP BY 1, 2),
q AS (SELECT lg.*, cc_shift, cc_max, CASE WHEN noise_amp = 0 THEN 9999.0 ELSE 20 * log10(obs_amp / noise_amp) END AS snr, os / (oo * ss) AS cc0, ss / oo AS ratio FROM lg JOIN best ON lg.vec_id = best.vec_id AND lg.id = best.id),
z AS (SELECT *, rule_weight * ({taper_sql("snr", MEASURE.corners["snr"])}) * ({taper_sql("cc0", MEASURE.corners["cc0"])}) * ({taper_sql("cc_max", MEASURE.corners["cc_max"])}) * ({taper_sql("cc_shift", MEASURE.corners["cc_shift"])}) AS weight FROM q)"""


def with_windows(spark, sf_dir):
    """Pairs of vectors as stations with windows by rule."""
    t = three(spark, sf_dir).select("vec_id", F.col("baz").alias("back_azimuth"), *W.OBSERVED, *W.SYNTHETIC).withColumn("distance", F.col("vec_id") % 40 / 10)
    d, k, f = F.col("distance"), F.col("vec_id"), F.lit
    st = t.select("vec_id", f(10.0).alias("depth"), "distance", "back_azimuth", f(True).alias("horizontals"), f(0.0).alias("first"), f(LAST).alias("last"))
    ar = arrivals_of(st, "vec_id", [arrival("P", 1.5 + d / 2, f(True)), arrival("pP", 2.5 + d / 2, k % 3 != 0), arrival("S", 3 + 0.9 * d, k % 4 != 0)])
    windows = O.gather_windows(O.station_windows(st, ar, SHORT, ["vec_id"]), ["vec_id"])
    rows = t.join(windows, "vec_id", "left").withColumns({"rate": f(RATE), "noise_end": 1.5 + d / 2, "windows": F.coalesce("windows", F.array().cast(windows.schema["windows"].dataType))})
    return rows.drop("back_azimuth", "distance")


def measured(spark, sf_dir):
    return O.measure_window_table(with_windows(spark, sf_dir), MEASURE)


@query(TABLE + """
SELECT vec_id, id, cmp AS component, round(b, 6) AS begin, round(e, 6) AS "end", round(obs_amp, 6) AS obs_amp, round(syn_amp, 6) AS syn_amp, round(noise_amp, 6) AS noise_amp, round(snr, 4) AS snr, round(cc0, 6) AS cc0,
  round(cc0 * ratio, 5) AS ar0, round(cc_shift, 6) AS cc_shift, round(cc_max, 6) AS cc_max, round(cc_max * ratio, 5) AS ar_max, round(weight, 5) AS weight FROM z""")
def measure_window_table(spark, sf_dir):
    """Every window of a table by its own band, span, taper and component."""
    digits = {"snr": 4, "ar0": 5, "ar_max": 5, "weight": 5}
    return O.window_rows(measured(spark, sf_dir)).select("vec_id", "id", "component", *[F.round(c, digits.get(c, 6)).alias(c) for c in ("begin", "end", *W.MEASURES, "weight")])


BACK = ", ".join(f"list_transform(range({N}), lambda i: weight * list_inner_product(dp{d}, list_transform(range({N}), lambda k: h[((i - k) % {SIZE} + {SIZE}) % {SIZE} + 1]))) AS a{d}" for d in "enz")


@query(TABLE + f""", dd AS (SELECT vec_id, weight, h, cmp, ne, nn, nz, {", ".join(f"list_transform(ob{d}, lambda x, i: (x - os / (ss * ss) * s{d}[i]) * w[i] / (oo * ss)) AS d{d}" for d in "enz")} FROM z),
pd AS (SELECT vec_id, weight, h, {projected("d")} FROM dd), bk AS (SELECT vec_id, {BACK} FROM pd),
un AS (SELECT vec_id, unnest(ae) AS e, unnest(an) AS n, unnest(az) AS z, unnest(range({N})) AS i FROM bk), sm AS (SELECT vec_id, i, sum(e) AS e, sum(n) AS n, sum(z) AS z FROM un GROUP BY 1, 2),
ev AS (SELECT vec_id, sqrt(sum(e * e)) AS size_e, sqrt(sum(n * n)) AS size_n, sqrt(sum(z * z)) AS size_z, sum(e * (i + 1) + n - z * i) AS moment FROM sm GROUP BY 1)
SELECT t.vec_id, {", ".join(f"round(coalesce(size_{d}, 0), 6) AS size_{d}" for d in "enz")}, round(coalesce(moment, 0), 5) AS moment FROM t LEFT JOIN ev ON t.vec_id = ev.vec_id""")
def station_adjoint_source(spark, sf_dir):
    """The adjoint source of a station: weighted and filtered back, summed over its windows."""
    a = measured(spark, sf_dir)
    size = lambda c: F.round(F.sqrt(S.inner(F.col(c), F.col(c))), 6)
    zipped = F.arrays_zip("adj_e", "adj_n", "adj_z", F.sequence(F.lit(0), F.lit(N - 1)).alias("i"))
    moment = F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x["adj_e"] * (x["i"] + 1) + x["adj_n"] - x["adj_z"] * x["i"])
    return a.select("vec_id", *[size(f"adj_{c}").alias(f"size_{c}") for c in "enz"], F.round(moment, 5).alias("moment"))


#: Changes of the synthetic by four parameters, each a mixture of the traces: e, n, z of (u, v) as columns and what they are times.
MIXED = [[("vn", 1.0), ("vz", 1.0), ("ve", 1.0)], [("uz", 1.0), ("ue", 1.0), ("un", 1.0)], [("ue", 1.0), ("vn", -2.0), ("uz", 0.5)], [("vz", 0.5), ("un", 1.0), ("vn", 2.0)]]
CHANGED = ", ".join(f"list_transform({t}, lambda x: x * {f}) AS m{i}{d}" for i, mixed in enumerate(MIXED) for d, (t, f) in zip("enz", mixed))
GRAM = ", ".join([f"{dots(f'x{i}', f'x{j}')} AS g{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"{dots('ob', f'x{i}')} AS d{i}" for i in range(4)] + [f"{dots('s', f'x{i}')} AS u{i}" for i in range(4)])
SECOND = ", ".join(f"round((-os / (ss * ss) * g{i}_{j} + (3 * os / (ss * ss) * u{i} * u{j} - u{i} * d{j} - u{j} * d{i}) / (ss * ss)) / (oo * ss), 5) AS h{i}{j}" for i in range(4) for j in range(i, 4))


@query(TABLE.replace("FROM c, hh)", f"FROM c, hh), f2 AS (SELECT vec_id AS v2, butter_n AS b2, {CHANGED} FROM fl)") + f""",
m2 AS (SELECT z.vec_id, z.id, z.w, z.oo, z.ss, z.os, z.cmp, z.ne, z.nn, z.nz, {", ".join(f"z.{a}{d}" for a in ("ob", "s") for d in "enz")}, {", ".join(f"m{i}{d}" for i in range(4) for d in "enz")}
  FROM z JOIN w ON z.vec_id = w.vec_id AND z.id = w.id JOIN f2 ON v2 = z.vec_id AND b2 = w.butter_n),
p2 AS (SELECT *, {", ".join(projected(f"m{i}") for i in range(4))} FROM m2),
x2 AS (SELECT *, {", ".join(f"list_transform(m{i}p{d}, lambda x, i: x * w[i]) AS x{i}{d}" for i in range(4) for d in "enz")} FROM p2),
y2 AS (SELECT vec_id, id, oo, ss, os, {GRAM} FROM x2)
SELECT vec_id, id, {SECOND} FROM y2""")
def source_hessian(spark, sf_dir):
    """Second derivatives of the similarity of every window by four parameters of the source."""
    t = with_windows(spark, sf_dir)
    of = dict(zip(TRACES, (*W.OBSERVED, *W.SYNTHETIC)))
    one = lambda name, factor: F.transform(of[name], lambda x: x * factor)
    t = t.withColumn("derivatives", F.array(*[F.concat(*[one(*m) for m in mixed]) for mixed in MIXED]))
    found = O.window_rows(O.source_hessian(t, MEASURE))
    return found.select("vec_id", "id", *[F.round(F.get("hessian", F.lit(4 * i + j)), 5).alias(f"h{i}{j}") for i in range(4) for j in range(i, 4)])

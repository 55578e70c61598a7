"""Windows made by rules, and their measurement: every window has a band, a span and a taper of its own.

Stations meet the rules and their arrivals without a join of rows: rules are a literal list and the
arrivals of a station one map, so a row yields its windows by itself. The windows of a station travel as one
array beside its traces; these are sent once, whatever the number of windows, and the adjoint
source of a station is summed where its windows are measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signal import band_response
from ..functions.waveform import MEASURES, NO_NOISE, OBSERVED, SYNTHETIC, blocks, component_direction, lanczos_kernel, window_bounds, within_data

#: Phases that tell the first P and the first S.
FIRST_P, FIRST_S = ("p", "P", "Pdiff", "PKIKP"), ("s", "S", "Sdiff", "SKIKS")


@dataclass(frozen=True)
class WindowRule:
    """One kind of window: where it applies (ranges of source depth and distance, both ends included), what it spans
    (see :func:`tracefold.functions.waveform.window_bounds`), and how it is to be measured."""

    id: str
    kind: str
    component: str
    band: tuple[int, float, float]  # order, lowest and highest frequency
    phases: tuple[str, ...] = ()
    depth: tuple[float, float] = (0.0, 1e4)
    distance: tuple[float, float] = (0.0, 180.0)
    twin: tuple[float, float] = (0.0, 0.0)
    swin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    after_s: float = 0.0
    slowness: float = 0.0
    taper: float = 0.2
    weight: float = 1.0

    def literal(self) -> Column:
        f = {
            "id": self.id, "kind": self.kind, "component": self.component, "order": self.band[0], "low": min(self.band[1:]), "high": max(self.band[1:]),
            "depth_from": min(self.depth), "depth_to": max(self.depth), "distance_from": min(self.distance), "distance_to": max(self.distance),
            "twin_from": min(self.twin), "twin_to": max(self.twin), "slow_from": self.swin[0], "slow_to": self.swin[1], "least": self.swin[2],
            "after_s": self.after_s, "slowness": self.slowness, "taper": self.taper, "weight": self.weight,
        }
        own = [F.lit(float(v) if isinstance(v, float) else v).alias(k) for k, v in f.items()]
        return F.struct(*own, F.array(*[F.lit(p) for p in self.phases]).cast("array<string>").alias("phases"))


def arrival_maps(arrivals: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key with the first and last time of each phase: phase -> (first, last).

    Times are taken together before a station's phases are gathered, so a map holds one entry a phase.
    """
    spans = arrivals.filter("time is not null and phase is not null").groupBy(*keys, "phase").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    return spans.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("phase", F.struct("first", "last")))).alias("arrivals"))


def station_windows(stations: DataFrame, arrivals: DataFrame, rules: list[WindowRule], keys: list[str]) -> DataFrame:
    """A row per station and rule that applies: the window's rule, component direction, begin and end.

    ``stations`` has the keys, depth, distance, back_azimuth, horizontals (whether there are any), and the first and
    last time that there are data for; ``arrivals`` keys, phase and time (seconds after the origin). A rule makes no
    window where depth or distance is out of its range, where its phases or the first P or S that it starts from do
    not arrive, where a component but Z is asked of a station without horizontals, for a component or kind not
    known, or where data cover less than half of the span.
    """
    if len({r.id for r in rules}) != len(rules):
        raise ValueError("the rules' ids must differ")
    own = [c for c in stations.columns if c not in ("depth", "distance", "back_azimuth", "horizontals", "first", "last")]
    if not rules:
        raise ValueError("no rules")
    # a source above the surface counts as at the surface
    depth, distance = F.greatest(F.col("depth"), F.lit(0.0)), F.col("distance")
    applies = lambda r: (
        depth.between(r["depth_from"], r["depth_to"]) & distance.between(r["distance_from"], r["distance_to"])
        & (F.col("horizontals") | (r["component"] == "Z")) & r["component"].isin(*"ZRTHF")
    )
    met = stations.join(arrival_maps(arrivals, keys), keys, "left")
    rows = met.withColumn("rule", F.explode(F.filter(F.array(*[r.literal() for r in rules]), applies)))
    rule, spans = F.col("rule"), F.col("arrivals")

    def times(phases: Column, which: str) -> Column:
        found = F.filter(F.transform(phases, lambda p: F.try_element_at(spans, p)[which]), lambda t: t.isNotNull())
        return F.array_min(found) if which == "first" else F.array_max(found)

    first = lambda names: times(F.array(*[F.lit(n) for n in names]), "first")
    bounds = window_bounds(
        rule["kind"], distance, {"body": (times(rule["phases"], "first"), times(rule["phases"], "last")), "P": (first(FIRST_P), None), "S": (first(FIRST_S), None)},
        (rule["twin_from"], rule["twin_to"]), (rule["slow_from"], rule["slow_to"], rule["least"]), rule["after_s"], rule["slowness"],
    )
    rows = rows.withColumns(dict(zip(("_b", "_e"), bounds))).filter(F.col("_b").isNotNull() & F.col("_e").isNotNull())
    # greatest() passes over nulls: a Pwin or Swin that also waits for the other phase needs both
    needs = F.when(rule["kind"] == "Pwin", first(FIRST_S)).otherwise(F.lit(0.0))
    begin, end, enough = within_data(F.col("_b"), F.col("_e"), F.col("first"), F.col("last"))
    azimuth, dip = component_direction(rule["component"], F.col("back_azimuth"))
    return rows.filter(needs.isNotNull() & enough).select(
        *own, rule["id"].alias("id"), rule["kind"].alias("kind"), rule["component"].alias("component"), azimuth.alias("azimuth"), dip.alias("dip"),
        *[rule[c].alias(c) for c in ("order", "low", "high", "taper", "weight")], begin.alias("begin"), end.alias("end"),
    )


#: What a window carries to its measurement (times in seconds from the first sample).
WINDOW = ("component", "azimuth", "dip", "order", "low", "high", "begin", "end", "taper", "weight")


def gather_windows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its windows as an array, in the order of their ids. As many as there are rules at most."""
    fields = ["id", *[c for c in WINDOW if c in windows.columns], *[c for c in windows.columns if c not in (*keys, "id", *WINDOW)]]
    return windows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("windows"))


@dataclass(frozen=True)
class TableRules:
    """What holds for all windows: the step of the search for a time shift (seconds), half width of the interpolation in
    samples, least length that is padded at both ends before filtering (seconds), and the corners of the weights."""

    step: float = 0.1
    lanczos: int = 20
    pad: float = 20.0
    corners: dict = field(default_factory=lambda: {"snr": (10, 15), "cc0": (0.5, 0.7), "cc_max": (0.7, 0.9), "cc_shift": (-10, -8, 8, 10)})
    #: Numbers held at once while windows are measured.
    block: int = 1 << 22


def fast_length(n: int) -> int:
    """The least length from n on whose only prime factors are 2, 3, 5, 7 and 11."""
    while True:
        rest = n
        for p in (2, 3, 5, 7, 11):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def ramps(x: np.ndarray, corners: list) -> np.ndarray:
    """Cosine taper of an array; corners (two: stop, pass; four: stop, pass, pass, stop) are numbers or columns of them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        rise = lambda stop, full: 0.5 - 0.5 * np.cos(np.pi * np.clip((x - stop) / (full - stop), 0, 1))
        if len(corners) == 2:
            return rise(*corners)
        a, b, c, d = corners
        return np.select([(x < a) | (x > d), (x >= b) & (x <= c), x < b], [0.0, 1.0, rise(a, b)], rise(d, c))


class Band:
    """The filter of one band for traces of one rate and length, with the padding around it."""

    def __init__(self, n: int, rate: float, order: int, low: float, high: float, pad: float):
        self.n, self.pad = n, int(max(pad, 2.0 / low) * rate)
        self.size = fast_length(n + 2 * self.pad)
        self.freq = np.fft.rfftfreq(self.size, 1 / rate)
        self.gain = band_response(self.freq, rate, order, low, high)
        self.edges = ramps(np.arange(self.size, dtype=float), [0, self.pad, self.pad + n, self.size - 1])

    def __call__(self, x: np.ndarray, factor: np.ndarray | float = 1.0) -> np.ndarray:
        wide = np.pad(x, ((0, 0), (0, 0), (self.pad, self.size - self.n - self.pad)), mode="edge") * self.edges
        return np.fft.irfft(np.fft.rfft(wide) * self.gain * factor, self.size)[..., self.pad : self.pad + self.n]

    def back(self, x: np.ndarray, factor: np.ndarray | float = 1.0) -> np.ndarray:
        """The adjoint way, of what is zero outside a window."""
        return np.fft.irfft(np.fft.rfft(x, self.size) * self.gain * np.conj(factor), self.size)[..., : self.n]


def shifted_correlation(o: np.ndarray, s: np.ndarray, reach: np.ndarray, rate: float, rules: TableRules) -> tuple[np.ndarray, np.ndarray]:
    """The shift of the synthetic (seconds) with the largest correlation within ``reach`` of each row, and the correlation."""
    n, a = o.shape[2], rules.lanczos
    wide = 1 << int(np.ceil(np.log2(2 * n)))
    full = np.fft.irfft((np.fft.rfft(o, wide) * np.conj(np.fft.rfft(s, wide))).sum(axis=1), wide)
    step = min(rules.step, 1 / rate)
    most = np.floor(reach / step + 1e-9).astype(int)
    fine = np.arange(-most.max(), most.max() + 1)
    u = fine * step * rate
    taps = np.floor(u).astype(int)[:, None] + np.arange(-a + 1, a + 1)
    kernel = np.where(np.abs(taps) < n, lanczos_kernel(u[:, None] - taps, a), 0.0)
    cc = np.zeros((len(o), len(fine)))
    for k in range(2 * a):  # one tap of all shifts at a time
        cc += full[:, taps[:, k] % wide] * kernel[:, k]
    told = np.where(np.abs(fine) <= most[:, None], cc, -np.inf)
    scale = np.maximum(np.abs(cc).max(axis=1), 1e-300)[:, None]
    best = np.argmax(np.round(told / scale, 9), axis=1)
    return fine[best] * step, cc[np.arange(len(cc)), best]


def measured(obs: np.ndarray, syn: np.ndarray, matrix: np.ndarray, span: np.ndarray, noise_end: np.ndarray, low: float, rate: float, rules: TableRules):
    """MEASURES of filtered traces under their windows (begin, end, share of the taper), and what an adjoint source is made of."""
    t = np.arange(obs.shape[2]) / rate
    begin, end, share = span.T[:, :, None]
    width = (end - begin) * np.minimum(share, 0.4)
    window = ramps(t[None, :], [begin, begin + width, end - width, end])[:, None, :]
    o, s = (np.einsum("rij,rjt->rit", matrix, x) * window for x in (obs, syn))
    edge = 0.5 / low
    quiet = (t >= edge) & (t <= noise_end[:, None] - edge)
    noise = np.einsum("rij,rjt->rit", matrix, obs) * quiet[:, None, :]
    amplitude = lambda x: np.sqrt((x * x).sum(axis=1).max(axis=1))
    size = lambda x: np.sqrt((x * x).sum(axis=(1, 2)))
    amp, own, before = amplitude(o), amplitude(s), amplitude(noise)
    with np.errstate(divide="ignore", invalid="ignore"):
        snr = np.where(amp == 0, np.nan, np.where(before == 0, NO_NOISE, 20 * np.log10(amp / before)))
        both, ratio = size(o) * size(s), size(s) / size(o)
        both = np.where(both == 0, np.nan, both)
        cc0 = (o * s).sum(axis=(1, 2)) / both
        shift, top = shifted_correlation(o, s, (end - begin)[:, 0] / 2, rate, rules)
        top = top / both
        change = (o - (cc0 / ratio)[:, None, None] * s) * window / both[:, None, None]
    shift = np.where(np.isnan(both), np.nan, shift)
    return np.stack([amp, own, before, snr, cc0, cc0 * ratio, shift, top, top * ratio], axis=1), np.einsum("rji,rjt->rit", matrix, change)


def directions(component: np.ndarray, azimuth: np.ndarray, dip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projections (rows x 3 x 3) and which components are known. As :func:`tracefold.functions.waveform.projection`."""
    az, d = np.radians(azimuth), np.radians(dip)
    n = np.stack([np.cos(d) * np.sin(az), np.cos(d) * np.cos(az), -np.sin(d)], axis=1)
    out = n[:, :, None] * n[:, None, :]
    out[component == "H"], out[component == "F"] = np.diag([1.0, 1.0, 0.0]), np.eye(3)
    return out, np.isin(component, list("ZRTHF"))


def measure_window_table(df: DataFrame, rules: TableRules = TableRules()) -> DataFrame:
    """Every station with its measured windows and its adjoint source (adj_e, adj_n, adj_z); traces are left behind.

    ``df`` has obs_e, obs_n, obs_z and syn_e, syn_n, syn_z (arrays of one length), rate (Hz), noise_end (where the
    noise before the first arrival ends, seconds from the first sample) and windows (see :func:`gather_windows`).
    Optional: derive (the synthetic is displacement and the observation velocity), tau (the synthetic is to be convolved with a Gaussian source of
    that duration), pre (array of (order, low, high) of bands that both traces already went through).
    Each window is filtered by its band, projected, cut by its span, and compared; its weight becomes the product of
    its own and the tapers of the corners. The adjoint source is the sum over valid windows of weight times the
    change of CC0 with the synthetic, taken back through projection, band, earlier bands and derivative.

    Cases: traces of zeros, a component that is not known or a null in a window give null measures, weight 0 and valid false. A
    station without windows keeps an empty array and an adjoint source of zeros. Traces that are null or of several
    lengths give null measures and no adjoint source. Without samples of noise SNR is that of no noise.
    """
    optional = {"derive": F.lit(False), "tau": F.lit(None).cast("double"), "pre": F.lit(None).cast("array<struct<order:int,low:double,high:double>>")}
    df = df.withColumns({c: v for c, v in optional.items() if c not in df.columns})
    inner = [f.name for f in df.schema["windows"].dataType.elementType.fields]
    others = [c for c in df.columns if c not in (*OBSERVED, *SYNTHETIC, "rate", "noise_end", "windows", *optional)]
    told = [*inner, *[m for m in MEASURES if m not in inner], "valid"]
    cast = {"order": "int", **{c: "double" for c in ("azimuth", "dip", "low", "high", "begin", "end", "taper", "weight")}}
    window = lambda w: F.struct(*[(w[c].cast(cast[c]) if c in cast else w[c]).alias(c) for c in inner])
    rows = df.select(
        *others, *[F.col(c).cast("array<double>").alias(c) for c in (*OBSERVED, *SYNTHETIC)], F.col("rate").cast("double").alias("rate"),
        F.col("noise_end").cast("double").alias("noise_end"), F.transform("windows", window).alias("windows"), *optional,
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["windows"].dataType.elementType.fields} | {m: "double" for m in MEASURES} | {"valid": "boolean"}
    result = f"array<struct<{','.join(f'`{c}`:{kinds[c]}' for c in told)}>>"
    schema = ", ".join([*[f"`{n}` {t}" for n, t in rows.select(*others).dtypes], f"windows {result}", *[f"adj_{c} array<double>" for c in "enz"]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("windows")
            of, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
            out, weight, adjoint = measure_batch(batch, of, flat, rules)
            fields = {c: flat.field(c) for c in inner} | {m: pa.array(out[:, i], mask=np.isnan(out[:, i])) for i, m in enumerate(MEASURES)}
            valid = ~np.isnan(out[:, MEASURES.index("cc0")])
            fields |= {"weight": pa.array(np.where(valid, weight, 0.0)), "valid": pa.array(valid)}
            ends = np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0))))
            many = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([fields[c] for c in told], names=told))
            traces = [pa.array([None if a is None else a[i] for a in adjoint], pa.list_(pa.float64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], many, *traces], names=[*others, "windows", "adj_e", "adj_n", "adj_z"])

    return rows.mapInArrow(work, schema)


def measure_batch(batch: pa.RecordBatch, of: np.ndarray, flat: pa.StructArray, rules: TableRules):
    """Measures and weights of all windows of a batch (``of``: their rows), and the adjoint source of every row.

    Windows of one length, rate and band are filtered and measured together, in blocks of bounded size.
    """
    number = lambda c: np.asarray(flat.field(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), float)
    column = lambda c: np.asarray(batch.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), float)
    component = np.array(flat.field("component").to_pylist(), object)
    matrix, known = directions(component, number("azimuth"), number("dip"))
    span = np.stack([number("begin"), number("end"), number("taper")], axis=1)
    weight, bands = number("weight").copy(), np.stack([number("order"), number("low"), number("high")], axis=1)
    rate, noise_end, tau = column("rate"), column("noise_end"), column("tau")
    derive = np.asarray(batch.column("derive").fill_null(False))
    pre = [tuple((p["order"], p["low"], p["high"]) for p in x or ()) for x in batch.column("pre").to_pylist()]
    usable = known & np.isfinite(span).all(axis=1) & np.isfinite(bands).all(axis=1) & (bands[:, 1] > 0) & np.isfinite(weight) & np.isfinite(rate)[of]
    out = np.full((len(of), len(MEASURES)), np.nan)
    adjoint: list = [None] * batch.num_rows
    for rows, traces in blocks(batch, [*OBSERVED, *SYNTHETIC]):
        n = traces.shape[2]
        at = np.full(batch.num_rows, -1)
        at[rows] = np.arange(len(rows))
        for r in rows:
            adjoint[r] = np.zeros((3, n))
        here = np.flatnonzero(usable & (at[of] >= 0))
        groups, which = np.unique(np.column_stack([rate[of[here]], bands[here]]), axis=0, return_inverse=True)
        for g, (hz, order, low, high) in enumerate(groups.tolist()):
            band = Band(n, hz, int(order), low, high, rules.pad)
            mine = here[which == g]
            few = max(1, rules.block // (12 * band.size))
            for start in range(0, len(mine), few):
                some = mine[start : start + few]
                stations, place = np.unique(of[some], return_inverse=True)
                obs, syn = traces[at[stations], :3], traces[at[stations], 3:]
                slope = np.where(derive[stations, None], 2j * np.pi * band.freq, 1.0)[:, None, :]
                with np.errstate(invalid="ignore"):
                    source = np.where(np.isnan(tau[stations])[:, None], 1.0, np.exp(-((np.pi * band.freq * tau[stations, None]) ** 2)))[:, None, :]
                obs, syn = band(obs), band(syn, slope * source)
                found, change = measured(obs[place], syn[place], matrix[some], span[some], noise_end[of[some]], low, hz, rules)
                out[some] = found
                for name, corners in rules.corners.items():
                    weight[some] *= ramps(found[:, MEASURES.index(name)], list(corners))
                earlier = np.stack([np.prod([band_response(band.freq, hz, *p) for p in pre[s]], axis=0) * np.ones(len(band.freq)) for s in stations])[:, None, :]
                good = np.isfinite(change).all(axis=(1, 2)) & np.isfinite(weight[some])
                back = band.back(change[good], (earlier * slope)[place[good]]) * weight[some][good][:, None, None]
                for r, one in zip(of[some][good], back):
                    adjoint[r] += one
    return out, weight, adjoint


def window_rows(measured_stations: DataFrame) -> DataFrame:
    """A row per measured window, with the station's other columns."""
    own = [c for c in measured_stations.columns if c not in ("windows", "adj_e", "adj_n", "adj_z")]
    return measured_stations.select(*own, F.explode("windows").alias("_w")).select(*own, "_w.*")


def source_hessian(df: DataFrame, rules: TableRules = TableRules(), source_terms: bool = False) -> DataFrame:
    """Second derivatives of each window's CC0 by the parameters of the source, to first order in the traces.

    ``df`` as for :func:`measure_window_table`, with derivatives: an array with, for every parameter, the change of the
    synthetic (east, north and up in one array of three lengths). ``source_terms`` adds origin time and duration
    (``tau`` must be given), whose changes follow from the synthetic. Each window gets hessian, an array of k x k numbers by rows. All
    products of a window's traces come of one matrix product.

    Cases: as for measuring; a window without a finite result, or whose parameters are not all there, gets null.
    """
    df = df.withColumns({c: v for c, v in (("derive", F.lit(False)), ("tau", F.lit(None).cast("double"))) if c not in df.columns})
    inner = [f.name for f in df.schema["windows"].dataType.elementType.fields]
    others = [c for c in df.columns if c not in (*OBSERVED, *SYNTHETIC, "rate", "windows", "derivatives", "derive", "tau", "noise_end", "pre")]
    rows = df.select(
        *others, *[F.col(c).cast("array<double>").alias(c) for c in (*OBSERVED, *SYNTHETIC)], F.flatten("derivatives").cast("array<double>").alias("derivatives"),
        F.col("rate").cast("double").alias("rate"), "windows", "derive", F.col("tau").cast("double").alias("tau"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["windows"].dataType.elementType.fields} | {"hessian": "array<double>"}
    schema = ", ".join([*[f"`{n}` {t}" for n, t in rows.select(*others).dtypes], f"windows array<struct<{','.join(f'`{c}`:{t}' for c, t in kinds.items())}>>"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("windows")
            of, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
            found = hessian_batch(batch, of, flat, rules, source_terms)
            ends = np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0))))
            fields = [*[flat.field(c) for c in inner], pa.array(found, pa.list_(pa.float64()))]
            many = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=[*inner, "hessian"]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], many], names=[*others, "windows"])

    return rows.mapInArrow(work, schema)


def hessian_batch(batch: pa.RecordBatch, of: np.ndarray, flat: pa.StructArray, rules: TableRules, source_terms: bool) -> list:
    number = lambda c: np.asarray(flat.field(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), float)
    column = lambda c: np.asarray(batch.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), float)
    matrix, known = directions(np.array(flat.field("component").to_pylist(), object), number("azimuth"), number("dip"))
    span = np.stack([number("begin"), number("end"), number("taper")], axis=1)
    bands = np.stack([number("order"), number("low"), number("high")], axis=1)
    rate, tau, derive = column("rate"), column("tau"), np.asarray(batch.column("derive").fill_null(False))
    sizes = np.asarray(batch.column("derivatives").value_lengths().fill_null(-1))
    usable = known & np.isfinite(span).all(axis=1) & np.isfinite(bands).all(axis=1) & (bands[:, 1] > 0) & np.isfinite(rate)[of]
    out: list = [None] * len(of)
    for rows, traces in blocks(batch, [*OBSERVED, *SYNTHETIC]):
        n = traces.shape[2]
        at = np.full(batch.num_rows, -1)
        at[rows] = np.arange(len(rows))
        here = np.flatnonzero(usable & (at[of] >= 0) & (sizes[of] >= 0) & (sizes[of] % (3 * n) == 0))
        groups, which = np.unique(np.column_stack([rate[of[here]], sizes[of[here]], bands[here]]), axis=0, return_inverse=True)
        for g, (hz, size, order, low, high) in enumerate(groups.tolist()):
            k = int(size) // (3 * n)
            band = Band(n, hz, int(order), low, high, rules.pad)
            mine = here[which == g]
            few = max(1, rules.block // (12 * band.size * (k + 3)))
            for start in range(0, len(mine), few):
                some = mine[start : start + few]
                stations, place = np.unique(of[some], return_inverse=True)
                slope = np.where(derive[stations, None], 2j * np.pi * band.freq, 1.0)[:, None, :]
                w = np.pi * band.freq
                with np.errstate(invalid="ignore"):
                    source = np.where(np.isnan(tau[stations])[:, None], 1.0, np.exp(-((w * tau[stations, None]) ** 2)))[:, None, :]
                changes = batch.column("derivatives").take(pa.array(stations)).flatten().to_numpy(zero_copy_only=False).reshape(len(stations), k, 3, n)
                syn = traces[at[stations], 3:]
                made = [band(traces[at[stations], :3]), band(syn, slope * source), *[band(changes[:, i], slope) for i in range(k)]]
                if source_terms:
                    by_tau = -2 * w * w * tau[stations, None]
                    made += [band(syn, slope * source * f) for f in ((-2j * w)[None, None, :], by_tau[:, None, :])]
                t = np.arange(n) / hz
                begin, end, share = span[some].T[:, :, None]
                width = (end - begin) * np.minimum(share, 0.4)
                window = ramps(t[None, :], [begin, begin + width, end - width, end])[:, None, :]
                cut = np.stack([(np.einsum("rij,rjt->rit", matrix[some], m[place]) * window).reshape(len(some), -1) for m in made], axis=1)
                gram = cut @ cut.transpose(0, 2, 1)  # 0: observed, 1: synthetic, then the parameters
                dd, uu, du, d, u = gram[:, 0, 0], gram[:, 1, 1], gram[:, 0, 1], gram[:, 0, 2:], gram[:, 1, 2:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    a = (du / uu)[:, None, None]
                    cross = u[:, :, None] * d[:, None, :]
                    h = (-a * gram[:, 2:, 2:] + (3 * a * u[:, :, None] * u[:, None, :] - cross - cross.transpose(0, 2, 1)) / uu[:, None, None]) / np.sqrt(dd * uu)[:, None, None]
                for i, one in zip(some, h):
                    if np.isfinite(one).all():
                        out[i] = one.ravel()
    return out

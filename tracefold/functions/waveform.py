"""Three-component traces: rotation, projection, windows, measures and adjoint sources.

A batch of rows is a block of arrays; rows of equal length are measured together with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tapers import cosine_taper

#: Value of a signal-to-noise ratio without noise.
NO_NOISE = 9999.0


def polarisation(azimuth: Column, dip: Column) -> Column:
    """The unit vector (east, north, up) in which a channel looks; degrees, dip down from the horizontal."""
    az, d = F.radians(azimuth), F.radians(dip)
    return F.array(F.cos(d) * F.sin(az), F.cos(d) * F.cos(az), -F.sin(d))


def rotate_to_enz(directions: list[Column], traces: list[Column]) -> list[Column]:
    """East, north and up traces of three channels that look in any three independent directions.

    The channels see P·x; x is the inverse of P (by cofactors) times what they see.
    """
    p = [[F.get(d, F.lit(i)) for i in range(3)] for d in directions]
    cof = [[p[(i + 1) % 3][(j + 1) % 3] * p[(i + 2) % 3][(j + 2) % 3] - p[(i + 1) % 3][(j + 2) % 3] * p[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    det = sum(p[0][j] * cof[0][j] for j in range(3))
    zipped = F.arrays_zip(*[t.alias(f"c{i}") for i, t in enumerate(traces)])

    def part(j: int) -> Column:
        return F.transform(zipped, lambda x: sum(x[f"c{i}"] * cof[i][j] / det for i in range(3)))

    return [part(j) for j in range(3)]


def projection(component: Column, azimuth: Column, dip: Column) -> Column:
    """The nine numbers (by rows) that project east, north, up: onto a direction (Z, R, T), the horizontal (H) or nothing (F).

    Null for a component that is not known.
    """
    n = polarisation(azimuth, dip)
    onto = F.array(*[F.get(n, F.lit(i)) * F.get(n, F.lit(j)) for i in range(3) for j in range(3)])
    fixed = lambda *d: F.array(*[F.lit(float(d[i] if i == j else 0)) for i in range(3) for j in range(3)])
    return F.when(component.isin("Z", "R", "T"), onto).when(component == "H", fixed(1, 1, 0)).when(component == "F", fixed(1, 1, 1))


def component_direction(component: Column, back_azimuth: Column) -> tuple[Column, Column]:
    """Azimuth and dip of a window's component; NaN where it has none."""
    none = F.lit(float("nan"))
    azimuth = F.when(component == "R", F.pmod(back_azimuth + 180, F.lit(360.0))).when(component == "T", F.pmod(back_azimuth - 90, F.lit(360.0))).when(component == "Z", 0.0)
    dip = F.when(component == "Z", -90.0).when(component.isin("R", "T", "H"), 0.0)
    return azimuth.otherwise(none), dip.otherwise(none)


def window_bounds(kind: Column, distance: Column, arrivals: dict[str, tuple[Column, Column]], twin: tuple[Column, Column], swin: tuple[Column, Column, Column], after_s: Column, slowness: Column) -> tuple[Column, Column]:
    """Begin and end (seconds after the origin) of a window by its type; null for a type that is not known or without arrivals.

    ``arrivals``: first and last time of the window's own phases (``body``) and the first of P and S
    (``P``, ``S``; their second entry is not used). ``swin``: least and largest slowness and the
    least length, to which a surface window is padded on both sides.
    """
    (b0, b1), p, s = arrivals["body"], arrivals["P"][0], arrivals["S"][0]
    low, high = twin
    slow, fast_end, least = swin[0] * distance, swin[1] * distance, swin[2]
    pad = F.greatest(F.lit(0.0), (least - (fast_end - slow)) / 2)
    begin = F.when(kind == "body", b0 + low).when(kind.isin("Pwin", "full"), p + low).when(kind == "Swin", s + low).when(kind == "surf", slow - pad)
    end = (
        F.when(kind == "body", b1 + high).when(kind == "Pwin", F.greatest(p + high, s + after_s)).when(kind == "Swin", F.greatest(s + high, distance * slowness))
        .when(kind == "surf", fast_end + pad).when(kind == "full", F.greatest(p + high, distance * slowness))
    )
    return begin, end


def within_data(begin: Column, end: Column, first: Column, last: Column) -> tuple[Column, Column, Column]:
    """The part of a window that there are data for, and whether that is half of it at least."""
    b, e = F.greatest(begin, first), F.least(end, last)
    return b, e, (e - b) >= (end - begin) / 2


def taper_over(n: int, rate: float, corners: tuple[float, float, float, float]) -> np.ndarray:
    """A window over sample times: 0 outside the outer corners (seconds), 1 inside the inner ones, half cosines between."""
    t = np.arange(n) / rate
    a, b, c, d = corners
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = 0.5 - 0.5 * np.cos(np.pi * (t - a) / (b - a)), 0.5 - 0.5 * np.cos(np.pi * (d - t) / (d - c))
    return np.select([(t < a) | (t > d), (t >= b) & (t <= c), t < b], [0.0, 1.0, up], down)


@dataclass(frozen=True)
class MeasureRules:
    """Sampling (Hz), the signal window and the noise before it (seconds from the first sample), the
    share of the window that each taper takes (0.4 at most), the search for a time shift (largest
    shift, step and half width of the interpolation in samples), and the corners of the weights."""

    rate: float = 2.0
    signal: tuple[float, float] = (2.0, 9.5)
    noise: tuple[float, float] = (0.0, 1.75)
    taper: float = 0.2
    largest_shift: float = 2.0
    step: float = 0.125
    lanczos: int = 20
    snr: tuple[float, ...] = (10, 15)
    cc0: tuple[float, ...] = (0.5, 0.7)
    cc_max: tuple[float, ...] = (0.7, 0.9)
    shift: tuple[float, ...] = (-10, -8, 8, 10)

    def window(self, n: int) -> np.ndarray:
        begin, end = self.signal
        width = (end - begin) * min(self.taper, 0.4)
        return taper_over(n, self.rate, (begin, begin + width, end - width, end))

    def samples(self, span: tuple[float, float]) -> slice:
        return slice(int(np.ceil(span[0] * self.rate)), int(np.floor(span[1] * self.rate)) + 1)


def lanczos_kernel(u: np.ndarray, width: int) -> np.ndarray:
    return np.sinc(u) * np.sinc(u / width) * (np.abs(u) < width)


def blocks(batch: pa.RecordBatch, traces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, traces of shape rows x len(traces) x samples) for every length of trace in a batch.

    Rows with a null trace, or traces of several lengths, are in none.
    """
    columns = [batch.column(t) for t in traces]
    sizes = np.stack([np.asarray(c.value_lengths().fill_null(-1)) for c in columns])
    alike = (sizes == sizes[0]).all(axis=0) & (sizes[0] > 0)
    for n in np.unique(sizes[0][alike]):
        rows = np.flatnonzero(alike & (sizes[0] == n))
        take = pa.array(rows)
        yield rows, np.stack([c.take(take).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), n) for c in columns], axis=1)


OBSERVED, SYNTHETIC = ["obs_e", "obs_n", "obs_z"], ["syn_e", "syn_n", "syn_z"]
MEASURES = ("obs_amp", "syn_amp", "noise_amp", "snr", "cc0", "ar0", "cc_shift", "cc_max", "ar_max")


def windowed(x: np.ndarray, matrix: np.ndarray, window: np.ndarray) -> np.ndarray:
    return np.einsum("rij,rjt->rit", matrix, x) * window


def measured(obs: np.ndarray, syn: np.ndarray, matrix: np.ndarray, rules: MeasureRules) -> np.ndarray:
    """A row of MEASURES for every row of traces (rows x 3 x samples); NaN where a trace is all zero."""
    n = obs.shape[2]
    o, s = windowed(obs, matrix, rules.window(n)), windowed(syn, matrix, rules.window(n))
    noise = np.einsum("rij,rjt->rit", matrix, obs)[:, :, rules.samples(rules.noise)]
    amplitude = lambda x: np.sqrt((x * x).sum(axis=1).max(axis=1))
    size = lambda x: np.sqrt((x * x).sum(axis=(1, 2)))
    amp, own, before = amplitude(o), amplitude(s), amplitude(noise)
    with np.errstate(divide="ignore", invalid="ignore"):
        snr = np.where(amp == 0, np.nan, np.where(before == 0, NO_NOISE, 20 * np.log10(amp / before)))
        both, ratio = size(o) * size(s), size(s) / size(o)
        cc0 = (o * s).sum(axis=(1, 2)) / both
        # correlation at all whole lags, summed over the components, then between the samples
        wide = 1 << int(np.ceil(np.log2(2 * n)))
        full = np.fft.irfft((np.fft.rfft(o, wide) * np.conj(np.fft.rfft(s, wide))).sum(axis=1), wide)
        lags = np.arange(-n + 1, n)
        step = min(rules.step, 1 / rules.rate)
        fine = np.arange(-round(rules.largest_shift / step), round(rules.largest_shift / step) + 1) * step
        cc = full[:, lags % wide] @ lanczos_kernel(fine[None, :] * rules.rate - lags[:, None], rules.lanczos) / both[:, None]
    best = np.argmax(np.round(np.nan_to_num(cc, nan=-9.0), 9), axis=1)
    shift, top = fine[best], cc[np.arange(len(cc)), best]
    shift = np.where(np.isnan(top), np.nan, shift)
    return np.stack([amp, own, before, snr, cc0, cc0 * ratio, shift, top, top * ratio], axis=1)


def measure_windows(df: DataFrame, rules: MeasureRules = MeasureRules(), matrix: str = "matrix", weight: str = "weight") -> DataFrame:
    """``df`` with the MEASURES of its window and its weight times the tapers of SNR, CC0, largest CC and shift.

    Columns wanted: obs_e, obs_n, obs_z and syn_e, syn_n, syn_z (arrays of one rate and length), the
    projection and the base weight. A trace that is all zero gives null measures and weight 0; the
    traces themselves are left behind.
    """
    others = [c for c in df.columns if c not in [*OBSERVED, *SYNTHETIC, matrix]]
    rows = df.select(*[F.col(c) for c in others], *[F.col(c).cast("array<double>").alias(c) for c in [*OBSERVED, *SYNTHETIC, matrix]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, len(MEASURES)), np.nan)
            flat = batch.column(matrix)
            for at, traces in blocks(batch, [*OBSERVED, *SYNTHETIC]):
                ok = np.asarray(flat.take(pa.array(at)).value_lengths().fill_null(0)) == 9
                at, traces = at[ok], traces[ok]
                if len(at):
                    p = flat.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
                    out[at] = measured(traces[:, :3], traces[:, 3:], p, rules)
            measures = [pa.array(out[:, i], mask=np.isnan(out[:, i])) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *measures], names=[*others, *MEASURES])

    schema = [f"`{n}` {t}" for n, t in rows.select(*others).dtypes] + [f"{m} double" for m in MEASURES]
    told = rows.mapInArrow(work, ", ".join(schema))
    product = F.col(weight)
    for name, corners in (("snr", rules.snr), ("cc0", rules.cc0), ("cc_max", rules.cc_max), ("cc_shift", rules.shift)):
        product = product * cosine_taper(F.col(name), list(corners))
    return told.withColumn("valid", F.col("cc0").isNotNull()).withColumn(weight, F.coalesce(product, F.lit(0.0)))


def adjoint_source(df: DataFrame, rules: MeasureRules = MeasureRules(), matrix: str = "matrix") -> DataFrame:
    """``df`` with adj_e, adj_n, adj_z in place of the traces: how CC0 changes with each sample of the synthetic.

    Transposed projection of window times (observed - A synthetic) over both norms, where A makes the
    synthetic as like the observation as it can be. A synthetic or observation of zeros gives null.
    """
    others = [c for c in df.columns if c not in [*OBSERVED, *SYNTHETIC, matrix]]
    rows = df.select(*[F.col(c) for c in others], *[F.col(c).cast("array<double>").alias(c) for c in [*OBSERVED, *SYNTHETIC, matrix]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[None] * batch.num_rows for _ in range(3)]
            for at, traces in blocks(batch, [*OBSERVED, *SYNTHETIC]):
                p = batch.column(matrix).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
                window = rules.window(traces.shape[2])
                o, s = windowed(traces[:, :3], p, window), windowed(traces[:, 3:], p, window)
                oo, ss, os_ = ((a * b).sum(axis=(1, 2)) for a, b in ((o, o), (s, s), (o, s)))
                with np.errstate(divide="ignore", invalid="ignore"):
                    change = (o - (os_ / ss)[:, None, None] * s) * window / np.sqrt(oo * ss)[:, None, None]
                back = np.einsum("rji,rjt->rit", p, change)
                for k, row in zip(at.tolist(), back):
                    if np.isfinite(row).all():
                        for c in range(3):
                            found[c][k] = row[c]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array(f, pa.list_(pa.float64())) for f in found]], names=[*others, "adj_e", "adj_n", "adj_z"])

    schema = [f"`{n}` {t}" for n, t in rows.select(*others).dtypes] + [f"adj_{c} array<double>" for c in "enz"]
    return rows.mapInArrow(work, ", ".join(schema))


def response_corrected(traces: Column, rate: float, response: np.ndarray, freqs: np.ndarray, low: float, high: float, order: int = 4) -> Column:
    """Traces with an instrument's response taken out: its spectrum (tabulated, complex) is divided
    out where it is not zero, under the magnitudes of a high-pass and an anti-alias low-pass; no mean is left."""
    from .signal import band_response

    @F.pandas_udf("array<double>")
    def corrected(column):
        def one(t):
            x = np.asarray(t, float)
            n = 1 << int(np.ceil(np.log2(2 * len(x))))
            f = np.fft.rfftfreq(n, 1 / rate)
            h = np.interp(f, freqs, response.real) + 1j * np.interp(f, freqs, response.imag)
            spectrum = np.fft.rfft(x - x.mean(), n) * band_response(f, rate, order, low, None) * band_response(f, rate, order, None, high)
            spectrum = np.divide(spectrum, h, out=np.zeros_like(spectrum), where=h != 0)
            spectrum[0] = 0
            return np.fft.irfft(spectrum, n)[: len(x)]

        return column.map(one, na_action="ignore")

    return corrected(traces)


def source_spectrum(freq: Column, tau: Column, t0: Column) -> dict[str, Column]:
    """Amplitude of a Gaussian source of duration ``tau`` at a frequency, its phase when it is ``t0`` late, and
    the factors by which a change of tau (real) and of t0 (imaginary) acts on it."""
    w = F.lit(np.pi) * freq
    return {"amplitude": F.exp(-w * w * tau * tau), "phase": -2 * w * t0, "by_tau": -2 * w * w * tau, "by_t0": -2 * w}

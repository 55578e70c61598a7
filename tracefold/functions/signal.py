"""Traces as arrays: similarity and amplitudes in Catalyst, spectra in Arrow batches of numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def zero_lag_cc(observed: Column, synthetic: Column) -> Column:
    return F.try_divide(dot(observed, synthetic), norm(observed) * norm(synthetic))


def amplitude_ratio(observed: Column, synthetic: Column) -> Column:
    """Of the synthetic part that is like the observation, to the observation."""
    return zero_lag_cc(observed, synthetic) * F.try_divide(norm(synthetic), norm(observed))


def largest_amplitude(trace: Column) -> Column:
    return F.array_max(F.transform(trace, lambda x: F.abs(x.cast("double"))))


def snr_db(signal: Column, noise: Column) -> Column:
    """20 log10 of largest amplitudes; 9999 without noise, null without signal."""
    s, n = largest_amplitude(signal), largest_amplitude(noise)
    return F.when(s == 0, F.lit(None).cast("double")).when(n == 0, 9999.0).otherwise(20 * F.log10(s / n))


def slice_by_time(trace: Column, start: Column, rate: Column, t0: Column, t1: Column) -> Column:
    """Samples from t0 to before t1 (seconds); places truncate toward zero and are clamped."""
    place = lambda t: F.greatest(F.lit(0), F.least(F.size(trace), ((t - start) * rate).cast("int")))
    return F.slice(trace, place(t0) + 1, F.greatest(F.lit(0), place(t1) - place(t0)))


def lagged_cc(observed: Column, synthetic: Column, lag: int) -> Column:
    """CC with the synthetic moved ``lag`` samples later; samples without a partner count as zero."""
    n = F.size(observed) - abs(lag)
    a, b = (F.slice(observed, lag + 1, n), F.slice(synthetic, 1, n)) if lag >= 0 else (F.slice(observed, 1, n), F.slice(synthetic, 1 - lag, n))
    return F.try_divide(dot(a, b), norm(observed) * norm(synthetic))


def band_response(freq: np.ndarray, rate: float, order: int, low: float | None, high: float | None) -> np.ndarray:
    """Magnitude of a digital Butterworth filter (bilinear): band, high-pass or low-pass."""
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.tan(np.pi * np.minimum(freq, rate / 2) / rate)
        edge = lambda f: np.tan(np.pi * f / rate)
        if low is not None and high is not None:
            x = (w * w - edge(low) * edge(high)) / (w * (edge(high) - edge(low)))
        elif low is not None:
            x = edge(low) / w
        else:
            x = w / edge(high)
        return np.nan_to_num(1 / np.sqrt(1 + x ** (2 * order)), nan=0.0)


def zero_phase_filter(rate: float, order: int, low: float | None, high: float | None, pad: int = 0):
    """A vectorised function of trace arrays: multiply the spectrum by the magnitude only.

    Traces of equal length are filtered as one matrix. ``pad`` repeats the end samples.
    """

    @F.pandas_udf("array<double>")
    def filtered(traces: pd.Series) -> pd.Series:
        out = [None] * len(traces)
        lengths = np.array([-1 if t is None else len(t) for t in traces])
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            x = np.pad(np.stack([np.asarray(traces.iloc[i], float) for i in at]), ((0, 0), (pad, pad)), mode="edge")
            h = band_response(np.fft.rfftfreq(x.shape[1], 1 / rate), rate, order, low, high)
            y = np.fft.irfft(np.fft.rfft(x, axis=1) * h, x.shape[1], axis=1)[:, pad : pad + n]
            for i, row in zip(at, y):
                out[i] = row
        return pd.Series(out)

    return filtered


def impulse_response(n: int, rate: float, order: int, low: float | None, high: float | None) -> np.ndarray:
    """What :func:`zero_phase_filter` makes of a single one in ``n`` samples."""
    return np.fft.irfft(band_response(np.fft.rfftfreq(n, 1 / rate), rate, order, low, high), n)


#: Samples of a matrix of traces; what is made of them (spectra, fine lags) is some dozen times as large.
SAMPLES = 1 << 16


def stacked(*columns: pd.Series):
    """(rows, a matrix for every column) for each length that all traces of a row share, ``SAMPLES`` at a time."""
    sizes = np.array([[-1 if t is None else len(t) for t in c] for c in columns])
    alike = (sizes == sizes[0]).all(axis=0) & (sizes[0] > 0)
    for n in np.unique(sizes[0][alike]):
        rows, few = np.flatnonzero(alike & (sizes[0] == n)), max(1, SAMPLES // int(n))
        for first in range(0, len(rows), few):
            at = rows[first : first + few]
            yield at, *[np.stack(c.iloc[at].to_numpy()).astype(float) for c in columns]


def correlations(a: np.ndarray, b: np.ndarray, fine: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of rows over their sizes at lags of 1/fine samples (spectral interpolation), and the lags in order."""
    n = 1 << int(np.ceil(np.log2(2 * a.shape[1])))
    with np.errstate(divide="ignore", invalid="ignore"):
        size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))[:, None]
        spectrum = np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n))
        if fine > 1:
            spectrum[:, -1] /= 2  # the highest frequency stands for two between the samples
        full = np.fft.irfft(spectrum, n * fine) * fine / size
    return np.roll(full, n * fine // 2, axis=1), (np.arange(n * fine) - n * fine // 2) / fine


def cc_lag_search(rate: float, max_lag: float, fine: int = 8):
    """Best lag (seconds) and CC of two traces of one length: full correlation by FFT, refined by zero-padding its
    spectrum. Of equal ones the first lag. Null for traces of zeros or of different lengths."""

    @F.pandas_udf("struct<lag: double, cc: double>")
    def best(observed: pd.Series, synthetic: pd.Series) -> pd.DataFrame:
        out = np.full((len(observed), 2), np.nan)
        for at, a, b in stacked(observed, synthetic):
            cc, lags = correlations(a, b, fine)
            near = np.flatnonzero(np.abs(lags) <= max_lag * rate)
            k = near[np.argmax(np.round(np.nan_to_num(cc[:, near], nan=-9.0), 9), axis=1)]
            top = cc[np.arange(len(at)), k]
            out[at] = np.stack([np.where(np.isnan(top), np.nan, lags[k] / rate), top], axis=1)
        return pd.DataFrame(out, columns=["lag", "cc"])

    return best


def best_lag(most: int):
    """Best whole lag in samples and its CC; of equal ones the last lag."""

    @F.pandas_udf("struct<lag: int, cc: double>")
    def best(observed: pd.Series, synthetic: pd.Series) -> pd.DataFrame:
        lag, top = np.zeros(len(observed), np.int32), np.full(len(observed), np.nan)
        for at, a, b in stacked(observed, synthetic):
            cc, lags = correlations(a, b)
            near = np.flatnonzero(np.abs(lags) <= most)[::-1]
            k = near[np.argmax(np.nan_to_num(cc[:, near], nan=-9.0), axis=1)]
            lag[at], top[at] = lags[k], cc[np.arange(len(at)), k]
        missing = np.isnan(top)
        return pd.DataFrame({"lag": pd.array(np.where(missing, 0, lag), dtype="Int32").astype(object).where(~missing, None) if missing.any() else lag, "cc": top})

    return best


def search_dots():
    """Dot products of an observation, a synthetic and its change: all that a linear step needs."""

    @F.pandas_udf("struct<oo: double, ou: double, ov: double, uu: double, uv: double, vv: double>")
    def dots(observed: pd.Series, synthetic: pd.Series, change: pd.Series) -> pd.DataFrame:
        out = np.full((len(observed), 6), np.nan)
        for at, o, u, v in stacked(observed, synthetic, change):
            out[at] = np.stack([(a * b).sum(axis=1) for a, b in ((o, o), (o, u), (o, v), (u, u), (u, v), (v, v))], axis=1)
        return pd.DataFrame(out, columns=["oo", "ou", "ov", "uu", "uv", "vv"])

    return dots


def stepped_cc(d: Column, step: Column) -> Column:
    """Similarity of the observation to u + step·v, from :func:`search_dots`."""
    size = F.sqrt(d["oo"]) * F.sqrt(d["uu"] + 2 * step * d["uv"] + step * step * d["vv"])
    return F.try_divide(d["ou"] + step * d["ov"], size)


def derivative(rate: float):
    """Time derivative in the frequency domain."""

    @F.pandas_udf("array<double>")
    def derived(traces: pd.Series) -> pd.Series:
        def one(t):
            x = np.asarray(t, float)
            f = np.fft.rfftfreq(len(x), 1 / rate)
            return np.fft.irfft(np.fft.rfft(x) * 2j * np.pi * f, len(x))

        return traces.map(one, na_action="ignore")

    return derived


def lanczos_resample(rate: float, new_rate: float, width: int = 20):
    """Resample with a Lanczos kernel of ``width`` samples on either side."""

    @F.pandas_udf("array<double>")
    def resampled(traces: pd.Series) -> pd.Series:
        def one(t):
            x = np.asarray(t, float)
            at = np.arange(int((len(x) - 1) * new_rate / rate) + 1) * rate / new_rate
            first = np.floor(at).astype(int)
            out = np.zeros(len(at))
            for k in range(-width + 1, width + 1):
                place = first + k
                u = at - place
                kernel = np.sinc(u) * np.sinc(u / width) * (np.abs(u) < width)
                ok = (place >= 0) & (place < len(x))
                out[ok] += x[place[ok]] * kernel[ok]
            return out

        return traces.map(one, na_action="ignore")

    return resampled

"""Instrument responses as rows of poles and zeros, and traces with their own response taken out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.signal import band_response
from .joins import epoch_join
from .windows import fast_length

COMPLEX = "array<struct<re:double,im:double>>"


@dataclass(frozen=True)
class RemovalRules:
    """Corners and orders of the filters (the high-pass is at least of so many orders as the response has zeros at
    zero, and one more for displacement), what comes out (VEL or DISP, from a velocity response), and the new rate."""

    low: float = 0.01
    high: float = 0.4
    low_order: int = 2
    high_order: int = 4
    output: str = "VEL"
    new_rate: float = 2.0
    lanczos: int = 20


def roots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Complex numbers of each row in a matrix (rows x most), and which of its cells are used. A null list is empty."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)), complex)
    used = np.arange(out.shape[1]) < sizes[:, None]
    flat = column.flatten()
    out[used] = flat.field("re").to_numpy(zero_copy_only=False) + 1j * flat.field("im").to_numpy(zero_copy_only=False)
    return out, used


def transfer(freq: np.ndarray, poles: tuple[np.ndarray, np.ndarray], zeros: tuple[np.ndarray, np.ndarray], gain: np.ndarray) -> np.ndarray:
    """gain times the product of (s - zero) over that of (s - pole) at s = 2 pi i f: a row of frequencies per response.

    ``freq``: one array for all rows, or a matrix with a row each.
    """
    s = 2j * np.pi * np.atleast_2d(freq)
    out = np.repeat(gain[:, None].astype(complex), s.shape[1], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for (values, used), up in ((zeros, True), (poles, False)):
            for k in range(values.shape[1]):
                factor = np.where(used[:, k : k + 1], s - values[:, k : k + 1], 1.0)
                out = out * factor if up else out / factor
    return out


def response_at(df: DataFrame, frequency: str, poles: str, zeros: str, gain: str) -> DataFrame:
    """``df`` with response_re and response_im of each row's response at its frequency (Hz). Null where something is null or infinite."""
    rows = df.withColumns({"_f": F.col(frequency).cast("double"), "_p": F.col(poles).cast(COMPLEX), "_z": F.col(zeros).cast(COMPLEX), "_g": F.col(gain).cast("double")})
    schema = ", ".join([*[f"`{n}` {t}" for n, t in df.dtypes], "response_re double", "response_im double"])

    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = lambda c: np.asarray(batch.column(c).fill_null(np.nan).to_numpy(zero_copy_only=False), float)
            h = transfer(number("_f")[:, None], roots(batch.column("_p")), roots(batch.column("_z")), number("_g"))[:, 0] if batch.num_rows else np.zeros(0, complex)
            bad = ~np.isfinite(h)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(h.real, mask=bad), pa.array(h.imag, mask=bad)], names=[*names, "response_re", "response_im"])

    return rows.mapInArrow(work, schema)


def resampled(x: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Rows of samples at their own places (rows x new samples, counted in samples), by a Lanczos kernel."""
    first = np.floor(at).astype(int)
    out = np.zeros(at.shape)
    for k in range(-width + 1, width + 1):
        place = first + k
        u = at - place
        kernel = np.where((place >= 0) & (place < x.shape[1]), np.sinc(u) * np.sinc(u / width) * (np.abs(u) < width), 0.0)
        out += np.take_along_axis(x, np.clip(place, 0, x.shape[1] - 1), axis=1) * kernel
    return out


def without_trend(x: np.ndarray) -> np.ndarray:
    """Rows less their straight line."""
    t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    slope = x @ t / max((t * t).sum(), 1e-300)
    return x - x.mean(axis=1, keepdims=True) - slope[:, None] * t


def corrected(x: np.ndarray, rate: float, low: float, order: int, response: tuple, rules: RemovalRules) -> tuple[np.ndarray, int]:
    """Rows of one rate with their responses divided out, with padding before and after; and the padding before."""
    n = x.shape[1]
    pad = max(5, 2 * int(1.0 / low * rate))
    size = fast_length(n + 2 * pad)
    freq = np.fft.rfftfreq(size, 1 / rate)
    mean = x.mean(axis=1, keepdims=True)
    wide = np.concatenate([np.repeat(mean, pad, axis=1), x, np.repeat(mean, size - n - pad, axis=1)], axis=1)
    h = transfer(freq, *response)
    if rules.output == "DISP":
        h = h * 2j * np.pi * freq
    spectrum = np.fft.rfft(wide) * band_response(freq, rate, order, low, None) * band_response(freq, rate, rules.high_order, None, rules.high)
    usable = np.isfinite(h) & (np.abs(h) > 0)
    spectrum = np.where(usable, spectrum / np.where(usable, h, 1), spectrum)
    spectrum[:, 0] = 0
    return np.fft.irfft(spectrum, size), pad


def remove_responses(records: DataFrame, responses: DataFrame, keys: list[str], station: list[str], samples: str = "samples", rules: RemovalRules = RemovalRules()) -> DataFrame:
    """Records with their own response taken out, on the common grid of their station.

    ``records``: keys, starttime (timestamp), rate and samples; ``responses``: keys, starttime, endtime (null: still),
    poles and zeros (arrays of re, im; rad/s), gain, and lowest (the lowest frequency that the response allows; null: any).
    A record meets the response whose epoch holds its start. Trends go, the spectrum is divided by the response under a high-pass and
    a low-pass by magnitude, and a Lanczos kernel takes the trace to the new rate from the latest start of the station's
    records on to the earliest end. Rows of one rate, length and filter are worked through together.

    Cases: a record without an epoch, with a null or empty trace, or whose station has no time in common is left out.
    Where a response is zero or infinite nothing is divided. Records are told apart by nothing but their row, so copies stay copies.
    """
    if rules.output not in ("VEL", "DISP"):
        raise ValueError(rules.output)
    held = records.filter(F.size(samples) > 0)
    met = epoch_join(held.withColumn("_at", F.col("starttime")), responses.withColumnRenamed("starttime", "_from").withColumnRenamed("endtime", "_to"), keys, "_at", "_from", "_to").drop("_at", "_from", "_to")
    at_zero = F.size(F.filter(F.coalesce(F.col("zeros").cast(COMPLEX), F.array().cast(COMPLEX)), lambda z: (z["re"] == 0) & (z["im"] == 0)))
    own = Window.partitionBy(*station)
    start = F.unix_micros(F.col("starttime").cast("timestamp"))
    rows = met.withColumns({
        "_low": F.greatest(F.lit(rules.low), F.coalesce(F.col("lowest").cast("double"), F.lit(rules.low))),
        "_order": F.greatest(F.lit(rules.low_order), at_zero + (1 if rules.output == "DISP" else 0)),
        "_s": start, "_e": start + F.round((F.size(samples) - 1) * 1e6 / F.col("rate")).cast("long"),
    })
    # the worst of a station's channels decides for all of them
    rows = rows.withColumns({"_low": F.max("_low").over(own), "_order": F.max("_order").over(own), "_t0": F.max("_s").over(own), "_t1": F.min("_e").over(own)})
    rows = rows.withColumn("_n", F.floor((F.col("_t1") - F.col("_t0")) * rules.new_rate / 1e6 + 1e-9).cast("int")).filter("_n > 0")
    kept = [c for c in records.columns if c not in (samples, "rate", "starttime")]
    rows = rows.select(
        *kept, F.timestamp_micros("_t0").alias("starttime"), F.lit(float(rules.new_rate)).alias("rate"), F.col(samples).cast("array<double>").alias("_x"), F.col("rate").cast("double").alias("_rate"),
        "_low", "_order", ((F.col("_t0") - F.col("_s")) / 1e6).alias("_skip"), "_n", F.col("poles").cast(COMPLEX).alias("_p"), F.col("zeros").cast(COMPLEX).alias("_z"), F.col("gain").cast("double").alias("_g"),
    )
    out = [*kept, "starttime", "rate"]
    schema = ", ".join([*[f"`{n}` {t}" for n, t in rows.select(*out).dtypes], f"`{samples}` array<double>"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = lambda c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float)
            sizes = np.asarray(batch.column("_x").value_lengths(), float)
            rate, low, order, skip, n_new = (number(c) for c in ("_rate", "_low", "_order", "_skip", "_n"))
            poles, zeros, gain = roots(batch.column("_p")), roots(batch.column("_z")), number("_g")
            found: list = [None] * batch.num_rows
            alike, which = np.unique(np.column_stack([sizes, rate, low, order, n_new]), axis=0, return_inverse=True)
            for g, (n, hz, corner, orders, count) in enumerate(alike.tolist()):
                rows_here = np.flatnonzero(which == g)
                for first in range(0, len(rows_here), 256):
                    some = rows_here[first : first + 256]
                    x = batch.column("_x").take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), int(n))
                    own = tuple((v[some], u[some]) for v, u in (poles, zeros))
                    y, pad = corrected(without_trend(x), hz, corner, int(orders), (*own, gain[some]), rules)
                    at = (skip[some, None] + np.arange(int(count)) / rules.new_rate) * hz + pad
                    for i, row in zip(some.tolist(), resampled(y, at, rules.lanczos)):
                        found[i] = row
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array(found, pa.list_(pa.float64()))], names=[*out, samples])

    return rows.mapInArrow(work, schema)

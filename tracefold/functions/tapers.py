"""Cosine tapers and the weights made of them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_taper(x: Column, corners: list[float]) -> Column:
    """0 outside and 1 inside, with half-cosine ramps between.

    Two corners (stop, pass): a ramp from the stop to the pass side; pass < stop tapers the right
    end. Four corners (stop, pass, pass, stop) must strictly increase. Null stays null.
    """
    def ramp(stop: float, full: float) -> Column:
        return 0.5 - 0.5 * F.cos(math.pi * (x - stop) / (full - stop))

    if len(corners) == 2:
        stop, full = map(float, corners)
        if stop == full:
            raise ValueError("the two corners are equal")
        if stop < full:
            return F.when(x <= stop, 0.0).when(x >= full, 1.0).otherwise(ramp(stop, full))
        return F.when(x >= stop, 0.0).when(x <= full, 1.0).otherwise(ramp(stop, full))
    if len(corners) != 4 or any(a >= b for a, b in zip(corners, corners[1:])):
        raise ValueError("four corners must strictly increase")
    a, b, c, d = map(float, corners)
    return (
        F.when((x <= a) | (x >= d), 0.0).when((x >= b) & (x <= c), 1.0)
        .when(x < b, ramp(a, b)).otherwise(ramp(d, c))
    )


def exponential_taper(x: Column, corners: list[float], stop: float = 0.01, floor: float = 0.0) -> Column:
    """1 inside, and beyond the pass corners a bell that is ``stop`` at the stop corners (of 1 - ``floor``, which stays).

    Two corners (stop, pass) taper one end, four (stop, pass, pass, stop) both. Null stays null.
    """
    if not 0 < stop < 1:
        raise ValueError("the amplitude at the stop must lie between 0 and 1")

    def bell(full: float, end: float) -> Column:
        share = (x - full) / (end - full)
        return floor + (1 - floor) * F.exp(math.log(stop) * share * share)

    if len(corners) == 2:
        end, full = map(float, corners)
        if end == full:
            raise ValueError("the two corners are equal")
        return F.when(x >= full if end < full else x <= full, 1.0).otherwise(bell(full, end))
    if len(corners) != 4 or any(a >= b for a, b in zip(corners, corners[1:])):
        raise ValueError("four corners must strictly increase")
    a, b, c, d = map(float, corners)
    return F.when(x.between(b, c), 1.0).when(x < b, bell(b, a)).otherwise(bell(c, d))


def window_weight(base: Column, rules: dict[str, tuple[Column, list[float]]]) -> Column:
    """The base weight times one taper per measured quality. The base stays as it was: measuring again gives the same."""
    return reduce(lambda w, r: w * cosine_taper(*r), rules.values(), base)


def taper_width(length: Column, share: Column) -> Column:
    """Width of a window's taper; no more than 0.4 of the window."""
    return length * F.least(share, F.lit(0.4))

"""Distances, frames and rotations on sphere and ellipsoid, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 semi-major axis (m) and flattening.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle in radians by the law of cosines (degrees in); rounding past 1 is clamped."""
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2 - lon1))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def geocentric_latitude(lat: Column) -> Column:
    return F.degrees(F.atan((1 - WGS84_F) ** 2 * F.tan(F.radians(lat))))


def geodetic_latitude(lat: Column) -> Column:
    return F.degrees(F.atan(F.tan(F.radians(lat)) / (1 - WGS84_F) ** 2))


def to_ecef(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(a) * F.sin(a))
    return (n + height) * F.cos(a) * F.cos(b), (n + height) * F.cos(a) * F.sin(b), (n * (1 - WGS84_E2) + height) * F.sin(a)


def from_ecef_surface(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Geodetic latitude and longitude (degrees) of a point at zero height."""
    return F.degrees(F.atan2(z, (1 - WGS84_E2) * F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Geodetic latitude, longitude (degrees) and height (m), by the reduced latitude of the place's direction; near
    the surface (some hundred km) good to a micrometre and better."""
    short, h = WGS84_A * (1 - WGS84_F), F.sqrt(x * x + y * y)
    reduced = F.atan2(z * WGS84_A, h * short)
    up, out = F.sin(reduced), F.cos(reduced)
    lat = F.atan2(z + WGS84_E2 / (1 - WGS84_E2) * short * up * up * up, h - WGS84_E2 * WGS84_A * out * out * out)
    height = h * F.cos(lat) + z * F.sin(lat) - WGS84_A * F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), height


def to_enu(dx: Column, dy: Column, dz: Column, lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """An ECEF difference in the east, north, up frame of a place."""
    a, b = F.radians(lat), F.radians(lon)
    east = -F.sin(b) * dx + F.cos(b) * dy
    north = -F.sin(a) * F.cos(b) * dx - F.sin(a) * F.sin(b) * dy + F.cos(a) * dz
    up = F.cos(a) * F.cos(b) * dx + F.cos(a) * F.sin(b) * dy + F.sin(a) * dz
    return east, north, up


def component_azimuth(component: Column, back_azimuth: Column) -> Column:
    """Azimuth of a component: R away from the source, T to its right, Z 0; others none (NaN)."""
    return (
        F.when(component == "R", F.pmod(back_azimuth + 180, F.lit(360.0))).when(component == "T", F.pmod(back_azimuth - 90, F.lit(360.0)))
        .when(component == "Z", 0.0).otherwise(F.lit(float("nan")))
    )


def azimuth_from_perpendicular(az1: Column, az2: Column) -> Column:
    """|cos| of the angle between two horizontals: 0 when perpendicular, whichever way they wind."""
    return F.abs(F.cos(F.radians(az1 - az2)))


def in_rectangle(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def in_ring(lat: Column, lon: Column, lat0: float, lon0: float, least: float, most: float) -> Column:
    """Within ``least`` to ``most`` degrees of a place."""
    return F.degrees(great_circle(lat, lon, F.lit(lat0), F.lit(lon0))).between(least, most)


@dataclass(frozen=True)
class Chunk:
    """A part of the sphere with its centre (degrees) and the angle by which its axes are turned counter-clockwise from east and north."""

    lat: float
    lon: float
    rotation: float

    def frame(self) -> np.ndarray:
        """Rows: unit vectors outward, along xi and along eta."""
        t = np.arctan((1 - WGS84_F) ** 2 * np.tan(np.radians(self.lat)))
        p, g = np.radians(self.lon), np.radians(self.rotation)
        out = np.array([np.cos(t) * np.cos(p), np.cos(t) * np.sin(p), np.sin(t)])
        east, north = np.array([-np.sin(p), np.cos(p), 0.0]), np.array([-np.sin(t) * np.cos(p), -np.sin(t) * np.sin(p), np.cos(t)])
        return np.stack([out, np.cos(g) * east + np.sin(g) * north, np.cos(g) * north - np.sin(g) * east])

    def coordinates(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """xi and eta (degrees) of a geodetic place at no height."""
        v = unit_vector(geocentric_latitude(lat), lon)
        out, xi, eta = (sum(float(a) * x for a, x in zip(row, v)) for row in self.frame())
        return F.degrees(F.atan2(xi, out)), F.degrees(F.atan2(eta, out))

    def place(self, xi: Column, eta: Column) -> tuple[Column, Column]:
        """Geodetic latitude and longitude of chunk coordinates."""
        along = (F.lit(1.0), F.tan(F.radians(xi)), F.tan(F.radians(eta)))
        x, y, z = (sum(float(a) * c for a, c in zip(column, along)) for column in self.frame().T)
        return geodetic_latitude(F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))), F.degrees(F.atan2(y, x))


def edge_distance(xi: Column, eta: Column, width_xi: float, width_eta: float) -> Column:
    """How far (degrees) inside a chunk's edges a place is; negative outside."""
    return F.least(width_xi / 2 - F.abs(xi), width_eta / 2 - F.abs(eta))


def geodesic(steps: int = 20):
    """A function of two places (lat, lon, lat, lon in degrees): distance (m), azimuth and back azimuth on the
    ellipsoid, by Vincenty's inverse formula over whole batches. Nearly opposite places may not converge: null."""

    @F.pandas_udf("struct<distance: double, azimuth: double, back: double>")
    def inverse(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
        u, w = (np.arctan((1 - WGS84_F) * np.tan(np.radians(x.to_numpy(float)))) for x in (lat1, lat2))
        gap = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
        lam, moved = gap.copy(), np.inf
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(steps):
                ss = np.hypot(np.cos(w) * np.sin(lam), np.cos(u) * np.sin(w) - np.sin(u) * np.cos(w) * np.cos(lam))
                cs = np.sin(u) * np.sin(w) + np.cos(u) * np.cos(w) * np.cos(lam)
                s = np.arctan2(ss, cs)
                sa = np.where(ss == 0, 0.0, np.cos(u) * np.cos(w) * np.sin(lam) / ss)
                c2 = 1 - sa * sa
                cm = np.where(c2 == 0, 0.0, cs - 2 * np.sin(u) * np.sin(w) / c2)
                c = WGS84_F / 16 * c2 * (4 + WGS84_F * (4 - 3 * c2))
                new = gap + (1 - c) * WGS84_F * sa * (s + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
                lam, moved = new, np.abs(new - lam)
            q = c2 * (1 / (1 - WGS84_F) ** 2 - 1)
            a, b = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))), q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
            bent = b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1) - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
            distance = np.where(ss == 0, 0.0, WGS84_A * (1 - WGS84_F) * a * (s - bent))
            there = np.degrees(np.arctan2(np.cos(w) * np.sin(lam), np.cos(u) * np.sin(w) - np.sin(u) * np.cos(w) * np.cos(lam))) % 360
            back = (np.degrees(np.arctan2(np.cos(u) * np.sin(lam), np.cos(u) * np.sin(w) * np.cos(lam) - np.sin(u) * np.cos(w))) + 180) % 360
        good = np.asarray(moved) < 1e-9
        return pd.DataFrame({"distance": np.where(good, distance, np.nan), "azimuth": np.where(good, there, np.nan), "back": np.where(good, back, np.nan)})

    return inverse

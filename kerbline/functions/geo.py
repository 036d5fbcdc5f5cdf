"""Positions on the globe: distances, local and UTM metres, tiles, sun height."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_DIAMETER_KM = 12742.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p = math.pi / 180
    h = (
        F.pow(F.sin((lat2 - lat1) * p / 2), 2)
        + F.cos(lat1 * p) * F.cos(lat2 * p) * F.pow(F.sin((lon2 - lon1) * p / 2), 2)
    )
    return F.lit(EARTH_DIAMETER_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def local_km(lat: Column, lon: Column, lat0: float = 26.2, lon0: float = 92.9) -> tuple[Column, Column]:
    """Equirectangular kilometres around an origin: (x, y)."""
    kx = 111.32 * math.cos(math.radians(lat0))
    return (lon - lon0) * kx, (lat - lat0) * 110.57


def nearest_fixed(
    lat: Column, lon: Column, stations: Sequence[tuple[str, float, float]], limit_km: float | None = None
) -> Column:
    """Nearest of a small fixed list as struct(km, name); name is NULL beyond the limit."""
    options = [
        F.struct(haversine_km(lat, lon, F.lit(float(la)), F.lit(float(lo))).alias("km"), F.lit(name).alias("name"))
        for name, la, lo in stations
    ]
    best = F.array_min(F.array(*options)) if len(options) > 1 else options[0]
    if limit_km is None:
        return best
    return F.struct(best["km"].alias("km"), F.when(F.bround(best["km"], 1) <= limit_km, best["name"]).alias("name"))


def slippy_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    n = 2.0**zoom
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n)
    return x, y


def tile_pixel_position(zoom: Column, x: Column, y: Column, px: Column, py: Column, extent: float) -> tuple[Column, Column]:
    """(lon, lat) of a pixel inside a slippy tile."""
    n = F.pow(F.lit(2.0), zoom)
    lon = (x + px / extent) / n * 360.0 - 180.0
    lat = F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * (y + py / extent) / n))))
    return lon, lat


def ten_degree_tile(lat: Column, lon: Column) -> Column:
    h = F.floor((lon + 180.0) / 10.0).cast("string")
    v = F.floor((90.0 - lat) / 10.0).cast("string")
    return F.concat(F.lit("h"), F.lpad(h, 2, "0"), F.lit("v"), F.lpad(v, 2, "0"))


def pixel_index(lat: Column, lon: Column, per_degree: float = 240.0) -> tuple[Column, Column]:
    """Row and column of a global raster with ``per_degree`` pixels (north to south, west to east)."""
    return (
        F.bround((90.0 - lat) * per_degree - 0.5).cast("int"),
        F.bround((lon + 180.0) * per_degree - 0.5).cast("int"),
    )


# ---- UTM by the Krueger series (published coefficients in the third flattening, order 4)
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * 0.9996
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_DELTA = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]


def utm_forward(lat: Column, lon: Column, zone: int = 46) -> tuple[Column, Column]:
    """Longitude/latitude to northern-hemisphere UTM metres (east, north)."""
    c = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(lat))
    dl = F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + _RADIUS * east, _RADIUS * north


def utm_inverse(east: Column, north: Column, zone: int = 46) -> tuple[Column, Column]:
    """Northern-hemisphere UTM metres to (lat, lon)."""
    xi, eta = north / _RADIUS, (east - 500000.0) / _RADIUS
    xp, ep = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xp = xp - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    lat = chi
    for j, d in enumerate(_DELTA, start=1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(ep), F.cos(xp)))


# ---- sun height: low-precision solar coordinates (good to about 0.02 degrees), refraction near the horizon
def sun_elevation(utc: Column, lat: Column, lon: Column) -> Column:
    days = F.unix_micros(utc.cast("timestamp")) / 8.64e10 - 10957.5
    mean_lon = F.radians(F.pmod(F.lit(280.460) + days * 0.9856474, F.lit(360.0)))
    anomaly = F.radians(F.pmod(F.lit(357.528) + days * 0.9856003, F.lit(360.0)))
    ecl = mean_lon + F.radians(1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = F.radians(23.439 - days * 4.0e-7)
    dec = F.asin(F.sin(tilt) * F.sin(ecl))
    ra = F.atan2(F.cos(tilt) * F.sin(ecl), F.cos(ecl))
    gmst = F.pmod(F.lit(280.46061837) + days * 360.98564736629, F.lit(360.0))
    hour_angle = F.radians(gmst + lon) - ra
    la = F.radians(lat)
    true = F.degrees(F.asin(F.sin(la) * F.sin(dec) + F.cos(la) * F.cos(dec) * F.cos(hour_angle)))
    lift = 1.02 / F.tan(F.radians(true + 10.3 / (true + 5.11))) / 60.0
    return F.when(true > -0.575, true + lift).otherwise(true)


def light_class(elevation: Column) -> Column:
    """Dark up to -6, civil twilight up to 0, daylight above."""
    return F.when(elevation <= -6, "dark").when(elevation <= 0, "civil_twilight").when(elevation > 0, "daylight")

"""Zones, grids, names and the transverse Mercator projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["wrap_longitude", "utm_epsg", "utm_forward", "utm_inverse", "grid_of_box", "coordinate_text", "footprint_json", "ring_area", "resolution_text"]

#: WGS 84.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
#: Coefficients of the forward Krueger series, to the third order in the third flattening.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
#: Those of the inverse series, and of the latitude from the conformal one.
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def wrap_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180); values already there stay bit for bit."""
    wrapped = lon + 180.0 - F.floor((lon + 180.0) / 360.0) * 360.0 - 180.0
    wrapped = F.when(wrapped >= 180.0, wrapped - 360.0).otherwise(wrapped)
    return F.when((lon >= -180.0) & (lon < 180.0), lon).otherwise(wrapped)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone; beyond 84 north and 80 south the polar codes."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    utm = F.when(lat >= 0, F.lit(32600) + zone).otherwise(F.lit(32700) + zone)
    return F.when(lat > 84, F.lit(5041)).when(lat < -80, F.lit(5042)).otherwise(utm).cast("int")


def utm_forward(lon: Column, lat: Column, epsg: Column | None = None) -> tuple[Column, Column]:
    """(easting, northing) in the UTM zone of an EPSG code, the point's own if none is given. Polar codes are not projected; ``planes`` knows them."""
    code = utm_epsg(lon, lat) if epsg is None else epsg
    zone, south = code % 100, code >= 32700
    dlon = F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    e = _E
    atanh = lambda x: F.lit(0.5) * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(s) - F.lit(e) * atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(dlon)), atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + F.lit(0.9996 * _RADIUS) * x, F.when(south, F.lit(1e7)).otherwise(F.lit(0.0)) + F.lit(0.9996 * _RADIUS) * y


def _latitude(conformal: Column) -> Column:
    """Latitude in degrees from the conformal latitude in radians."""
    out = conformal
    for j, d in enumerate(_DELTA, 1):
        out = out + F.lit(d) * F.sin(2 * j * conformal)
    return F.degrees(out)


def utm_inverse(easting: Column, northing: Column, epsg: Column) -> tuple[Column, Column]:
    """(lon, lat) of a place in the UTM zone of an EPSG code, the longitude in [-180, 180)."""
    zone, south = epsg % 100, epsg >= 32700
    x0, y0 = (easting - 500000.0) / (0.9996 * _RADIUS), (northing - F.when(south, F.lit(1e7)).otherwise(F.lit(0.0))) / (0.9996 * _RADIUS)
    eta, xi = x0, y0
    for j, b in enumerate(_BETA, 1):
        eta = eta - F.lit(b) * F.cos(2 * j * y0) * F.sinh(2 * j * x0)
        xi = xi - F.lit(b) * F.sin(2 * j * y0) * F.cosh(2 * j * x0)
    lat = _latitude(F.asin(F.sin(xi) / F.cosh(eta)))
    return wrap_longitude(zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))), lat


def grid_of_box(w: Column, s: Column, e: Column, n: Column, res: float) -> dict[str, Column]:
    """Pixel grid that covers a box, with its edges on multiples of the resolution."""
    x0, x1, y0, y1 = F.floor(w / res), F.ceil(e / res), F.floor(s / res), F.ceil(n / res)
    return {"minx": x0 * res, "miny": y0 * res, "maxx": x1 * res, "maxy": y1 * res, "width": (x1 - x0).cast("int"), "height": (y1 - y0).cast("int")}


def fixed_text(v: Column, digits: int) -> Column:
    """A number with a fixed number of decimals, rounded from its exact binary value, exact halves to even.

    format_string rounds the shortest decimal form instead, which differs where that ends in 5. The product with the
    power of ten is taken in two parts, as a rounded value and its error; the error decides what looks like a half.
    """
    x, scale = F.abs(v), float(10**digits)
    p = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - p) + (x - high) * scale
    whole = F.floor(p)
    rest = p - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = whole + up.cast("long")
    sign = F.when(v < 0, "-").otherwise("")
    return F.concat(sign, F.floor(n / 10**digits).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))


def coordinate_text(lon: Column, lat: Column) -> Column:
    """'45.1549°N, 15.0020°E'."""
    return F.concat(fixed_text(F.abs(lat), 4), F.lit("°"), F.when(lat >= 0, "N").otherwise("S"), F.lit(", "), fixed_text(F.abs(lon), 4), F.lit("°"), F.when(lon >= 0, "E").otherwise("W"))


def resolution_text(res: Column) -> Column:
    return F.when(res < 1, F.concat((res * 100).cast("int").cast("string"), F.lit("cm"))).otherwise(F.concat(res.cast("int").cast("string"), F.lit("m")))


def anchor_stem(lon: Column, lat: Column, dates: Column, res: Column) -> Column:
    """'13.000000_52.000000_20240115_10m'."""
    return F.concat_ws("_", fixed_text(lon, 6), fixed_text(lat, 6), dates, resolution_text(res))


def footprint_json(w: Column, s: Column, e: Column, n: Column) -> Column:
    """GeoJSON text of the rectangle."""
    p = lambda x, y: F.array(x, y)
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.array(p(w, s), p(w, n), p(e, n), p(e, s), p(w, s))).alias("coordinates")))


def ring_area(ring: Column) -> Column:
    """Area inside a closed or open ring of [x, y], by the shoelace sum."""
    n = F.size(ring)
    at = lambda i, k: F.get(F.get(ring, F.pmod(i, n)), F.lit(k))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + at(i, 0) * at(i + 1, 1) - at(i + 1, 0) * at(i, 1))
    return F.when(n >= 3, F.abs(total) / 2).otherwise(F.lit(0.0))

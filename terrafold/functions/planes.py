"""Places from one plane to another, for whole columns of places at once.

The series of a projection use each of their terms many times; as column expressions, chained from plane to plane, they
grow beyond what a plan can hold. So the chain runs over Arrow batches. A single step is in ``geo``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions.geo import _A, _ALPHA, _BETA, _DELTA, _E, _RADIUS

#: Radius of the polar stereographic plane at its pole, by the scale of UPS.
_UPS = 2 * _A * 0.994 / math.sqrt((1 + _E) ** (1 + _E) * (1 - _E) ** (1 - _E))

Places = tuple[np.ndarray, np.ndarray]


def _utm(lon: np.ndarray, lat: np.ndarray, epsg: np.ndarray) -> Places:
    off = np.radians(lon - (epsg % 100 * 6 - 183))
    s = np.sin(np.radians(lat))
    t = np.sinh(np.arctanh(s) - _E * np.arctanh(_E * s))
    xi, eta = np.arctan2(t, np.cos(off)), np.arctanh(np.sin(off) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return 500000.0 + 0.9996 * _RADIUS * x, np.where(epsg >= 32700, 1e7, 0.0) + 0.9996 * _RADIUS * y


def _latitude(conformal: np.ndarray) -> np.ndarray:
    return np.degrees(conformal + sum(d * np.sin(2 * j * conformal) for j, d in enumerate(_DELTA, 1)))


def _utm_back(x: np.ndarray, y: np.ndarray, epsg: np.ndarray) -> Places:
    a, b = (x - 500000.0) / (0.9996 * _RADIUS), (y - np.where(epsg >= 32700, 1e7, 0.0)) / (0.9996 * _RADIUS)
    eta = a - sum(c * np.cos(2 * j * b) * np.sinh(2 * j * a) for j, c in enumerate(_BETA, 1))
    xi = b - sum(c * np.sin(2 * j * b) * np.cosh(2 * j * a) for j, c in enumerate(_BETA, 1))
    return epsg % 100 * 6 - 183 + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), _latitude(np.arcsin(np.sin(xi) / np.cosh(eta)))


def _polar(lon: np.ndarray, lat: np.ndarray, epsg: np.ndarray) -> Places:
    up = np.where(epsg == 5041, 1.0, -1.0)
    phi = np.radians(lat) * up
    s = _E * np.sin(phi)
    rho = _UPS * np.tan(math.pi / 4 - phi / 2) * ((1 + s) / (1 - s)) ** (_E / 2)
    return 2e6 + rho * np.sin(np.radians(lon)), 2e6 - up * rho * np.cos(np.radians(lon))


def _polar_back(x: np.ndarray, y: np.ndarray, epsg: np.ndarray) -> Places:
    up = np.where(epsg == 5041, 1.0, -1.0)
    a, b = x - 2e6, (2e6 - y) * up
    return np.degrees(np.arctan2(a, b)), _latitude(math.pi / 2 - 2 * np.arctan(np.hypot(a, b) / _UPS)) * up


def _mercator(lon: np.ndarray, lat: np.ndarray, _: np.ndarray) -> Places:
    return np.radians(lon) * _A, np.log(np.tan(math.pi / 4 + np.radians(lat) / 2)) * _A


def _mercator_back(x: np.ndarray, y: np.ndarray, _: np.ndarray) -> Places:
    return np.degrees(x / _A), np.degrees(2 * np.arctan(np.exp(y / _A)) - math.pi / 2)


def _chosen(x: np.ndarray, y: np.ndarray, epsg: np.ndarray, mercator, polar, utm) -> Places:
    """Each place by the function of its plane; 4326 stays as it is, any other plane gives NaN."""
    out = np.full(len(x), np.nan), np.full(len(x), np.nan)
    zones = (epsg > 32600) & (epsg <= 32660) | (epsg > 32700) & (epsg <= 32760)
    for which, f in ((epsg == 4326, lambda x, y, _: (x, y)), (epsg == 3857, mercator), ((epsg == 5041) | (epsg == 5042), polar), (zones, utm)):
        if which.any():
            for o, v in zip(out, f(x[which], y[which], epsg[which])):
                o[which] = v
    return out


def project(lon: np.ndarray, lat: np.ndarray, epsg: np.ndarray) -> Places:
    """(x, y) in the plane of an EPSG code: 4326, 3857, the UTM zones and the two polar ones."""
    with np.errstate(all="ignore"):
        return _chosen(lon, lat, epsg, _mercator, _polar, _utm)


def unproject(x: np.ndarray, y: np.ndarray, epsg: np.ndarray) -> Places:
    """(lon, lat), the longitude in [-180, 180), of a place in the plane of an EPSG code."""
    with np.errstate(all="ignore"):
        lon, lat = _chosen(x, y, epsg, _mercator_back, _polar_back, _utm_back)
        return np.where((lon >= -180) & (lon < 180), lon, (lon + 180) % 360 - 180), lat


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def _floats(*columns: pd.Series) -> list[np.ndarray]:
    return [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]


@F.pandas_udf(_struct("x", "y"))
def _turned(x: pd.Series, y: pd.Series, epsg: pd.Series, to: pd.Series) -> pd.DataFrame:
    x, y, epsg, to = _floats(x, y, epsg, to)
    a, b = project(*unproject(x, y, epsg), to)
    a, b = np.where(epsg == to, x, a), np.where(epsg == to, y, b)
    return pd.DataFrame({"x": pd.Series(a).astype("Float64").where(np.isfinite(a), None), "y": pd.Series(b).astype("Float64").where(np.isfinite(b), None)})


def turned(x: Column, y: Column, epsg: Column, to: Column) -> Column:
    """Struct (x, y) of a place in another plane; nulls if either plane isn't known or the place isn't in it."""
    return _turned(x.cast("double"), y.cast("double"), epsg.cast("double"), to.cast("double"))


@F.pandas_udf(_struct("w", "s", "e", "n"))
def _box(w: pd.Series, s: pd.Series, e: pd.Series, n: pd.Series, epsg: pd.Series, to: pd.Series) -> pd.DataFrame:
    w, s, e, n, epsg, to = _floats(w, s, e, n, epsg, to)
    share = np.linspace(0, 1, 22)
    xs, ys = w[:, None] + (e - w)[:, None] * share, s[:, None] + (n - s)[:, None] * share
    full = lambda v: np.repeat(v[:, None], len(share), axis=1)
    x, y = np.concatenate([xs, xs, full(w), full(e)], axis=1), np.concatenate([full(s), full(n), ys, ys], axis=1)
    repeat = x.shape[1]
    a, b = (v.reshape(x.shape) for v in project(*unproject(x.ravel(), y.ravel(), np.repeat(epsg, repeat)), np.repeat(to, repeat)))
    over = (to == 4326) & (np.nanmax(a, axis=1, initial=-np.inf) - np.nanmin(a, axis=1, initial=np.inf) > 180)
    a = np.where(over[:, None] & (a < 0), a + 360, a)
    same = (epsg == to)[:, None]
    a, b = np.where(same, x, a), np.where(same, y, b)
    out = {k: pd.Series(v).astype("Float64").where(np.isfinite(v), None) for k, v in (("w", a.min(axis=1)), ("s", b.min(axis=1)), ("e", a.max(axis=1)), ("n", b.max(axis=1)))}
    return pd.DataFrame(out)


def box_in(w: Column, s: Column, e: Column, n: Column, epsg: Column, to: Column) -> Column:
    """The box around a box in another plane, as a struct (w, s, e, n): its sides are followed in 21 pieces, as their middles may lie farther out.

    In degrees a box over the 180 degree line has its east beyond 180.
    """
    return _box(*[c.cast("double") for c in (w, s, e, n, epsg, to)])

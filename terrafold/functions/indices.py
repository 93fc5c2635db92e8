"""Spectral indices as column expressions.

All compute in double and give null where a band is null or the denominator is exactly zero. EPS keeps a
denominator of zero reflectance finite.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b + EPS): what all normalized differences are."""
    return F.try_divide(a - b, a + b + F.lit(EPS))


def _difference(first: str, second: str, doc: str) -> Callable[..., Column]:
    def index(**bands: Column | str) -> Column:
        return ratio(_d(bands[first]), _d(bands[second]))

    index.__doc__ = doc
    return index


ndvi = _difference("nir", "red", "Normalized difference vegetation index.")
ndre = _difference("nir", "rededge", "Normalized difference red edge.")
ndbi = _difference("swir1", "nir", "Normalized difference built-up index.")
ndwi = _difference("green", "nir", "Normalized difference water index.")
mndwi = _difference("green", "swir1", "Modified normalized difference water index.")
ndci = _difference("rededge", "red", "Normalized difference chlorophyll index.")
ndmi = _difference("nir", "swir1", "Normalized difference moisture index.")
nbr = _difference("nir", "swir2", "Normalized burn ratio.")
ndsi = _difference("green", "swir1", "Normalized difference snow index.")


def evi(*, nir, red, blue) -> Column:
    """Enhanced vegetation index."""
    n, r, b = _d(nir), _d(red), _d(blue)
    return F.try_divide(F.lit(2.5) * (n - r), n + F.lit(6.0) * r - F.lit(7.5) * b + F.lit(1.0) + F.lit(EPS))


def evi2(*, nir, red) -> Column:
    """Enhanced vegetation index of two bands."""
    n, r = _d(nir), _d(red)
    return F.try_divide(F.lit(2.5) * (n - r), n + F.lit(2.4) * r + F.lit(1.0) + F.lit(EPS))


def savi(*, nir, red) -> Column:
    """Soil adjusted vegetation index with L = 0.5."""
    n, r = _d(nir), _d(red)
    return F.try_divide(n - r, n + r + F.lit(0.5) + F.lit(EPS)) * F.lit(1.5)


def msavi2(*, nir, red) -> Column:
    """Modified soil adjusted vegetation index."""
    n, r = _d(nir), _d(red)
    t = F.lit(2.0) * n + F.lit(1.0)
    return (t - F.sqrt(F.greatest(t * t - F.lit(8.0) * (n - r), F.lit(0.0)))) / F.lit(2.0)


def bsi(*, swir1, red, nir, blue) -> Column:
    """Bare soil index."""
    a, b = _d(swir1) + _d(red), _d(nir) + _d(blue)
    return F.try_divide(a - b, a + b + F.lit(EPS))


#: name -> (function, bands it takes)
INDICES: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "ndvi": (ndvi, ("nir", "red")),
    "evi": (evi, ("nir", "red", "blue")),
    "evi2": (evi2, ("nir", "red")),
    "savi": (savi, ("nir", "red")),
    "msavi2": (msavi2, ("nir", "red")),
    "ndre": (ndre, ("nir", "rededge")),
    "bsi": (bsi, ("swir1", "red", "nir", "blue")),
    "ndbi": (ndbi, ("swir1", "nir")),
    "ndwi": (ndwi, ("green", "nir")),
    "mndwi": (mndwi, ("green", "swir1")),
    "ndci": (ndci, ("rededge", "red")),
    "ndmi": (ndmi, ("nir", "swir1")),
    "nbr": (nbr, ("nir", "swir2")),
    "ndsi": (ndsi, ("green", "swir1")),
}


def index(name: str, bands: dict[str, Column | str]) -> Column:
    """The index by name over a mapping of band roles to columns."""
    if name not in INDICES:
        raise ValueError(f"unknown index {name!r}; known: {', '.join(sorted(INDICES))}")
    f, roles = INDICES[name]
    missing = [r for r in roles if r not in bands]
    if missing:
        raise ValueError(f"{name} needs the bands {', '.join(missing)}")
    return f(**{r: bands[r] for r in roles})

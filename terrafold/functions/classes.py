"""Masks, class codes, probabilities and display values as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed class codes of the scene classification that count as not clear; 11 (snow) does not.
SCL_MASKED = (0, 1, 3, 8, 9, 10)
CIRRUS_THRESHOLD = 0.01

#: Fixed nodata values: floats NaN, unsigned integers their maximum, signed ones their minimum.
_NODATA = {"float32": math.nan, "float64": math.nan, "uint8": 255, "uint16": 65535, "uint32": 4294967295, "int8": -128, "int16": -32768, "int32": -2147483648}


def cirrus_mask(b10: Column) -> Column:
    return b10 > F.lit(CIRRUS_THRESHOLD)


def scl_mask(code: Column) -> Column:
    return code.isin(*SCL_MASKED)


def default_nodata(dtype: str) -> float:
    if dtype not in _NODATA:
        raise ValueError(f"{dtype} has no nodata value")
    return _NODATA[dtype]


def nodata_to_null(value: Column, *nodata: float) -> Column:
    return F.when(~value.isin(*[float(v) for v in nodata]) & ~F.isnan(value), value)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; null or empty arrays stay as they are."""
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def top_class(probabilities: Column) -> tuple[Column, Column]:
    """(class from 0, confidence); the first class of equal ones."""
    best = F.array_max(probabilities)
    return (F.array_position(probabilities, best) - 1).cast("int"), best


def apply_thresholds(pred: Column, p: Column, thresholds: list[float], *, ignore_index: int = 255, mask: Column | None = None) -> Column:
    """The predicted class if its confidence reaches the class's threshold and it isn't masked, else ignore_index."""
    keep = p >= F.get(F.array(*map(F.lit, thresholds)), pred)
    if mask is not None:
        keep = keep & ~mask
    return F.when(keep, pred).otherwise(F.lit(ignore_index))


def remap(value: Column, mapping: dict[int, int]) -> Column:
    """Label replacement one pair after the other, each on the result of the one before: {0: 1, 1: 2} sends 0 to 2."""
    for old, new in mapping.items():
        value = F.when(value == old, F.lit(new)).otherwise(value)
    return value


def hex_channel(color: Column, channel: int) -> Column:
    """Red, green or blue (0, 1, 2) of '#rrggbb'."""
    return F.conv(F.substring(F.regexp_replace(color, "^#", ""), 1 + 2 * channel, 2), 16, 10).cast("int")


def colorize(code: Column, palette: dict[int, str], default: str = "#000000") -> Column:
    entries = [x for k, v in palette.items() for x in (F.lit(k), F.lit(v))]
    known = F.try_element_at(F.create_map(*entries), code.cast("int")) if entries else F.lit(None).cast("string")
    return F.coalesce(known, F.lit(default))


def stretch(value: Column, low: Column, high: Column) -> Column:
    """Linear stretch of [low, high] to [0, 1], clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low + F.lit(1e-8))))


def panel_kind(n_bands: Column, is_float: Column, n_values: Column, most: int = 32) -> Column:
    """How a layer is shown: rgb from three bands on, else by type and number of distinct values; two bands are a fallback."""
    return F.when(n_bands >= 3, "rgb").when(n_bands == 2, "fallback").when(is_float, "continuous").when(n_values <= most, "categorical").otherwise("continuous")


def hann(i: Column, n: int) -> Column:
    """Non-periodic Hann window of n points at point i."""
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi) * i / F.lit(float(n - 1)))


def yolo_to_corners(cx: Column, cy: Column, w: Column, h: Column, width: float, height: float) -> list[Column]:
    """x0, y0, x1, y1 in pixels of a box given by centre and size in shares of the image."""
    return [(cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height]


def corners_to_yolo(x0: Column, y0: Column, x1: Column, y1: Column, width: float, height: float) -> list[Column]:
    return [(x0 + x1) / 2 / width, (y0 + y1) / 2 / height, (x1 - x0) / width, (y1 - y0) / height]


def time_encoding(ts: Column) -> list[Column]:
    """sin and cos of the ISO week of 52 and of the hour of 24."""
    week, hour = F.weekofyear(ts) * F.lit(2 * math.pi / 52), F.hour(ts) * F.lit(2 * math.pi / 24)
    return [F.sin(week), F.cos(week), F.sin(hour), F.cos(hour)]


def location_encoding(lat: Column, lon: Column) -> list[Column]:
    return [F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon))]

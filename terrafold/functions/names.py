"""Canonical forms of tile codes, split names, sources and product identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed form of a product identifier: satellite, level, sensing time, [N baseline,] orbit, tile, generation time.
PRODUCT = r"(S2[ABC])_MSI(?:L)?(1C|2A)_(\d{8}T\d{6})(?:_N(\d{4}))?_R(\d{3})_T(\d{2}[A-Z]{3})_(\d{8}T\d{6})"


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def product_part(name: Column, group: int) -> Column:
    """One part of a product identifier, whatever its case, folders and ending; null where the name has none.

    Of several identifiers in one path the last counts.
    """
    return _or_null(F.regexp_extract(F.upper(name), r"(?s).*" + PRODUCT, group))


def product_parts(*names: Column) -> Column:
    """The parts of the first name that is a product identifier as an array of seven, '' for a missing baseline; null if none is.

    The pattern is run once per name, where single parts would run it once each.
    """
    whole = r"(?s).*" + PRODUCT + ".*"
    each = F.transform(F.array(*[F.upper(n) for n in names]), lambda n: F.split(F.regexp_replace(n, whole, "$1|$2|$3|$4|$5|$6|$7"), r"\|"))
    return F.get(F.filter(each, lambda p: F.size(p) == 7), F.lit(0))


def tile_code(tile: Column, product: Column | None = None) -> Column:
    """MGRS tile as two-digit zone and three capitals; a code that can't be read is taken from the product name."""
    text = F.regexp_replace(F.upper(tile), r"[^0-9A-Z]", "")
    zone, square = F.regexp_extract(text, r"(\d{1,2})([A-Z]{3})$", 1), F.regexp_extract(text, r"(\d{1,2})([A-Z]{3})$", 2)
    code = F.when(square != "", F.concat(F.lpad(zone, 2, "0"), square))
    return code if product is None else F.coalesce(code, product_part(product, 6))


def split_name(split: Column) -> Column:
    """train, val or test by the first letters, without regard to case and outer blanks; null for anything else."""
    s = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    return F.when(s.startswith("tr"), "train").when(s.startswith("v"), "val").when(s.startswith("te"), "test")


def source_name(source: Column) -> Column:
    """A source without regard to case and outer blanks; null and blank are null."""
    return _or_null(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")))

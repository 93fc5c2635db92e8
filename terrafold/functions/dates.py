"""Date ranges in reduced or full ISO 8601 form, as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern: year to microsecond, extended or compact, with an optional offset.
STAMP = r"^\s*(\d{4})(?:-?(\d{2})(?:-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?)?)?)?\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?\s*$"


def _parts(text: Column) -> Column:
    """The eight groups of the pattern as an array, '' for one that isn't there; another size if the text doesn't match."""
    return F.split(F.regexp_replace(text, STAMP, "$1|$2|$3|$4|$5|$6|$7|$8"), r"\|")


def _with_parts(text: Column, build) -> Column:
    """build(parts) with the parts worked out once; null if the text can't be read."""
    one = F.get(F.transform(F.array(_parts(text)), build), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(STAMP)), one)


def _number(parts: Column, i: int, least: int) -> Column:
    return F.coalesce(F.when(parts[i] != "", parts[i].cast("int")), F.lit(least))


def _start(p: Column) -> Column:
    fraction = F.rpad(F.substring(p[6], 1, 6), 6, "0")
    second = F.concat(F.when(p[5] != "", p[5]).otherwise("0"), F.lit("."), fraction).cast("decimal(16,6)")
    local = F.try_make_timestamp_ntz(_number(p, 0, 0), _number(p, 1, 1), _number(p, 2, 1), _number(p, 3, 0), _number(p, 4, 0), second)
    digits = F.regexp_replace(p[7], "[^0-9]", "")
    size = F.when(F.length(digits) >= 2, F.substring(digits, 1, 2).cast("int") * 60).otherwise(0) + F.when(F.length(digits) == 4, F.substring(digits, 3, 2).cast("int")).otherwise(0)
    return local - F.make_dt_interval(mins=F.when(p[7].startswith("-"), -size).otherwise(size).cast("int"))


def _depth(p: Column) -> Column:
    return sum((F.when(p[i] != "", 1).otherwise(0) for i in range(7)), F.lit(0))


def stamp_depth(text: Column) -> Column:
    """How many of year, month, day, hour, minute, second, fraction the text states; 0 if it can't be read."""
    return F.coalesce(_with_parts(text, _depth), F.lit(0))


def parse_start(text: Column) -> Column:
    """Earliest moment of the text in UTC as timestamp_ntz; times without offset are UTC; null if it can't be read."""
    return _with_parts(text, _start)


def parse_end(text: Column) -> Column:
    """Last microsecond of the period the text names, in UTC."""

    def end(p: Column) -> Column:
        start, depth = _start(p), _depth(p)
        months = F.when(depth == 1, 12).when(depth == 2, 1).otherwise(0)
        step = F.when(depth == 3, 86400).when(depth == 4, 3600).when(depth == 5, 60).when(depth == 6, 1).otherwise(0)
        micro = F.make_dt_interval(secs=F.lit(0.000001).cast("decimal(18,6)"))
        after = F.when(depth <= 2, start + F.make_ym_interval(F.lit(0), months)).otherwise(start + F.make_dt_interval(secs=step.cast("decimal(18,6)")))
        return F.when(depth == 7, start).otherwise(after - micro)

    return _with_parts(text, end)


def parse_range(text: Column, last: Column | None = None) -> tuple[Column, Column]:
    """(start, end) of one text, of two with / between, or of a pair; an end that is empty or .. is open and null."""
    open_ = lambda c: F.when(~F.trim(c).isin("", ".."), F.trim(c))
    if last is not None:
        return parse_start(open_(text)), parse_end(open_(last))
    parts = F.split(text, "/", 2)
    return parse_start(open_(F.get(parts, F.lit(0)))), parse_end(open_(F.get(parts, F.size(parts) - 1)))

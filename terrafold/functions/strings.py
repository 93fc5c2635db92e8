"""Keys, file name dates and place names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a date at the beginning of a word of a file name looks like.
DATE_WORD = r"^\d{8}(T\d{6})?"
#: Fixed list of administrative suffixes.
ADMIN_SUFFIX = r"(?i)\s+(Province|State|Region|District|Prefecture|Department|Governorate|Oblast|Krai|County|Municipality)$"


def file_stem(path: Column) -> Column:
    """The last path component without its ending; a trailing slash doesn't count."""
    name = F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extract_key(path: Column, pattern: str | None = None, *, strict: bool = False) -> Column:
    """Sample key of a path: its stem, or the first group (else the whole match) of a pattern over the file name.

    Without a match the key is null, or an error if ``strict``.
    """
    if pattern is None:
        return file_stem(path)
    import re

    name = F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)
    key = F.regexp_extract(name, pattern, 1 if re.compile(pattern).groups else 0)
    miss = F.raise_error(F.concat(F.lit("no key in "), name)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(F.regexp_like(name, F.lit(pattern)), key).otherwise(miss)


def stem_dates(stem: Column) -> Column:
    """'a' or 'a/b' of the dates in a stem; null where it has none.

    The words of a stem are parted by - and _; the first one behind another word that begins with a date gives it, and
    if it is no more than a date the next word may give the end.
    """
    words = F.split(stem, "[-_]")
    date = lambda w: F.regexp_extract(w, DATE_WORD, 0)
    later = F.when(F.size(words) > 1, F.slice(words, 2, F.size(words)))
    dated = F.filter(F.transform(later, lambda w, i: F.struct(w.alias("word"), F.get(later, i + 1).alias("next"))), lambda p: date(p["word"]) != "")
    first = F.get(dated, F.lit(0))
    start = date(first["word"])
    end = F.when(first["word"] == start, date(first["next"]))
    return F.when(first.isNotNull(), F.when(F.coalesce(end, F.lit("")) != "", F.concat_ws("/", start, end)).otherwise(start))


def compact_range(start: Column, end: Column) -> Column:
    """Shortest token that names the range, else one token for each side, joined by '-'."""
    depths = ["yyyy", "yyyyMM", "yyyyMMdd", "yyyyMMdd'T'HH", "yyyyMMdd'T'HHmm", "yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmmss.SSSSSS"]
    micro = F.expr("INTERVAL '0.000001' SECOND")
    steps = [F.expr(f"INTERVAL '1' {u}") for u in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")]
    units = ["YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"]
    last = lambda t, k: F.date_trunc(units[k], t) + steps[k] - micro
    one = two_a = two_b = None
    for k in range(6):
        floor = F.date_trunc(units[k], start).cast("timestamp_ntz") == start
        ceil = last(end, k).cast("timestamp_ntz") == end
        same = last(start, k).cast("timestamp_ntz") == end
        put = lambda acc, cond, t: F.when(cond, F.date_format(t, depths[k])) if acc is None else acc.when(cond, F.date_format(t, depths[k]))  # noqa: B023, E731
        one, two_a, two_b = put(one, floor & same, start), put(two_a, floor, start), put(two_b, ceil, end)
    full = lambda t: F.date_format(t, depths[6])
    return F.coalesce(one, F.when(start == end, full(start)), F.concat_ws("-", F.coalesce(two_a, full(start)), F.coalesce(two_b, full(end))))


def strip_admin_suffix(name: Column) -> Column:
    out = F.trim(F.regexp_replace(name, ADMIN_SUFFIX, ""))
    return F.when(out != "", out)


def address(parts: list[Column], region_chain: list[Column], country: Column) -> Column:
    """Comma-joined non-null parts, the first known of the region's names, and the country."""
    return F.concat_ws(", ", *parts, strip_admin_suffix(F.coalesce(*region_chain)), country)

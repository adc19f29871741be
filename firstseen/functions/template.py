"""Destination templates rendered from a file's modification time.

The template is split at its tokens once, on the driver; per row only a
``concat`` of literals and date parts remains. Dates are computed from the epoch
value itself, so no result depends on the session time zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six tokens a template may contain.
TOKENS = ("{year_utc}", "{month_utc}", "{day_utc}", "{year_local}", "{month_local}", "{day_local}")

_SPLIT = re.compile("(" + "|".join(map(re.escape, TOKENS)) + ")")
_PART = {"year": F.year, "month": F.month, "day": F.dayofmonth}

NS_PER_DAY = 86_400 * 1_000_000_000
US_PER_DAY = 86_400 * 1_000_000


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def valid_time(ns: Column) -> Column:
    return ns.isNotNull() & (ns >= 0)


def utc_date(ns: Column) -> Column:
    """UTC calendar date of an epoch-nanosecond value; NULL when invalid."""
    return F.when(valid_time(ns), F.date_from_unix_date(_div(ns, NS_PER_DAY).cast("int")))


def local_date(ns: Column, tz: str) -> Column:
    """Calendar date in zone ``tz``; NULL when invalid."""
    shifted = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(_div(ns, 1_000)), tz))
    day_start = shifted - F.pmod(shifted, F.lit(US_PER_DAY))
    return F.when(valid_time(ns), F.date_from_unix_date(_div(day_start, US_PER_DAY).cast("int")))


def tokens_in(template: str) -> list[str]:
    return [token for token in TOKENS if token in template]


def token_value(token: str, ns: Column, tz: str) -> Column:
    part, zone = token.strip("{}").split("_")
    date = utc_date(ns) if zone == "utc" else local_date(ns, tz)
    return _PART[part](date).cast("string")


def render(template: str, mtime_ns: Column, tz: str) -> Column:
    """Rendered template; NULL when a token is used and the time is invalid."""
    pieces = [p for p in _SPLIT.split(template) if p]
    columns = [token_value(p, mtime_ns, tz) if p in TOKENS else F.lit(p) for p in pieces]
    return F.concat(*columns) if columns else F.lit("")


def _prefix(template: str, mtime_ns: Column, tz: str) -> Column:
    prefix = render(template, mtime_ns, tz)
    return F.concat(prefix, F.lit("/")) if template and not template.endswith("/") else prefix


def destination(template: str, mtime_ns: Column, rel_path: Column, tz: str) -> Column:
    """Rendered prefix joined to a relative path; NULL if either is missing."""
    return F.concat(_prefix(template, mtime_ns, tz), rel_path)


def destination_bytes(template: str, mtime_ns: Column, rel_bytes: Column, tz: str) -> Column:
    """The same over bytes: a path that is not valid UTF-8 stays as it is."""
    return F.concat(_prefix(template, mtime_ns, tz).cast("binary"), rel_bytes)

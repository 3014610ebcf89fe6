"""Time parsing, formatting and the resolution of time ranges to literals."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted time formats, first hit wins.
SEARCH_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "yyyy-MM-dd'T'HH:mm",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
]
STRICT_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
]
# Relative ranges that end now.
RELATIVE = {
    "last-hour": dt.timedelta(hours=1),
    "last-day": dt.timedelta(days=1),
    "last-week": dt.timedelta(weeks=1),
    "last-month": dt.timedelta(days=30),
    "last-year": dt.timedelta(days=365),
}
_PY_FORMATS = [
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%d %H:%M",
    "%Y-%m-%d",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M:%SZ",
    "%Y-%m-%dT%H:%M:%S.%fZ",
    "%Y-%m-%dT%H:%M",
    "%m/%d/%Y %H:%M:%S",
    "%m/%d/%Y %H:%M",
    "%m/%d/%Y",
    "%d/%m/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M",
    "%d/%m/%Y",
]


# Fixed value: RFC 3339, with a fraction of any length and an offset.
RFC3339_PATTERN = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def parse_search_time(text: Column) -> Column:
    """The first format that fits, else RFC 3339; digits below microseconds are cut off."""
    general = F.when(text.rlike(RFC3339_PATTERN), F.upper(text).try_cast("timestamp"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in SEARCH_FORMATS], general)


def parse_strict_time(text: Column) -> Column:
    """ISO, SQL or date text, else whole Unix seconds."""
    seconds = F.when(text.rlike(r"^[+-]?\d+$"), F.timestamp_seconds(text.try_cast("long")))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in STRICT_FORMATS], seconds)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def rfc3339(ts: Column) -> Column:
    """RFC 3339 in UTC; the fraction has 0, 3 or 6 digits, as few as are exact."""
    micros = F.unix_micros(ts) % 1_000_000
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = (
        F.when(micros == 0, F.lit(""))
        .when(micros % 1000 == 0, F.date_format(ts, ".SSS"))
        .otherwise(F.date_format(ts, ".SSSSSS"))
    )
    return F.concat(base, fraction, F.lit("+00:00"))


def floor_div(value: Column, size: int) -> Column:
    """Exact floor division of a long; a division through double loses digits."""
    if size == 1:
        return value
    return F.call_function("div", value - F.pmod(value, F.lit(size)), F.lit(size))


def ns_to_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ns, 1000))


def ns_to_date(ns: Column) -> Column:
    return F.to_date(ns_to_timestamp(ns))


# -- ranges: resolved on the driver, so that scans see plain literals ------------


def _parse_py(text: str) -> dt.datetime:
    text = text.strip()
    for fmt in _PY_FORMATS:
        try:
            return dt.datetime.strptime(text, fmt)
        except ValueError:
            continue
    try:
        stamp = dt.datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"cannot read time: {text!r}") from None
    if stamp.tzinfo:
        stamp = stamp.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return stamp


def search_range(text: str, as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """``today``, ``last-week``, ``a..b`` or ``a to b`` as a closed UTC range."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    last_second = dt.timedelta(hours=23, minutes=59, seconds=59)
    word = text.strip().lower()
    if word == "today":
        return midnight, midnight + last_second
    if word == "yesterday":
        start = midnight - dt.timedelta(days=1)
        return start, start + last_second
    if word in RELATIVE:
        return as_of - RELATIVE[word], as_of
    parts = text.split("..") if ".." in text else re.split(r" to ", text)
    if len(parts) != 2:
        raise ValueError(f"time range must be 'start..end' or 'start to end': {text!r}")
    start, end = _parse_py(parts[0]), _parse_py(parts[1])
    if start > end:
        raise ValueError("start time must not be after end time")
    return start, end


def _parse_strict_py(text: str) -> dt.datetime:
    for fmt in ("%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return dt.datetime.strptime(text, fmt)
        except ValueError:
            continue
    if re.fullmatch(r"[+-]?\d+", text):
        return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(text))
    raise ValueError(f"cannot read time: {text!r}")


def service_range(text: str, as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """The stricter form: today ends now, a single time opens one hour."""
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    day = dt.timedelta(days=1)
    if text == "today":
        return midnight, as_of
    if text == "yesterday":
        return midnight - day, midnight
    if ".." in text:
        parts = text.split("..")
        if len(parts) != 2:
            raise ValueError(f"time range must be 'start..end': {text!r}")
        start, end = _parse_strict_py(parts[0]), _parse_strict_py(parts[1])
        if start >= end:
            raise ValueError("start time must be before end time")
        return start, end
    start = _parse_strict_py(text)
    return start, start + dt.timedelta(hours=1)


def time_literal(frame: DataFrame, column: str, value: dt.datetime) -> Column:
    """A literal of the column's own type, so that the filter reaches the scan."""
    kind = frame.schema[column].dataType
    micros = (value - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    if isinstance(kind, T.LongType):
        return F.lit(micros * 1000)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(micros))


def in_range(
    frame: DataFrame, column: str, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> Column:
    """Closed at both ends; without an end it is open there."""
    inside = F.lit(True)
    if start is not None:
        inside = F.col(column) >= time_literal(frame, column, start)
    if end is not None:
        inside = inside & (F.col(column) <= time_literal(frame, column, end))
    return inside

"""Sizes, durations and rates as text, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names in rising order.
UNITS = ["B", "KB", "MB", "GB", "TB"]


def fixed(value: Column, digits: int) -> Column:
    """A non-negative double with ``digits`` decimals, rounded by its exact binary value.

    ``format_string`` rounds the shortest decimal form instead, which turns 2.085
    (a little below the tie) into 2.09. Here the rounding error of the product with
    the power of ten is computed too (Dekker's product), and it decides the ties.
    """
    power = float(10**digits)
    v = value.cast("double")
    split = v * F.lit(134217729.0)
    high = split - (split - v)
    low = v - high
    product = v * F.lit(power)
    error = (high * F.lit(power) - product) + low * F.lit(power)
    whole = F.floor(product)
    past_half = (product - whole.cast("double") - F.lit(0.5)) + error
    up = (past_half > 0) | ((past_half == 0) & (whole % 2 == 1))
    scaled = whole + up.cast("long")
    units = F.call_function("div", scaled, F.lit(10**digits)).cast("string")
    rest = F.lpad((scaled % 10**digits).cast("string"), digits, "0")
    return F.concat(units, F.lit("."), rest)


def bytes_binary(size: Column) -> Column:
    """Base 1024, one decimal above bytes."""
    text = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(UNITS[1:], start=1):
        step = float(1024**power)
        text = F.when(
            size >= F.lit(step),
            F.concat(fixed(size.cast("double") / step, 1), F.lit(f" {unit}")),
        ).otherwise(text)
    return text


def bytes_decimal(size: Column) -> Column:
    """Base 1000, two decimals, up to PB; zero is ``0 B``."""
    value = size.cast("double")
    power = F.greatest(F.floor(F.log10(value) / 3), F.lit(0))
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (power + 1).cast("int"))
    scaled = fixed(value / F.pow(F.lit(1000.0), power), 2)
    huge = F.concat(fixed(value / 1e15, 2), F.lit(" PB"))
    return (
        F.when(value == 0, F.lit("0 B"))
        .when(power < len(UNITS), F.concat(scaled, F.lit(" "), unit))
        .otherwise(huge)
    )


def parse_bytes(text: Column) -> Column:
    """``1.5GB`` to bytes; a bare number is bytes, anything else is null."""
    clean = F.upper(F.trim(text))
    pattern = r"^([0-9]*\.?[0-9]+)(B|KB|MB|GB|TB)?$"
    number = F.regexp_extract(clean, pattern, 1)
    unit = F.regexp_extract(clean, pattern, 2)
    factor = reduce(
        lambda chain, item: chain.when(unit == item[1], F.lit(float(1024 ** item[0]))),
        list(enumerate(UNITS))[1:],
        F.when(unit.isin("B", ""), F.lit(1.0)),
    )
    return F.when(number != "", (number.cast("double") * factor).cast("long"))


def duration(millis: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s``, ``1.234s`` or ``12ms``."""
    total = F.floor(millis / 1000).cast("long")
    hours, minutes, seconds = (
        F.floor(total / 3600).cast("long"),
        F.floor(total % 3600 / 60).cast("long"),
        total % 60,
    )
    return (
        F.when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, seconds))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, seconds))
        .when(seconds > 0, F.format_string("%d.%03ds", seconds, millis.cast("long") % 1000))
        .otherwise(F.format_string("%dms", millis.cast("long")))
    )


def rate(value: Column, unit: str) -> Column:
    return (
        F.when(value >= 1e6, F.concat(fixed(value / 1e6, 2), F.lit(f"M {unit}/s")))
        .when(value >= 1e3, F.concat(fixed(value / 1e3, 2), F.lit(f"K {unit}/s")))
        .otherwise(F.concat(fixed(value, 2), F.lit(f" {unit}/s")))
    )


def mb_per_hour(bytes_per_second: Column) -> Column:
    return bytes_per_second * 3600.0 / (1024.0 * 1024.0)


def mb_per_day(bytes_per_second: Column) -> Column:
    return bytes_per_second * 86400.0 / (1024.0 * 1024.0)

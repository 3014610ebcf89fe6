"""Exact order statistics per group, without sorting a huge group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import running

# Zero-based index of the wanted value in the sorted group of n values. ``floor``
# takes a share, ``nearest`` a percentage.
INDEX_RULES: dict[str, Callable[[Column, float], Column]] = {
    "floor": lambda n, p: F.least(F.floor(n * F.lit(p)), n - 1).cast("long"),
    "nearest": lambda n, p: F.least(F.round((n - 1) * F.lit(float(p)) / 100.0), n - 1).cast(
        "long"
    ),
    "lower_middle": lambda n, p: F.floor((n - 1) / 2).cast("long"),
    "upper_middle": lambda n, p: F.floor(n / 2).cast("long"),
}


def order_stats(
    frame: DataFrame,
    keys: list[str],
    value: str,
    wanted: dict[str, tuple[str, float]],
    parts: int | None = None,
) -> DataFrame:
    """One row per group: ``keys`` and, per name in ``wanted``, the value at
    the index given by ``(rule, p)``.

    Equal values are counted first. A running count over ranges of (keys, value) then
    tells which indexes a value holds; a group of any size takes part in as many tasks
    as it has ranges. Null keys are a group, null values are left out.
    """
    counts = frame.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    placed = running(counts, keys, ["_v"], {"_cum": ("sum", F.col("_c"))}, parts=parts)
    group = F.struct(*keys) if keys else F.struct(F.lit(0))
    sizes = placed.groupBy(group.alias("_g")).agg(F.max("_cum").alias("_n"))
    placed = placed.withColumn("_g", group).join(sizes, "_g")

    def holds(name: str) -> Column:
        rule, p = wanted[name]
        index = INDEX_RULES[rule](F.col("_n"), p)
        return (index < F.col("_cum")) & (index >= F.col("_cum") - F.col("_c"))

    return placed.groupBy(*keys).agg(
        *[F.max(F.when(holds(name), F.col("_v"))).alias(name) for name in wanted]
    )

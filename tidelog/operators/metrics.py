"""Metrics: latency reports, baselines, growth, rates, summaries of runs and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import formats as fm
from tidelog.operators.ranks import order_stats

# Change in percent that counts.
CHANGE_PERCENT = 5.0
# Limits of a healthy resource sample and of the default baseline.
CPU_PERCENT, MEMORY_PERCENT, DISK_PERCENT = 80.0, 85.0, 90.0
BASELINE = {"latency_ms": 100.0, "throughput": 1000.0, "memory_mb": 500.0, "cpu_percent": 80.0}
HEALTHY_ERRORS, HEALTHY_UTILIZATION = 10, 80.0
LEAK_SAMPLES, LEAK_SHARE, LEAK_RATE = 10, 0.7, 0.01

# Named aggregates: add an entry to add a metric.
MEASURES = {
    "n": lambda v: F.count(v),
    "mean": lambda v: F.avg(v),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "total": lambda v: F.sum(v),
    "stddev_pop": lambda v: F.stddev_pop(v),
}


def measure(name: str, value: Column) -> Column:
    return MEASURES[name](value).alias(name)


def _with_ranks(
    samples: DataFrame,
    key: str,
    value: str,
    aggregates: list[Column],
    wanted: dict[str, tuple[str, float]],
    parts: int | None,
) -> DataFrame:
    ranks = order_stats(samples, [key], value, wanted, parts)
    # A null key is a group, and so is one whose values are all null.
    ranks = ranks.withColumnRenamed(key, "_key")
    report = samples.groupBy(key).agg(*aggregates)
    return report.join(ranks, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def latency_report(
    samples: DataFrame, key: str, value: str, parts: int | None = None
) -> DataFrame:
    """n, mean, min, max, median, p95, p99 and population deviation per metric."""
    v = F.col(value)
    wanted = {
        "_low": ("lower_middle", 0.5),
        "_high": ("upper_middle", 0.5),
        "p95": ("floor", 0.95),
        "p99": ("floor", 0.99),
    }
    names = ["n", "mean", "min", "max", "stddev_pop"]
    report = _with_ranks(samples, key, value, [measure(m, v) for m in names], wanted, parts)
    median = (F.col("_low") + F.col("_high")) / 2
    return report.withColumn("median", median).drop("_low", "_high")


def latency_percentiles(
    samples: DataFrame, key: str, value: str, parts: int | None = None
) -> DataFrame:
    """p50, p95 and p99 as elements of the sample, with max and mean."""
    wanted = {"p50": ("floor", 0.50), "p95": ("floor", 0.95), "p99": ("floor", 0.99)}
    aggregates = [measure("max", F.col(value)), measure("mean", F.col(value))]
    return _with_ranks(samples, key, value, aggregates, wanted, parts)


def stats_set(
    samples: DataFrame,
    key: str,
    value: str,
    percents: tuple[float, ...] = (90.0, 95.0),
    parts: int | None = None,
) -> DataFrame:
    """Mean, median, percentiles by nearest index, sample deviation (0 below two values)."""
    wanted = {"_low": ("lower_middle", 0.5), "_high": ("upper_middle", 0.5)}
    wanted.update({f"pct{p:g}": ("nearest", p) for p in percents})
    spread = F.when(F.count(value) < 2, 0.0).otherwise(F.stddev_samp(value)).alias("stddev")
    report = _with_ranks(samples, key, value, [measure("mean", F.col(value)), spread], wanted, parts)
    return report.withColumn("median", (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")


def baseline_compare(averages: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """``averages`` (key, mean) against ``baselines`` (key, baseline). Without a
    baseline the comparison is null."""
    joined = averages.join(baselines, key, "left")
    change = (F.col("mean") - F.col("baseline")) / F.col("baseline") * 100.0
    return joined.withColumn("change_percent", change).withColumns(
        {
            "is_regression": F.col("change_percent") > CHANGE_PERCENT,
            "is_improvement": F.col("change_percent") < -CHANGE_PERCENT,
        }
    )


def threshold_check(rows: DataFrame, baseline: dict[str, float] = BASELINE) -> DataFrame:
    """One row per violated limit: throughput must reach its limit, the rest stay under."""
    checks = [
        F.when(
            F.col(name) < bound if name == "throughput" else F.col(name) > bound,
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).cast("double").alias("actual"),
                F.lit(float(bound)).alias("bound"),
            ),
        )
        for name, bound in baseline.items()
    ]
    kept = [c for c in rows.columns if c not in baseline]
    return rows.select(*kept, F.explode(F.array_compact(F.array(*checks))).alias("v")).select(
        *kept, "v.*"
    )


def profile(samples: DataFrame, key: str, value: str) -> DataFrame:
    v = F.col(value)
    return samples.groupBy(key).agg(
        F.count(v).alias("calls"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.greatest(F.max(v), F.lit(0.0)).alias("max"),
    )


def resource_alert() -> Column:
    memory = F.col("used_mb") / F.col("total_mb") * 100.0
    return (
        (F.col("cpu") > CPU_PERCENT) | (memory > MEMORY_PERCENT) | (F.col("disk") > DISK_PERCENT)
    )


def resource_summary(samples: DataFrame, ts: str) -> DataFrame:
    memory = F.col("used_mb") / F.col("total_mb") * 100.0
    return samples.agg(
        F.coalesce(F.avg("cpu"), F.lit(0.0)).alias("avg_cpu"),
        F.coalesce(F.greatest(F.max("cpu"), F.lit(0.0)), F.lit(0.0)).alias("max_cpu"),
        F.coalesce(F.avg(memory), F.lit(0.0)).alias("avg_memory"),
        F.coalesce(F.greatest(F.max(memory), F.lit(0.0)), F.lit(0.0)).alias("max_memory"),
        F.count_if(resource_alert()).alias("alerts"),
        F.coalesce(F.max(ts) - F.min(ts), F.lit(0)).alias("duration"),
    )


def growth(samples: DataFrame, key: str, value: str, ts_us: str, unique: str) -> DataFrame:
    """Peak, mean and change per second between the first and last sample of a key."""
    at = F.struct(ts_us, unique)
    seconds = (F.max(ts_us) - F.min(ts_us)) / 1_000_000.0
    change = F.max_by(value, at) - F.min_by(value, at)
    few = F.count(F.lit(1)) < 2
    return samples.groupBy(key).agg(
        F.when(few, 0.0).otherwise(F.greatest(F.max(value), F.lit(0.0))).alias("peak"),
        F.when(few, 0.0).otherwise(F.avg(value)).alias("mean"),
        F.when(few | (seconds <= 0), 0.0).otherwise(change / seconds).alias("per_second"),
    )


def leak_trend(
    samples: DataFrame,
    key: str,
    value: str,
    ts_us: str,
    unique: str,
    min_rate: float = LEAK_RATE,
) -> DataFrame:
    """Keys whose last ten samples mostly rise, with their rate and confidence.

    Only ten rows per key pass the first window; Spark limits it per task before
    the shuffle, so the length of a key's history does not matter.
    """
    newest = Window.partitionBy(key).orderBy(F.col(ts_us).desc(), F.col(unique).desc())
    last = samples.withColumn("_rn", F.row_number().over(newest)).filter(
        F.col("_rn") <= LEAK_SAMPLES
    )
    rises = last.withColumn("_before", F.lead(value).over(newest))
    at = F.struct(ts_us, unique)
    seconds = (F.max(ts_us) - F.min(ts_us)) / 1_000_000.0
    per_key = rises.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.count_if(F.col(value) > F.col("_before")) / (F.count(F.lit(1)) - 1)).alias("confidence"),
        F.when(seconds > 0, (F.max_by(value, at) - F.min_by(value, at)) / seconds)
        .otherwise(0.0)
        .alias("per_second"),
    )
    return per_key.withColumn(
        "leak",
        (F.col("_n") >= LEAK_SAMPLES)
        & (F.col("confidence") > LEAK_SHARE)
        & (F.col("per_second") > min_rate),
    ).drop("_n")


# -- summaries of sources, runs and stores -------------------------------------------------


def source_stats(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Per source; expects boolean ``dropped`` and ``failed`` and a ``size``."""
    taken = ~F.col("dropped") & ~F.col("failed")
    return rows.groupBy(key).agg(
        F.count_if(taken).alias("collected"),
        F.count_if("dropped").alias("dropped"),
        F.count_if("failed").alias("errors"),
        F.coalesce(F.avg(F.when(taken, F.col("size"))), F.lit(0.0)).alias("avg_size"),
        F.max(F.when(taken, F.col(ts))).alias("last_event"),
    )


def system_health(per_source: DataFrame, utilization: Column) -> DataFrame:
    sums = per_source.agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum("collected").alias("collected"),
        F.sum("dropped").alias("dropped"),
        F.sum("errors").alias("errors"),
    ).withColumn("utilization", utilization)
    healthy = (F.col("errors") < HEALTHY_ERRORS) & (F.col("utilization") < HEALTHY_UTILIZATION)
    return sums.withColumn("healthy", healthy)


def ingest_stats(rows: DataFrame, failed: Column, seconds: str) -> DataFrame:
    bad, good = F.count_if(failed), F.count_if(~failed)
    return rows.agg(
        good.alias("processed"),
        bad.alias("failed"),
        F.when(good + bad > 0, good / (good + bad) * 100.0).otherwise(0.0).alias("success_percent"),
        (F.avg(seconds) * 1000.0).alias("mean_ms"),
    )


def throughput(rows: DataFrame, failed: Column, ts_us: str) -> DataFrame:
    seconds = (F.max(ts_us) - F.min(ts_us)) / 1_000_000.0
    bad, good = F.count_if(failed), F.count_if(~failed)
    return rows.agg(
        good.alias("operations"),
        bad.alias("errors"),
        (good / seconds).alias("per_second"),
        (bad / (good + bad)).alias("error_rate"),
    )


def log_summary(rows: DataFrame, ts_us: str) -> DataFrame:
    n, seconds = F.count(F.lit(1)), (F.max(ts_us) - F.min(ts_us)) / 1_000_000.0
    return rows.agg(
        n.alias("events"),
        F.min(ts_us).alias("oldest"),
        F.max(ts_us).alias("newest"),
        F.when(seconds > 0, n / seconds).otherwise(0.0).alias("per_second"),
    )


def rate_units(rows: DataFrame, key: str, size: Column, ts_us: str) -> DataFrame:
    per_second = F.sum(size) / ((F.max(ts_us) - F.min(ts_us)) / 1_000_000.0)
    rates = rows.groupBy(key).agg(per_second.alias("bytes_per_second"))
    return rates.withColumns(
        {
            "mb_per_hour": fm.mb_per_hour(F.col("bytes_per_second")),
            "mb_per_day": fm.mb_per_day(F.col("bytes_per_second")),
        }
    )


def run_ledger(runs: DataFrame, key: str, failed: Column, seconds: str) -> DataFrame:
    return runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(~failed).alias("succeeded"),
        F.count_if(failed).alias("failed"),
        F.avg(seconds).alias("mean_seconds"),
    )

"""Metric queries: samples are the values of events by event type."""

from pyspark.sql import functions as F

from tidelog.operators import metrics as m
from tidelog.plans.base import CHECKS, query
from tidelog.plans.search import K
from tidelog.sources import tables as t


def _samples(spark, root):
    return t.events(spark, root).select(
        F.col("event_type").alias("metric"), "value", "ts_us", "event_id"
    )


def _rounded(frame, keep, names):
    return frame.select(*keep, *[F.round(n, 6).alias(n) for n in names])


_RANKED = (
    "(SELECT event_type AS metric, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, "
    "count(*) OVER (PARTITION BY event_type) AS c FROM events) r"
)


def _floor_at(p: float, name: str) -> str:
    return f"max(value) FILTER (WHERE i = least(CAST(floor(c * {p}::DOUBLE) AS BIGINT), c - 1)) AS {name}"


def _nearest_at(p: int, name: str) -> str:
    return (
        f"max(value) FILTER (WHERE i = least(CAST(round((c - 1)::DOUBLE * {p} / 100) AS BIGINT), c - 1)) "
        f"AS {name}"
    )


@query(
    "latency_report",
    "SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, "
    "round(median(value), 6) AS median, round(stddev_pop(value), 6) AS stddev_pop, "
    + _floor_at(0.95, "p95")
    + ", "
    + _floor_at(0.99, "p99")
    + f" FROM {_RANKED} GROUP BY metric",
)
def latency_report(spark, root):
    report = m.latency_report(_samples(spark, root), "metric", "value")
    return _rounded(report, ["metric", "n", "min", "max", "p95", "p99"], ["mean", "median", "stddev_pop"])


@query(
    "latency_pcts",
    "SELECT metric, max(value) AS max, round(avg(value), 6) AS mean, "
    + ", ".join(_floor_at(p, f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99))
    + f" FROM {_RANKED} GROUP BY metric",
)
def latency_pcts(spark, root):
    report = m.latency_percentiles(_samples(spark, root), "metric", "value")
    return _rounded(report, ["metric", "max", "p50", "p95", "p99"], ["mean"])


@query(
    "stats_set",
    "SELECT metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, "
    "round(stddev_samp(value), 6) AS stddev, "
    + ", ".join(_nearest_at(p, f"pct{p}") for p in (90, 95))
    + f" FROM {_RANKED} GROUP BY metric",
)
def stats_set(spark, root):
    report = m.stats_set(_samples(spark, root), "metric", "value")
    return _rounded(report, ["metric", "pct90", "pct95"], ["mean", "median", "stddev"])


@query(
    "baseline_compare",
    "SELECT metric, round(mean, 6) AS mean, round(baseline, 6) AS baseline, round(change, 6) AS change_percent, "
    "change > 5 AS is_regression, change < -5 AS is_improvement FROM (SELECT *, (mean - baseline) / baseline "
    "* 100 AS change FROM (SELECT event_type AS metric, avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') "
    "AS mean, CASE WHEN event_type <> 'view' THEN avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16') END "
    "AS baseline FROM events GROUP BY event_type))",
)
def baseline_compare(spark, root):
    samples = _samples(spark, root)
    middle = 1_705_363_200_000_000  # 2024-01-16
    averages = (
        samples.filter(F.col("ts_us") >= middle).groupBy("metric").agg(F.avg("value").alias("mean"))
    )
    # Nothing is recorded for views, as for a metric that is new.
    earlier = samples.filter((F.col("ts_us") < middle) & (F.col("metric") != "view"))
    baselines = earlier.groupBy("metric").agg(F.avg("value").alias("baseline"))
    compared = m.baseline_compare(averages, baselines, "metric")
    return _rounded(
        compared,
        ["metric", "is_regression", "is_improvement"],
        ["mean", "baseline", "change_percent"],
    )


_CHECKED = (
    f"(SELECT event_id, value AS latency_ms, {K} * 20.0::DOUBLE AS throughput, user_id * 10.0::DOUBLE "
    "AS memory_mb, (event_id % 100)::DOUBLE AS cpu_percent FROM events)"
)


@query(
    "threshold_check",
    "SELECT event_id, 'latency_ms' AS metric, latency_ms AS actual, 100.0::DOUBLE AS bound FROM "
    f"{_CHECKED} WHERE latency_ms > 100 UNION ALL SELECT event_id, 'throughput', throughput, 1000.0 FROM "
    f"{_CHECKED} WHERE throughput < 1000 UNION ALL SELECT event_id, 'memory_mb', memory_mb, 500.0 FROM "
    f"{_CHECKED} WHERE memory_mb > 500 UNION ALL SELECT event_id, 'cpu_percent', cpu_percent, 80.0 FROM "
    f"{_CHECKED} WHERE cpu_percent > 80",
)
def threshold_check(spark, root):
    rows = t.events(spark, root).select(
        "event_id",
        F.col("value").alias("latency_ms"),
        (F.col("k") * 20.0).alias("throughput"),
        (F.col("user_id") * 10.0).alias("memory_mb"),
        (F.col("event_id") % 100).cast("double").alias("cpu_percent"),
    )
    return m.threshold_check(rows)


@query(
    "profile_agg",
    "SELECT event_type AS metric, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, "
    "min(value) AS min, max(value) AS max FROM events GROUP BY 1",
)
def profile_agg(spark, root):
    profile = m.profile(_samples(spark, root), "metric", "value")
    return profile.select(
        "metric",
        "calls",
        F.round("total", 4).alias("total"),
        F.round("mean", 6).alias("mean"),
        "min",
        "max",
    )


_RESOURCES = (
    f"(SELECT event_id, epoch_us(ts) AS ts_us, least(value, 100) AS cpu, {K} * 10.0::DOUBLE AS used_mb, "
    "1000.0::DOUBLE AS total_mb, (user_id % 101)::DOUBLE AS disk FROM events) s"
)
_ALERT = "(cpu > 80 OR used_mb / total_mb * 100 > 85 OR disk > 90)"


def _resources(spark, root):
    return t.events(spark, root).select(
        "event_id",
        "ts_us",
        F.least("value", F.lit(100.0)).alias("cpu"),
        (F.col("k") * 10.0).alias("used_mb"),
        F.lit(1000.0).alias("total_mb"),
        (F.col("user_id") % 101).cast("double").alias("disk"),
    )


@query(
    "resource_summary",
    "SELECT round(avg(cpu), 6) AS avg_cpu, max(cpu) AS max_cpu, round(avg(used_mb / total_mb * 100), 6) AS avg_memory, "
    f"max(used_mb / total_mb * 100) AS max_memory, count(*) FILTER (WHERE {_ALERT}) AS alerts, "
    f"max(ts_us) - min(ts_us) AS duration FROM {_RESOURCES}",
)
def resource_summary(spark, root):
    summary = m.resource_summary(_resources(spark, root), "ts_us")
    return _rounded(
        summary, ["max_cpu", "max_memory", "alerts", "duration"], ["avg_cpu", "avg_memory"]
    )


@query("metric_alerts", f"SELECT event_id FROM {_RESOURCES} WHERE {_ALERT}")
def metric_alerts(spark, root):
    return _resources(spark, root).filter(m.resource_alert()).select("event_id")


@query(
    "growth_rate",
    "SELECT event_type AS metric, max(value) AS peak, round(avg(value), 6) AS mean, round((arg_max(value, "
    "event_id) - arg_min(value, event_id)) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE), 9) "
    "AS per_second FROM events GROUP BY 1",
)
def growth_rate(spark, root):
    grown = m.growth(_samples(spark, root), "metric", "value", "ts_us", "event_id")
    return grown.select(
        "metric", "peak", F.round("mean", 6).alias("mean"), F.round("per_second", 9).alias("per_second")
    )


@query(
    "leak_trend",
    "SELECT source, round(confidence, 6) AS confidence, round(per_second, 9) AS per_second, n >= 10 AND confidence "
    "> 0.7 AND per_second > 0 AS leak FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE level > "
    "before)::DOUBLE / (count(*) - 1) AS confidence, (arg_max(level, event_id) - arg_min(level, event_id)) / "
    "((max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE) AS per_second FROM (SELECT *, lag(level) OVER (PARTITION BY "
    "source ORDER BY ts_us) AS before FROM (SELECT user_id AS source, event_id, epoch_us(ts) AS ts_us, value + "
    "event_id / 20.0::DOUBLE AS level, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM "
    "events) WHERE rn <= 10) GROUP BY source)",
)
def leak_trend(spark, root):
    level = F.col("value") + F.col("event_id") / 20.0
    samples = t.events(spark, root).select(
        F.col("user_id").alias("source"), "event_id", "ts_us", level.alias("level")
    )
    trend = m.leak_trend(samples, "source", "level", "ts_us", "event_id", min_rate=0.0)
    return trend.select(
        "source",
        F.round("confidence", 6).alias("confidence"),
        F.round("per_second", 9).alias("per_second"),
        "leak",
    )


_SOURCES = (
    f"(SELECT user_id % 20 AS source, epoch_us(ts) AS ts_us, {K} > 90 AS dropped, event_type = 'error' AND "
    f"{K} <= 90 AS failed, strlen(props) + strlen(event_type) AS size FROM events) s"
)


def _sources(spark, root):
    dropped = F.col("k") > 90
    return t.events(spark, root).select(
        (F.col("user_id") % 20).alias("source"),
        "ts_us",
        dropped.alias("dropped"),
        ((F.col("event_type") == "error") & ~dropped).alias("failed"),
        (F.octet_length("props") + F.octet_length("event_type")).alias("size"),
    )


@query(
    "source_stats",
    "SELECT source, count(*) FILTER (WHERE NOT dropped AND NOT failed) AS collected, count(*) FILTER (WHERE dropped) "
    "AS dropped, count(*) FILTER (WHERE failed) AS errors, round(avg(size) FILTER (WHERE NOT dropped AND NOT failed), 6) "
    f"AS avg_size, max(ts_us) FILTER (WHERE NOT dropped AND NOT failed) AS last_event FROM {_SOURCES} GROUP BY source",
)
def source_stats(spark, root):
    stats = m.source_stats(_sources(spark, root), "source", "ts_us")
    return _rounded(stats, ["source", "collected", "dropped", "errors", "last_event"], ["avg_size"])


@query(
    "system_health",
    "SELECT *, errors < 10 AND utilization < 80 AS healthy FROM (SELECT count(DISTINCT source) AS sources, count(*) FILTER (WHERE NOT dropped AND NOT failed) AS collected, count(*) FILTER "
    "(WHERE dropped) AS dropped, count(*) FILTER (WHERE failed) AS errors, count(*) FILTER (WHERE dropped) / "
    f"count(*)::DOUBLE * 100 AS utilization FROM {_SOURCES})",
)
def system_health(spark, root):
    total = F.col("collected") + F.col("dropped") + F.col("errors")
    per_source = m.source_stats(_sources(spark, root), "source", "ts_us")
    return m.system_health(per_source, F.col("dropped") / total * 100.0)


@query(
    "ingest_stats",
    "SELECT count(*) FILTER (WHERE event_type <> 'error') AS processed, count(*) FILTER (WHERE event_type = 'error') "
    "AS failed, round(count(*) FILTER (WHERE event_type <> 'error') / count(*)::DOUBLE * 100, 6) AS success_percent, "
    "round(avg(value) * 1000, 4) AS mean_ms FROM events",
)
def ingest_stats(spark, root):
    """Also registered as ``pipeline_stats``."""
    stats = m.ingest_stats(t.events(spark, root), F.col("event_type") == "error", "value")
    return stats.select(
        "processed",
        "failed",
        F.round("success_percent", 6).alias("success_percent"),
        F.round("mean_ms", 4).alias("mean_ms"),
    )


query("pipeline_stats", CHECKS["ingest_stats"])(ingest_stats)


@query(
    "throughput",
    "SELECT count(*) FILTER (WHERE event_type <> 'error') AS operations, count(*) FILTER (WHERE event_type = 'error') "
    "AS errors, round(count(*) FILTER (WHERE event_type <> 'error') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / "
    "1000000.0::DOUBLE), 9) AS per_second, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 9) "
    "AS error_rate FROM events",
)
def throughput(spark, root):
    rates = m.throughput(t.events(spark, root), F.col("event_type") == "error", "ts_us")
    return rates.select(
        "operations",
        "errors",
        F.round("per_second", 9).alias("per_second"),
        F.round("error_rate", 9).alias("error_rate"),
    )


@query(
    "log_summary",
    "SELECT count(*) AS events, epoch_us(min(ts)) AS oldest, epoch_us(max(ts)) AS newest, round(count(*) / "
    "((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE), 9) AS per_second FROM events",
)
def log_summary(spark, root):
    summary = m.log_summary(t.events(spark, root).select("ts_us"), "ts_us")
    return summary.withColumn("per_second", F.round("per_second", 9))


@query(
    "rate_units",
    "SELECT event_type, round(b, 9) AS bytes_per_second, round(b * 3600 / 1048576, 9) AS mb_per_hour, round(b * 86400 "
    "/ 1048576, 9) AS mb_per_day FROM (SELECT event_type, sum(strlen(props)) / ((epoch_us(max(ts)) - "
    "epoch_us(min(ts))) / 1000000.0::DOUBLE) AS b FROM events GROUP BY 1)",
)
def rate_units(spark, root):
    rows = t.events(spark, root).select("event_type", "props", "ts_us")
    rates = m.rate_units(rows, "event_type", F.octet_length("props"), "ts_us")
    return rates.select(
        "event_type",
        *[F.round(c, 9).alias(c) for c in ("bytes_per_second", "mb_per_hour", "mb_per_day")],
    )


@query(
    "run_ledger",
    "SELECT o_orderpriority AS job, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus <> 'F') AS succeeded, "
    "count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, round(avg(o_totalprice), 4) AS mean_seconds "
    "FROM orders GROUP BY 1",
)
def run_ledger(spark, root):
    runs = t.table(spark, root, "orders").withColumnRenamed("o_orderpriority", "job")
    ledger = m.run_ledger(runs, "job", F.col("o_orderstatus") == "F", "o_totalprice")
    return ledger.withColumn("mean_seconds", F.round("mean_seconds", 4))

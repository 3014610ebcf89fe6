"""The given tables, and views of them in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.times import floor_div


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


def _micros() -> F.Column:
    # The stored type has no zone; the session zone is UTC.
    return F.unix_micros(F.col("ts").cast("timestamp"))


def as_events(raw: DataFrame) -> DataFrame:
    """Raw events with the time also as microseconds and ``props.k`` as a column."""
    return raw.withColumns({"ts_us": _micros(), "k": _k()})


def events(spark: SparkSession, root: str) -> DataFrame:
    return as_events(table(spark, root, "events"))


def event_log(spark: SparkSession, root: str) -> DataFrame:
    return as_event_log(table(spark, root, "events"))


def as_event_log(raw: DataFrame) -> DataFrame:
    """Raw events as the stored seven-column event table."""
    return raw.select(
        (_micros() * 1000).alias("timestamp_ns"),
        "event_type",
        F.concat(F.lit("app."), (F.col("user_id") % 10).cast("string")).alias("app_bundle_id"),
        F.concat(F.lit("window "), _k().cast("string")).alias("window_title"),
        F.col("props").alias("data"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").cast("string").alias("event_id"),
    )


def moves(spark: SparkSession, root: str) -> DataFrame:
    """Pointer positions per session."""
    return events(spark, root).select(
        F.col("user_id").alias("session"),
        "ts_us",
        "event_id",
        F.col("value").alias("x"),
        F.col("k").cast("double").alias("y"),
    )


def focus(spark: SparkSession, root: str) -> DataFrame:
    """Front window per session; a third-hand gap (no window) when k is a multiple of ten."""
    seen = F.col("k") % 10 != 0
    return events(spark, root).select(
        F.col("user_id").alias("session"),
        "ts_us",
        "event_id",
        F.when(seen, F.col("event_type")).alias("window_id"),
        F.when(seen, F.col("k") % 2).alias("process_id"),
        F.when(seen, F.col("k") % 3).alias("title"),
        F.when(seen, F.lit(0)).alias("bounds"),
        seen.alias("has_window"),
    )


def counters(spark: SparkSession, root: str) -> DataFrame:
    """Byte counters per host: they rise with the event number and sometimes fall."""
    return events(spark, root).select(
        F.col("user_id").alias("host"),
        "ts_us",
        "event_id",
        (F.col("event_id") * 50 + F.round(F.col("value") * 100).cast("long")).alias("bytes_in"),
        (F.col("event_id") * 20 + F.col("k") * 100).alias("bytes_out"),
    )


# Event type of the given table -> kind and severity in the security log.
SECURITY_KINDS = {
    "error": ("AuthenticationFailure", 3),
    "signup": ("AuthenticationSuccess", 1),
    "click": ("RateLimitExceeded", 2),
    "view": ("SuspiciousRequest", 3),
    "purchase": ("DataWipe", 4),
}


def security_log(
    spark: SparkSession, root: str, kinds: list[str] | None = None
) -> DataFrame:
    return as_security_log(table(spark, root, "events"), kinds)


def as_security_log(raw: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Raw events as security events, optionally only of some kinds. That choice is
    made on the stored type, where the scan can apply it."""
    if kinds is not None:
        raw = raw.filter(
            F.col("event_type").isin([t for t, (k, _) in SECURITY_KINDS.items() if k in kinds])
        )
    kind, severity = F.lit(None).cast("string"), F.lit(None).cast("int")
    for event_type, (name, level) in SECURITY_KINDS.items():
        is_type = F.col("event_type") == event_type
        kind = F.when(is_type, F.lit(name)).otherwise(kind)
        severity = F.when(is_type, F.lit(level)).otherwise(severity)
    return as_events(raw).select(
        "event_id",
        "ts_us",
        F.col("user_id").alias("source"),
        kind.alias("kind"),
        severity.alias("severity"),
    )


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    return as_arrivals(table(spark, root, "events"))


def arrival() -> F.Column:
    """Place of a raw event in the order of arrival."""
    e = F.col("event_id")
    return (e + F.when(e % 50 == 0, 7).otherwise(0)).cast("long")


def as_arrivals(raw: DataFrame) -> DataFrame:
    """All events, renumbered and reordered so that a log check finds something.

    ``id`` skips a number after every 97 events and repeats a number at every
    101st; every 50th event arrives seven places late.
    """
    e = F.col("event_id")
    renumbered = e + floor_div(e, 97) - F.when(e % 101 == 0, 1).otherwise(0)
    return as_events(raw).select(
        renumbered.cast("long").alias("id"),
        arrival().alias("arrival"),
        "event_id",
        "ts_us",
        "event_type",
        F.col("user_id").alias("session"),
        "props",
    )


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Search documents with tags and a day."""
    return table(spark, root, "documents").select(
        "doc_id",
        "text",
        F.array("lang", "source").alias("tags"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias(
            "day"
        ),
    )


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """``orders`` read as a file catalogue: one file per order."""
    return table(spark, root, "orders").select(
        F.concat(F.lit("f/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("size"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_us"),
        F.col("o_orderstatus").alias("format"),
        F.col("o_orderpriority").alias("compression"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("checksum"),
        (F.col("o_custkey") % 100).cast("long").alias("record_count"),
    )

"""Security log: counters, sliding alerts per source, lockout, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import COPY, Split, running_over, trailing_count, with_previous
from tidelog.session import materialize

SECOND_US = 1_000_000
# Thresholds and windows of the alerts.
AUTH_FAILURES, AUTH_WINDOW_S = 5, 300
RATE_LIMITS, RATE_WINDOW_S = 10, 900
SUSPICIOUS, SUSPICIOUS_WINDOW_S = 3, 3600
LOCKOUT_FAILURES, LOCKOUT_WINDOW_S = 5, 900
KEEP_EVENTS, KEEP_SECONDS = 10_000, 86_400

# Kinds by alert.
SUSPICIOUS_KINDS = ["SuspiciousRequest", "SqlInjectionAttempt", "XssAttempt"]
CRITICAL_KINDS = ["DataWipe", "PrivilegeEscalation", "UnauthorizedAccess"]
ACCESS_KINDS = ["DataAccess", "SensitiveDataAccess", "DataExport"]
COUNTERS = {
    "failed_auth_attempts": ["AuthenticationFailure"],
    "successful_auth_attempts": ["AuthenticationSuccess"],
    "rate_limit_violations": ["RateLimitExceeded"],
    "input_validation_failures": ["InputValidationFailure"],
    "suspicious_requests": ["SuspiciousRequest"],
    "data_access_events": ACCESS_KINDS,
}


def security_counters(log: DataFrame) -> DataFrame:
    return log.agg(*[F.count_if(F.col("kind").isin(k)).alias(n) for n, k in COUNTERS.items()])


def _alerts(
    log: DataFrame,
    kinds: list[str],
    threshold: int,
    window_s: int,
    with_current: bool,
    action: Column,
    parts: int | None,
) -> DataFrame:
    rows = log.filter(F.col("kind").isin(kinds) & F.col("source").isNotNull())
    counted = trailing_count(
        rows.select("source", "ts_us", "event_id"),
        ["source"],
        "ts_us",
        "event_id",
        window_s * SECOND_US,
        parts=parts,
    )
    if not with_current:
        counted = counted.withColumn("recent", F.col("recent") - 1)
    return counted.filter(F.col("recent") >= threshold).withColumn("action", action)


def _about(text: str) -> Column:
    return F.format_string(text, F.col("source").cast("string"))


def auth_alerts(
    log: DataFrame,
    threshold: int = AUTH_FAILURES,
    window_s: int = AUTH_WINDOW_S,
    parts: int | None = None,
) -> DataFrame:
    """Failures that are at least the ``threshold``-th of their source within the window."""
    action = _about("IP %s temporarily blocked")
    return _alerts(log, ["AuthenticationFailure"], threshold, window_s, True, action, parts)


def rate_alerts(
    log: DataFrame,
    threshold: int = RATE_LIMITS,
    window_s: int = RATE_WINDOW_S,
    parts: int | None = None,
) -> DataFrame:
    """As above, but the event itself is not counted."""
    action = _about("IP %s rate limited")
    return _alerts(log, ["RateLimitExceeded"], threshold, window_s, False, action, parts)


def suspicious_alerts(
    log: DataFrame,
    threshold: int = SUSPICIOUS,
    window_s: int = SUSPICIOUS_WINDOW_S,
    parts: int | None = None,
) -> DataFrame:
    action = _about("IP %s flagged as suspicious")
    return _alerts(log, SUSPICIOUS_KINDS, threshold, window_s, False, action, parts)


def critical_alerts(log: DataFrame) -> DataFrame:
    rows = log.filter(F.col("kind").isin(CRITICAL_KINDS))
    return rows.withColumn("action", F.lit("Alert triggered"))


def by_severity(log: DataFrame, severity: int, n: int) -> DataFrame:
    rows = log.filter(F.col("severity") == severity)
    return rows.orderBy(F.col("ts_us").desc(), F.col("event_id").desc()).limit(n)


def retain(
    log: DataFrame, as_of_us: int, keep: int = KEEP_EVENTS, seconds: int = KEEP_SECONDS
) -> DataFrame:
    """The newest ``keep`` events that are not older than ``seconds``."""
    fresh = log.filter(F.col("ts_us") >= as_of_us - seconds * SECOND_US)
    return fresh.orderBy(F.col("ts_us").desc(), F.col("event_id").desc()).limit(keep)


def active_sessions(rows: DataFrame, session: str, ts_us: str, as_of_us: int, timeout_s: int):
    """Sessions whose last access is less than ``timeout_s`` before ``as_of``."""
    last = rows.groupBy(session).agg(F.max(ts_us).alias("last_us"))
    return last.filter(F.lit(as_of_us) - F.col("last_us") < timeout_s * SECOND_US)


# -- lockout -----------------------------------------------------------------------------
#
# A refused attempt is itself a failure and an admitted success clears the history,
# so the outcome depends on earlier outcomes. But two facts about earlier attempts decide it.
# An attempt is *dense* if the one ``limit`` places before it lies inside the window.
# After ``limit`` failures in a row the history is full, and it stays full until a success
# that is not dense: a failure adds to it, a dense success is refused and so is a failure too.
# So an attempt is refused if it is dense and, among those before it, the last end of
# ``limit`` failures in a row comes after the last success that was not dense. Both are
# running maxima, which a hot source shares among as many tasks as it has ranges.


def lockout(
    attempts: DataFrame, window_s: int = LOCKOUT_WINDOW_S, parts: int | None = None, limit: int = LOCKOUT_FAILURES
) -> DataFrame:
    """Attempts (source, ts_us, event_id, success) with ``refused``.

    Ids are of any type that sorts, and unique within a source and time. A null success
    counts as a failure; rows without a source are left out.
    """
    rows = attempts.select("source", "ts_us", "event_id", "success").filter(F.col("source").isNotNull())
    split = with_previous(rows, ["source"], "ts_us", "event_id", limit, parts)
    before = F.col("ts_us") - F.lag("ts_us", limit).over(split.window)
    dense = F.coalesce(before < window_s * SECOND_US, F.lit(False))
    success = F.coalesce("success", F.lit(False))
    failures = F.sum((~success).cast("int")).over(split.rows(1 - limit, 0))
    place = F.struct("ts_us", "event_id")
    marked = split.frame.withColumns({"_dense": dense, "_failures": failures}).filter(~F.col(COPY)).drop(COPY)
    # Written, as the edges of its ranges are looked at, too.
    marked = materialize(marked, "attempts")
    facts = {
        "_full": ("max", F.when(F.col("_failures") == limit, place)),
        "_cleared": ("max", F.when(success & ~F.col("_dense"), place)),
    }
    known = running_over(Split(marked, split.keys, split.order), facts, include_current=False)
    still = F.col("_full").isNotNull() & (F.col("_cleared").isNull() | (F.col("_full") > F.col("_cleared")))
    return known.select("source", "ts_us", "event_id", "success", (F.col("_dense") & still).alias("refused"))

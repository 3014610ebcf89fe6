"""Security log queries. The given events are hours apart, so windows are days."""

from pyspark.sql import functions as F

from tidelog.operators import security as s
from tidelog.plans.base import query
from tidelog.sources import tables as t

AS_OF_US = 1_706_659_200_000_000  # 2024-01-31 00:00:00
DAY = 86_400

_LOG = (
    "(SELECT event_id, epoch_us(ts) AS ts_us, user_id AS source, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in t.SECURITY_KINDS.items())
    + " END AS kind, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in t.SECURITY_KINDS.items())
    + " END AS severity FROM events) l"
)


def _alert_sql(kind: str, threshold: int, days: int, own: bool, action: str) -> str:
    """Counted by a self join, unlike the running counts of the operator."""
    minus = "" if own else " - 1"
    return (
        f"WITH k AS (SELECT * FROM {_LOG} WHERE kind = '{kind}') SELECT source, ts_us, event_id, recent, "
        f"'IP ' || source || ' {action}' AS action FROM (SELECT a.source, a.ts_us, a.event_id, "
        f"count(*){minus} AS recent FROM k a JOIN k b ON a.source = b.source AND b.ts_us > a.ts_us - "
        f"{days * DAY}000000 AND (b.ts_us < a.ts_us OR (b.ts_us = a.ts_us AND b.event_id <= a.event_id)) "
        f"GROUP BY ALL) WHERE recent >= {threshold}"
    )


@query("alert_auth", _alert_sql("AuthenticationFailure", 5, 6, True, "temporarily blocked"))
def alert_auth(spark, root):
    log = t.security_log(spark, root, ["AuthenticationFailure"])
    return s.auth_alerts(log, window_s=6 * DAY)


@query("alert_rate", _alert_sql("RateLimitExceeded", 10, 30, False, "rate limited"))
def alert_rate(spark, root):
    log = t.security_log(spark, root, ["RateLimitExceeded"])
    return s.rate_alerts(log, window_s=30 * DAY)


@query("alert_suspicious", _alert_sql("SuspiciousRequest", 3, 5, False, "flagged as suspicious"))
def alert_suspicious(spark, root):
    log = t.security_log(spark, root, s.SUSPICIOUS_KINDS)
    return s.suspicious_alerts(log, window_s=5 * DAY)


@query(
    "alert_critical",
    f"SELECT event_id, source, 'Alert triggered' AS action FROM {_LOG} WHERE kind = 'DataWipe'",
)
def alert_critical(spark, root):
    log = t.security_log(spark, root, s.CRITICAL_KINDS)
    return s.critical_alerts(log).select("event_id", "source", "action")


@query(
    "security_counters",
    "SELECT count(*) FILTER (WHERE event_type = 'error') AS failed_auth_attempts, "
    "count(*) FILTER (WHERE event_type = 'signup') AS successful_auth_attempts, "
    "count(*) FILTER (WHERE event_type = 'click') AS rate_limit_violations, "
    "0::BIGINT AS input_validation_failures, "
    "count(*) FILTER (WHERE event_type = 'view') AS suspicious_requests, "
    "0::BIGINT AS data_access_events FROM events",
)
def security_counters(spark, root):
    return s.security_counters(t.security_log(spark, root))


@query(
    "events_by_severity",
    f"SELECT event_id, kind FROM {_LOG} WHERE severity = 3 ORDER BY ts_us DESC, event_id DESC LIMIT 40",
)
def events_by_severity(spark, root):
    return s.by_severity(t.security_log(spark, root), 3, 40).select("event_id", "kind")


@query(
    "security_retain",
    f"SELECT event_id FROM {_LOG} WHERE ts_us >= {AS_OF_US} - 86400000000 ORDER BY ts_us DESC, event_id DESC "
    "LIMIT 200",
)
def security_retain(spark, root):
    return s.retain(t.security_log(spark, root), AS_OF_US, keep=200).select("event_id")


@query(
    "active_sessions",
    "SELECT user_id, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id "
    f"HAVING {AS_OF_US} - epoch_us(max(ts)) < 43200000000",
)
def active_sessions(spark, root):
    rows = t.events(spark, root).select("user_id", "ts_us")
    return s.active_sessions(rows, "user_id", "ts_us", AS_OF_US, 43_200)


def attempts(spark, root):
    """Signups are right passwords, everything else a wrong one."""
    return t.events(spark, root).select(
        F.col("user_id").alias("source"),
        "ts_us",
        "event_id",
        (F.col("event_type") == "signup").alias("success"),
    )


@query(
    "lockout",
    "WITH RECURSIVE a AS (SELECT user_id AS source, epoch_us(ts) AS ts_us, event_id, event_type = 'signup' AS success, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
    # Times of the failures since the last clearing that still lie inside the window, counted at each attempt.
    "seen AS (SELECT *, FALSE AS refused, CASE WHEN success THEN [] ELSE [ts_us] END AS past FROM a WHERE rn = 1 UNION ALL "
    "SELECT source, ts_us, event_id, success, rn, len(past) >= 5, CASE WHEN len(past) >= 5 OR NOT success THEN list_append(past, ts_us) "
    f"ELSE [] END FROM (SELECT a.*, list_filter(s.past, lambda f: a.ts_us - f < {DAY}000000) AS past FROM seen s JOIN a "
    "ON a.source = s.source AND a.rn = s.rn + 1)) "
    "SELECT source, ts_us, event_id, success, refused FROM seen",
)
def lockout(spark, root):
    return s.lockout(attempts(spark, root), window_s=DAY)



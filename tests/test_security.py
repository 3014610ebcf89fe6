import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import security as s

S = 1_000_000
LOG = "event_id long, ts_us long, source string, kind string, severity int"


def log(spark, seconds, kind, source="ip"):
    rows = [(i, int(t * S), source, kind, 3) for i, t in enumerate(seconds)]
    return spark.createDataFrame(rows, LOG)


def test_auth_alert_counts_itself_and_the_far_end_is_open(spark):
    rows = log(spark, [0, 60, 120, 180, 299, 300, 301], "AuthenticationFailure")
    nobody = log(spark, [0] * 9, "AuthenticationFailure").withColumn("source", F.lit(None).cast("string"))
    got = s.auth_alerts(rows.unionByName(nobody)).orderBy("event_id").collect()
    # At 300 s the failure at 0 s is exactly the window away and no longer counts.
    assert [(r.event_id, r.recent) for r in got] == [(4, 5), (5, 5), (6, 6)]
    assert got[0].action == "IP ip temporarily blocked"


def test_rate_alert_does_not_count_itself(spark):
    seconds = [i * 80 for i in range(10)] + [720]
    got = s.rate_alerts(log(spark, seconds, "RateLimitExceeded")).collect()
    # Two events at the same instant: the earlier one counts for the later one.
    assert [(r.event_id, r.recent) for r in got] == [(10, 10)]


def test_suspicious_alert_takes_three_kinds(spark):
    kinds = ["SuspiciousRequest", "SqlInjectionAttempt", "XssAttempt", "SuspiciousRequest"]
    rows = spark.createDataFrame([(i, i * S, "ip", k, 3) for i, k in enumerate(kinds)], LOG)
    assert [(r.event_id, r.recent) for r in s.suspicious_alerts(rows).collect()] == [(3, 3)]
    assert s.critical_alerts(rows).count() == 0


def lockout_by_hand(rows, window_s):
    """The rule told with a list of failure times."""
    out, failures = {}, {}
    for source, ts, ident, success in sorted(rows, key=lambda r: (r[1], r[2])):
        past = failures.setdefault(source, [])
        refused = sum(1 for f in past if ts - f < window_s * S) >= 5
        out[ident] = refused
        if refused or not success:
            past.append(ts)
        else:
            past.clear()
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("parts", [60, 8, 1])
def test_lockout(spark, seed, parts):
    rnd = random.Random(seed)
    rows, ts = [], 0
    for i in range(400):
        ts += rnd.choice([1, 30, 100, 300, 1200]) * S if seed < 3 else rnd.choice([0, 60, 250]) * S
        source = rnd.choice(["hot", "hot", "hot", "x", "y"])
        rows.append((source, ts, i, rnd.random() < 0.35))
    frame = spark.createDataFrame(rows, "source string, ts_us long, event_id long, success boolean")
    got = {r.event_id: r.refused for r in s.lockout(frame, parts=parts).collect()}
    want = lockout_by_hand(rows, 900)
    assert got == want
    assert 0 < sum(want.values()) < len(want)


def test_alerts_do_not_change_when_sources_are_cut(spark, small):
    from tidelog.sources import tables as t

    rows = t.security_log(spark, small).withColumn("source", F.lit(1))
    for run in (
        lambda n: s.auth_alerts(rows, window_s=86_400, parts=n),
        lambda n: s.rate_alerts(rows, window_s=7 * 86_400, parts=n),
    ):
        assert sorted(map(str, run(50).collect())) == sorted(map(str, run(1).collect()))
        assert run(1).count() > 0


def test_retain_and_sessions(spark):
    rows = log(spark, [0, 100, 200, 300], "DataAccess")
    kept = s.retain(rows, 300 * S, keep=2, seconds=200)
    assert sorted(r.event_id for r in kept.collect()) == [2, 3]
    assert sorted(r.event_id for r in s.retain(rows, 300 * S, seconds=200).collect()) == [1, 2, 3]
    active = s.active_sessions(rows, "source", "ts_us", 400 * S, 100)
    assert active.count() == 0
    assert s.security_counters(rows).first().data_access_events == 4


def test_rows_of_equal_ids_all_count(spark):
    failure = lambda at, ident: ("a", at * 1_000_000, ident, "AuthenticationFailure")
    rows = [failure(1, "x"), failure(2, "same"), failure(3, "same"), failure(4, "same"), failure(5, None), failure(6, None), failure(7, "y")]
    log = spark.createDataFrame(rows, "source string, ts_us long, event_id string, kind string")
    assert sorted(r.recent for r in s.auth_alerts(log).collect()) == [5, 6, 7]
    # Repeated at the same time, too.
    log = spark.createDataFrame([failure(1, "same")] * 4 + [failure(1, None)] * 3, log.schema)
    assert sorted(r.recent for r in s.auth_alerts(log).collect()) == [5, 6, 7]
    limited = log.withColumn("kind", F.lit("RateLimitExceeded"))
    assert sorted(r.recent for r in s.rate_alerts(limited, threshold=3).collect()) == [3, 4, 5, 6]


def test_lockout_of_odd_rows(spark):
    second = 1_000_000
    rows = [("a", k * second, f"e{k}", None if k % 2 else False) for k in range(6)] + [(None, 1, "x", True)]
    rows += [("a", 6 * second, "e6", True), ("a", 2000 * second, "e7", True), ("b", 1, None, True)]
    frame = spark.createDataFrame(rows, "source string, ts_us long, event_id string, success boolean")
    got = {(r.source, r.event_id): r.refused for r in s.lockout(frame).collect()}
    assert len(got) == 9 and {i for (_, i), refused in got.items() if refused} == {"e5", "e6"}
    assert s.lockout(frame.limit(0)).count() == 0

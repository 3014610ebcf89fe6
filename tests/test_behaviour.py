import math
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import behaviour as b

S = 1_000_000
MOVE = "session string, ts_us long, event_id long, x double, y double"


def moves(spark, points, step_s=1.0, session="s"):
    rows = [(session, int(i * step_s * S), i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, MOVE)


def last(frame):
    return frame.orderBy(F.col("event_id").desc()).first()


def test_first_move_is_left_out_and_no_time_means_no_speed(spark):
    rows = [("s", 0, 0, 0.0, 0.0), ("s", 2 * S, 1, 3.0, 4.0), ("s", 2 * S, 2, 9.0, 9.0)]
    got = b.pointer_velocity(spark.createDataFrame(rows, MOVE)).orderBy("event_id").collect()
    assert [r.velocity for r in got] == [2.5, 0.0]


def test_thinning_waits(spark):
    rows = [("s", 0, 0, 0.0, 0.0)]
    # 0.06 s fast, 0.06 s slow, 0.1 s slow, 0.04 s fast
    for i, (dt, dx) in enumerate([(0.06, 50.0), (0.06, 1.0), (0.1, 1.0), (0.04, 50.0)], 1):
        rows.append(("s", rows[-1][1] + int(dt * S), i, rows[-1][3] + dx, 0.0))
    kept = b.move_thinning(b.pointer_velocity(spark.createDataFrame(rows, MOVE)))
    assert sorted(r.event_id for r in kept.collect()) == [1, 3]


def test_patterns(spark):
    zigzag = moves(spark, [(i % 2 * 10, 0) for i in range(12)])
    assert last(b.motion_patterns(zigzag)).back_and_forth
    assert not last(b.motion_patterns(moves(spark, [(i % 2 * 10, 0) for i in range(10)]))).back_and_forth
    still = moves(spark, [(i * 0.1, 0) for i in range(11)])
    assert last(b.motion_patterns(still)).idle
    # Ten moves over more than the buffer time are no pattern.
    assert not last(b.motion_patterns(moves(spark, [(0, 0)] * 11, step_s=4.0))).idle
    for end, name in [((60, 0), "right"), ((-60, 0), "left"), ((0, 60), "down"), ((0, -60), "up")]:
        path = [(end[0] * i / 4, end[1] * i / 4) for i in range(-1, 5)]
        assert last(b.motion_patterns(moves(spark, path))).swipe == name
    short = [(10 * i, 0) for i in range(5)]
    assert last(b.motion_patterns(moves(spark, short))).swipe is None


def buffer_by_hand(rows, max_rows, seconds):
    got, moved, before = {}, [], None
    for _, ts, ident, x, y in rows:
        if before:
            step = math.hypot(x - before[1], y - before[2])
            dt = (ts - before[0]) / S
            moved.append((ts, step, step / dt if dt > 0 else 0.0))
            kept = [m for m in moved[-max_rows:] if m[0] >= ts - seconds * S]
            speeds = [m[2] for m in kept]
            got[ident] = (
                len(kept),
                sum(m[1] for m in kept[1:]),
                (ts - kept[0][0]) / S,
                sum(speeds) / len(speeds),
                max(speeds),
                min(speeds),
            )
        before = (ts, x, y)
    return got


@pytest.mark.parametrize("parts", [25, 4, 1])
@pytest.mark.parametrize("max_rows,seconds", [(100, 30.0), (5, 30.0), (100, 3.0)])
def test_move_buffer_has_both_bounds(spark, parts, max_rows, seconds):
    rnd = random.Random(5)
    rows, ts = [], 0
    for i in range(150):
        ts += rnd.choice([0, S // 10, S // 4, S])
        rows.append(("s", ts, i, rnd.random() * 100, rnd.random() * 100))
    stats = b.move_stats(spark.createDataFrame(rows, MOVE), max_rows=max_rows, seconds=seconds, parts=parts)
    got = {
        r.event_id: (r.moves, r.distance, r.span_s, r.avg_velocity, r.max_velocity, r.min_velocity)
        for r in stats.collect()
    }
    want = buffer_by_hand(rows, max_rows, seconds)
    assert got.keys() == want.keys()
    for ident in want:
        assert got[ident] == pytest.approx(want[ident])


@pytest.mark.parametrize("parts", [70, 9])
def test_cutting_hot_sessions_changes_nothing(spark, small, parts):
    from tidelog.sources import tables as t

    hot = F.when(F.col("event_id") % 3 != 0, 0).otherwise(F.col("session")).cast("long")
    rows = t.moves(spark, small).withColumn("session", hot)
    week = 7 * 86_400
    pairs = [
        lambda n: b.pointer_velocity(rows, parts=n),
        lambda n: b.motion_patterns(rows, seconds=week, parts=n),
        lambda n: b.focus_changes(t.focus(spark, small).withColumn("session", hot), parts=n),
        lambda n: b.counter_rate(
            t.counters(spark, small).withColumn("host", F.lit("h")), ["bytes_in"], parts=n
        ),
        lambda n: b.event_pairs(
            t.events(spark, small).withColumn("user_id", F.lit(1)), "event_type", "user_id", parts=n
        ),
        lambda n: b.replay_schedule(t.events(spark, small).select("event_id", "ts_us"), "ts_us", "event_id", parts=n),
        lambda n: b.type_sequence(t.events(spark, small), "event_type", "ts_us", "event_id", parts=n),
        lambda n: b.idle_state(t.events(spark, small), "event_type", parts=n),
    ]
    for run in pairs:
        assert sorted(map(str, run(parts).collect())) == sorted(map(str, run(1).collect()))


def test_focus_reasons(spark):
    A, A2, B, none = ("w1", 1, "t"), ("w1", 1, "t2"), ("w2", 1, "t2"), None
    C = ("w3", 2, "t2")
    rows = []
    for i, w in enumerate([A, A, A2, B, C, none, none, A]):
        rows.append(("s", i, i, *(w or (None, None, None)), 0 if w else None, w is not None))
    frame = spark.createDataFrame(
        rows,
        "session string, ts_us long, event_id long, window_id string, process_id int, title string, "
        "bounds int, has_window boolean",
    )
    got = [(r.event_id, r.reason) for r in b.focus_changes(frame).orderBy("event_id").collect()]
    assert got == [
        (0, "initial_focus"),
        (2, "window_title_change"),
        (3, "window_switch"),
        (4, "application_switch"),
        (5, "window_closed"),
        (6, "window_closed"),
        (7, "initial_focus"),
    ]


def test_moved_window_has_no_named_reason(spark):
    rows = [("s", 0, 0, "w", 1, "t", 0, True), ("s", 1, 1, "w", 1, "t", 9, True)]
    frame = spark.createDataFrame(
        rows,
        "session string, ts_us long, event_id long, window_id string, process_id int, title string, "
        "bounds int, has_window boolean",
    )
    assert last(b.focus_changes(frame)).reason == "unknown"


def test_consecutive_repeats(spark):
    rows = [("s", i, i, h) for i, h in enumerate(["a", "a", "", "", "a", "b"])]
    frame = spark.createDataFrame(rows, "s string, ts_us long, event_id long, h string")
    kept = b.drop_consecutive(frame, "h", "s").orderBy("event_id").collect()
    assert [r.event_id for r in kept] == [0, 2, 3, 4, 5]


def test_counter_reset_and_equal_times_give_no_row(spark):
    rows = [("h", t, i, c) for i, (t, c) in enumerate([(0, 10), (S, 30), (S, 40), (2 * S, 5), (4 * S, 25)])]
    frame = spark.createDataFrame(rows, "host string, ts_us long, event_id long, c long")
    got = [(r.event_id, r.c_delta, r.rate) for r in b.counter_rate(frame, ["c"]).collect()]
    assert got == [(1, 20, 20.0), (4, 20, 10.0)]


def test_idle_and_replay(spark):
    rows = [("s", t * S, i) for i, t in enumerate([0, 30, 61])]
    frame = spark.createDataFrame(rows, "s string, ts_us long, event_id long")
    states = b.idle_state(frame, "s").orderBy("event_id").collect()
    assert [r.state_rate for r in states] == [1.0, 1.0, 0.2]
    paced = b.replay_schedule(frame, "ts_us", "event_id", 100.0).orderBy("event_id").collect()
    assert [r.wait_ms for r in paced] == [300.0, 310.0, None]
    with pytest.raises(ValueError):
        b.replay_schedule(frame, "ts_us", "event_id", 0)


def test_buffers_filters_routes(spark):
    frame = spark.range(10).select(F.col("id").alias("event_id"), F.col("id").alias("arrival"))
    keep = lambda k: sorted(r.event_id for r in b.bounded_buffer(frame, "arrival", "event_id", 3, k).collect())
    assert keep("newest") == [7, 8, 9] and keep("oldest") == [0, 1, 2]
    assert b.buffer_overflow(frame, 3).first().overflow == 7
    apps = spark.createDataFrame([("a",), ("b",), (None,)], "app string")
    assert {r.app for r in b.exclude_apps(apps, "app", ["a"]).collect()} == {"b", None}
    routed = b.route_events(
        spark.createDataFrame([("x",), ("y",)], "t string"), [("h", "x"), ("all", "*"), ("h", "*")], "t"
    )
    assert sorted((r.t, r.handler) for r in routed.collect()) == [
        ("x", "all"),
        ("x", "h"),
        ("y", "all"),
        ("y", "h"),
    ]
    rate = b.sample_rows(spark.range(20_000), "id", 0.25).count() / 20_000
    assert 0.23 < rate < 0.27


def test_key_names(spark):
    assert len(b.KEY_NAMES) == 110
    codes = spark.createDataFrame([(11,), (35,), (10,), (None,)], "code long")
    named = b.with_names(codes, b.key_names(spark), "code", "key_name", "?")
    assert {r.code: r.key_name for r in named.collect()} == {11: "B", 35: "P", 10: "?", None: "?"}


def test_network_keeps_hosts_that_cannot_be_read(spark):
    urls = ["http://127.0.0.1/a", "http://localhost:80/", "http://[::1]/", "http://localhost.example/", "not a url", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.remote: r.requests for r in b.network_totals(rows, "url", F.lit(1)).groupBy("remote").agg(F.sum("requests").alias("requests")).collect()}
    assert got == {"localhost.example": 1, None: 2}


def test_small_sample_rates_are_kept(spark):
    rows = spark.range(300_000)
    for rate in (0.00005, 0.001, 0.5):
        n = b.sample_rows(rows, "id", rate).count()
        assert abs(n - 300_000 * rate) < 5 * (300_000 * rate) ** 0.5 + 1
    assert b.sample_rows(rows, "id", 0.0).count() == 0


def test_names_from_a_table_keep_all_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "code int, v string")
    names = spark.createDataFrame([(1, "one"), (3, "three")], "code int, label string")
    got = b.with_names(rows, names, "code", "label", "?")
    assert got.columns == ["code", "v", "label"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", "one"), (1, "d", "one"), (2, "b", "?"), (None, "c", "?")]

import math
import random
import statistics

import pytest

from tidelog.operators import metrics as m
from tidelog.operators.ranks import order_stats

WANTED = {
    "p50": ("floor", 0.5),
    "p95": ("floor", 0.95),
    "p99": ("floor", 0.99),
    "n90": ("nearest", 90.0),
    "n10": ("nearest", 10.0),
    "low": ("lower_middle", 0.5),
    "high": ("upper_middle", 0.5),
}


def expected(values):
    s, n = sorted(values), len(values)
    nearest = lambda p: s[min(int(math.floor((n - 1) * p / 100 + 0.5)), n - 1)]
    floor = lambda p: s[min(int(n * p), n - 1)]
    return (floor(0.5), floor(0.95), floor(0.99), nearest(90), nearest(10), s[(n - 1) // 2], s[n // 2])


@pytest.fixture(scope="module")
def samples():
    rnd = random.Random(3)
    rows = [("one", 5.0), ("four", 4.0), ("four", 1.0), ("four", 3.0), ("four", 2.0)]
    for size in (17, 20, 66, 100, 333):
        rows += [(f"g{size}", round(rnd.expovariate(0.1), 2)) for _ in range(size)]
    # A third of a group in one value.
    rows += [("ties", 7.0)] * 100 + [("ties", float(i % 40)) for i in range(200)]
    return rows


@pytest.mark.parametrize("parts", [60, 8, 1])
def test_rules_hold_however_groups_are_cut(spark, samples, parts):
    nulls = [(None, 3.0), (None, 1.0)]
    frame = spark.createDataFrame([*samples, *nulls, ("four", None)], "g string, v double").repartition(5)
    got = {r.g: tuple(r[n] for n in WANTED) for r in order_stats(frame, ["g"], "v", WANTED, parts).collect()}
    groups = {}
    for g, v in [*samples, *nulls]:
        groups.setdefault(g, []).append(v)
    assert got == {g: expected(v) for g, v in groups.items()}


@pytest.mark.parametrize("n", [1, 4, 20, 100])
def test_reports(spark, n):
    values = [float(v) for v in range(1, n + 1)]
    frame = spark.createDataFrame([("m", v) for v in values], "g string, v double")
    report = m.latency_report(frame, "g", "v").first()
    assert report.median == statistics.median(values)
    assert report.p95 == values[min(int(n * 0.95), n - 1)]
    assert report.stddev_pop == pytest.approx(statistics.pstdev(values))
    stats = m.stats_set(frame, "g", "v").first()
    assert stats.stddev == pytest.approx(statistics.stdev(values) if n > 1 else 0.0)
    assert stats.pct95 == values[min(int(math.floor((n - 1) * 0.95 + 0.5)), n - 1)]
    assert m.latency_percentiles(frame, "g", "v").first().p50 == values[min(n // 2, n - 1)]


def test_leak_trend(spark):
    rising = [("up", i, i * 1_000_000, float(i)) for i in range(10)]
    level = [0, 1, 2, 3, 3, 4, 5, 6, 7, 7]  # seven of nine rises
    mostly = [("mostly", i, i * 1_000_000, float(v)) for i, v in enumerate(level)]
    few = [("few", i, i * 1_000_000, float(i)) for i in range(9)]
    old = [("late", i, i * 1_000_000, 100.0 - i) for i in range(50)]
    rows = rising + mostly + few + old
    frame = spark.createDataFrame(rows, "c string, id long, ts_us long, v double")
    got = {r.c: r for r in m.leak_trend(frame, "c", "v", "ts_us", "id").collect()}
    assert {c: r.leak for c, r in got.items()} == {
        "up": True,
        "mostly": True,
        "few": False,
        "late": False,
    }
    assert got["mostly"].confidence == pytest.approx(7 / 9)


def test_growth_of_one_sample_is_zero(spark):
    frame = spark.createDataFrame([("a", 1, 5, 3.0)], "c string, id long, ts_us long, v double")
    row = m.growth(frame, "c", "v", "ts_us", "id").first()
    assert (row.peak, row["mean"], row.per_second) == (0.0, 0.0, 0.0)


def test_baseline_bounds_are_strict(spark):
    means = spark.createDataFrame(
        [("a", 105.0), ("b", 105.1), ("c", 95.0), ("d", 94.9), ("e", 1.0)], "m string, mean double"
    )
    base = spark.createDataFrame([(x, 100.0) for x in "abcd"], "m string, baseline double")
    got = {r.m: (r.is_regression, r.is_improvement) for r in m.baseline_compare(means, base, "m").collect()}
    assert got == {
        "a": (False, False),
        "b": (True, False),
        "c": (False, False),
        "d": (False, True),
        "e": (None, None),
    }


def test_null_groups_and_groups_without_values_stay(spark):
    frame = spark.createDataFrame([(None, 2.0), (None, 4.0), ("void", None), ("a", 1.0)], "g string, v double")
    got = {r.g: (r.n, r.median) for r in m.latency_report(frame, "g", "v").collect()}
    assert got[None][1] == 3.0 and got["void"][1] is None and got["a"] == (1, 1.0)

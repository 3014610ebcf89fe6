import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import formats as fm
from tidelog.functions import payload as pl
from tidelog.functions import text as tx
from tidelog.functions import times as tm


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


def test_times(spark):
    cases = {
        "2024-02-03 04:05:06": dt.datetime(2024, 2, 3, 4, 5, 6),
        "2024-02-03 04:05": dt.datetime(2024, 2, 3, 4, 5),
        "2024-02-03": dt.datetime(2024, 2, 3),
        "2024-02-03T04:05:06Z": dt.datetime(2024, 2, 3, 4, 5, 6),
        "2024-02-03T04:05:06.123Z": dt.datetime(2024, 2, 3, 4, 5, 6, 123000),
        "2024-02-03T04:05": dt.datetime(2024, 2, 3, 4, 5),
        "02/03/2024": dt.datetime(2024, 2, 3),
        "13/02/2024": dt.datetime(2024, 2, 13),
        "2024-02-03T04:05:06+01:00": dt.datetime(2024, 2, 3, 3, 5, 6),
        "junk": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "v string")
    got = dict(frame.select("v", F.to_timestamp_ntz(tm.parse_search_time(F.col("v")).cast("string"))).collect())
    assert got == cases


def test_rfc3339_digits(spark):
    for micros, text in [(0, "1970-01-01T00:00:00+00:00"), (1500, "1970-01-01T00:00:00.001500+00:00"), (2000, "1970-01-01T00:00:00.002+00:00")]:
        assert one(spark, micros, lambda c: tm.rfc3339(F.timestamp_micros(c)), "long") == text


def test_nanoseconds_are_exact(spark):
    ns = 1_704_114_417_313_040_999
    assert one(spark, ns, lambda c: F.unix_micros(tm.ns_to_timestamp(c)), "long") == ns // 1000
    assert one(spark, -1, lambda c: F.unix_micros(tm.ns_to_timestamp(c)), "long") == -1
    big = (1 << 62) + 12_345
    assert one(spark, big, lambda c: tm.floor_div(c, 1000), "long") == big // 1000


def test_fixed_rounds_like_the_binary_value(spark):
    rnd = random.Random(1)
    values = [2.085, 0.005, 0.015, 1.005, 2.675, 0.125, 0.375, 1e15, 0.0, 999.995]
    values += [round(rnd.random() * 10 ** rnd.randrange(6), 3) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = frame.select("v", fm.fixed(F.col("v"), 2).alias("t"), fm.fixed(F.col("v"), 1).alias("u")).collect()
    assert all(r.t == f"{r.v:.2f}" and r.u == f"{r.v:.1f}" for r in got)


@pytest.mark.parametrize(
    "size,binary,decimal",
    [
        (0, "0 B", "0 B"),
        (1, "1 B", "1.00 B"),
        (999, "999 B", "999.00 B"),
        (1000, "1000 B", "1.00 KB"),
        (1024, "1.0 KB", "1.02 KB"),
        (1536, "1.5 KB", "1.54 KB"),
        (5 * 1024**4, "5.0 TB", "5.50 TB"),
        (2 * 10**15, "1819.0 TB", "2.00 PB"),
    ],
)
def test_sizes(spark, size, binary, decimal):
    assert one(spark, size, fm.bytes_binary, "long") == binary
    assert one(spark, size, fm.bytes_decimal, "long") == decimal


@pytest.mark.parametrize(
    "text,size",
    [("1.5GB", int(1.5 * 1024**3)), ("10", 10), (" 7 b".replace(" b", "B"), 7), ("2kb", 2048), ("1XB", None), ("GB", None), ("", None)],
)
def test_parse_size(spark, text, size):
    assert one(spark, text, fm.parse_bytes) == size


def test_durations_and_rates(spark):
    for ms, text in [(12, "12ms"), (1234, "1.234s"), (62_000, "1m 2s"), (3_723_000, "1h 2m 3s"), (3_600_000, "1h 0m 0s")]:
        assert one(spark, ms, fm.duration, "long") == text
    for rate, text in [(1.5, "1.50 x/s"), (1500.0, "1.50K x/s"), (2.5e6, "2.50M x/s")]:
        assert one(spark, rate, lambda c: fm.rate(c, "x"), "double") == text


def test_truncate_counts_bytes_but_cuts_characters(spark):
    assert one(spark, "abcdef", lambda c: tx.truncate(c, 6)) == "abcdef"
    assert one(spark, "abcdefg", lambda c: tx.truncate(c, 6)) == "abc..."
    assert one(spark, "äöüß", lambda c: tx.truncate(c, 6)) == "äöü..."
    assert one(spark, "abcdef", lambda c: tx.truncate(c, 2)) == "ab"


def test_sensitive(spark):
    assert one(spark, "My PassWord is", tx.filter_sensitive) == "[FILTERED]"
    assert one(spark, "a (b)", lambda c: tx.filter_sensitive(c, ["(B)"])) == "[FILTERED]"
    assert one(spark, "plain", lambda c: tx.filter_sensitive(c, ["a.ain"])) == "plain"


def test_flags(spark):
    assert one(spark, 0x100 | 0x4000 | 0x8000, pl.file_change, "long") == "created,metadata_modified,owner_changed"
    assert one(spark, 1, pl.file_change, "long") == "unknown"
    assert one(spark, 0x20000 | 0x100000, pl.modifiers, "long") == ["Shift", "Command"]


def test_search_time_reads_rfc3339(spark):
    from tidelog.functions import times

    texts = ["2024-01-01T00:00:00.5+02:00", "2024-01-01T00:00:00.123456789Z", "2024-01-01T10:00:00-05:30", "2024-13-01T00:00:00Z", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(times.parse_search_time(F.col("t")).cast("string").alias("v"))
    want = ["2023-12-31 22:00:00.5", "2024-01-01 00:00:00.123456", "2024-01-01 15:30:00", None, None]
    assert [r.v for r in rows.collect()] == want

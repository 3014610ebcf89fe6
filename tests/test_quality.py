import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import payload as pl
from tidelog.operators import quality as q
from tidelog.schema import EVENT_LOG

GOOD = (1, "click", None, None, '{"a": 1}', "s", "e1")


def test_event_rules(spark):
    rows = [
        GOOD,
        (0, *GOOD[1:]),
        (1, "", *GOOD[2:]),
        (*GOOD[:4], "{", "s", "e1"),
        (*GOOD[:5], "", "e1"),
        (*GOOD[:6], ""),
        (0, "", None, None, "{", "", ""),
    ]
    got = [r.errors for r in q.validate_events(spark.createDataFrame(rows, EVENT_LOG)).collect()]
    assert [len(e) for e in got] == [0, 1, 1, 1, 1, 1, 5]
    assert got[-1] == [m for m, _ in q.EVENT_RULES]


@pytest.mark.parametrize(
    "text,valid",
    [
        ('{"a":null}', True),
        ("{}", True),
        ('"x"', True),
        (" [1, 2] ", True),
        ("1", True),
        ("null", True),
        ('{"a":1,"a":2}', True),
        ("", False),
        ("1,2", False),
        ("1] [2", False),
        ('1} {"v":2', False),
        ('{"a":1}}', False),
        ("{'a':1}", False),
        ("[1", False),
        ("nul", False),
    ],
)
def test_json_validity(spark, text, valid):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(pl.is_json(F.col("t"))).first()[0] is valid


def broken(spark, text, *rules):
    checked = q.apply_rules(spark.createDataFrame([(text,)], "data string"), list(rules))
    return [e.rule for e in checked.first().rule_errors]


def test_rules_on_missing_and_null_fields(spark):
    rules = [
        q.required("a"),
        q.required("b.c"),
        q.field_type("a", "string"),
        q.number_range("a", 0, 10),
        q.pattern("a", "^x"),
        q.non_empty("a"),
        q.positive("a"),
    ]
    # A JSON null is there, but is neither text nor a number.
    assert broken(spark, '{"a": null, "b": {"c": [1]}}', *rules) == [
        "field_type_a",
        "non_empty_string_a",
        "positive_number_a",
    ]
    # A missing field breaks only the required and custom rules.
    assert broken(spark, "{}", *rules) == [
        "required_field_a",
        "required_field_b.c",
        "non_empty_string_a",
        "positive_number_a",
    ]
    # Ranges are closed, patterns search.
    assert broken(spark, '{"a": 10}', q.number_range("a", 0, 10), q.positive("a")) == []
    assert broken(spark, '{"a": "zxz"}', q.pattern("a", "x"), q.pattern("a", "^x")) == ["pattern_a"]


@pytest.mark.parametrize(
    "value,kind",
    [("1", "number"), ("1.5", "number"), ('"t"', "string"), ("true", "boolean"), ("[1]", "array"), ('{"x":1}', "object"), ("null", "null")],
)
def test_types(spark, value, kind):
    for other in pl.JSON_TYPES:
        found = broken(spark, '{"a": %s}' % value, q.field_type("a", other))
        assert (found == []) == (other == kind)


def test_custom_rule_from_pandas(spark):
    @F.pandas_udf(T.BooleanType())
    def short(v: pd.Series) -> pd.Series:
        return v.str.len() < 12

    rule = q.custom("short", lambda d: short(F.to_json(d)))
    assert broken(spark, '{"a": 1}', rule) == []
    assert broken(spark, '{"a": 123456789}', rule) == ["short"]


def test_late_and_future(spark):
    as_of = dt.datetime(2024, 2, 1)
    now = int((as_of - dt.datetime(1970, 1, 1)).total_seconds())
    rows = [(t * 1_000_000,) for t in (now, now + 3600, now + 3601, now - 365 * 86400, now - 366 * 86400)]
    got = q.late_flags(spark.createDataFrame(rows, "t long"), "t", as_of).collect()
    assert [r.in_future for r in got] == [False, False, True, False, False]
    assert [r.too_old for r in got] == [False, False, False, False, True]


ROWS = "id long, arrival long, event_id long, ts long"


def arrivals(spark, ids, times=None):
    times = times or list(range(len(ids)))
    return spark.createDataFrame(
        [(i, n, n, t) for n, (i, t) in enumerate(zip(ids, times))], ROWS
    )


def test_disorder_and_gaps(spark):
    hour = 3_600_000_000
    times = [0, hour, 2 * hour + 1, hour, 10 * hour]
    rows = arrivals(spark, range(5), times)
    assert [r.event_id for r in q.out_of_order(rows, "arrival", "event_id", "ts").collect()] == [3]
    assert sorted(r.event_id for r in q.large_gaps(rows, "arrival", "event_id", "ts").collect()) == [2, 4]


def test_sequence(spark):
    rows = arrivals(spark, [1, 2, 5, 4, 4, 4, 6, 20])
    issues = q.sequence_issues(rows, "id", "arrival", "event_id")
    got = sorted((r.event_id, r.issue) for r in issues.collect())
    assert got == [(2, "gap"), (3, "out_of_order"), (4, "duplicate"), (5, "duplicate"), (7, "gap")]
    missing = sorted(r.missing_id for r in q.missing_ids(issues, "id", block=4).collect())
    assert missing == [3, 4, *range(7, 20)]


def by_hand(ids):
    top, late, issues = None, set(), []
    for n, ident in enumerate(ids):
        if top is not None and ident != top + 1:
            if ident > top:
                issues.append((n, "gap"))
            elif ident in late:
                issues.append((n, "duplicate"))
            else:
                late.add(ident)
                issues.append((n, "out_of_order"))
        top = ident if top is None else max(top, ident)
    return issues


@pytest.mark.parametrize("parts", [60, 1])
def test_sequence_against_plain_python(spark, parts):
    rnd = random.Random(11)
    ids = [100 + n // 3 + rnd.choice([-4, 0, 0, 0, 2]) for n in range(300)] + [7] * 60
    rows = arrivals(spark, ids).repartition(5)
    got = q.sequence_issues(rows, "id", "arrival", "event_id", parts=parts)
    assert sorted((r.event_id, r.issue) for r in got.collect()) == by_hand(ids)


def test_first_and_repeats(spark):
    rows = arrivals(spark, [3, 1, 3, 2, 1, 3])
    kept = q.keep_first(rows, "id", "arrival", "event_id")
    assert kept.columns == rows.columns
    assert sorted(r.event_id for r in kept.collect()) == [0, 1, 3]
    again = q.repeats(rows, "id", "arrival", "event_id")
    assert sorted(r.event_id for r in again.collect()) == [2, 4, 5]


def test_no_expectation_no_finding(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, checksum string")
    wanted = spark.createDataFrame([(1, "a"), (2, "x")], "id long, checksum string")
    assert [r.id for r in q.checksum_mismatch(rows, wanted, "id").collect()] == [2]


def test_loss(spark):
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "c string")
    sent = frame([str(i) for i in range(20)])
    row = q.loss_check(sent, frame([str(i) for i in range(19)]), "c").first()
    assert (row.share, row.enough, row.equal, row.lost) == (0.95, True, False, 1)
    assert not q.loss_check(sent, frame([str(i) for i in range(18)]), "c").first().enough
    assert q.loss_check(sent, sent, "c", allowed=0.0).first().equal


def test_nulls_break_the_event_rules(spark):
    loose = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_LOG)
    rows = spark.createDataFrame([(1, None, None, None, "{}", None, None)], loose)
    assert len(q.validate_events(rows).first().errors) == 3


def test_blank_of_any_kind_is_empty(spark):
    rows = spark.createDataFrame([('{"a": " \\t\\n"}',), ('{"a": "\\u00a0\\u3000"}',), ('{"a": " x "}',)], "data string")
    assert [len(r.rule_errors) for r in q.apply_rules(rows, [q.non_empty("a")]).collect()] == [1, 1, 0]

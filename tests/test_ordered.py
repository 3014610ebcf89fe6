"""Cutting hot groups must not change any result: compare with plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import ordered as o

SCHEMA = "k string, at long, seq long, v long"
DAY = 86_400_000_000


def hot_rows():
    """One key has most rows; many share a time, some share one microsecond; a null key."""
    rnd = random.Random(7)
    rows = []
    for seq in range(600):
        key = rnd.choice(["hot"] * 7 + ["a", "b", None])
        at = rnd.choice(
            [
                5 * DAY,  # one instant with very many rows
                5 * DAY + rnd.randrange(1_000),
                5 * DAY + rnd.randrange(60_000_000),
                rnd.randrange(40 * DAY),
            ]
        )
        rows.append((key, at, seq, rnd.randrange(-50, 50)))
    return rows


def groups(rows, by_key=True):
    out = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(row[0] if by_key else "all", []).append(row)
    return out


@pytest.fixture(scope="module")
def rows():
    return hot_rows()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("down", [False, True])
def test_cells_follow_the_order_and_cut_large_groups(frame, keys, down):
    split = o.split_groups(frame, keys, ["at", "seq"], 40, down)
    assert split.frame.count() == 600
    assert split.frame.groupBy(o.CELL).count().agg(F.max("count")).first()[0] < 100
    ranges = (
        split.frame.groupBy(*split.by)
        .agg(F.min(F.struct("at", "seq")).alias("lo"), F.max(F.struct("at", "seq")).alias("hi"))
        .collect()
    )
    per_key = {}
    for r in ranges:
        per_key.setdefault(r["k"] if keys else 0, []).append((-r[o.CELL] if down else r[o.CELL], r["lo"], r["hi"]))
    for cells in per_key.values():
        cells.sort()
        assert all(a[2] < b[1] for a, b in zip(cells, cells[1:]))
    assert max(map(len, per_key.values())) > 10


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("depth,parts", [(1, 100), (10, 100), (3, 24), (10, 1)])
def test_with_previous(frame, rows, keys, depth, parts):
    split = o.with_previous(frame, keys, "at", "seq", depth, parts)
    seen = split.frame.withColumns(
        {
            "before": F.lag("seq", depth).over(split.window),
            "recent": F.sum("v").over(split.rows(-depth, 0)),
        }
    )
    got = {r.seq: (r.before, r.recent) for r in split.own(seen).collect()}
    want = {}
    for members in groups(rows, bool(keys)).values():
        for i, row in enumerate(members):
            before = members[i - depth][2] if i >= depth else None
            want[row[2]] = (before, sum(r[3] for r in members[max(0, i - depth) : i + 1]))
    assert got == want


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("parts,include", [(100, True), (100, False), (24, True), (1, False)])
def test_running(frame, rows, keys, parts, include):
    measures = {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}
    out = o.running(frame, keys, ["at", "seq"], measures, include, parts)
    assert set(out.columns) == {"k", "at", "seq", "v", "total", "top"}
    got = {r.seq: (r.total, r.top) for r in out.collect()}
    want = {}
    for members in groups(rows, bool(keys)).values():
        for i, row in enumerate(members):
            upto = [r[3] for r in members[: i + (1 if include else 0)]]
            want[row[2]] = (sum(upto), max(upto) if upto else None)
    assert got == want


@pytest.mark.parametrize(
    "parts,span", [(100, 1), (100, 30_000_000), (24, 500), (24, 3 * DAY), (1, 500)]
)
def test_trailing_count(frame, rows, parts, span):
    got = {r.seq: r.recent for r in o.trailing_count(frame, ["k"], "at", "seq", span, parts=parts).collect()}
    want = {
        row[2]: sum(
            1
            for r in members
            if r[1] > row[1] - span and (r[1], r[2]) <= (row[1], row[2])
        )
        for members in groups(rows).values()
        for row in members
    }
    assert got == want


def test_row_numbers_without_keys(frame, rows):
    got = [r.seq for r in o.row_numbers(frame, [], "at", "seq", parts=50).orderBy("row_no").collect()]
    assert got == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]


def test_ids_of_any_type(spark, rows):
    """Large and textual ids: no arithmetic is done with them."""
    by_text = {f"id-{r[2]:04d}": r for r in rows}
    texts = spark.createDataFrame([(r[0], r[1], i) for i, r in by_text.items()], "k string, at long, seq string")
    large = spark.createDataFrame([(r[0], r[1], 2**63 - 1 - r[2]) for r in rows], "k string, at long, seq long")
    want = {r.seq: r.recent for r in o.trailing_count(texts, ["k"], "at", "seq", DAY, parts=30).collect()}
    assert want == {
        i: sum(1 for j, s in by_text.items() if s[0] == r[0] and r[1] - DAY < s[1] and (s[1], j) <= (r[1], i))
        for i, r in by_text.items()
    }
    assert o.trailing_count(large, ["k"], "at", "seq", DAY, parts=30).count() == 600

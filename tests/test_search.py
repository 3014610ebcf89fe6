import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.functions import times as tm
from tidelog.operators import search as so

DOCS = [
    (1, "The quick brown fox", ["a", "x"]),
    (2, "the  lazy\tdog", ["b"]),
    (3, "Enterprise entry ent", ["a"]),
    (4, "Größe und Höhe", ["c", "x"]),
    (5, "cat", ["c"]),
    (6, "quack duck", ["b", "x"]),
]
AS_OF = dt.datetime(2024, 2, 15, 12, 30)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, text string, tags array<string>")


@pytest.mark.parametrize(
    "query,mode,ids",
    [
        ("*", "token", [1, 2, 3, 4, 5, 6]),
        ("THE", "token", [1, 2]),
        ("th", "token", []),
        ("UCK", "wildcard", [6]),
        ("duck", "token", [6]),
        ("quick brown", "token", []),
        ("k b", "wildcard", []),
        ("en", "prefix", [3]),
        ("ent", "prefix", [3]),
        ("cat", "prefix", []),
        ("Ent", "prefix", []),
        ("grö", "prefix", [4]),
        ("q.*", "token", []),
        ("\\E", "token", []),
        ("enterprise", "prefix", [3]),
        ("größe", "token", [4]),
        # Distance counts bytes: the two-byte letter costs a change and a deletion.
        ("grosse", "fuzzy", []),
        ("quick", "fuzzy", [1, 6]),
        # Words of up to three bytes never match, and the query keeps its case.
        ("cat", "fuzzy", []),
        ("QUICK", "fuzzy", []),
        ("/^the/", "token", [2]),
        ("/^the/i", "token", [1, 2]),
        ("la[xyz]y", "regex", [2]),
    ],
)
def test_text_modes(docs, query, mode, ids):
    found = docs.filter(so.text_predicate(F.col("text"), query, mode))
    assert sorted(r.id for r in found.collect()) == ids


def test_bad_queries():
    for query in ("", "/(/", "x" * 1001):
        with pytest.raises(ValueError):
            so.text_predicate(F.lit("x"), query) if query else so.text_predicate(None, query)


def test_filters():
    assert so.parse_filters("a=1, b = 2 ,,a=3=4") == {"a": "3=4", "b": "2"}
    for text in ("a", "=1", "a="):
        with pytest.raises(ValueError):
            so.parse_filters(text)


def test_filter_lookup_order(spark):
    frame = spark.sql(
        "select 1 id, 'col' color, map('shape','round') metadata, '{\"size\":\"5\",\"shape\":\"no\"}' data"
    )
    for text, hits in [("color=col", 1), ("shape=round", 1), ("size=5", 1), ("shape=no", 0), ("none=1", 0)]:
        spec = so.SearchSpec(filters=so.parse_filters(text))
        assert so.matching(frame, spec).count() == hits, text


def test_paging(spark):
    rows = spark.range(50).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("ts"), F.lit("").alias("data"))
    order = sorted(((i % 7, i) for i in range(50)), reverse=True)
    page = so.search(rows, so.SearchSpec(limit=5, offset=3)).collect()
    assert [(r.ts, r.event_id) for r in page] == order[3:8]
    oldest = so.search(rows, so.SearchSpec(sort="oldest", limit=2)).collect()
    assert [(r.ts, r.event_id) for r in oldest] == order[::-1][:2]
    for limit, offset, want in [(10, 0, (50, 10, True)), (10, 40, (50, 10, False)), (10, 45, (50, 5, False)), (10, 60, (50, 0, False))]:
        assert tuple(so.totals(rows, so.SearchSpec(limit=limit, offset=offset)).first()) == want
    for bad in (dict(limit=0), dict(limit=10_001), dict(offset=1_000_001), dict(sort="up")):
        with pytest.raises(ValueError):
            so.search(rows, so.SearchSpec(**bad))


def test_facets_and_index(docs):
    got = {(r.facet, r.value): r.n for r in so.facets(docs, {"tag": F.col("tags")}).collect()}
    assert got == {("tag", "a"): 2, ("tag", "b"): 2, ("tag", "c"): 2, ("tag", "x"): 3}
    posted = so.postings(docs, "id", "text")
    assert posted.count() == posted.distinct().count()
    assert sorted(r.id for r in so.lookup(docs, posted, "id", "The").collect()) == [1, 2]


def test_relative_ranges():
    day = dt.datetime(2024, 2, 15)
    assert tm.search_range("Today", AS_OF) == (day, dt.datetime(2024, 2, 15, 23, 59, 59))
    assert tm.search_range("yesterday", AS_OF)[0] == dt.datetime(2024, 2, 14)
    assert tm.search_range("last-month", AS_OF) == (AS_OF - dt.timedelta(days=30), AS_OF)
    assert tm.search_range("2024-01-01 to 2024-01-02 10:00", AS_OF) == (
        dt.datetime(2024, 1, 1),
        dt.datetime(2024, 1, 2, 10),
    )
    assert tm.search_range("2024-01-01T10:00:00+02:00..2024-01-02", AS_OF)[0] == dt.datetime(2024, 1, 1, 8)
    assert tm.search_range("2024-01-01..2024-01-01", AS_OF)
    for text in ("next-week", "2024-01-02..2024-01-01", "a..b..c", "x to y"):
        with pytest.raises(ValueError):
            tm.search_range(text, AS_OF)


def test_service_ranges():
    day = dt.datetime(2024, 2, 15)
    assert tm.service_range("today", AS_OF) == (day, AS_OF)
    assert tm.service_range("yesterday", AS_OF) == (day - dt.timedelta(days=1), day)
    start, end = tm.service_range("1704067200", AS_OF)
    assert start == dt.datetime(2024, 1, 1) and end - start == dt.timedelta(hours=1)
    with pytest.raises(ValueError):
        tm.service_range("2024-01-01..2024-01-01", AS_OF)


def test_patterns_are_checked_where_they_run(spark):
    rows = spark.createDataFrame([("é1",), ("12",)], "data string")
    assert so.search(rows.withColumn("ts", F.lit(0)).withColumn("event_id", F.lit(1)), so.SearchSpec(query=r"/\p{L}+/")).count() == 1
    for bad in ("/(?P<n>a)/", "/(/"):
        with pytest.raises(ValueError):
            so.text_predicate(F.col("data"), bad)


def test_open_ended_search(spark):
    rows = spark.createDataFrame([(d * 86_400 * 10**9,) for d in range(4)], "ts long")
    two = dt.datetime(1970, 1, 3)
    assert so.matching(rows, so.SearchSpec(start=two)).count() == 2
    assert so.matching(rows, so.SearchSpec(end=two)).count() == 3


@pytest.mark.parametrize("size", [1, 7, 20, 100])
def test_every_page_as_a_range(spark, size):
    rows = [(k // 5, k % 37, k) for k in range(100)]
    frame = spark.createDataFrame(rows, "at long, id long, v long").repartition(3)
    starts = so.page_starts(frame, "at", "id", size, parts=4).persist()
    want = sorted(rows)
    for page in range(0, 100 // size + 2, max(1, 20 // size)):
        got = [tuple(r) for r in so.page_at(frame, starts, page, "at", "id").collect()]
        assert got == want[page * size : (page + 1) * size]
    assert so.page_starts(frame.limit(0), "at", "id", size).count() == 0
    with pytest.raises(ValueError):
        so.page_starts(frame, "at", "id", 0)

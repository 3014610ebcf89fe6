"""Search queries over ``events`` and ``documents``."""

import datetime as dt

from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.functions.times import in_range, search_range, service_range
from tidelog.operators import search as so
from tidelog.operators import wordindex as wi
from tidelog.plans.base import query
from tidelog.session import materialize, work_dir
from tidelog.sources import tables as t

AS_OF = dt.datetime(2024, 2, 1)

# Words of a document as the checks see them.
WORDS = (
    "list_filter(string_split_regex(lower(text), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}]+'), lambda t: t <> '')"
)
K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def _texts(spark, root):
    return t.table(spark, root, "documents").select("doc_id", "text")


def _hits(predicate: str) -> str:
    return f"SELECT doc_id FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE {predicate}"


@query("search_token", _hits("list_contains(w, 'the')"))
def search_token(spark, root):
    docs = t.table(spark, root, "documents")
    return docs.filter(so.text_predicate(F.col("text"), "The", "token")).select("doc_id")


@query("search_wildcard", _hits("len(list_filter(w, lambda t: contains(t, 'tion'))) > 0"))
def search_wildcard(spark, root):
    docs = t.table(spark, root, "documents")
    return docs.filter(so.text_predicate(F.col("text"), "TION", "wildcard")).select("doc_id")


@query(
    "search_regex",
    "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)[a-z]+tion (of|the)[ ,.]')",
)
def search_regex(spark, root):
    docs = t.table(spark, root, "documents")
    pattern = "/[a-z]+tion (of|the)[ ,.]/i"
    return docs.filter(so.text_predicate(F.col("text"), pattern)).select("doc_id")


@query(
    "search_prefix",
    _hits("len(list_filter(w, lambda t: strlen(t) > 3 AND starts_with(t, 'ent'))) > 0"),
)
def search_prefix(spark, root):
    docs = t.table(spark, root, "documents")
    return docs.filter(so.text_predicate(F.col("text"), "enter", "prefix")).select("doc_id")


# Every multi-byte character becomes one byte, its extra bytes go to the end.
_DISTANCE = (
    "levenshtein(regexp_replace(t, '[^\\x00-\\x7F]', '#', 'g') || repeat(chr(1), strlen(t) - length(t)), "
    "'{word}')"
)


_FUZZY = _hits(
    "len(list_filter(w, lambda t: strlen(t) > 3 AND " + _DISTANCE.format(word="thesea") + " <= 2)) > 0"
)


@query("search_fuzzy_scan", _FUZZY)
def search_fuzzy_scan(spark, root):
    docs = t.table(spark, root, "documents")
    return docs.filter(so.text_predicate(F.col("text"), "thesea", "fuzzy")).select("doc_id")


# -- searches on the written index ----------------------------------------------------------------

_INDEXES: dict[tuple[str, str], wi.WordIndex] = {}


def index_of(spark, root) -> wi.WordIndex:
    """The index of the given documents, written once per application, as a service would keep it."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _INDEXES:
        docs, path = t.documents(spark, root), work_dir(spark, "search-index")
        _INDEXES[key] = wi.write_word_index(docs, path, "doc_id", "text", F.col("tags"), F.col("day"))
    return _INDEXES[key]


@query("search_fuzzy", _FUZZY)
def search_fuzzy(spark, root):
    return wi.search_near_one(index_of(spark, root), "thesea")


# A hundred misspelt words: every seventh distinct word of the items, cut and changed.
_MISSPELT = (
    "(SELECT DISTINCT substr(w, 1, 2) || 'x' || substr(w, 4) AS query FROM (SELECT w, row_number() OVER (ORDER BY w) AS n FROM "
    "(SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) = strlen(w) AND length(w) > 5) "
    "WHERE n % 7 = 0 AND n <= 700)"
)


@query(
    "search_fuzzy_many",
    f"WITH q AS {_MISSPELT}, v AS (SELECT DISTINCT unnest({WORDS}) AS t, doc_id FROM documents), "
    "near AS (SELECT query, t FROM q JOIN (SELECT DISTINCT t FROM v) ON strlen(t) > 3 AND abs(strlen(t) - strlen(query)) <= 2 AND "
    + _DISTANCE.replace("'{word}'", "query")
    + " <= 2) SELECT DISTINCT query, doc_id FROM near JOIN v USING (t)",
)
def search_fuzzy_many(spark, root):
    items = t.table(spark, root, "benchmark")
    words = items.select(F.explode(F.split("text", " ")).alias("w")).distinct()
    words = words.filter((F.octet_length("w") == F.char_length("w")) & (F.char_length("w") > 5))
    numbered = so.row_numbers(words, [], "w", "w", "n").filter("n % 7 = 0 and n <= 700")
    asked = numbered.select(F.concat(F.substring("w", 1, 2), F.lit("x"), F.expr("substring(w, 4)")).alias("query"))
    return wi.search_near(index_of(spark, root), asked).select("query", "doc_id")


@query("search_wildcard_index", _hits("len(list_filter(w, lambda t: contains(t, 'tion'))) > 0"))
def search_wildcard_index(spark, root):
    return wi.search_part(index_of(spark, root), "TION").select("doc_id")


@query(
    "search_regex_index",
    "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)[a-z]+tion (of|the)[ ,.]')",
)
def search_regex_index(spark, root):
    docs = t.table(spark, root, "documents")
    return wi.search_pattern(index_of(spark, root), docs, "text", "(?i)[a-z]+tion (of|the)[ ,.]", ["tion"]).select("doc_id")


@query(
    "search_complex",
    _hits("list_contains(w, 'the')").replace(
        "WHERE", "JOIN documents d2 USING (doc_id) WHERE d2.source IN ('src1', 'src7') AND"
    ),
)
def search_complex(spark, root):
    docs = t.documents(spark, root)
    tagged = F.arrays_overlap("tags", F.array(F.lit("src1"), F.lit("src7")))
    return docs.filter(tagged & so.text_predicate(F.col("text"), "the")).select("doc_id")


@query(
    "search_days",
    "SELECT doc_id FROM documents WHERE DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) "
    "BETWEEN DATE '2024-03-05' AND DATE '2024-04-01'",
)
def search_days(spark, root):
    index = index_of(spark, root)
    return wi.documents(index, wi.between(index, wi.DAY, "2024-03-05", "2024-04-01"))


@query(
    "time_range",
    "SELECT event_id, epoch_us(ts) AS ts_us FROM events "
    "WHERE ts BETWEEN TIMESTAMP '2024-01-25 00:00:00' AND TIMESTAMP '2024-02-01 00:00:00'",
)
def time_range(spark, root):
    frame = t.table(spark, root, "events")
    start, end = search_range("last-week", AS_OF)
    hits = frame.filter(in_range(frame, "ts", start, end))
    return hits.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query(
    "time_range_hour",
    "SELECT event_id, epoch_us(ts) AS ts_us FROM events "
    "WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-10 13:00:00'",
)
def time_range_hour(spark, root):
    frame = t.table(spark, root, "events")
    start, end = service_range("2024-01-10 12:00:00", AS_OF)
    hits = frame.filter(in_range(frame, "ts", start, end))
    return hits.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query(
    "search_filters",
    f"SELECT event_id, user_id FROM events WHERE event_type = 'click' AND {K} = 42",
)
def search_filters(spark, root):
    frame = t.table(spark, root, "events")
    spec = so.SearchSpec(filters=so.parse_filters("event_type=view, k=42, event_type=click"))
    return so.matching(frame, spec, text="props").select("event_id", "user_id")


@query("type_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def type_filter(spark, root):
    spec = so.SearchSpec(event_types=["click", "error"])
    return so.matching(t.table(spark, root, "events"), spec).select("event_id")


@query(
    "find_by_id",
    "SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 777",
)
def find_by_id(spark, root):
    rows = t.table(spark, root, "events").filter(F.col("event_id") == 777)
    return rows.select("event_id", "user_id", "event_type", "value")


@query("search_ids", "SELECT event_id FROM events WHERE props LIKE '%7%'")
def search_ids(spark, root):
    spec = so.SearchSpec(query="/7/")
    return so.matching(t.table(spark, root, "events"), spec, text="props").select("event_id")


_PAGE_WHERE = (
    "FROM events WHERE event_type IN ('click', 'purchase') "
    "AND ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00' "
)
_PAGE_SPEC = so.SearchSpec(
    event_types=["click", "purchase"],
    start=dt.datetime(2024, 1, 2),
    end=dt.datetime(2024, 1, 31),
    limit=200,
    offset=300,
)


@query(
    "search_page",
    "SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value "
    + _PAGE_WHERE
    + "ORDER BY ts DESC, event_id DESC LIMIT 200 OFFSET 300",
)
def search_page(spark, root):
    page = so.search(t.table(spark, root, "events"), _PAGE_SPEC)
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")
    return page.select("event_id", micros, "user_id", "event_type", "value")


@query(
    "search_totals",
    "SELECT total_count, CAST(greatest(least(total_count - 300, 200), 0) AS BIGINT) AS returned, "
    "300 + greatest(least(total_count - 300, 200), 0) < total_count AS has_more "
    "FROM (SELECT count(*) AS total_count " + _PAGE_WHERE + ")",
)
def search_totals(spark, root):
    return so.totals(t.table(spark, root, "events"), _PAGE_SPEC)


@query(
    "search_sorted",
    "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 100",
)
def search_sorted(spark, root):
    spec = so.SearchSpec(sort="oldest")
    return so.search(t.table(spark, root, "events"), spec).select("event_id", "value")


@query(
    "recent_events",
    "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
)
def recent_events(spark, root):
    return so.newest(t.table(spark, root, "events"), "ts", "event_id", 50).select(
        "event_id", "user_id"
    )


_ARRIVALS = (
    "(SELECT CAST(event_id + event_id // 97 - CASE WHEN event_id % 101 = 0 THEN 1 ELSE 0 END AS BIGINT) AS id, "
    "CAST(event_id + CASE WHEN event_id % 50 = 0 THEN 7 ELSE 0 END AS BIGINT) AS arrival, "
    "event_id, epoch_us(ts) AS ts_us, event_type, user_id AS session, props FROM events) a"
)


@query(
    "read_ordered",
    "SELECT event_id, ts_us FROM (SELECT event_id, ts_us FROM "
    + _ARRIVALS
    + " ORDER BY arrival, event_id LIMIT 100) ORDER BY ts_us, event_id",
)
def read_ordered(spark, root):
    frame = t.arrivals(spark, root)
    rows = so.first_arrived_by_time(frame, "arrival", "event_id", "ts_us", 100)
    return rows.select("event_id", "ts_us")


@query(
    "page_numbers",
    "SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 20 AS BIGINT) AS page "
    "FROM events",
)
def page_numbers(spark, root):
    frame = t.events(spark, root).select("event_id", "ts_us")
    return so.page_numbers(frame, "ts_us", "event_id").select("event_id", "page")


@query(
    "search_deep_page",
    "SELECT event_id, user_id, value FROM events ORDER BY ts, event_id LIMIT 20 OFFSET (SELECT (count(*) - 1) // 20 // 2 * 20 FROM events)",
)
def search_deep_page(spark, root):
    """The page in the middle of all, read as a range of times and ids."""
    frame = t.table(spark, root, "events")
    starts = materialize(so.page_starts(frame, "ts", "event_id"), "page-starts")
    last = starts.agg(F.max("page")).first()[0]
    return so.page_at(frame, starts, (last or 0) // 2, "ts", "event_id").select("event_id", "user_id", "value")


@query(
    "facets",
    "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang "
    "UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source "
    "UNION ALL SELECT 'tags', tag, count(*) FROM (SELECT unnest(list_distinct([lang, source])) AS tag "
    "FROM documents) GROUP BY tag",
)
def facets(spark, root):
    frame = t.table(spark, root, "documents").select("lang", "source")
    return so.facets(
        frame,
        {"lang": F.col("lang"), "source": F.col("source"), "tags": F.array("lang", "source")},
    )


@query(
    "build_index",
    f"SELECT token, count(*) AS n_docs FROM (SELECT unnest(list_distinct({WORDS})) AS token "
    "FROM documents) GROUP BY token",
)
def build_index(spark, root):
    posted = so.postings(_texts(spark, root), "doc_id", "text")
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


@query(
    "posting_lists",
    f"SELECT token, doc_id FROM (SELECT unnest(list_distinct({WORDS})) AS token, doc_id FROM documents)",
)
def posting_lists(spark, root):
    """The word index as it is on disk."""
    path = work_dir(spark, "word-index")
    so.write_index(so.postings(_texts(spark, root), "doc_id", "text"), path, "doc_id")
    return spark.read.parquet(path)


@query("day_index", "SELECT CAST(ts AS DATE) AS day, event_id FROM events")
def day_index(spark, root):
    rows = t.table(spark, root, "events").select("ts", "event_id")
    return so.day_index(rows, "event_id", F.col("ts"))


@query("search_index_join", _hits("list_contains(w, 'tion')"))
def search_index_join(spark, root):
    docs = t.table(spark, root, "documents")
    path = work_dir(spark, "word-index")
    so.write_index(so.postings(_texts(spark, root), "doc_id", "text"), path, "doc_id")
    return so.lookup(docs, spark.read.parquet(path), "doc_id", "Tion").select("doc_id")


@query(
    "union_ids",
    f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({WORDS}) AS token FROM documents) "
    "WHERE token IN ('der', 'que')",
)
def union_ids(spark, root):
    index = index_of(spark, root)
    return wi.documents(index, wi.any_of(index, wi.WORD, ["der", "que"]))


@query(
    "intersect_ids",
    f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({WORDS}) AS token FROM documents) "
    "WHERE token = 'the' INTERSECT SELECT doc_id FROM documents WHERE lang IN ('en', 'fr')",
)
def intersect_ids(spark, root):
    index = index_of(spark, root)
    both = wi.all_of([wi.any_of(index, wi.WORD, ["the"]), wi.any_of(index, wi.TAG, ["en", "fr"])])
    return wi.documents(index, both)


@query(
    "lev_distance",
    "SELECT DISTINCT t AS token, CAST("
    + _DISTANCE.format(word="ention")
    + f" AS INTEGER) AS distance FROM (SELECT unnest({WORDS}) AS t FROM documents)",
)
def lev_distance(spark, root):
    words = so.postings(_texts(spark, root), "doc_id", "text")
    words = words.select("token").distinct()
    return words.select("token", tx.edit_distance(F.col("token"), F.lit("ention")).alias("distance"))

"""Search over events and documents: predicates, paging, facets, word index."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import text as tx
from tidelog.functions.times import floor_div, in_range
from tidelog.operators.ordered import row_numbers

# Bounds of paging.
MAX_LIMIT = 10_000
MAX_OFFSET = 1_000_000
DEFAULT_LIMIT = 100
MAX_QUERY_BYTES = 1000


@dataclass(frozen=True)
class SearchSpec:
    query: str = "*"
    mode: str = "token"
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    filters: dict[str, str] = field(default_factory=dict)
    event_types: list[str] = field(default_factory=list)
    sort: str = "newest"
    limit: int = DEFAULT_LIMIT
    offset: int = 0


def parse_filters(text: str) -> dict[str, str]:
    """``a=1,b=2``; a later pair with the same key wins."""
    found: dict[str, str] = {}
    for pair in filter(None, (p.strip() for p in text.split(","))):
        key, eq, value = (part.strip() for part in pair.partition("="))
        if not (key and eq and value):
            raise ValueError(f"filter must be key=value: {pair!r}")
        found[key] = value
    return found


def regex_of(query: str) -> str | None:
    """The pattern inside ``/.../`` or ``/.../i``, else None."""
    match = re.fullmatch(r"/(.*)/(i?)", query, flags=re.DOTALL)
    if not match:
        return None
    return ("(?i)" if match.group(2) else "") + match.group(1)


def _check_pattern(pattern: str) -> None:
    """Compiles the pattern where it will run, so that a broken one fails before the job."""
    spark = SparkSession.active()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as problem:
        raise ValueError(f"invalid pattern: {problem}") from None


def text_predicate(text: Column, query: str, mode: str = "token") -> Column:
    if not query:
        raise ValueError("query cannot be empty")
    if query == "*":
        return F.lit(True)
    pattern = regex_of(query)
    if pattern is not None or mode == "regex":
        pattern = query if pattern is None else pattern
        _check_pattern(pattern)
        return text.rlike(pattern)
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise ValueError(f"query too long (at most {MAX_QUERY_BYTES} bytes)")
    modes = {
        "token": tx.has_token,
        "wildcard": tx.token_contains,
        "prefix": tx.token_starts,
        "fuzzy": tx.token_near,
    }
    if mode not in modes:
        raise ValueError(f"unknown search mode: {mode}")
    return modes[mode](text, query)


def filter_predicate(frame: DataFrame, key: str, value: str, payload: str = "data") -> Column:
    """A column of that name, else a metadata entry, else a payload field."""
    if key in frame.columns:
        return F.col(key).cast("string") == value
    if "metadata" in frame.columns and isinstance(frame.schema["metadata"].dataType, T.MapType):
        if payload not in frame.columns:
            return F.try_element_at("metadata", F.lit(key)) == value
        return (
            F.coalesce(
                F.try_element_at("metadata", F.lit(key)), F.get_json_object(payload, f"$.{key}")
            )
            == value
        )
    return F.get_json_object(payload, f"$.{key}") == value


def matching(
    frame: DataFrame, spec: SearchSpec, time: str = "ts", text: str = "data"
) -> DataFrame:
    """All rows that satisfy the spec, before sorting and paging."""
    wanted: list[Column] = []
    if spec.start is not None and spec.end is not None and spec.start > spec.end:
        raise ValueError("start time must not be after end time")
    if spec.start is not None or spec.end is not None:
        wanted.append(in_range(frame, time, spec.start, spec.end))
    if spec.event_types:
        wanted.append(F.col("event_type").isin(spec.event_types))
    wanted += [filter_predicate(frame, k, v, text) for k, v in spec.filters.items()]
    if spec.query != "*":
        wanted.append(text_predicate(F.col(text), spec.query, spec.mode))
    return frame.filter(reduce(lambda a, b: a & b, wanted)) if wanted else frame


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset must be 0 to {MAX_OFFSET}")


def sort_columns(sort: str, time: str, unique: str) -> list[Column]:
    if sort == "newest":
        return [F.col(time).desc(), F.col(unique).desc()]
    if sort == "oldest":
        return [F.col(time).asc(), F.col(unique).asc()]
    raise ValueError("sort must be 'newest' or 'oldest'")


def search(
    frame: DataFrame,
    spec: SearchSpec,
    time: str = "ts",
    text: str = "data",
    unique: str = "event_id",
) -> DataFrame:
    """One page of hits. Sorting and cutting plan as a top-k, not as a full sort."""
    check_page(spec.limit, spec.offset)
    order = sort_columns(spec.sort, time, unique)
    return matching(frame, spec, time, text).orderBy(*order).offset(spec.offset).limit(spec.limit)


def totals(
    frame: DataFrame, spec: SearchSpec, time: str = "ts", text: str = "data"
) -> DataFrame:
    """Number of hits and whether more follow after this page."""
    check_page(spec.limit, spec.offset)
    n = F.count(F.lit(1))
    returned = F.greatest(F.least(n - spec.offset, F.lit(spec.limit)), F.lit(0)).cast("long")
    return matching(frame, spec, time, text).agg(
        n.alias("total_count"),
        returned.alias("returned"),
        (F.lit(spec.offset) + returned < n).alias("has_more"),
    )


def page_numbers(
    frame: DataFrame,
    time_us: str,
    unique: str,
    page_size: int = 20,
    parts: int | None = None,
) -> DataFrame:
    """Zero-based page of every row, oldest first, without a global sort."""
    numbered = row_numbers(frame, [], time_us, unique, "_row", parts=parts)
    return numbered.withColumn("page", floor_div(F.col("_row") - 1, page_size)).drop("_row")


def page_starts(
    frame: DataFrame, time: str, unique: str, page_size: int = 20, parts: int | None = None
) -> DataFrame:
    """``page``, and time and id of its first row, oldest first: the table by which pages are found."""
    if page_size < 1:
        raise ValueError("a page has at least one row")
    numbered = row_numbers(frame.select(time, unique), [], time, unique, "_row", parts=parts)
    first = numbered.filter((F.col("_row") - 1) % page_size == 0)
    return first.select(floor_div(F.col("_row") - 1, page_size).alias("page"), time, unique)


def page_at(frame: DataFrame, starts: DataFrame, page: int, time: str, unique: str) -> DataFrame:
    """The rows of one page, however deep it lies: a range read between two starts.

    ``starts`` is ``page_starts`` of the same rows; the pair (time, id) must be unique. Of a page that
    is not there nothing is returned.
    """
    bounds = {r["page"]: (r[time], r[unique]) for r in starts.filter(F.col("page").isin(page, page + 1)).collect()}
    if page not in bounds:
        return frame.limit(0)
    at, ident = bounds[page]
    rows = frame.filter((F.col(time) >= F.lit(at)) & ((F.col(time) > F.lit(at)) | (F.col(unique) >= F.lit(ident))))
    if page + 1 in bounds:
        at, ident = bounds[page + 1]
        rows = rows.filter((F.col(time) <= F.lit(at)) & ((F.col(time) < F.lit(at)) | (F.col(unique) < F.lit(ident))))
    return rows.orderBy(time, unique)


def newest(frame: DataFrame, time: str, unique: str, n: int) -> DataFrame:
    return frame.orderBy(F.col(time).desc(), F.col(unique).desc()).limit(n)


def first_arrived_by_time(
    frame: DataFrame, arrival: str, unique: str, time: str, n: int
) -> DataFrame:
    """The first ``n`` rows by arrival, then sorted by time."""
    return frame.orderBy(arrival, unique).limit(n).orderBy(time, unique)


def facets(frame: DataFrame, unpivoted: dict[str, Column]) -> DataFrame:
    """Counts per value for several facets in one pass.

    A facet may be an array; each of its values counts once per row.
    """

    def labelled(name: str, values: Column) -> Column:
        return F.transform(
            values,
            lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value")),
        )

    pairs = []
    for name, col in unpivoted.items():
        kind = frame.select(col.alias("c")).schema["c"].dataType
        values = F.array_distinct(col) if isinstance(kind, T.ArrayType) else F.array(col)
        pairs.append(labelled(name, values))
    return (
        frame.select(F.explode(F.concat(*pairs)).alias("f"))
        .groupBy("f.facet", "f.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("value").isNotNull())
    )


# -- word index ------------------------------------------------------------------


def postings(frame: DataFrame, unique: str, text: str) -> DataFrame:
    """(token, id), each pair once. Pairs are unique per row, so nothing is shuffled."""
    words = F.array_distinct(tx.tokens(F.col(text)))
    return frame.select(F.explode(words).alias("token"), unique)


def day_index(frame: DataFrame, unique: str, time: Column) -> DataFrame:
    """(day, id) of every row with a time, for lookups of whole days."""
    return frame.select(F.to_date(time).alias("day"), unique).filter(F.col("day").isNotNull())


def write_index(posting: DataFrame, path: str, unique: str, files: int | None = None) -> None:
    """Sorted by token and id; frequent words spread over several files."""
    by = ["token", unique]
    (
        (posting.repartitionByRange(files, *by) if files else posting.repartitionByRange(*by))
        .sortWithinPartitions("token", unique)
        .write.mode("overwrite")
        .parquet(path)
    )


def lookup(frame: DataFrame, index: DataFrame, unique: str, query: str) -> DataFrame:
    """Rows whose id is posted under the word; the word filter reaches the index scan."""
    hits = index.filter(F.col("token") == query.lower()).select(unique)
    return frame.join(hits, unique, "left_semi")

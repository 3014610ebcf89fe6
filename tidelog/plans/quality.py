"""Data quality queries."""

import datetime as dt

from pyspark.sql import functions as F

from tidelog.functions import payload as pl
from tidelog.functions import times as tm
from tidelog.operators import quality as q
from tidelog.plans.base import query
from tidelog.plans.search import _ARRIVALS, K
from tidelog.sources import tables as t

AS_OF = dt.datetime(2024, 2, 1)


def _texts(spark, root):
    return t.table(spark, root, "documents").select("doc_id", "text")


def _flawed_log(spark, root):
    """The event log with faults written into it by row number."""
    n = F.col("event_id").cast("long")
    return t.event_log(spark, root).withColumns(
        {
            "_n": n,
            "timestamp_ns": F.when(n % 11 == 0, F.lit(0)).otherwise(F.col("timestamp_ns")),
            "event_type": F.when(n % 13 == 0, F.lit("")).otherwise(F.col("event_type")),
            "session_id": F.when(n % 17 == 0, F.lit("")).otherwise(F.col("session_id")),
            "data": F.when(n % 19 == 0, F.concat(F.lit("{bad "), "data")).otherwise(F.col("data")),
        }
    )


_FLAWS = (
    "(SELECT event_id, list_filter(["
    "CASE WHEN event_id % 11 = 0 THEN 'Timestamp cannot be zero' END, "
    "CASE WHEN event_id % 13 = 0 THEN 'Event type cannot be empty' END, "
    "CASE WHEN event_id % 17 = 0 THEN 'Session ID cannot be empty' END, "
    "CASE WHEN event_id % 19 = 0 THEN 'Event data is not valid JSON' END], "
    "lambda e: e IS NOT NULL) AS errors FROM events) f"
)


@query(
    "validate_events",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, array_to_string(errors, '; ') AS errors, "
    f"len(errors) = 0 AS passed FROM {_FLAWS}",
)
def validate_events(spark, root):
    checked = q.validate_events(_flawed_log(spark, root))
    return checked.select("event_id", F.array_join("errors", "; ").alias("errors"), "passed")


@query(
    "errors_by_rule",
    f"SELECT unnest(errors) AS rule, count(*) AS n FROM {_FLAWS} GROUP BY 1",
)
def errors_by_rule(spark, root):
    return q.errors_by_rule(q.validate_events(_flawed_log(spark, root)), F.col("errors"))


@query(
    "integrity_stats",
    f"SELECT item, count(*) AS n FROM (SELECT unnest(list_concat(['total', CASE WHEN len(errors) = 0 "
    "THEN 'passed' ELSE 'failed' END], list_transform(errors, lambda e: 'error: ' || e))) AS item "
    f"FROM {_FLAWS}) GROUP BY item",
)
def integrity_stats(spark, root):
    return q.integrity_stats(q.validate_events(_flawed_log(spark, root)), "passed", "errors")


_RULES = [
    q.required("k"),
    q.required("missing.deep"),
    q.field_type("k", "number"),
    q.field_type("k", "string"),
    q.number_range("k", 10, 90),
    q.pattern("type", "^(click|view)"),
    q.non_empty("type"),
    q.positive("k"),
    q.custom("even_user", lambda d: F.try_variant_get(d, "$.user", "long") % 2 == 0),
]


def _rule_rows(spark, root):
    doc = F.to_json(
        F.struct(F.col("k"), F.col("event_type").alias("type"), F.col("user_id").alias("user"))
    )
    return t.events(spark, root).select("event_id", doc.alias("data"))


_RULE_SQL = (
    "(SELECT event_id, list_filter(["
    "'required_field_missing.deep', 'field_type_k', "
    f"CASE WHEN {K} NOT BETWEEN 10 AND 90 THEN 'range_k' END, "
    "CASE WHEN event_type NOT IN ('click', 'view') THEN 'pattern_type' END, "
    f"CASE WHEN {K} <= 0 THEN 'positive_number_k' END, "
    "CASE WHEN user_id % 2 <> 0 THEN 'even_user' END], lambda e: e IS NOT NULL) AS errors "
    "FROM events) r"
)


@query(
    "rule_engine",
    f"SELECT event_id, array_to_string(errors, ',') AS broken FROM {_RULE_SQL}",
)
def rule_engine(spark, root):
    checked = q.apply_rules(_rule_rows(spark, root), _RULES)
    return checked.select("event_id", F.array_join(F.col("rule_errors.rule"), ",").alias("broken"))


@query(
    "rule_totals",
    "SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS passed, "
    "count(*) FILTER (WHERE NOT ok) AS failed FROM (SELECT "
    f"{K} BETWEEN 10 AND 90 AND {K} > 0 AS ok FROM events)",
)
def rule_totals(spark, root):
    rules = [q.required("k"), q.number_range("k", 10, 90), q.positive("k")]
    checked = q.apply_rules(_rule_rows(spark, root), rules)
    return q.rule_totals(checked, F.size("rule_errors") == 0)


_CONTACT = "(SELECT page_id, url, 'user' || page_id || CASE WHEN page_id % 3 = 0 THEN '#' ELSE '@' END || split_part(split_part(url, '//', 2), '/', 1) AS mail, page_id % 5 - 1 AS score, CASE WHEN page_id % 7 = 0 THEN '  ' ELSE 'x' END AS title FROM pages) p"


@query(
    "ready_rules",
    "SELECT page_id, array_to_string(list_filter(["
    f"CASE WHEN NOT regexp_matches(mail, '{q.EMAIL}') THEN 'pattern_mail' END, "
    f"CASE WHEN NOT regexp_matches(url, '{q.URL_PATTERN}') THEN 'pattern_url' END, "
    "CASE WHEN trim(title) = '' THEN 'non_empty_string_title' END, "
    "CASE WHEN score <= 0 THEN 'positive_number_score' END, "
    "CASE WHEN score NOT BETWEEN 0 AND 2 THEN 'range_score' END], lambda e: e IS NOT NULL), ',') AS broken "
    f"FROM {_CONTACT}",
)
def ready_rules(spark, root):
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    at = F.when(F.col("page_id") % 3 == 0, "#").otherwise("@")
    doc = F.to_json(
        F.struct(
            "url",
            F.concat(F.lit("user"), F.col("page_id").cast("string"), at, host).alias("mail"),
            (F.col("page_id") % 5 - 1).alias("score"),
            F.when(F.col("page_id") % 7 == 0, "  ").otherwise("x").alias("title"),
        )
    )
    rows = t.table(spark, root, "pages").select("page_id", doc.alias("data"))
    rules = [
        q.email("mail"),
        q.url("url"),
        q.non_empty("title"),
        q.positive("score"),
        q.number_range("score", 0, 2),
    ]
    checked = q.apply_rules(rows, rules)
    return checked.select("page_id", F.array_join(F.col("rule_errors.rule"), ",").alias("broken"))


@query(
    "late_flags",
    "SELECT event_id, ts_us > 1706745600000000 + 3600000000 AS in_future, "
    "ts_us < 1706745600000000 - 365 * 86400000000 AS too_old FROM "
    "(SELECT event_id, epoch_us(ts) + (event_id % 3 - 1) * 390 * 86400000000 AS ts_us FROM events)",
)
def late_flags(spark, root):
    shift = (F.col("event_id") % 3 - 1) * F.lit(390 * 86_400_000_000)
    rows = t.events(spark, root).select("event_id", (F.col("ts_us") + shift).alias("ts_us"))
    return q.late_flags(rows, "ts_us", AS_OF).drop("ts_us")


_STEP = (
    "SELECT event_id, step FROM (SELECT event_id, ts_us - lag(ts_us) OVER "
    "(ORDER BY arrival, event_id) AS step FROM " + _ARRIVALS + ") s WHERE step "
)


@query("out_of_order", _STEP + "< 0")
def out_of_order(spark, root):
    rows = t.arrivals(spark, root).select("arrival", "event_id", "ts_us")
    return q.out_of_order(rows, "arrival", "event_id", "ts_us").select("event_id", "step")


@query("large_gaps", _STEP + "> 1200000000")
def large_gaps(spark, root):
    rows = t.arrivals(spark, root).select("arrival", "event_id", "ts_us")
    found = q.large_gaps(rows, "arrival", "event_id", "ts_us", threshold=1_200_000_000)
    return found.select("event_id", "step")


_PREV_MAX = (
    "(SELECT id, arrival, event_id, max(id) OVER (ORDER BY arrival, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM " + _ARRIVALS + ") m"
)


@query(
    "sequence_issues",
    "SELECT event_id, id, prev_max, CASE WHEN id > prev_max + 1 THEN 'gap' WHEN row_number() OVER "
    "(PARTITION BY id, id <= prev_max ORDER BY arrival, event_id) = 1 THEN 'out_of_order' "
    f"ELSE 'duplicate' END AS issue FROM {_PREV_MAX} WHERE prev_max IS NOT NULL AND id <> prev_max + 1",
)
def sequence_issues(spark, root):
    rows = t.arrivals(spark, root).select("id", "arrival", "event_id")
    found = q.sequence_issues(rows, "id", "arrival", "event_id")
    return found.select("event_id", "id", "prev_max", "issue")


@query(
    "missing_ids",
    "SELECT unnest(generate_series(prev_max + 1, id - 1)) AS missing_id "
    f"FROM {_PREV_MAX} WHERE id > prev_max + 1",
)
def missing_ids(spark, root):
    rows = t.arrivals(spark, root).select("id", "arrival", "event_id")
    return q.missing_ids(q.sequence_issues(rows, "id", "arrival", "event_id"), "id")


_NTH = (
    "SELECT id, event_id, arrival FROM (SELECT id, event_id, arrival, row_number() OVER "
    "(PARTITION BY id ORDER BY arrival, event_id) AS n FROM " + _ARRIVALS + ") x WHERE n "
)


@query("dedup_first", _NTH + "= 1")
def dedup_first(spark, root):
    rows = t.arrivals(spark, root).select("id", "event_id", "arrival")
    return q.keep_first(rows, "id", "arrival", "event_id")


@query("duplicate_ids", _NTH + "> 1")
def duplicate_ids(spark, root):
    rows = t.arrivals(spark, root).select("id", "event_id", "arrival")
    return q.repeats(rows, "id", "arrival", "event_id")


@query(
    "checksum_mismatch",
    "SELECT doc_id, sha256(text) AS checksum, sha256(text || '!') AS expected FROM documents JOIN labels "
    "USING (doc_id) WHERE toxic = 1",
)
def checksum_mismatch(spark, root):
    docs = t.table(spark, root, "documents").select("doc_id", "text")
    actual = docs.select("doc_id", F.sha2("text", 256).alias("checksum"))
    # Something is expected of the labelled documents only, and of some of them
    # another text.
    labelled = docs.join(t.table(spark, root, "labels"), "doc_id")
    other = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    expected = labelled.select("doc_id", F.sha2(other, 256).alias("checksum"))
    return q.checksum_mismatch(actual, expected, "doc_id")


@query(
    "batch_checksum",
    "SELECT batch, count(*) AS n, sha256(string_agg(CAST(id AS VARCHAR) || event_type, '' ORDER BY "
    "arrival, event_id)) AS checksum FROM (SELECT *, CAST((row_number() OVER (ORDER BY arrival, "
    "event_id) - 1) // 250 AS BIGINT) AS batch FROM " + _ARRIVALS + ") b GROUP BY batch",
)
def batch_checksum(spark, root):
    rows = t.arrivals(spark, root).select("id", "arrival", "event_id", "event_type")
    batched = q.batches(rows, "arrival", "event_id", 250)
    parts = [F.col("id").cast("string"), F.col("event_type")]
    return q.batch_checksum(batched, "arrival", "event_id", parts)


@query(
    "batch_ids",
    "SELECT event_id, CAST((row_number() OVER (ORDER BY arrival, event_id) - 1) // 100 AS BIGINT) "
    "AS batch FROM " + _ARRIVALS,
)
def batch_ids(spark, root):
    rows = t.arrivals(spark, root).select("arrival", "event_id")
    return q.batches(rows, "arrival", "event_id", 100).select("event_id", "batch")


@query(
    "loss_check",
    "SELECT CAST(n AS BIGINT) AS sent, CAST(s AS BIGINT) AS stored, CAST(n - s + x AS BIGINT) AS lost, "
    "CAST(x AS BIGINT) AS extra, s / n AS share, s / n >= 0.95 AS enough, n = s AND x = 0 AS equal FROM ("
    f"SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE {K} <> 13)::DOUBLE AS s, "
    f"count(*) FILTER (WHERE {K} <> 13 AND value > 100)::DOUBLE AS x FROM events)",
)
def loss_check(spark, root):
    log = t.events(spark, root)
    parts = [F.col("event_id").cast("string"), F.col("event_type"), F.col("props")]
    sent = log.withColumn("checksum", F.sha2(F.concat(*parts), 256))
    # The stored side lost the events of one key and damaged the large ones.
    damaged = F.when(F.col("value") > 100, F.sha2("checksum", 256))
    stored = sent.filter(F.col("k") != 13).withColumn(
        "checksum", F.coalesce(damaged, F.col("checksum"))
    )
    return q.loss_check(sent, stored, "checksum")


_STAMP = (
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' "
    "WHEN epoch_us(ts) % 1000 = 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') "
    "ELSE strftime(ts, '.%f') END || '+00:00'"
)


@query(
    "event_checksum",
    "SELECT event_id, sha256(CAST(event_id AS VARCHAR) || "
    + _STAMP
    + " || event_type || props) AS checksum FROM events",
)
def event_checksum(spark, root):
    stamp = tm.rfc3339(F.col("ts").cast("timestamp"))
    checksum = pl.event_checksum(F.col("event_id"), stamp, F.col("event_type"), F.col("props"))
    return t.table(spark, root, "events").select("event_id", checksum.alias("checksum"))


@query(
    "event_size",
    "SELECT event_id, CAST(8 + 12 + strlen(event_type) + strlen(props) + CASE WHEN event_id % 2 = 0 "
    "THEN 64 ELSE 0 END AS BIGINT) AS size FROM events",
)
def event_size(spark, root):
    checksum = F.when(F.col("event_id") % 2 == 0, F.sha2("props", 256))
    size = pl.event_size(F.col("event_type"), F.col("props"), checksum)
    return t.table(spark, root, "events").select("event_id", size.alias("size"))


@query(
    "hashes",
    "SELECT doc_id, sha256(text) AS sha FROM documents",
)
def hashes(spark, root):
    return _texts(spark, root).select("doc_id", F.sha2("text", 256).alias("sha"))


@query("crc_hashes")
def crc_hashes(spark, root):
    return _texts(spark, root).select("doc_id", F.crc32("text").alias("crc"))


_DOC = (
    "CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN '{\"a\": null}' WHEN 1 THEN '{}' WHEN 2 THEN "
    "'{\"a\": {\"b\": [' || k || ']}}' WHEN 3 THEN '{\"a\": {\"b\": \"' || k || '\"}}' WHEN 4 THEN "
    "'{\"a\": {\"b\": ' || k || '}}' ELSE '{\"a\": {\"b\": true}}' END"
)


def _odd_documents(spark, root):
    """JSON in six shapes, made from ``props.k`` of every event."""
    k = F.col("k").cast("string")
    shapes = [
        F.lit('{"a": null}'),
        F.lit("{}"),
        F.concat(F.lit('{"a": {"b": ['), k, F.lit("]}}")),
        F.concat(F.lit('{"a": {"b": "'), k, F.lit('"}}')),
        F.concat(F.lit('{"a": {"b": '), k, F.lit("}}")),
        F.lit('{"a": {"b": true}}'),
    ]
    chosen = F.element_at(F.array(*shapes), (F.col("event_id") % 6 + 1).cast("int"))
    return t.events(spark, root).select("event_id", chosen.alias("data"))


@query(
    "json_path",
    "SELECT event_id, json_exists(d, '$.a') AS has_a, json_exists(d, '$.a.b') AS has_b, "
    "CASE json_type(d, '$.a') WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' END AS type_a, "
    "CASE json_type(d, '$.a.b') WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' "
    "THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' END AS type_b FROM (SELECT event_id, "
    f"CAST({_DOC} AS JSON) AS d FROM (SELECT event_id, CAST({K} AS VARCHAR) AS k FROM events))",
)
def json_path(spark, root):
    doc = F.try_parse_json("data")
    rows = _odd_documents(spark, root).select("event_id", doc.alias("d"))
    a, b = pl.json_field(F.col("d"), "a"), pl.json_field(F.col("d"), "a.b")
    return rows.select(
        "event_id",
        a.isNotNull().alias("has_a"),
        b.isNotNull().alias("has_b"),
        pl.json_type(a).alias("type_a"),
        pl.json_type(b).alias("type_b"),
    )


@query(
    "json_valid",
    "SELECT event_id, json_valid(CASE WHEN event_id % 5 = 0 THEN props || '}' ELSE props END) "
    "AS valid FROM events",
)
def json_valid(spark, root):
    data = F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("}"))).otherwise(
        F.col("props")
    )
    return t.table(spark, root, "events").select("event_id", pl.is_json(data).alias("valid"))

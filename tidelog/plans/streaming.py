"""Streaming queries: a stream reads the given files to their end, then the
tables it has written are the result. The checks are those of the batch form."""

from pyspark.sql import functions as F

from tidelog.functions.times import floor_div
from tidelog.operators import search as so
from tidelog.plans.base import CHECKS, query
from tidelog.plans.search import _ARRIVALS, K
from tidelog.plans.security import _LOG as _SECURITY
from tidelog.plans.security import _alert_sql
from tidelog.plans.storage import _COLS, _LOG
from tidelog.schema import EVENT_LOG, RAW_EVENTS
from tidelog.session import work_dir
from tidelog.sources import tables as t
from tidelog.sources.eventlog import ROWS_PER_FILE, folder_exists
from tidelog.streaming import compaction, jobs, stateful
from tidelog.streaming.tables import read_table

DAY = 86_400


#: Files of the stream, at least, and rows of each, about.
FILES, FILE_ROWS = 4, 1_000_000


def _raw(spark, root, least=FILES):
    """The events as they arrive: several files, written one after the other, one a batch."""
    path, raw = work_dir(spark, "arriving"), t.table(spark, root, "events")
    first, last, n = raw.agg(F.min(t.arrival()), F.max(t.arrival()), F.count(F.lit(1))).first()
    files = max(least, -(-n // FILE_ROWS))
    width = ((last or 0) - (first or 0)) // files + 1
    # All events are dealt out once; then each file is written from its own, as a stream takes the oldest first.
    number = floor_div(t.arrival() - F.lit(first or 0), width)
    dealt, staged = raw.withColumn("file_number", number).filter("file_number is not null"), work_dir(spark, "dealt")
    dealt.repartition(files, "file_number").write.partitionBy("file_number").parquet(staged)
    for k in range(files):
        own = f"{staged}/file_number={k}"
        part = spark.read.schema(raw.schema).parquet(own) if folder_exists(spark, own) else spark.createDataFrame([], raw.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, RAW_EVENTS, files_per_batch=1)


# Ids as text, sorted as text; beside the events, failures without an id, and one dated far ahead.
_ODD = (
    "(SELECT CAST(event_id AS VARCHAR) AS event_id, source, ts_us FROM ({log}) WHERE kind = 'AuthenticationFailure' UNION ALL "
    "SELECT NULL, source, ts_us FROM ({log}) WHERE kind = 'AuthenticationFailure' AND event_id % 5 = 0 UNION ALL "
    "SELECT 'ahead', source, 4000000000000000 FROM ({log}) WHERE event_id = 10) o"
).format(log=f"SELECT * FROM {_SECURITY}")


def _run(stream, handler, out):
    jobs.start(stream, handler, f"{out}/checkpoint").awaitTermination()


@query("stream_ingest", f"SELECT {_COLS} FROM {_LOG}")
def stream_ingest(spark, root):
    out = work_dir(spark, "stream-ingest")
    _run(t.as_event_log(_raw(spark, root)), jobs.ingest_handler(out), out)
    return read_table(spark, f"{out}/events", EVENT_LOG)


@query(
    "stream_ledger",
    "SELECT count(*) AS events, 0::BIGINT AS invalid, 0::BIGINT AS frames, CAST(sum(strlen(props)) AS BIGINT) AS bytes "
    "FROM events",
)
def stream_ledger(spark, root):
    out = work_dir(spark, "stream-ingest")
    _run(t.as_event_log(_raw(spark, root)), jobs.ingest_handler(out), out)
    ledger = read_table(
        spark, f"{out}/ledger", "events long, invalid long, frames long, bytes long"
    )
    return ledger.agg(*[F.sum(c).alias(c) for c in ledger.columns])


def _compacted(spark, root):
    """Eight batches, packed after every third of them and at the end."""
    out = work_dir(spark, "stream-compact")
    _run(t.as_event_log(_raw(spark, root, 8)), jobs.ingest_handler(out, compact_every=3), out)
    compaction.compact(spark, f"{out}/events", EVENT_LOG, before=2**62)
    return f"{out}/events"


@query("stream_compact", f"SELECT {_COLS} FROM {_LOG}")
def stream_compact(spark, root):
    return compaction.read_compacted(spark, _compacted(spark, root), EVENT_LOG)


@query(
    "compacted_days",
    "SELECT CAST(to_timestamp(timestamp_ns / 1000000000) AT TIME ZONE 'UTC' AS DATE) AS event_date, count(*) AS events, "
    f"true AS few_files, true AS bounded FROM {_LOG} GROUP BY 1",
)
def compacted_days(spark, root):
    """Days of a log after eight batches: few files, and none with more rows than allowed."""
    rows = compaction.read_compacted(spark, _compacted(spark, root), EVENT_LOG, folders=True)
    files = rows.groupBy("event_date", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    # Folders of over half a file stay, and of all packed files of a day at most one is less full.
    most = 2 * F.sum("n") / F.lit(ROWS_PER_FILE) + 1
    return files.groupBy("event_date").agg(
        F.sum("n").alias("events"),
        (F.count(F.lit(1)) <= most).alias("few_files"),
        (F.max("n") <= ROWS_PER_FILE).alias("bounded"),
    )


@query("stream_alert", _alert_sql("AuthenticationFailure", 5, 6, True, "temporarily blocked"))
def stream_alert(spark, root):
    out = work_dir(spark, "stream-alert")
    alerts = stateful.failure_alerts(t.as_security_log(_raw(spark, root)), window_s=6 * DAY)
    stateful.start_stateful(alerts, f"{out}/alerts", f"{out}/checkpoint").awaitTermination()
    return read_table(
        spark,
        f"{out}/alerts",
        "source long, ts_us long, event_id long, recent long, action string",
    )


@query(
    "stream_alert_odd",
    f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts_us, event_id NULLS FIRST) AS place FROM {_ODD}), "
    "c AS (SELECT a.source, a.ts_us, a.event_id, a.place - count(b.place) AS recent FROM k a LEFT JOIN k b ON a.source = b.source "
    f"AND b.ts_us <= a.ts_us - {6 * DAY}000000 GROUP BY a.source, a.ts_us, a.event_id, a.place) "
    "SELECT source, ts_us, event_id, recent FROM c WHERE recent >= 5",
)
def stream_alert_odd(spark, root):
    """Alerts where ids are text, null and repeated, and one event lies decades ahead."""
    out = work_dir(spark, "stream-alert")
    log = t.as_security_log(_raw(spark, root)).withColumn("event_id", F.col("event_id").cast("string"))
    is_failure = F.col("kind") == "AuthenticationFailure"
    number = F.col("event_id").cast("long")
    as_it_is = F.struct("event_id", "ts_us", "kind")
    unnamed = F.struct(F.lit(None).cast("string").alias("event_id"), "ts_us", "kind")
    ahead = F.struct(
        F.lit("ahead").alias("event_id"), F.lit(4_000_000_000_000_000).alias("ts_us"), F.lit("AuthenticationFailure").alias("kind")
    )
    added = F.array(as_it_is, F.when(is_failure & (number % 5 == 0), unnamed), F.when(number == 10, ahead))
    stream = log.select("source", F.inline(F.array_compact(added)))
    alerts = stateful.failure_alerts(stream, window_s=6 * DAY)
    stateful.start_stateful(alerts, f"{out}/alerts", f"{out}/checkpoint").awaitTermination()
    return read_table(spark, f"{out}/alerts", "source long, ts_us long, event_id string, recent long")


_ROUTES = [("storage", "click"), ("storage", "view"), ("alerts", "error"), ("metrics", "*")]


@query(
    "stream_route",
    "SELECT event_id, handler, event_type, user_id, value, props FROM (" + CHECKS["route_events"] + ") JOIN events USING (event_id)",
)
def stream_route(spark, root):
    out = work_dir(spark, "stream-route")
    names = ["storage", "alerts", "metrics"]
    handlers = {name: jobs.table_handler(f"{out}/{name}") for name in names}
    _run(_raw(spark, root), jobs.route_handler(_ROUTES, handlers, "event_type"), out)
    routed = None
    for name in names:
        rows = read_table(spark, f"{out}/{name}", "event_id long, event_type string, user_id long, value double, props string")
        rows = rows.withColumn("handler", F.lit(name))
        routed = rows if routed is None else routed.unionByName(rows)
    return routed


@query("stream_follow", f"SELECT event_id FROM events WHERE event_type = 'view' AND {K} = 7")
def stream_follow(spark, root):
    out = work_dir(spark, "stream-follow")
    spec = so.SearchSpec(event_types=["view"], filters={"k": "7"})
    hits = jobs.follow(_raw(spark, root), spec, "ts", "props").select("event_id")
    jobs.append(hits, f"{out}/hits", f"{out}/checkpoint").awaitTermination()
    return read_table(spark, f"{out}/hits", "event_id long")


@query("stream_dedup", f"SELECT DISTINCT id FROM {_ARRIVALS}")
def stream_dedup(spark, root):
    out = work_dir(spark, "stream-dedup")
    rows = t.as_arrivals(_raw(spark, root)).select(
        "id", F.timestamp_micros("ts_us").alias("seen")
    )
    unique = jobs.dedup(rows, "id", "seen", "10 days").select("id")
    jobs.append(unique, f"{out}/ids", f"{out}/checkpoint").awaitTermination()
    return read_table(spark, f"{out}/ids", "id long")


_BY_SESSION = (
    "(SELECT session, id, arrival, event_id, max(id) OVER (PARTITION BY session ORDER BY arrival, event_id "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM {_ARRIVALS}) m"
)


@query(
    "stream_sequence",
    "SELECT session, event_id, id, prev_max, CASE WHEN id > prev_max + 1 THEN 'gap' WHEN row_number() OVER "
    "(PARTITION BY session, id, id <= prev_max ORDER BY arrival, event_id) = 1 THEN 'out_of_order' ELSE 'duplicate' "
    f"END AS issue FROM {_BY_SESSION} WHERE prev_max IS NOT NULL AND id <> prev_max + 1",
)
def stream_sequence(spark, root):
    out = work_dir(spark, "stream-sequence")
    rows = t.as_arrivals(_raw(spark, root))
    _run(rows, jobs.sequence_handler(out, key="session"), out)
    return read_table(
        spark,
        f"{out}/issues",
        "session long, event_id long, id long, prev_max long, issue string",
    )

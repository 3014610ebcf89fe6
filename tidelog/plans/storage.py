"""Queries that write, scan, export, copy and compare the event log."""

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import times as tm
from tidelog.operators import storage as st
from tidelog.plans.base import CHECKS, query
from tidelog.plans.search import K
from tidelog.schema import EVENT_COLUMNS
from tidelog.session import work_dir
from tidelog.sources import eventlog as el
from tidelog.sources import export as ex
from tidelog.sources import tables as t

AS_OF = dt.datetime(2024, 2, 1)

_LOG = (
    "(SELECT epoch_us(ts) * 1000 AS timestamp_ns, event_type, 'app.' || (user_id % 10) AS app_bundle_id, "
    f"'window ' || {K} AS window_title, props AS data, CAST(user_id AS VARCHAR) AS session_id, "
    "CAST(event_id AS VARCHAR) AS event_id, ts FROM events) g"
)
_COLS = ", ".join(EVENT_COLUMNS)


def _written(spark, root, codec="SNAPPY"):
    path = work_dir(spark, "event-log")
    el.write_event_log(t.event_log(spark, root), path, codec)
    return path


@query(
    "scan_events",
    f"SELECT {_COLS} FROM {_LOG} WHERE ts BETWEEN TIMESTAMP '2024-01-05 12:00:00' AND TIMESTAMP '2024-01-09'",
)
def scan_events(spark, root):
    path = _written(spark, root)
    return el.scan_event_log(spark, path, dt.datetime(2024, 1, 5, 12), dt.datetime(2024, 1, 9))


@query("write_events_roundtrip", f"SELECT {_COLS} FROM {_LOG}")
def write_events_roundtrip(spark, root):
    return el.scan_event_log(spark, _written(spark, root, "ZSTD"))


@query(
    "partition_counts",
    " UNION ALL ".join(
        f"SELECT '{name}' AS layout, {path} AS folder, count(*) AS n FROM events GROUP BY 1, 2"
        for name, path in [
            ("daily", "strftime(ts, 'year=%Y/month=%m/day=%d')"),
            ("hourly", "strftime(ts, 'year=%Y/month=%m/day=%d/hour=%H')"),
            ("type", "'type=' || event_type || strftime(ts, '/year=%Y/month=%m/day=%d')"),
            (
                "type_hour",
                "'type=' || event_type || strftime(ts, '/year=%Y/month=%m/day=%d/hour=%H')",
            ),
        ]
    ),
)
def partition_counts(spark, root):
    log = t.event_log(spark, root).select("timestamp_ns", "event_type")
    folders = []
    for layout in ("daily", "hourly", "type", "type_hour"):
        cols = el.layout_columns(layout, F.col("timestamp_ns"), F.col("event_type"))
        parts = [F.concat(F.lit(f"{name}="), col) for name, col in cols.items()]
        folders.append(
            F.struct(F.lit(layout).alias("layout"), F.concat_ws("/", *parts).alias("folder"))
        )
    each = log.select(F.explode(F.array(*folders)).alias("f")).select("f.layout", "f.folder")
    return each.groupBy("layout", "folder").agg(F.count(F.lit(1)).alias("n"))


@query("layout_files", CHECKS["partition_counts"])
def layout_files(spark, root):
    """The folders that the writer of each layout makes, with the rows found in them."""
    log, found = t.event_log(spark, root), []
    for layout in ("daily", "hourly", "type", "type_hour"):
        path = work_dir(spark, f"layout-{layout}")
        el.write_layout(log, path, layout)
        folder = F.regexp_extract(F.input_file_name(), f"layout-{layout}-[^/]*/(.*)/[^/]*$", 1)
        rows = spark.read.parquet(path).select(F.lit(layout).alias("layout"), folder.alias("folder"))
        found.append(rows.groupBy("layout", "folder").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionAll, found)


@query("wipe_rows", f"SELECT {_COLS} FROM {_LOG} WHERE NOT (ts >= TIMESTAMP '2024-01-05 12:00:00' AND event_type IN ('click', 'view'))")
def wipe_rows(spark, root):
    path = _written(spark, root)
    log = el.scan_event_log(spark, path)
    st.wipe(spark, path, st.selection(log, start=dt.datetime(2024, 1, 5, 12), event_types=["click", "view"]))
    return el.scan_event_log(spark, path)


@query("append_days", f"SELECT {_COLS} FROM {_LOG}")
def append_days(spark, root):
    """Two writes, then one day again: all rows are there once."""
    log, path = t.event_log(spark, root), work_dir(spark, "append")
    early = F.col("timestamp_ns") < F.lit(1_704_672_000_000_000_000)
    el.write_event_log(log.filter(early), path)
    el.write_event_log(log.filter(~early), path)
    st.backfill_day(log, dt.date(2024, 1, 5), dry_run=False, path=path)
    return el.scan_event_log(spark, path)


@query("shard_counts")
def shard_counts(spark, root):
    log = t.event_log(spark, root)
    cols = el.layout_columns("shard", F.col("timestamp_ns"), F.col("event_type"))
    return log.groupBy(cols["shard"].alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("shard_files", "SELECT count(*) AS rows, 0::BIGINT AS differing FROM events")
def shard_files(spark, root):
    """Rows that the writer of shards wrote, and the shards that do not hold what ``shard_counts`` counts."""
    path = work_dir(spark, "layout-shard")
    el.write_layout(t.event_log(spark, root), path, "shard")
    written = spark.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    both = written.join(shard_counts(spark, root), "shard", "full_outer")
    return both.agg(F.sum("rows").alias("rows"), F.count_if(~F.col("rows").eqNullSafe(F.col("n"))).alias("differing"))


@query(
    "events_per_day",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
)
def events_per_day(spark, root):
    log = t.event_log(spark, root)
    day = tm.ns_to_date(F.col("timestamp_ns")).cast("string").alias("day")
    return log.groupBy(day).agg(F.count(F.lit(1)).alias("n"))


@query("rotate_check")
def rotate_check(spark, root):
    return el.crowded_folders(el.list_files(spark, _written(spark, root)))


@query("file_catalog")
def file_catalog(spark, root):
    return el.file_catalog(spark, _written(spark, root))


@query(
    "catalog_days",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, TRUE AS complete FROM events GROUP BY 1",
)
def catalog_days(spark, root):
    """What the catalogue says of each day: rows, and whether its files have sizes and checksums of their own."""
    files = el.file_catalog(spark, _written(spark, root))
    whole = (F.min("size") > 0) & (F.count_distinct("checksum") == F.count(F.lit(1))) & (F.min(F.length("checksum")) == 64)
    day = F.regexp_extract("path", r"event_date=([\d-]+)/", 1).alias("day")
    return files.groupBy(day).agg(F.sum("record_count").alias("rows"), whole.alias("complete"))


@query(
    "verify_written",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, TRUE AS same, date_diff('day', TIMESTAMP '2024-01-01', ts) % 7 = 0 "
    "AS hurt FROM events GROUP BY ALL",
)
def verify_written(spark, root):
    """The log catalogued twice; each Monday's files lack a column in what was expected. Rows, bytes as before, schema not."""
    path = _written(spark, root)
    first, now = el.file_catalog(spark, path), el.file_catalog(spark, path)
    day = F.regexp_extract("path", r"event_date=([\d-]+)/", 1).cast("date")
    monday = F.dayofweek(day) == 2
    expected = first.withColumn("columns", F.when(monday, F.regexp_replace("columns", ",data", "")).otherwise(F.col("columns")))
    checked = st.verify_files(expected, now, ("size", "checksum", "record_count", "columns"))
    rows = checked.join(now.select("path", "record_count"), "path")
    whole = F.col("size_ok") & F.col("checksum_ok") & F.col("record_count_ok") & (F.col("columns_ok") == F.col("passed"))
    return rows.groupBy(day.cast("string").alias("day")).agg(
        F.sum("record_count").alias("rows"), F.bool_and(whole).alias("same"), F.bool_and(~F.col("columns_ok")).alias("hurt")
    )


@query(
    "rotate_folders",
    "SELECT o_orderpriority || '/' || o_orderstatus AS folder, count(*) AS files, count(*) > 500 AS rotate FROM orders GROUP BY 1",
)
def rotate_folders(spark, root):
    """Orders as files in folders of their priority and status."""
    parts = ["o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string")]
    return el.crowded_folders(t.table(spark, root, "orders").select(F.concat_ws("/", *parts).alias("path")), 500)


@query(
    "schema_missing",
    "SELECT '' AS missing, TRUE AS passed, count(*) AS rows FROM events UNION ALL "
    "SELECT 'app_bundle_id, window_title', FALSE, count(*) FROM events WHERE event_type = 'click'",
)
def schema_missing(spark, root):
    """A log, and beside it the clicks written without two columns: what files lack, and rows in them."""
    path, log = work_dir(spark, "event-log"), t.event_log(spark, root)
    el.write_event_log(log, f"{path}/whole")
    log.filter("event_type = 'click'").drop("app_bundle_id", "window_title").write.parquet(f"{path}/part")
    groups = el.footers(spark, path)
    rows = groups.groupBy("path").agg(F.sum("rows").alias("rows"))
    found = el.schema_check(groups).join(rows, "path")
    return found.groupBy("missing", "passed").agg(F.sum("rows").alias("rows"))


@query("rowgroup_rows", "SELECT count(*) AS rows, TRUE AS consistent, TRUE AS numbered FROM events")
def rowgroup_rows(spark, root):
    """Rows of all row groups, whether their columns agree, and whether groups are numbered from 0."""
    groups = el.rowgroup_check(el.footers(spark, _written(spark, root)))
    files = groups.groupBy("path").agg(
        F.sum("rows").alias("rows"),
        F.bool_and("consistent").alias("consistent"),
        (F.max("row_group") + 1 == F.count(F.lit(1))).alias("numbered"),
    )
    return files.agg(F.sum("rows").alias("rows"), F.bool_and("consistent").alias("consistent"), F.bool_and("numbered").alias("numbered"))


@query("schema_check")
def schema_check(spark, root):
    return el.schema_check(el.footers(spark, _written(spark, root)))


@query("rowgroup_check")
def rowgroup_check(spark, root):
    return el.rowgroup_check(el.footers(spark, _written(spark, root)))


@query("backlog_check")
def backlog_check(spark, root):
    return st.backlog(el.list_files(spark, root), capacity=64 * 1024 * 1024)


def _with_frames(spark, root):
    """Views become frames; some with broken base64, some with broken JSON."""
    n = F.col("event_id").cast("long")
    coded = F.base64(F.concat(F.lit("img"), F.col("event_id")).cast("binary"))
    text = (
        F.when(n % 7 == 0, F.lit('{"data": "***"}'))
        .when(n % 11 == 0, F.lit("{broken"))
        .otherwise(F.concat(F.lit('{"data": "'), coded, F.lit('"}')))
    )
    is_view = F.col("event_type") == "view"
    return t.event_log(spark, root).withColumns(
        {
            "data": F.when(is_view, text).otherwise(F.col("data")),
            "event_type": F.when(is_view, "frame").otherwise(F.col("event_type")),
        }
    )


@query(
    "frame_extract",
    "SELECT event_id, 'img' || event_id AS frame FROM events WHERE event_type = 'view' AND event_id % 7 <> 0 "
    "AND event_id % 11 <> 0",
)
def frame_extract(spark, root):
    found = el.frames(_with_frames(spark, root))
    return found.select(
        F.col("event_id").cast("long").alias("event_id"), F.col("frame").cast("string").alias("frame")
    )


# -- exports ------------------------------------------------------------------------------------


def _rows(spark, root):
    return t.table(spark, root, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


_ROWS_SQL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


def _exported(spark, root, kind, compression=None):
    rows, path = _rows(spark, root), work_dir(spark, f"export-{kind}")
    ex.export(rows, path, kind, compression)
    return ex.read_export(spark, path, kind, rows.schema)


@query("export_json", _ROWS_SQL)
def export_json(spark, root):
    return _exported(spark, root, "json", "gzip")


@query("export_parquet", _ROWS_SQL)
def export_parquet(spark, root):
    return _exported(spark, root, "parquet", "lz4")


@query("export_arrow", _ROWS_SQL)
def export_arrow(spark, root):
    return _exported(spark, root, "arrow", "lz4")


_STAMP = (
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' "
    "WHEN epoch_us(ts) % 1000 = 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') "
    "ELSE strftime(ts, '.%f') END || '+00:00'"
)


@query(
    "export_csv",
    f"SELECT {_STAMP} AS timestamp, event_type AS type, CAST(event_id AS VARCHAR) AS id, props AS data FROM events",
)
def export_csv(spark, root):
    events = t.table(spark, root, "events").withColumnRenamed("props", "data")
    rows, path = ex.csv_rows(events, F.col("ts").cast("timestamp")), work_dir(spark, "export-csv")
    ex.export(rows, path, "csv")
    return ex.read_export(spark, path, "csv", rows.schema)


@query(
    "validate_export",
    " UNION ALL ".join(
        f"SELECT '{k}' AS format, count(*) AS rows, count(*) AS expected, TRUE AS valid FROM events"
        for k in ex.FORMATS
    ),
)
def validate_export(spark, root):
    rows, reports = _rows(spark, root), None
    for kind in ex.FORMATS:
        path = work_dir(spark, f"export-{kind}")
        ex.export(rows, path, kind)
        report = ex.validate_export(spark, rows, path, kind)
        reports = report if reports is None else reports.unionByName(report)
    return reports


# -- backup, wipe, retention -----------------------------------------------------------------------

_RANGE = (dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 22))
_IN_RANGE = (
    "ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22' AND event_type IN ('click', 'view')"
)


def _chosen(log):
    return st.selection(log, *_RANGE, ["click", "view"])


@query("backup_manifest")
def backup_manifest(spark, root):
    log = t.event_log(spark, root)
    return st.backup(spark, log, work_dir(spark, "backup"), _chosen(log))


@query(
    "backup_plan",
    "SELECT count(*) AS events, CAST(sum(strlen(props) + strlen(event_type)) AS BIGINT) AS bytes FROM events "
    f"WHERE {_IN_RANGE}",
)
def backup_plan(spark, root):
    log = t.event_log(spark, root)
    return st.backup_plan(log, _chosen(log))


@query(
    "backup_verify",
    f"SELECT count(*) AS restored, 0::BIGINT AS left_only, 0::BIGINT AS right_only, TRUE AS equal FROM events WHERE {_IN_RANGE}",
)
def backup_verify(spark, root):
    log, target = t.event_log(spark, root), work_dir(spark, "backup")
    st.backup(spark, log, target, _chosen(log))
    restored = st.restore(spark, target)
    count = restored.agg(F.count(F.lit(1)).alias("restored"))
    return count.crossJoin(st.same_content(log.filter(_chosen(log)), restored))


@query(
    "backup_twice",
    f"SELECT count(*) AS restored, 0::BIGINT AS left_only, 0::BIGINT AS right_only, TRUE AS equal, CAST(count(*) AS BIGINT) AS listed "
    f"FROM events WHERE {_IN_RANGE}",
)
def backup_twice(spark, root):
    """A wider backup, then the usual one to the same target: only the second is there."""
    log, target = t.event_log(spark, root), work_dir(spark, "backup")
    st.backup(spark, log, target, st.selection(log, _RANGE[0]))
    manifest = st.backup(spark, log, target, _chosen(log))
    restored = st.restore(spark, target)
    count = restored.agg(F.count(F.lit(1)).alias("restored"))
    listed = manifest.agg(F.sum("record_count").alias("listed"))
    return count.crossJoin(st.same_content(log.filter(_chosen(log)), restored)).crossJoin(listed)


@query(
    "content_difference",
    f"SELECT event_id, event_type, 1::BIGINT AS surplus FROM events WHERE event_type = 'error' AND {K} < 20 "
    "UNION ALL SELECT event_id, 'copy', -1 FROM events WHERE event_type = 'purchase' AND value > 50",
)
def content_difference(spark, root):
    events = t.events(spark, root)
    cols = ["event_id", "event_type"]
    kept = events.filter(~((F.col("event_type") == "error") & (F.col("k") < 20))).select(*cols)
    large = events.filter((F.col("event_type") == "purchase") & (F.col("value") > 50))
    copies = large.select("event_id", F.lit("copy").alias("event_type"))
    return st.difference(events.select(*cols), kept.unionByName(copies))


@query(
    "manifest_remove",
    "SELECT 'f/' || o_orderkey AS path, CAST(round(o_totalprice * 100) AS BIGINT) AS size FROM orders "
    "WHERE o_orderstatus <> 'P'",
)
def manifest_remove(spark, root):
    manifest = t.catalogue(spark, root).select("path", "size", "format")
    removed = manifest.filter(F.col("format") == "P")
    return st.remove_entries(manifest, removed).select("path", "size")


@query(
    "backup_stats",
    "SELECT count(*) AS files, CAST(sum(stored) AS BIGINT) AS stored_bytes, CAST(sum(size) FILTER (WHERE known) AS BIGINT) "
    "AS original_bytes, round(sum(stored)::DOUBLE / (sum(size) FILTER (WHERE known))::DOUBLE, 9) AS ratio FROM "
    "(SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS size, CAST(round(o_totalprice * 100) AS BIGINT) // 2 AS stored, "
    "o_orderstatus <> 'P' AS known FROM orders)",
)
def backup_stats(spark, root):
    files = t.catalogue(spark, root)
    manifest = files.select("path", tm.floor_div(F.col("size"), 2).alias("size"))
    stats = st.backup_stats(manifest, files.filter(F.col("format") != "P"))
    return stats.withColumn("ratio", F.round("ratio", 9))


@query("wipe_keep", f"SELECT event_id FROM {_LOG} WHERE NOT ({_IN_RANGE})")
def wipe_keep(spark, root):
    log = t.event_log(spark, root)
    return st.wipe_keep(log, _chosen(log)).select("event_id")


@query(
    "wipe_plan",
    f"SELECT event_type, count(*) AS events FROM events WHERE {_IN_RANGE} GROUP BY 1",
)
def wipe_plan(spark, root):
    log = t.event_log(spark, root)
    return st.wipe_plan(log, _chosen(log))


@query(
    "retention_split",
    "SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS events, strftime(ts, '%Y-%m-%d') < '2024-01-12' AS expired "
    "FROM events GROUP BY ALL",
)
def retention_split(spark, root):
    split = st.retention_split(t.event_log(spark, root), AS_OF, days=20)
    return split.withColumn("event_date", F.col("event_date").cast("string"))


@query("retention_apply", f"SELECT {_COLS} FROM {_LOG} WHERE ts >= TIMESTAMP '2024-01-15'")
def retention_apply(spark, root):
    """The log after the folders of days older than the retention have been dropped."""
    path = _written(spark, root)
    st.drop_expired(spark, path, dt.datetime(2024, 3, 15, 12))
    return el.scan_event_log(spark, path)


@query(
    "backfill_day",
    "SELECT count(*) AS events, CAST(sum(strlen(props)) AS BIGINT) AS bytes, 1::BIGINT AS folders FROM events "
    "WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'",
)
def backfill_day(spark, root):
    return st.backfill_day(t.event_log(spark, root), dt.date(2024, 1, 15))


# -- catalogue ---------------------------------------------------------------------------------------


@query(
    "files_in_range",
    "SELECT 'f/' || o_orderkey AS path FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND "
    "TIMESTAMP '1996-06-30'",
)
def files_in_range(spark, root):
    low, high = (F.lit(us) for us in (820_454_400_000_000, 836_092_800_000_000))
    return st.files_in_range(t.catalogue(spark, root), "created_us", low, high).select("path")


@query(
    "storage_stats",
    "SELECT o_orderstatus AS format, count(*) AS files, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) "
    "AS bytes FROM orders GROUP BY ROLLUP (o_orderstatus)",
)
def storage_stats(spark, root):
    return st.storage_stats(t.catalogue(spark, root).select("format", "size"))


def _actual_files(spark, root):
    """The catalogue after some accidents: files gone, grown, damaged, and strangers."""
    n = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    files = t.catalogue(spark, root)
    gone = (F.col("format") == "P") & (F.col("compression") == "5-LOW")
    hurt = files.filter(~gone).withColumns(
        {
            "size": F.when(n % 43 == 0, F.col("size") + 1).otherwise(F.col("size")),
            "checksum": F.when(n % 47 == 0, F.sha2("checksum", 256)).otherwise(F.col("checksum")),
            "record_count": F.when(n % 53 == 0, F.col("record_count") + 1).otherwise(
                F.col("record_count")
            ),
        }
    )
    new = (F.col("format") == "P") & (F.col("compression") == "1-URGENT")
    strangers = files.filter(new).withColumn("path", F.concat("path", F.lit(".new")))
    return hurt.unionByName(strangers)


_THERE = "NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"
_VERIFIED = (
    f"(SELECT 'f/' || o_orderkey AS path, TRUE AS listed, {_THERE} AS exists, CASE WHEN {_THERE} THEN o_orderkey % 43 <> 0 "
    f"END AS size_ok, CASE WHEN {_THERE} THEN o_orderkey % 47 <> 0 END AS checksum_ok, CASE WHEN {_THERE} THEN "
    f"o_orderkey % 53 <> 0 END AS record_count_ok, {_THERE} AND o_orderkey % 43 <> 0 AND o_orderkey % 47 <> 0 AND "
    "o_orderkey % 53 <> 0 AS passed, o_custkey % 100 AS n FROM orders) v"
)


@query(
    "verify_files",
    f"SELECT path, listed, exists, size_ok, checksum_ok, record_count_ok, passed FROM {_VERIFIED} UNION ALL "
    "SELECT 'f/' || o_orderkey || '.new', FALSE, TRUE, NULL, NULL, NULL, FALSE FROM orders WHERE o_orderstatus = 'P' "
    "AND o_orderpriority = '1-URGENT'",
)
def verify_files(spark, root):
    return st.verify_files(t.catalogue(spark, root), _actual_files(spark, root))


@query(
    "stored_report",
    "SELECT count(*) AS files, count(*) FILTER (WHERE passed) AS valid, count(*) FILTER (WHERE NOT passed) AS corrupted, "
    "CAST(sum(n) FILTER (WHERE passed) AS BIGINT) AS events, round(count(*) FILTER (WHERE passed) / count(*)::DOUBLE, 9) "
    f"AS success_rate FROM {_VERIFIED}",
)
def stored_report(spark, root):
    expected = t.catalogue(spark, root)
    report = st.stored_report(st.verify_files(expected, _actual_files(spark, root)), expected)
    return report.withColumn("success_rate", F.round("success_rate", 9))


_DRIVE_IDS = ["uuid", "bsd_name", "volume_label", "serial_number"]


def _drives(frame, key, nation, balance):
    k = F.col(key)
    return frame.select(
        k.alias("drive"),
        F.when(k % 5 != 0, F.concat(F.lit("u"), (k % 977).cast("string"))).alias("uuid"),
        F.when(k % 7 == 0, F.concat(F.lit("disk"), (k % 91).cast("string"))).alias("bsd_name"),
        F.when(F.col(balance) < 0, F.concat(F.lit("vol"), F.col(nation).cast("string"), (k % 6).cast("string"))).alias(
            "volume_label"
        ),
        F.when(k % 3 == 0, F.concat(F.lit("s"), (k % 389).cast("string"))).alias("serial_number"),
    )


def _drive_sql(table, key, nation, balance):
    return (
        f"(SELECT {key} AS drive, CASE WHEN {key} % 5 <> 0 THEN 'u' || ({key} % 977) END AS uuid, CASE WHEN {key} % 7 = 0 "
        f"THEN 'disk' || ({key} % 91) END AS bsd_name, CASE WHEN {balance} < 0 THEN 'vol' || {nation} || ({key} % 6) END "
        f"AS volume_label, CASE WHEN {key} % 3 = 0 THEN 's' || ({key} % 389) END AS serial_number FROM {table})"
    )


@query(
    "match_any_id",
    "SELECT d.drive FROM "
    + _drive_sql("customer", "c_custkey", "c_nationkey", "c_acctbal")
    + " d WHERE EXISTS (SELECT 1 FROM "
    + _drive_sql("supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    + " g WHERE d.uuid = g.uuid OR d.bsd_name = g.bsd_name OR d.volume_label = g.volume_label OR "
    "d.serial_number = g.serial_number)",
)
def match_any_id(spark, root):
    drives = _drives(t.table(spark, root, "customer"), "c_custkey", "c_nationkey", "c_acctbal")
    targets = _drives(t.table(spark, root, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal")
    return st.match_any(targets, drives, "drive", _DRIVE_IDS)


# -- versions and encryption ----------------------------------------------------------------------------


@query(
    "schema_compat",
    "SELECT p_partkey, version, coalesce(major = 1 AND minor >= 1, FALSE) AS compatible FROM (SELECT p_partkey, "
    "(p_size % 3) || '.' || (p_partkey % 4) || '.0' AS version, p_size % 3 AS major, p_partkey % 4 AS minor FROM part)",
)
def schema_compat(spark, root):
    version = F.concat(
        (F.col("p_size") % 3).cast("string"),
        F.lit("."),
        (F.col("p_partkey") % 4).cast("string"),
        F.lit(".0"),
    )
    rows = t.table(spark, root, "part").select("p_partkey", version.alias("version"))
    return rows.withColumn("compatible", st.compatible(F.col("version"), "1.1.0"))


@query(
    "migrate_v11",
    f"SELECT {_COLS}, 0::INTEGER AS metadata_bytes FROM {_LOG}",
)
def migrate_v11(spark, root):
    """The log as version 1.0 wrote it, read as version 1.1."""
    old = el.scan_event_log(spark, _written(spark, root))
    new = st.migrate(old, "1.0.0", "1.1.0")
    return new.select(*EVENT_COLUMNS, F.octet_length("metadata").alias("metadata_bytes"))


_KEYS = [
    (kind, version, bytes((7 * i + 13 * version + j) % 256 for j in range(32)), dt.datetime(2024, version, 1))
    for i, kind in enumerate(("click", "error", "purchase", "signup", "view"))
    for version in (1, 2)
]


@query("encrypt_roundtrip", "SELECT event_id, 2::INTEGER AS key_id, props AS data FROM events")
def encrypt_roundtrip(spark, root):
    keys = spark.createDataFrame(_KEYS, "kind string, key_id int, key binary, created timestamp")
    first = keys.filter("key_id = 1")
    rows = t.table(spark, root, "events").select("event_id", "event_type", F.col("props").alias("data"))
    secret = st.encrypt_by_type(rows, first, "data", "event_type")
    rotated = st.rotate_keys(secret, keys, "data", "event_type")
    clear = st.decrypt_by_type(
        rotated.withColumn("_id", F.col("key_id")), keys, "data", "event_type"
    )
    return clear.select("event_id", F.col("_id").alias("key_id"), "data")


@query("rotate_named_keys", "SELECT event_id, 'k10' AS key_id, props AS data FROM events")
def rotate_named_keys(spark, root):
    """Keys with names: the one created last is the newest, though ``k9`` sorts after ``k10``."""
    named = [(kind, f"k{8 + version}", key, created) for kind, version, key, created in _KEYS]
    keys = spark.createDataFrame(named, "kind string, key_id string, key binary, created timestamp")
    rows = t.table(spark, root, "events").select("event_id", "event_type", F.col("props").alias("data"))
    secret = st.encrypt_by_type(rows, keys.filter("key_id = 'k9'"), "data", "event_type")
    rotated = st.rotate_keys(secret, keys, "data", "event_type").withColumn("_id", F.col("key_id"))
    clear = st.decrypt_by_type(rotated, keys, "data", "event_type")
    return clear.select("event_id", F.col("_id").alias("key_id"), "data")

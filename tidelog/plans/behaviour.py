"""Queries over ordered events: motion, focus, counters, buffers, filters."""

from pyspark.sql import functions as F

from tidelog.functions.times import floor_div
from tidelog.operators import behaviour as b
from tidelog.plans.base import query
from tidelog.plans.search import _ARRIVALS, K
from tidelog.sources import tables as t

_MOVES = (
    f"(SELECT user_id AS session, epoch_us(ts) AS ts_us, event_id, value AS x, {K}::DOUBLE AS y "
    "FROM events) m"
)
_MOTION = (
    "(SELECT *, sqrt(dx * dx + dy * dy) AS step, CASE WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / dt "
    "ELSE 0.0 END AS velocity FROM (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, "
    f"(ts_us - lag(ts_us) OVER w) / 1000000.0::DOUBLE AS dt FROM {_MOVES} WINDOW w AS "
    "(PARTITION BY session ORDER BY ts_us, event_id)) WHERE dt IS NOT NULL) v"
)


@query(
    "pointer_velocity",
    "SELECT event_id, round(dx, 6) AS dx, round(dy, 6) AS dy, round(velocity, 6) AS velocity "
    f"FROM {_MOTION}",
)
def pointer_velocity(spark, root):
    moved = b.pointer_velocity(t.moves(spark, root))
    return moved.select("event_id", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "velocity")])


# The given events are minutes apart; at a hundred-thousandth of their time the waits
# of the rule fall inside the range of the data.
@query(
    "move_thinning",
    f"SELECT event_id FROM {_MOTION.replace('epoch_us(ts) AS', 'epoch_us(ts) // 100000 AS')} "
    "WHERE dt >= CASE WHEN velocity > 100 THEN 0.05 ELSE 0.1 END",
)
def move_thinning(spark, root):
    moves = t.moves(spark, root)
    fast = moves.withColumn("ts_us", floor_div(F.col("ts_us"), 100_000))
    return b.move_thinning(b.pointer_velocity(fast)).select("event_id")


_DAY2 = 2 * 86_400


@query(
    "move_stats",
    "SELECT event_id, CAST(len(b) AS BIGINT) AS moves, round(list_sum(list_transform(b, lambda e: e.s)) - "
    "b[1].s, 6) AS distance, round((ts_us - b[1].t) / 1000000.0::DOUBLE, 6) AS span_s, "
    "round(list_sum(list_transform(b, lambda e: e.v)) / len(b), 6) AS avg_velocity, "
    "round(list_max(list_transform(b, lambda e: e.v)), 6) AS max_velocity, "
    "round(list_min(list_transform(b, lambda e: e.v)), 6) AS min_velocity FROM (SELECT event_id, ts_us, "
    f"list_filter(b, lambda e: e.t >= ts_us - {_DAY2}000000) AS b FROM (SELECT event_id, ts_us, "
    "list({'t': ts_us, 'v': velocity, 's': step}) OVER (PARTITION BY session ORDER BY ts_us, event_id "
    f"ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS b FROM {_MOTION}))",
)
def move_stats(spark, root):
    stats = b.move_stats(t.moves(spark, root), seconds=_DAY2)
    measures = ("distance", "span_s", "avg_velocity", "max_velocity", "min_velocity")
    return stats.select("event_id", "moves", *[F.round(c, 6).alias(c) for c in measures])


_WEEK = 7 * 86_400
_PATTERNS = (
    "(SELECT event_id, n10 = 10 AND t10 >= ts_us - {s}000000 AS full10, n5 = 5 AND t5 >= ts_us - {s}000000 "
    "AS full5, turns, speed, x - x5 AS ex, y - y5 AS ey FROM (SELECT event_id, ts_us, x, y, "
    "count(*) OVER w10 AS n10, first(ts_us) OVER w10 AS t10, count(*) OVER w5 AS n5, "
    "first(ts_us) OVER w5 AS t5, sum(turn) OVER w8 AS turns, avg(velocity) OVER w10 AS speed, "
    "first(x) OVER w5 AS x5, first(y) OVER w5 AS y5 FROM (SELECT *, CASE WHEN dx * lag(dx) OVER "
    "(PARTITION BY session ORDER BY ts_us, event_id) < 0 THEN 1 ELSE 0 END AS turn FROM {motion}) "
    "WINDOW w10 AS (PARTITION BY session ORDER BY ts_us, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), "
    "w8 AS (PARTITION BY session ORDER BY ts_us, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), "
    "w5 AS (PARTITION BY session ORDER BY ts_us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))) p"
).format(s=_WEEK, motion=_MOTION)


@query(
    "pattern_backforth",
    f"SELECT event_id, full10 AND turns >= 3 AS back_and_forth FROM {_PATTERNS}",
)
def pattern_backforth(spark, root):
    return b.motion_patterns(t.moves(spark, root), seconds=_WEEK).select(
        "event_id", "back_and_forth"
    )


@query("pattern_idle", f"SELECT event_id, full10 AND speed < 5 AS idle FROM {_PATTERNS}")
def pattern_idle(spark, root):
    return b.motion_patterns(t.moves(spark, root), seconds=_WEEK).select("event_id", "idle")


@query(
    "pattern_swipe",
    "SELECT event_id, CASE WHEN full5 AND sqrt(ex * ex + ey * ey) > 50 THEN CASE WHEN abs(ex) > abs(ey) "
    "THEN CASE WHEN ex > 0 THEN 'right' ELSE 'left' END WHEN ey > 0 THEN 'down' ELSE 'up' END END AS swipe "
    f"FROM {_PATTERNS}",
)
def pattern_swipe(spark, root):
    return b.motion_patterns(t.moves(spark, root), seconds=_WEEK).select("event_id", "swipe")


@query(
    "focus_changes",
    "SELECT event_id, CASE WHEN NOT has THEN 'window_closed' WHEN NOT coalesce(ph, FALSE) THEN 'initial_focus' "
    "WHEN p <> pp THEN 'application_switch' WHEN w <> pw THEN 'window_switch' ELSE 'window_title_change' END "
    "AS reason FROM (SELECT *, lag(has) OVER o AS ph, lag(p) OVER o AS pp, lag(w) OVER o AS pw, "
    "lag(ti) OVER o AS pt FROM (SELECT user_id, ts, event_id, k % 10 <> 0 AS has, k % 2 AS p, k % 3 AS ti, "
    f"event_type AS w FROM (SELECT *, {K} AS k FROM events)) WINDOW o AS (PARTITION BY user_id ORDER BY ts, "
    "event_id)) WHERE NOT (has AND coalesce(ph, FALSE) AND p = pp AND w = pw AND ti = pt)",
)
def focus_changes(spark, root):
    return b.focus_changes(t.focus(spark, root)).select("event_id", "reason")


@query(
    "dedup_consecutive",
    "SELECT event_id, content FROM (SELECT event_id, content, lag(content) OVER (PARTITION BY user_id "
    "ORDER BY ts, event_id) AS before FROM (SELECT *, CASE WHEN event_type = 'view' THEN '' ELSE event_type "
    "END AS content FROM events)) WHERE content = '' OR before IS NULL OR content <> before",
)
def dedup_consecutive(spark, root):
    content = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    rows = t.events(spark, root).select("user_id", "ts_us", "event_id", content.alias("content"))
    return b.drop_consecutive(rows, "content", "user_id").select("event_id", "content")


@query(
    "counter_rate",
    "SELECT event_id, bytes_in_delta, bytes_out_delta, round((bytes_in_delta + bytes_out_delta) / seconds, 6) "
    "AS rate FROM (SELECT event_id, i - lag(i) OVER w AS bytes_in_delta, o - lag(o) OVER w AS bytes_out_delta, "
    "(ts_us - lag(ts_us) OVER w) / 1000000.0::DOUBLE AS seconds FROM (SELECT user_id, epoch_us(ts) AS ts_us, "
    f"event_id, event_id * 50 + CAST(round(value * 100) AS BIGINT) AS i, event_id * 20 + {K} * 100 AS o "
    "FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)) WHERE seconds > 0 AND "
    "bytes_in_delta >= 0 AND bytes_out_delta >= 0",
)
def counter_rate(spark, root):
    rated = b.counter_rate(t.counters(spark, root), ["bytes_in", "bytes_out"])
    return rated.select(
        "event_id", "bytes_in_delta", "bytes_out_delta", F.round("rate", 6).alias("rate")
    )


@query(
    "idle_state",
    "SELECT event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, "
    "event_id) > 7200000000 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS state_rate FROM events",
)
def idle_state(spark, root):
    rows = t.events(spark, root).select("user_id", "ts_us", "event_id")
    return b.idle_state(rows, "user_id", timeout_s=7200.0).select("event_id", "state_rate")


@query(
    "event_bigrams",
    "SELECT first, second, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, "
    "event_id) AS first, event_type AS second FROM events) WHERE first IS NOT NULL GROUP BY ALL",
)
def event_bigrams(spark, root):
    return b.event_pairs(t.events(spark, root), "event_type", "user_id")


@query(
    "replay_schedule",
    "SELECT event_id, round(greatest(floor((lead(epoch_us(ts)) OVER (ORDER BY ts, event_id) - epoch_us(ts)) / "
    "1000.0::DOUBLE) / 4.0::DOUBLE, 1.0::DOUBLE) + CASE WHEN lead(ts) OVER (ORDER BY ts, event_id) IS NULL THEN NULL "
    "ELSE 0 END, 6) AS wait_ms FROM events",
)
def replay_schedule(spark, root):
    rows = t.events(spark, root).select("event_id", "ts_us")
    paced = b.replay_schedule(rows, "ts_us", "event_id", speed=4.0)
    return paced.select("event_id", F.round("wait_ms", 6).alias("wait_ms"))


@query(
    "type_sequence",
    "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS type_no FROM events",
)
def type_sequence(spark, root):
    rows = t.events(spark, root).select("event_id", "ts_us", "event_type")
    return b.type_sequence(rows, "event_type", "ts_us", "event_id").select("event_id", "type_no")


@query(
    "bounded_buffer",
    "SELECT event_id, id FROM " + _ARRIVALS + " ORDER BY arrival DESC, event_id DESC LIMIT 500",
)
def bounded_buffer(spark, root):
    rows = t.arrivals(spark, root).select("event_id", "id", "arrival")
    return b.bounded_buffer(rows, "arrival", "event_id", 500).select("event_id", "id")


@query(
    "buffer_overflow",
    "SELECT count(*) AS writes, CAST(greatest(count(*) - 500, 0) AS BIGINT) AS overflow, "
    "least(count(*), 500) / 500.0::DOUBLE AS utilization FROM events",
)
def buffer_overflow(spark, root):
    return b.buffer_overflow(t.table(spark, root, "events"), 500)


@query(
    "exclude_apps",
    "SELECT event_id FROM events WHERE user_id % 10 NOT IN (1, 2)",
)
def exclude_apps(spark, root):
    kept = b.exclude_apps(t.event_log(spark, root), "app_bundle_id", ["app.1", "app.2"])
    return kept.select(F.col("event_id").cast("long").alias("event_id"))


_PATH = (
    "'/home/u' || (doc_id % 7) || ['/src/', '/.git/', '/tmp/', '/.ssh/', '/Documents/', "
    "'/Documents/Private/'][CAST(doc_id % 6 AS INTEGER) + 1] || source || '.txt'"
)


@query(
    "exclude_paths",
    f"SELECT doc_id, {_PATH} AS path FROM documents WHERE doc_id % 6 IN (0, 4)",
)
def exclude_paths(spark, root):
    folders = ["/src/", "/.git/", "/tmp/", "/.ssh/", "/Documents/", "/Documents/Private/"]
    folder = F.element_at(
        F.array(*[F.lit(f) for f in folders]), (F.col("doc_id") % 6 + 1).cast("int")
    )
    user = (F.col("doc_id") % 7).cast("string")
    path = F.concat(F.lit("/home/u"), user, folder, F.col("source"), F.lit(".txt"))
    files = t.table(spark, root, "documents").select("doc_id", path.alias("path"))
    return files.filter(~b.excluded_path(F.col("path")))


@query(
    "dimension_names",
    "SELECT c_custkey, c_nationkey, coalesce(n_name, 'unknown') AS n_name FROM customer "
    "LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey",
)
def dimension_names(spark, root):
    customers = t.table(spark, root, "customer").select("c_custkey", F.col("c_nationkey"))
    names = t.table(spark, root, "nation").filter("n_regionkey <> 2")
    names = names.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return b.with_names(customers, names, "c_nationkey", "n_name", "unknown")


@query(
    "oversize_split",
    "SELECT strlen(text) > 5000 AS dropped, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes "
    "FROM documents GROUP BY 1",
)
def oversize_split(spark, root):
    docs = t.table(spark, root, "documents").select("text")
    sized = docs.select(F.octet_length("text").cast("long").alias("size"))
    return sized.groupBy((F.col("size") > 5000).alias("dropped")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )


@query(
    "oversize_encoded",
    "SELECT doc_id, size, size > 102400 AS dropped FROM (SELECT doc_id, CAST(strlen(CAST(to_json(struct_pack("
    "doc_id := doc_id, text := text, lang := lang, source := source, n_chars := n_chars)) AS VARCHAR)) AS BIGINT) AS size FROM documents)",
)
def oversize_encoded(spark, root):
    docs = t.table(spark, root, "documents")
    sized = docs.select("doc_id", b.encoded_size(docs).cast("long").alias("size"))
    return sized.withColumn("dropped", F.col("size") > b.MAX_EVENT_BYTES)


@query(
    "sample_events",
    "SELECT event_id, event_type FROM events WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 13) AS BIGINT) "
    "/ 4503599627370496.0 < 0.25",
)
def sample_events(spark, root):
    rows = t.table(spark, root, "events").select("event_id", "event_type")
    return b.sample_rows(rows, "event_id", 0.25)


_ROUTES = [("storage", "click"), ("storage", "view"), ("alerts", "error"), ("metrics", "*")]


@query(
    "route_events",
    "SELECT event_id, 'metrics' AS handler FROM events UNION ALL SELECT event_id, 'storage' FROM events "
    "WHERE event_type IN ('click', 'view') UNION ALL SELECT event_id, 'alerts' FROM events "
    "WHERE event_type = 'error'",
)
def route_events(spark, root):
    rows = t.table(spark, root, "events").select("event_id", "event_type")
    return b.route_events(rows, _ROUTES, "event_type").select("event_id", "handler")


_KEY_VALUES = ", ".join(
    "({}, '{}')".format(code, name.replace("'", "''")) for code, name in b.KEY_NAMES.items()
)


@query(
    "dim_lookup",
    "SELECT coalesce(name, 'Unknown (' || code || ')') AS key_name, count(*) AS n FROM (SELECT event_id % 130 "
    f"AS code FROM events) LEFT JOIN (VALUES {_KEY_VALUES}) names(code2, name) ON code = code2 GROUP BY 1",
)
def dim_lookup(spark, root):
    keys = t.table(spark, root, "events").select((F.col("event_id") % 130).alias("code"))
    names = b.with_names(keys, b.key_names(spark), "code", "key_name")
    unknown = F.concat(F.lit("Unknown ("), F.col("code").cast("string"), F.lit(")"))
    names = names.withColumn("key_name", F.coalesce("key_name", unknown))
    return names.groupBy("key_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "window_stats",
    "SELECT event_type AS app, count(*) AS windows, count(*) FILTER (WHERE user_id % 3 <> 0 AND "
    f"value / 500 > 0.1) AS visible, CAST(sum({K} * (user_id % 50)) AS BIGINT) AS area FROM events GROUP BY 1",
)
def window_stats(spark, root):
    rows = t.events(spark, root).select(
        F.col("event_type").alias("app"),
        (F.col("user_id") % 3 != 0).alias("on_screen"),
        (F.col("value") / 500).alias("alpha"),
        F.col("k").alias("width"),
        (F.col("user_id") % 50).alias("height"),
    )
    return b.window_stats(rows, "app")


@query(
    "meeting_flag",
    f"SELECT user_id, bool_or({K} = 7) AS in_meeting FROM events GROUP BY user_id",
)
def meeting_flag(spark, root):
    app = F.when(F.col("k") == 7, "us.zoom.xos").otherwise("org.editor")
    rows = t.events(spark, root).select("user_id", F.array(F.lit("org.mail"), app).alias("apps"))
    return b.meeting_flag(rows, "user_id", "apps")


@query(
    "net_by_remote",
    "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS remote, split_part(url, ':', 1) AS protocol, "
    "count(*) AS requests, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1, 2",
)
def net_by_remote(spark, root):
    pages = t.table(spark, root, "pages")
    return b.network_totals(pages, "url", F.octet_length("html").cast("long"))

"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from tidelog.functions import formats as fm
from tidelog.functions import payload as pl
from tidelog.functions import text as tx
from tidelog.functions import times as tm
from tidelog.plans.base import query
from tidelog.plans.search import K
from tidelog.sources import tables as t


@query(
    "str_truncate",
    "SELECT doc_id, CASE WHEN strlen(text) <= 600 THEN text ELSE left(text, 597) || '...' END AS short, "
    "CASE WHEN strlen(text) <= 2 THEN text ELSE left(text, 2) END AS tiny FROM documents",
)
def str_truncate(spark, root):
    text = F.col("text")
    return t.table(spark, root, "documents").select(
        "doc_id", tx.truncate(text, 600).alias("short"), tx.truncate(text, 2).alias("tiny")
    )


@query(
    "str_basic",
    "SELECT o_orderkey, lower(s) AS low, upper(s) AS up, trim(s) AS trimmed, split_part(trim(s), '-', 2) AS part, "
    "starts_with(trim(s), '1') AS starts, ends_with(trim(s), 'LOW') AS ends, contains(s, 'URG') AS has, "
    "upper(left(split_part(trim(s), '-', 2), 1)) || lower(substr(split_part(trim(s), '-', 2), 2, 2)) AS cap FROM "
    "(SELECT o_orderkey, ' ' || o_orderpriority || ' ' AS s FROM orders)",
)
def str_basic(spark, root):
    s = F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))
    part = F.split_part(F.trim(s), F.lit("-"), F.lit(2))
    return t.table(spark, root, "orders").select(
        "o_orderkey",
        F.lower(s).alias("low"),
        F.upper(s).alias("up"),
        F.trim(s).alias("trimmed"),
        part.alias("part"),
        F.trim(s).startswith("1").alias("starts"),
        F.trim(s).endswith("LOW").alias("ends"),
        s.contains("URG").alias("has"),
        tx.capitalize_words(F.left(part, F.lit(3))).alias("cap"),
    )


# Sizes over many magnitudes, from the order key and the price.
_SIZE = "(SELECT o_orderkey, CAST(floor(o_totalprice * pow(10, o_orderkey % 11 - 4) + 0.5) AS BIGINT) AS size FROM orders)"


def _sizes(spark, root):
    power = (F.col("o_orderkey") % 11 - 4).cast("double")
    size = F.floor(F.col("o_totalprice") * F.pow(F.lit(10.0), power) + 0.5)
    return t.table(spark, root, "orders").select("o_orderkey", size.alias("size"))


def _steps(base, template, names):
    cases = " ".join(
        f"WHEN size >= {float(base**p)!r}::DOUBLE THEN printf('{template} {n}', size / {float(base**p)!r}::DOUBLE)"
        for p, n in reversed(list(enumerate(names))[1:])
    )
    return f"CASE {cases}"


@query(
    "fmt_bytes",
    "SELECT o_orderkey, "
    + _steps(1024, "%.1f", fm.UNITS)
    + f" ELSE size || ' B' END AS shown FROM {_SIZE}",
)
def fmt_bytes(spark, root):
    return _sizes(spark, root).select("o_orderkey", fm.bytes_binary(F.col("size")).alias("shown"))


@query(
    "fmt_bytes_si",
    "SELECT o_orderkey, "
    + _steps(1000, "%.2f", fm.UNITS + ["PB"])
    + f" WHEN size = 0 THEN '0 B' ELSE printf('%.2f B', size::DOUBLE) END AS shown FROM {_SIZE}",
)
def fmt_bytes_si(spark, root):
    return _sizes(spark, root).select("o_orderkey", fm.bytes_decimal(F.col("size")).alias("shown"))


@query(
    "parse_bytes",
    "SELECT o_orderkey, CASE CAST(o_orderkey % 7 AS INTEGER) WHEN 6 THEN NULL ELSE CAST(floor((o_orderkey % 1000 + 0.5::DOUBLE) "
    "* [1, 1, 1024, 1048576, 1073741824, 1099511627776][CAST(o_orderkey % 7 AS INTEGER) + 1]) AS BIGINT) END AS bytes "
    "FROM orders",
)
def parse_bytes(spark, root):
    unit = F.element_at(
        F.array(*[F.lit(u) for u in ("", "B", "kb", "MB", "GB", "TB", "XB")]),
        (F.col("o_orderkey") % 7 + 1).cast("int"),
    )
    text = F.concat(F.lit(" "), (F.col("o_orderkey") % 1000).cast("string"), F.lit(".5"), unit)
    return t.table(spark, root, "orders").select(
        "o_orderkey", fm.parse_bytes(text).alias("bytes")
    )


_MS = "(SELECT event_id, CAST(floor(value * pow(10, event_id % 6) + 0.5) AS BIGINT) AS ms FROM events)"


def _millis(spark, root):
    power = (F.col("event_id") % 6).cast("double")
    ms = F.floor(F.col("value") * F.pow(F.lit(10.0), power) + 0.5)
    return t.table(spark, root, "events").select("event_id", ms.alias("ms"))


@query(
    "fmt_duration",
    "SELECT event_id, CASE WHEN ms >= 3600000 THEN printf('%dh %dm %ds', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000) "
    "WHEN ms >= 60000 THEN printf('%dm %ds', ms // 60000, ms % 60000 // 1000) WHEN ms >= 1000 THEN "
    f"printf('%d.%03ds', ms // 1000, ms % 1000) ELSE printf('%dms', ms) END AS shown FROM {_MS}",
)
def fmt_duration(spark, root):
    return _millis(spark, root).select("event_id", fm.duration(F.col("ms")).alias("shown"))


@query(
    "fmt_rate",
    "SELECT event_id, CASE WHEN ms >= 1000000 THEN printf('%.2fM ops/s', ms / 1000000.0::DOUBLE) WHEN ms >= 1000 THEN "
    f"printf('%.2fK ops/s', ms / 1000.0::DOUBLE) ELSE printf('%.2f ops/s', ms::DOUBLE) END AS shown FROM {_MS}",
)
def fmt_rate(spark, root):
    return _millis(spark, root).select(
        "event_id", fm.rate(F.col("ms").cast("double"), "ops").alias("shown")
    )


_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "us"),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M", "minute"),
    ("yyyy-MM-dd", "%Y-%m-%d", "day"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", "us"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "%Y-%m-%dT%H:%M:%S.%fZ", "us"),
    ("MM/dd/yyyy HH:mm", "%m/%d/%Y %H:%M", "minute"),
    ("MM/dd/yyyy", "%m/%d/%Y", "day"),
    ("'junk 'yyyy", "junk %Y", None),
]


def _shown(formats):
    ts = F.col("ts").cast("timestamp")
    texts = F.array(*[F.date_format(ts, f) for f in formats])
    return F.element_at(texts, (F.col("event_id") % len(formats) + 1).cast("int"))


def _truncated_us():
    cases = []
    for i, (_, sql, unit) in enumerate(_FORMATS):
        if unit is None:
            cases.append(f"WHEN {i} THEN NULL")
        elif unit == "us":
            keep = "epoch_us(ts)" if "%f" in sql else "epoch_us(ts) // 1000000 * 1000000"
            cases.append(f"WHEN {i} THEN {keep}")
        else:
            cases.append(f"WHEN {i} THEN epoch_us(date_trunc('{unit}', ts))")
    return f"CASE CAST(event_id % {len(_FORMATS)} AS INTEGER) {' '.join(cases)} END"


@query("parse_ts", f"SELECT event_id, {_truncated_us()} AS parsed_us FROM events")
def parse_ts(spark, root):
    text = _shown([f for f, _, _ in _FORMATS])
    parsed = F.unix_micros(tm.parse_search_time(text)).alias("parsed_us")
    return t.table(spark, root, "events").select("event_id", parsed)


@query(
    "parse_ts_unix",
    "SELECT event_id, CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN epoch_us(ts) // 1000 * 1000 WHEN 1 THEN epoch_us(ts) // "
    "1000000 * 1000000 WHEN 2 THEN epoch_us(date_trunc('day', ts)) ELSE NULL END AS parsed_us, epoch_us(ts) // 1000000 "
    "* 1000000 AS from_seconds_us FROM events",
)
def parse_ts_unix(spark, root):
    text = _shown(
        ["yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy"]
    )
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    return t.table(spark, root, "events").select(
        "event_id",
        F.unix_micros(tm.parse_strict_time(text)).alias("parsed_us"),
        F.unix_micros(tm.parse_strict_time(seconds)).alias("from_seconds_us"),
    )


@query(
    "fmt_ts",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS shown, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN "
    "'.' || lpad(CAST(epoch_us(ts) % 1000000 // 1000 AS VARCHAR), 3, '0') ELSE strftime(ts, '.%f') END || '+00:00' AS rfc "
    "FROM events",
)
def fmt_ts(spark, root):
    ts = F.col("ts").cast("timestamp")
    return t.table(spark, root, "events").select(
        "event_id",
        tm.iso_text(ts).alias("shown"),
        tm.file_stamp(ts).alias("stamp"),
        tm.rfc3339(ts).alias("rfc"),
    )


@query(
    "ts_parts",
    "SELECT event_id, year(ts)::INTEGER AS y, month(ts)::INTEGER AS m, day(ts)::INTEGER AS d, hour(ts)::INTEGER AS h, "
    "strftime(ts, '%Y-%m-%d') AS date, epoch_us(ts + INTERVAL 90 MINUTE) AS later_us FROM events",
)
def ts_parts(spark, root):
    log = t.events(spark, root).select("event_id", (F.col("ts_us") * 1000).alias("ns"))
    ts = tm.ns_to_timestamp(F.col("ns"))
    later = ts + F.expr("INTERVAL 90 MINUTES")
    return log.select(
        "event_id",
        F.year(ts).alias("y"),
        F.month(ts).alias("m"),
        F.day(ts).alias("d"),
        F.hour(ts).alias("h"),
        tm.ns_to_date(F.col("ns")).cast("string").alias("date"),
        F.unix_micros(later).alias("later_us"),
    )


def _flags_sql(table, bits, empty):
    names = ", ".join(f"CASE WHEN {bits} & {mask} <> 0 THEN '{name}' END" for mask, name in table)
    joined = f"array_to_string(list_filter([{names}], lambda e: e IS NOT NULL), ',')"
    return f"coalesce(nullif({joined}, ''), '{empty}')"


@query(
    "flags_to_text",
    f"SELECT event_id, {_flags_sql(pl.FILE_FLAGS, '(event_id * 37 % 512 * 128)', 'unknown')} AS change FROM events",
)
def flags_to_text(spark, root):
    bits = F.col("event_id") * 37 % 512 * 128
    return t.table(spark, root, "events").select("event_id", pl.file_change(bits).alias("change"))


@query(
    "flags_to_array",
    f"SELECT event_id, {_flags_sql(pl.MODIFIER_FLAGS, '(event_id * 41 % 256 * 65536)', '')} AS held FROM events",
)
def flags_to_array(spark, root):
    bits = F.col("event_id") * 41 % 256 * 65536
    held = F.array_join(pl.modifiers(bits), ",").alias("held")
    return t.table(spark, root, "events").select("event_id", held)


@query(
    "map_ops",
    f"SELECT event_id, user_id::VARCHAR AS user, NULL::VARCHAR AS absent, 'kind=' || event_type || ',level=' || ({K} % 3) || "
    "',user=' || user_id AS entries FROM events",
)
def map_ops(spark, root):
    base = F.create_map(
        F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")
    )
    put = F.map_concat(base, F.create_map(F.lit("level"), (F.col("k") % 3).cast("string")))
    pairs = F.transform(
        F.array_sort(F.map_entries("m")), lambda e: F.concat(e.key, F.lit("="), e.value)
    )
    return (
        t.events(spark, root)
        .select("event_id", put.alias("m"))
        .select(
            "event_id",
            F.try_element_at("m", F.lit("user")).alias("user"),
            F.try_element_at("m", F.lit("missing")).alias("absent"),
            F.array_join(pairs, ",").alias("entries"),
        )
    )


@query(
    "math_ops",
    f"SELECT event_id, round(sqrt(value), 6) AS root, abs(value - 50) AS distance, least(greatest(value, 10), 90) AS clamped, "
    f"round(log10(value + 1), 6) AS digits, pow({K}, 2) AS squared, round(sin(value), 6) AS wave, "
    "floor(value) AS whole FROM events",
)
def math_ops(spark, root):
    v = F.col("value")
    return t.events(spark, root).select(
        "event_id",
        F.round(F.sqrt(v), 6).alias("root"),
        F.abs(v - 50).alias("distance"),
        F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0)).alias("clamped"),
        F.round(F.log10(v + 1), 6).alias("digits"),
        F.pow("k", F.lit(2)).alias("squared"),
        F.round(F.sin(v), 6).alias("wave"),
        F.floor(v).cast("double").alias("whole"),
    )


_LEVELS = ["none", "basic", "enhanced", "strict"]


@query(
    "privacy_mask",
    "SELECT event_id, CASE level WHEN 'basic' THEN '{\"user\":' || user_id || ',\"content\":\"' || event_type || '\"}' "
    "WHEN 'enhanced' THEN '{\"user\":' || user_id || ',\"secret\":' || k || ',\"content\":\"hash_' || (strlen(event_type) + 2) "
    "|| '\"}' WHEN 'strict' THEN '{\"redacted\":true,\"timestamp\":' || epoch_us(ts) || '}' ELSE '{\"user\":' || user_id || "
    "',\"secret\":' || k || ',\"content\":\"' || event_type || '\"}' END AS masked FROM (SELECT *, ['none', 'basic', "
    f"'enhanced', 'strict'][CAST(event_id % 4 AS INTEGER) + 1] AS level, {K} AS k FROM events)",
)
def privacy_mask(spark, root):
    level = F.element_at(
        F.array(*[F.lit(x) for x in _LEVELS]), (F.col("event_id") % 4 + 1).cast("int")
    )
    payload = F.struct(
        F.col("user_id").alias("user"), F.col("k").alias("secret"), F.col("event_type").alias("content")
    )
    rows = t.events(spark, root).select(
        "event_id", "ts_us", level.alias("level"), payload.alias("p")
    )
    masked = pl.mask_payload(
        F.col("level"),
        F.col("p"),
        F.col("ts_us"),
        ["user", "secret", "content"],
        dropped="secret",
        hashed="content",
    )
    return rows.select("event_id", masked.alias("masked"))


@query(
    "redact_sensitive",
    "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '"
    + "|".join(tx.SENSITIVE_WORDS + ["heed"])
    + "') THEN '[FILTERED]' ELSE text END AS shown FROM documents",
)
def redact_sensitive(spark, root):
    shown = tx.filter_sensitive(F.col("text"), ["Heed"]).alias("shown")
    return t.table(spark, root, "documents").select("doc_id", shown)

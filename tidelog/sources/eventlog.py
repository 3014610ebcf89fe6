"""The event log on disk: layouts, write, scan, file catalogue, footers."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.times import floor_div, in_range, ns_to_date, ns_to_timestamp
from tidelog.schema import EVENT_COLUMNS
from tidelog.session import materialize
from tidelog.sources.arrow_files import open_fs

# Accepted codecs; anything else is written as snappy.
CODECS = {"SNAPPY": "snappy", "GZIP": "gzip", "LZ4": "lz4_raw", "ZSTD": "zstd"}
BLOOM_COLUMNS = ["app_bundle_id", "window_title"]
SHARDS = 256
MAX_FILES_PER_FOLDER = 1000
# Bounds a file at a few hundred MB.
ROWS_PER_FILE = 2_000_000
#: Bytes of a file that are hashed at once, and hashes that are combined to one.
CHUNK_BYTES, FAN = 4 << 20, 1024


def layout_columns(strategy: str, ns: Column, event_type: Column) -> dict[str, Column]:
    """Partition columns of a layout, outermost first."""
    ts = ns_to_timestamp(ns)
    day = {
        "year": F.date_format(ts, "yyyy"),
        "month": F.date_format(ts, "MM"),
        "day": F.date_format(ts, "dd"),
    }
    hour = {"hour": F.date_format(ts, "HH")}
    second = floor_div(ns, 1_000_000_000)
    shard = F.pmod(F.xxhash64(event_type, second), F.lit(SHARDS))
    layouts = {
        "daily": day,
        "hourly": {**day, **hour},
        "type": {"type": event_type, **day},
        "type_hour": {"type": event_type, **day, **hour},
        "shard": {"shard": F.format_string("shard_%03d", shard), **day},
    }
    if strategy not in layouts:
        raise ValueError(f"unknown layout: {strategy}")
    return layouts[strategy]


def write_event_log(
    log: DataFrame,
    path: str,
    codec: str = "SNAPPY",
    bloom: list[str] = BLOOM_COLUMNS,
    mode: str = "append",
) -> None:
    """Write events, one folder per UTC day.

    ``append`` adds files to the days, ``days`` replaces the days that the input has,
    ``all`` replaces the whole log. The rebalance hint lets Spark join small days and
    split a huge one over several tasks; sorting inside a task keeps row-group
    statistics tight. No events to write is an error.
    """
    if mode not in ("append", "days", "all"):
        raise ValueError(f"unknown mode: {mode}")
    # Reads one row at most, and comes first: an empty input must not empty the log.
    if log.isEmpty():
        raise ValueError("no events to write")
    (
        by_day(log)
        .write.mode("append" if mode == "append" else "overwrite")
        .option("partitionOverwriteMode", "dynamic" if mode == "days" else "static")
        .options(**event_options(codec, bloom))
        .partitionBy("event_date")
        .parquet(path)
    )


def by_day(log: DataFrame) -> DataFrame:
    """Events with their day, dealt out and sorted as they are written."""
    dated = log.withColumn("event_date", ns_to_date(F.col("timestamp_ns")))
    return dated.hint("rebalance", "event_date").sortWithinPartitions("event_date", "timestamp_ns")


def event_options(codec: str = "SNAPPY", bloom: list[str] = BLOOM_COLUMNS) -> dict[str, object]:
    """Options of the writer: codec, bound on rows per file, bloom filters."""
    filters = {f"parquet.bloom.filter.enabled#{column}": "true" for column in bloom}
    return {"compression": CODECS.get(codec.upper(), "snappy"), "maxRecordsPerFile": ROWS_PER_FILE, **filters}


def write_layout(log: DataFrame, path: str, strategy: str, codec: str = "SNAPPY", mode: str = "append") -> None:
    """Write events in one of the layouts, a folder level for each of its columns.

    ``append`` adds files, ``all`` replaces what is there.
    """
    if mode not in ("append", "all"):
        raise ValueError(f"unknown mode: {mode}")
    columns = layout_columns(strategy, F.col("timestamp_ns"), F.col("event_type"))
    (
        log.withColumns(columns)
        .hint("rebalance", *columns)
        .write.mode("append" if mode == "append" else "overwrite")
        .option("compression", CODECS.get(codec.upper(), "snappy"))
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(*columns)
        .parquet(path)
    )


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Remove a folder, wherever Spark can write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def day_folders(spark: SparkSession, path: str) -> list[dt.date]:
    """The days that a log has folders for; no file is opened."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory()]
    days = [n.removeprefix("event_date=") for n in names if n.startswith("event_date=")]
    return sorted(dt.date.fromisoformat(d) for d in days if d[:1].isdigit())


def scan_event_log(
    spark: SparkSession,
    path: str,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
) -> DataFrame:
    """The seven columns, optionally in a time range, closed where an end is given.

    The range also goes to the day folders, so other days are not opened.
    Unsigned times written by other tools arrive as decimals and are cast.
    """
    log = spark.read.parquet(path)
    if start is not None:
        log = log.filter(F.col("event_date") >= F.lit(start.date().isoformat()).cast("date"))
    if end is not None:
        log = log.filter(F.col("event_date") <= F.lit(end.date().isoformat()).cast("date"))
    if log.schema["timestamp_ns"].dataType.simpleString() != "bigint":
        log = log.withColumn("timestamp_ns", F.col("timestamp_ns").cast("long"))
    if start is not None or end is not None:
        log = log.filter(in_range(log, "timestamp_ns", start, end))
    return log.select(*EVENT_COLUMNS)


def frames(log: DataFrame) -> DataFrame:
    """Binary frames of ``frame`` events; broken JSON or base64 is left out."""
    text = F.get_json_object("data", "$.data")
    return (
        log.filter(F.col("event_type") == "frame")
        .select("timestamp_ns", "event_id", F.try_to_binary(text, F.lit("base64")).alias("frame"))
        .filter(F.col("frame").isNotNull())
    )


def without_frames(log: DataFrame) -> DataFrame:
    return log.filter(~F.col("event_type").eqNullSafe("frame"))


# -- files --------------------------------------------------------------------------------


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """path, size and time of every file; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )


def tree_hashes(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """``path`` and ``checksum`` of files (``path``, ``size``), from parts that are hashed in parallel.

    A leaf is the SHA-256, in hex digits, of ``leaf:`` and a chunk of the file; a file of no bytes is
    one empty chunk. Up to ``fan`` neighbours make a node: the SHA-256 of ``node:`` and their hex
    digits, in order, joined by commas. One alone goes up as it is. The last one left is the checksum. A
    task holds one chunk at a time, so files may be of any size. A file that is shorter
    than listed ends the job.
    """
    files = materialize(files.select("path", "size"), "listed")
    last = F.greatest(F.ceil(F.col("size") / F.lit(chunk_bytes)) - 1, F.lit(0)).cast("long")
    chunks = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("place"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, size, place in zip(*(batch[c].to_pylist() for c in ("path", "size", "place"))):
                system, name = open_fs(path)
                wanted = min(chunk_bytes, size - place * chunk_bytes)
                with system.open_input_file(name) as source:
                    part = source.read_at(wanted, place * chunk_bytes) if wanted else b""
                if len(part) != wanted:
                    raise OSError(f"{path} is shorter than listed")
                found.append(hashlib.sha256(b"leaf:" + part).hexdigest())
            yield pa.record_batch([batch["path"], batch["place"], pa.array(found, pa.string())], names=["path", "place", "hash"])

    # Written, so that no file is read again when the result is used again.
    level = materialize(chunks.repartition("path", "place").mapInArrow(digest, "path string, place long, hash string"), "leaves")
    most = (files.agg(F.max(last)).first()[0] or 0) + 1
    while most > 1:
        parts = F.sort_array(F.collect_list(F.struct("place", "hash")))["hash"]
        nodes = level.groupBy("path", floor_div(F.col("place"), fan).alias("place")).agg(parts.alias("parts"))
        joined = F.sha2(F.concat(F.lit("node:"), F.array_join("parts", ",")), 256)
        level = nodes.select("path", "place", F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(joined).alias("hash"))
        most = -(-most // fan)
    return level.select("path", F.col("hash").alias("checksum"))


def file_catalog(
    spark: SparkSession,
    path: str,
    pattern: str = "*.parquet",
    schema_version: str = "1.0.0",
    encrypted: bool = False,
) -> DataFrame:
    """path, size, time, format, compression, checksum, columns and row count of every file of a log.

    Whether payloads are encrypted and the version of the schema are the caller's to say.
    Files are hashed in chunks (``tree_hashes``), and ``columns`` are those of their footers, in order.
    """
    listed = materialize(list_files(spark, path, pattern), "files")
    footer = materialize(footers(spark, path, pattern).groupBy("path").agg(F.first("columns").alias("columns"), F.sum("rows").alias("record_count")), "footers")
    files = listed.select(
        "path",
        "size",
        F.unix_seconds("modified").alias("created_at"),
        F.lit("parquet").alias("format"),
        F.coalesce(F.nullif(F.regexp_extract("path", r"\.(\w+)\.parquet$", 1), F.lit("")), F.lit("none")).alias("compression"),
        F.lit(encrypted).alias("encrypted"),
        F.lit(schema_version).alias("schema_version"),
    )
    found = files.join(tree_hashes(listed), "path", "left").join(footer, "path", "left")
    return found.withColumn("record_count", F.coalesce("record_count", F.lit(0).cast("long")))


def crowded_folders(files: DataFrame, limit: int = MAX_FILES_PER_FOLDER) -> DataFrame:
    """Folders with more than ``limit`` files."""
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    return (
        files.groupBy(folder)
        .agg(F.count(F.lit(1)).alias("files"))
        .withColumn("rotate", F.col("files") > limit)
    )


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        out = []
        for path in batch["path"]:
            files, name = open_fs(path)
            with files.open_input_file(name) as source:
                footer = pq.read_metadata(source)
            columns = ",".join(footer.schema.to_arrow_schema().names)
            for group in range(footer.num_row_groups):
                part = footer.row_group(group)
                values = [part.column(i).num_values for i in range(part.num_columns)]
                out.append((path, columns, group, part.num_rows, min(values), max(values)))
        yield pd.DataFrame(
            out, columns=["path", "columns", "row_group", "rows", "min_values", "max_values"]
        )


def footers(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """One row per row group. Tasks open the listed files and read only their footers."""
    return list_files(spark, path, pattern).select("path").mapInPandas(
        _footers,
        "path string, columns string, row_group int, rows long, min_values long, max_values long",
    )


def schema_check(groups: DataFrame, needed: list[str] = EVENT_COLUMNS) -> DataFrame:
    """Per file: the needed columns it lacks. Day folders carry ``event_date``."""
    per_file = groups.groupBy("path").agg(F.first("columns").alias("columns"))
    missing = F.array_except(F.array(*[F.lit(c) for c in needed]), F.split("columns", ","))
    return per_file.select(
        "path",
        F.array_join(missing, ", ").alias("missing"),
        (F.size(missing) == 0).alias("passed"),
    )


def rowgroup_check(groups: DataFrame) -> DataFrame:
    """Row groups and whether all their columns hold the same number of values."""
    return groups.select(
        "path",
        "row_group",
        "rows",
        (F.col("min_values") == F.col("max_values")).alias("consistent"),
    )

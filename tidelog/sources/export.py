"""Exports of a search result and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.times import rfc3339
from tidelog.session import qualified
from tidelog.sources.arrow_files import SUFFIX, ArrowFiles, read_batches
from tidelog.sources.eventlog import list_files

# Formats, and the compressions each of them accepts.
FORMATS = ("json", "csv", "parquet", "arrow")
COMPRESSIONS = ("gzip", "bzip2", "lz4")
ROWS_PER_FILE = 1_000_000
# Times as text with all their digits.
_TEXT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
_SUPPORTED = {
    "json": {"gzip": "gzip", "bzip2": "bzip2", "lz4": "lz4"},
    "csv": {"gzip": "gzip", "bzip2": "bzip2", "lz4": "lz4"},
    "parquet": {"gzip": "gzip", "lz4": "lz4_raw"},
    "arrow": {"lz4": "lz4"},
}


def csv_rows(log: DataFrame, ts: Column) -> DataFrame:
    """The four CSV columns, with RFC 3339 times."""
    return log.select(
        rfc3339(ts).alias("timestamp"),
        F.col("event_type").alias("type"),
        F.col("event_id").cast("string").alias("id"),
        "data",
    )


def export(rows: DataFrame, path: str, kind: str, compression: str | None = None) -> None:
    if kind not in FORMATS:
        raise ValueError(f"format must be one of: {', '.join(FORMATS)}")
    if compression is not None and compression not in COMPRESSIONS:
        raise ValueError(f"compression must be one of: {', '.join(COMPRESSIONS)}")
    if compression is not None and compression not in _SUPPORTED[kind]:
        raise ValueError(f"{kind} files cannot be compressed with {compression}")
    # A bound on files: a compressed or quoted file is read back by one task.
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE)
    if compression:
        writer = writer.option("compression", _SUPPORTED[kind][compression])
    if kind == "json":
        writer.options(**_TEXT_TIMES).json(path)
    elif kind == "csv":
        writer.options(**_TEXT_TIMES).option("header", True).option("escape", '"').csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        rows.sparkSession.dataSource.register(ArrowFiles)
        writer.format("arrow_files").option("path", qualified(rows.sparkSession, path)).save()


def read_export(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """Read an export strictly: a row that does not fit the schema is an error."""
    if kind == "json":
        return spark.read.schema(schema).options(**_TEXT_TIMES).option("mode", "FAILFAST").json(path)
    if kind == "csv":
        return (
            spark.read.schema(schema)
            .options(**_TEXT_TIMES)
            .option("mode", "FAILFAST")
            .option("header", True)
            .option("escape", '"')
            .option("multiLine", True)
            .csv(path)
        )
    if kind == "parquet":
        return spark.read.parquet(path)
    return read_batches(list_files(spark, path, f"*{SUFFIX}"), schema)


def validate_export(
    spark: SparkSession, source: DataFrame, path: str, kind: str
) -> DataFrame:
    """One row: rows exported, rows read back, and whether they agree."""
    back = read_export(spark, path, kind, source.schema)
    # Read every column, so that a damaged value is noticed and not pruned away.
    touched = F.count(F.xxhash64(*back.columns)).alias("rows")
    return (
        back.agg(touched)
        .crossJoin(source.agg(F.count(F.lit(1)).alias("expected")))
        .select(
            F.lit(kind).alias("format"),
            "rows",
            "expected",
            (F.col("rows") == F.col("expected")).alias("valid"),
        )
    )

"""Keeping, copying and dropping parts of the log; catalogue comparisons."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.times import in_range, ns_to_date
from tidelog.session import materialize
from tidelog.sources.eventlog import (
    day_folders,
    drop_folder,
    file_catalog,
    scan_event_log,
    write_event_log,
)

RETENTION_DAYS = 60
#: Spark's folder name for a null.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
BACKLOG_BYTES = 50 * 1024 * 1024


def selection(
    log: DataFrame,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    event_types: list[str] | None = None,
    time: str = "timestamp_ns",
    everything: bool = False,
) -> Column:
    """Rows from ``start`` to ``end``, both included, and of the types.

    A missing end leaves the range open there. All rows are chosen only by an explicit
    ``everything``.
    """
    if start is None and end is None and not event_types and not everything:
        raise ValueError("nothing is selected; choose everything explicitly")
    chosen = F.lit(True)
    if start is not None or end is not None:
        chosen = chosen & in_range(log, time, start, end)
    if event_types:
        if any(not t.strip() for t in event_types):
            raise ValueError("event type cannot be empty")
        chosen = chosen & F.col("event_type").isin([t.strip() for t in event_types])
    return F.coalesce(chosen, F.lit(False))


# -- backup -----------------------------------------------------------------------------------


def backup_plan(log: DataFrame, chosen: Column) -> DataFrame:
    """Dry run: what would be copied."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("data", "event_type")])
    return log.filter(chosen).agg(
        F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")
    )


def backup(
    spark: SparkSession, log: DataFrame, target: str, chosen: Column, job: str = "backup", source: str | None = None
) -> DataFrame:
    """Copy the chosen rows; the result is the manifest of the written files.

    The target then holds this backup alone: what an earlier one left there is replaced. Each
    entry names its job and source; ``manifest_totals`` adds them up.
    """
    write_event_log(log.filter(chosen), target, mode="all")
    return file_catalog(spark, target).withColumns(
        {
            "backup_path": F.lit(target),
            "job": F.lit(job),
            "source": F.lit(source).cast("string"),
            "verified": F.lit(False),
        }
    )


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """Files, bytes and events of each job and source."""
    return manifest.groupBy("job", "source").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.sum("record_count").alias("events"),
        F.bool_and("verified").alias("verified"),
    )


def restore(spark: SparkSession, target: str) -> DataFrame:
    return scan_event_log(spark, target)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that the two sides do not have equally often, from one shuffle:
    ``surplus`` above zero is on the left, below zero on the right."""
    cols = left.columns
    signed = left.select(*cols, F.lit(1).alias("_d")).unionAll(
        right.select(*cols, F.lit(-1).alias("_d"))
    )
    net = signed.groupBy(*cols).agg(F.sum("_d").alias("surplus"))
    return net.filter(F.col("surplus") != 0)


def same_content(left: DataFrame, right: DataFrame) -> DataFrame:
    return difference(left, right).agg(
        F.coalesce(F.sum(F.greatest("surplus", F.lit(0))), F.lit(0)).alias("left_only"),
        F.coalesce(F.sum(F.greatest(-F.col("surplus"), F.lit(0))), F.lit(0)).alias("right_only"),
        (F.count(F.lit(1)) == 0).alias("equal"),
    )


def remove_entries(manifest: DataFrame, removed: DataFrame, path: str = "path") -> DataFrame:
    return manifest.join(removed.select(path), path, "left_anti")


def backup_stats(manifest: DataFrame, originals: DataFrame, path: str = "path") -> DataFrame:
    """Count, stored and original bytes, and their ratio (1 without originals)."""
    joined = manifest.select(path, F.col("size").alias("_stored")).join(
        originals.select(path, F.col("size").alias("_original")), path, "left"
    )
    stored, original = F.sum("_stored"), F.coalesce(F.sum("_original"), F.lit(0))
    return joined.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(stored, F.lit(0)).alias("stored_bytes"),
        original.alias("original_bytes"),
        F.when(original == 0, 1.0).otherwise(stored / original).alias("ratio"),
    )


# -- wipe and retention --------------------------------------------------------------------------


def wipe_keep(log: DataFrame, chosen: Column) -> DataFrame:
    """What is left after a wipe. Write it to a new path and then switch over:
    a plan must not overwrite the files it reads."""
    return log.filter(~chosen)


def wipe_plan(log: DataFrame, chosen: Column) -> DataFrame:
    return log.filter(chosen).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def wipe(spark: SparkSession, path: str, chosen: Column) -> list[dt.date]:
    """Delete the chosen rows of a log; the result is the days that changed, None for rows without a time.

    Only days that hold chosen rows are written again, from a copy of what is left of
    them, so a failure leaves each day as it was or as it should be.
    """
    dated = scan_event_log(spark, path).withColumn("_day", ns_to_date(F.col("timestamp_ns")))
    # As many rows as there are days.
    days = [r["_day"] for r in dated.filter(chosen).select("_day").distinct().collect()]
    if not days:
        return []
    touched = F.col("_day").isin([day for day in days if day]) | (F.col("_day").isNull() & F.lit(None in days))
    left = dated.filter(touched & ~chosen)
    left = materialize(left, "wipe")
    kept = {r["_day"] for r in left.select("_day").distinct().collect()}
    if kept:
        write_event_log(left.drop("_day"), path, mode="days")
    for day in days:
        if day not in kept:
            drop_folder(spark, f"{path}/event_date={day.isoformat() if day else NO_DAY}")
    return sorted(days, key=lambda day: day or dt.date.max)


def drop_expired(
    spark: SparkSession, path: str, as_of: dt.datetime, days: int = RETENTION_DAYS
) -> list[dt.date]:
    """Delete the folders of days older than the retention; the result is these days."""
    oldest = (as_of - dt.timedelta(days=days)).date()
    gone = [day for day in day_folders(spark, path) if day < oldest]
    for day in gone:
        drop_folder(spark, f"{path}/event_date={day.isoformat()}")
    return gone


def retention_split(log: DataFrame, as_of: dt.datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Events per day and whether the day is older than the retention."""
    oldest = F.lit((as_of - dt.timedelta(days=days)).date().isoformat()).cast("date")
    return (
        log.groupBy(ns_to_date(F.col("timestamp_ns")).alias("event_date"))
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("expired", F.col("event_date") < oldest)
    )


def backfill_day(log: DataFrame, day: dt.date, dry_run: bool = True, path: str | None = None):
    """One day again: a report in a dry run, else the day's folder at ``path``."""
    start = dt.datetime.combine(day, dt.time())
    end = start + dt.timedelta(days=1)
    rows = log.filter(
        in_range(log, "timestamp_ns", start, end)
        & (ns_to_date(F.col("timestamp_ns")) == F.lit(day.isoformat()).cast("date"))
    )
    if not dry_run:
        write_event_log(rows, path, mode="days")
        return rows
    return rows.agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"),
        F.count_distinct(ns_to_date(F.col("timestamp_ns"))).alias("folders"),
    )


# -- catalogue -------------------------------------------------------------------------------------


def files_in_range(catalogue: DataFrame, created: str, low: Column, high: Column) -> DataFrame:
    return catalogue.filter(F.col(created).between(low, high))


def storage_stats(catalogue: DataFrame) -> DataFrame:
    """Files and bytes per format, and in total (format null)."""
    return catalogue.rollup("format").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


def verify_files(
    expected: DataFrame, actual: DataFrame, checks: tuple[str, ...] = ("size", "checksum", "record_count")
) -> DataFrame:
    """Per expected file: exists, and size, checksum and row count as expected.
    An unknown expected row count is not checked. Other ``checks``, such as
    ``schema_version`` or a list of columns, are columns that both sides have."""
    e = expected.select(
        "path", F.lit(True).alias("_known"), *[F.col(c).alias(f"_e_{c}") for c in checks]
    )
    a = actual.select(
        "path", F.lit(True).alias("_found"), *[F.col(c).alias(f"_a_{c}") for c in checks]
    )
    joined = e.join(a, "path", "full_outer").withColumns(
        {
            "listed": F.coalesce("_known", F.lit(False)),
            "exists": F.coalesce("_found", F.lit(False)),
        }
    )
    both = F.col("listed") & F.col("exists")
    results = {
        f"{c}_ok": F.when(
            both,
            F.when(F.col(f"_e_{c}").isNull(), c == "record_count").otherwise(
                F.coalesce(F.col(f"_e_{c}") == F.col(f"_a_{c}"), F.lit(False))
            ),
        )
        for c in checks
    }
    out = joined.select("path", "listed", "exists", *[v.alias(n) for n, v in results.items()])
    passed = F.col("exists") & F.col("listed")
    for name in results:
        passed = passed & F.coalesce(F.col(name), F.lit(False))
    return out.withColumn("passed", passed)


def stored_report(verified: DataFrame, expected: DataFrame) -> DataFrame:
    """Valid and corrupted files, events in valid files, share of valid files (1 when none)."""
    counted = verified.filter("listed").join(
        expected.select("path", F.col("record_count").alias("_n")), "path"
    )
    n, valid = F.count(F.lit(1)), F.count_if("passed")
    return counted.agg(
        n.alias("files"),
        valid.alias("valid"),
        (n - valid).alias("corrupted"),
        F.coalesce(F.sum(F.when(F.col("passed"), F.col("_n"))), F.lit(0)).alias("events"),
        F.when(n == 0, 1.0).otherwise(valid / n).alias("success_rate"),
    )


def match_any(targets: DataFrame, drives: DataFrame, ident: str, kinds: list[str]) -> DataFrame:
    """Drives that share at least one identifier of the same kind with a target.

    Identifiers are unpivoted to (kind, value), so the four alternatives become one
    equi-join; nulls never match, and a value that very many targets share is
    reduced to one row before the join.
    """

    def pairs(frame: DataFrame, *keep: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])
        return (
            frame.select(*keep, F.explode(each).alias("p"))
            .select(*keep, "p.kind", "p.value")
            .filter(F.col("value").isNotNull())
        )

    known = pairs(targets).distinct()
    return pairs(drives, ident).join(known, ["kind", "value"], "left_semi").select(ident).distinct()


def backlog(files: DataFrame, capacity: int, threshold: int = BACKLOG_BYTES) -> DataFrame:
    """Waiting bytes, utilisation in percent and whether the alert threshold is passed."""
    waiting = F.coalesce(F.sum("size"), F.lit(0))
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        waiting.alias("bytes"),
        (waiting / F.lit(float(capacity)) * 100.0).alias("utilization"),
        (waiting > threshold).alias("alert"),
    )


# -- versions ----------------------------------------------------------------------------------------


def compatible(version: Column, target: str) -> Column:
    """Same major number and a minor number not below the target's."""
    parts = F.split(version, r"\.")
    major, minor = (int(p) for p in target.split(".")[:2])
    return (F.try_element_at(parts, F.lit(1)).try_cast("int") == major) & (
        F.try_element_at(parts, F.lit(2)).try_cast("int") >= minor
    )


def _add_metadata(rows: DataFrame) -> DataFrame:
    """Existing rows get empty bytes, not null."""
    empty = F.lit(bytearray()).cast("binary")
    if "metadata" in rows.columns:
        return rows.withColumn("metadata", F.coalesce("metadata", empty))
    return rows.withColumn("metadata", empty)


MIGRATIONS = {("1.0.0", "1.1.0"): _add_metadata}


def migrate(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Only direct migrations exist; register others in ``MIGRATIONS``."""
    if source == target:
        return rows
    if (source, target) not in MIGRATIONS:
        raise ValueError(f"no migration from {source} to {target}")
    return rows.transform(MIGRATIONS[source, target])


# -- payload encryption -----------------------------------------------------------------------------


def encrypt_by_type(rows: DataFrame, keys: DataFrame, payload: str, kind: str) -> DataFrame:
    """AES-GCM with the newest key of each row's type.

    ``keys`` (kind, key_id, key, created) is configuration: few short rows per type. The key that
    was created last counts, whatever its name; of equally old ones that of the largest id.
    A row whose type has no key fails the job.
    """
    newest = F.max_by(F.struct("key_id", "key"), F.struct("created", "key_id"))
    current = keys.groupBy("kind").agg(newest.alias("_k"))
    joined = rows.join(current.withColumnRenamed("kind", "_kind"), F.col(kind).eqNullSafe(F.col("_kind")), "left")
    missing = F.raise_error(F.concat(F.lit("no key for type "), F.coalesce(F.col(kind), F.lit("null"))))
    key = F.when(F.col("_k").isNull(), missing.cast("binary")).otherwise(F.col("_k.key"))
    return joined.withColumns(
        {
            "key_id": F.col("_k.key_id"),
            payload: F.aes_encrypt(F.col(payload).cast("binary"), key, F.lit("GCM")),
        }
    ).drop("_k", "_kind")


def decrypt_by_type(rows: DataFrame, keys: DataFrame, payload: str, kind: str) -> DataFrame:
    lookup = keys.select(F.col("kind").alias("_of_kind"), F.col("key_id").alias("_of_id"), F.col("key").alias("_key"))
    same = F.col(kind).eqNullSafe(F.col("_of_kind")) & F.col("key_id").eqNullSafe(F.col("_of_id"))
    joined = rows.join(lookup, same, "left")
    missing = F.raise_error(F.concat(F.lit("unknown key "), F.coalesce(F.col("key_id").cast("string"), F.lit("null"))))
    key = F.when(F.col("_key").isNull(), missing.cast("binary")).otherwise(F.col("_key"))
    clear = F.aes_decrypt(F.col(payload), key, F.lit("GCM"))
    return joined.withColumn(payload, clear.cast("string")).drop("_of_kind", "_of_id", "_key", "key_id")


def rotate_keys(rows: DataFrame, keys: DataFrame, payload: str, kind: str) -> DataFrame:
    """Encrypt again under the newest key of each type."""
    return encrypt_by_type(decrypt_by_type(rows, keys, payload, kind), keys, payload, kind)

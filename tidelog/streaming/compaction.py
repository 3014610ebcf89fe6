"""Pack the small folders that batches leave in each day of a stream's table.

A batch writes the folder ``event_date=D/batch_id=k``. Small folders of a day are packed, best
fit first, into files of at most ``room`` rows; large ones are left as they are, so no row is written
again and again. The steps of compaction number c, each of which may be repeated after a failure:

1. the plan, folders and the bin of each, is written beside the data;
2. the rows of its folders are written to ``batch_id=-c``, from the plan;
3. a marker commits it; from here on readers leave the old folders out;
4. the next compaction removes these, so whoever has listed them before can still read them.

Only batches that can never run again may be packed, and a table has one compaction at a time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import qualified
from tidelog.sources import eventlog as el
from tidelog.sources.arrow_files import open_fs
from tidelog.streaming.tables import BATCH

DAY = "event_date"
PLAN = f"{DAY} date, {BATCH} long, rows long, cell long, bin long"
#: Folders that are packed together; a day with more of them has several such cells.
CELL_FOLDERS = 10_000


def best_fit(sizes: list[int], room: int) -> list[int]:
    """The bin of each size: largest first, each into the fullest bin that still holds it.

    Of all bins at most one is no more than half full. A size above ``room`` is an error.
    """
    bins, rooms, opened = [0] * len(sizes), [], 0
    for place in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[place]
        if size > room:
            raise ValueError(f"{size} rows do not fit into {room}")
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            left, number = rooms.pop(at)
        else:
            left, number, opened = room, opened, opened + 1
        bins[place] = number
        insort(rooms, (left - size, number))
    return bins


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField(DAY, T.DateType()), T.StructField(BATCH, T.LongType())])
    return spark.read.schema(whole).parquet(path)


def _folder(path: str) -> Column:
    day = F.coalesce(F.col(DAY).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return F.concat(F.lit(f"{path}/{DAY}="), day, F.lit(f"/{BATCH}="), F.col(BATCH).cast("string"))


def _journal(path: str, step: str, number: int) -> str:
    # Folders whose names begin with an underscore are not part of the table.
    return f"{path}/_compactions/{step}-{number}"


def _done(spark: SparkSession, path: str, step: str, number: int) -> bool:
    return el.folder_exists(spark, f"{_journal(path, step, number)}/_SUCCESS")


def _mark(spark: SparkSession, path: str, step: str, number: int) -> None:
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(_journal(path, step, number))


def _latest(spark: SparkSession, path: str) -> int:
    """The number of the last compaction that has a whole plan, 0 if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_compactions")
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        return 0
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    numbers = [int(n.removeprefix("plan-")) for n in names if n.startswith("plan-")]
    return max((n for n in numbers if _done(spark, path, "plan", n)), default=0)


def _plan(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(PLAN).parquet(_journal(path, "plan", number))


def packing_plan(units: DataFrame, room: int) -> DataFrame:
    """``units`` (day, batch, rows) of at most half of ``room``, with cell and bin of each in its day.

    A bin of one folder is left out: there is nothing to gain. Days may be null.
    """

    def pack(cell: pd.DataFrame) -> pd.DataFrame:
        # In order of the batches, so that folders of equal size are packed alike each time.
        cell = cell.sort_values(BATCH)
        cell["bin"] = best_fit(cell["rows"].tolist(), room)
        several = cell.groupby("bin")[BATCH].transform("size") > 1
        return cell.loc[several, [DAY, BATCH, "rows", "cell", "bin"]]

    small = units.filter(F.col("rows") <= room // 2)
    cells = F.ceil(F.count(F.lit(1)) / F.lit(CELL_FOLDERS)).alias("_cells")
    of_day = small.groupBy(F.col(DAY).alias("_day")).agg(cells)
    dealt = small.join(of_day, F.col(DAY).eqNullSafe(F.col("_day"))).withColumn("cell", F.pmod(BATCH, "_cells"))
    return dealt.select(DAY, BATCH, "rows", "cell").groupBy(DAY, "cell").applyInPandas(pack, PLAN)


def _remove(plan: DataFrame, path: str) -> int:
    """Remove the folders of a plan, in tasks. One that is gone already is not missed."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = 0
            for folder in batch["folder"].to_pylist():
                system, name = open_fs(folder)
                if system.get_file_info(name).type == fs.FileType.Directory:
                    system.delete_dir(name)
                    gone += 1
            yield pa.record_batch([pa.array([gone], pa.int64())], names=["gone"])

    folders = plan.select(_folder(path).alias("folder"))
    return folders.mapInArrow(drop, "gone long").agg(F.sum("gone")).first()[0] or 0


def compact(
    spark: SparkSession, path: str, schema: T.StructType, before: int, order: str = "timestamp_ns", room: int = el.ROWS_PER_FILE
) -> int:
    """Pack the folders of batches below ``before``; the number of folders that went into others.

    ``schema`` is that of the rows without day and batch. A compaction that failed is finished first,
    from its own plan, instead of a new one. Removes the folders that the last one replaced.
    """
    path = qualified(spark, path)
    number = _latest(spark, path)
    if number == 0 or _done(spark, path, "written", number):
        clean(spark, path)
        number += 1
        rows = _table(spark, path, schema).filter(F.col(BATCH) < before)
        units = rows.groupBy(DAY, BATCH).agg(F.count(F.lit(1)).alias("rows"))
        packing_plan(units, room).write.mode("overwrite").parquet(_journal(path, "plan", number))
    plan = _plan(spark, path, number)
    # Names of folders, as many as the driver lists for any scan of them.
    folders = [r.folder for r in plan.select(_folder(path).alias("folder")).collect()]
    if folders:
        rows = spark.read.schema(_table(spark, path, schema).schema).option("basePath", path).parquet(*folders)
        bins = plan.select(F.col(DAY).alias("_day"), F.col(BATCH).alias("_batch"), "cell", "bin")
        packed = rows.join(bins, (F.col(BATCH) == F.col("_batch")) & F.col(DAY).eqNullSafe(F.col("_day")))
        packed = packed.repartition(DAY, "cell", "bin").sortWithinPartitions(DAY, order)
        (
            packed.select(*schema.names, DAY, F.lit(-number).cast("long").alias(BATCH))
            .write.mode("overwrite")
            .options(**{**el.event_options(), "maxRecordsPerFile": room})
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(DAY, BATCH)
            .parquet(path)
        )
    _mark(spark, path, "written", number)
    return len(folders)


def clean(spark: SparkSession, path: str) -> int:
    """Remove the folders that the last compaction replaced, now that nobody reads them; their number."""
    path = qualified(spark, path)
    number = _latest(spark, path)
    if number == 0 or not _done(spark, path, "written", number) or _done(spark, path, "cleaned", number):
        return 0
    gone = _remove(_plan(spark, path, number), path)
    _mark(spark, path, "cleaned", number)
    for step in ("plan", "written", "cleaned"):
        el.drop_folder(spark, _journal(path, step, number - 1))
    return gone


def read_compacted(spark: SparkSession, path: str, schema: T.StructType, folders: bool = False) -> DataFrame:
    """Every row once, whatever step a compaction has come to; with day and batch if ``folders``."""
    path = qualified(spark, path)
    rows, number = _table(spark, path, schema), _latest(spark, path)
    if number and not _done(spark, path, "written", number):
        rows = rows.filter(F.col(BATCH) != -number)
    elif number and not _done(spark, path, "cleaned", number):
        old = _plan(spark, path, number).select(F.col(DAY).alias("_day"), F.col(BATCH).alias("_batch"))
        rows = rows.join(old, (F.col(BATCH) == F.col("_batch")) & F.col(DAY).eqNullSafe(F.col("_day")), "left_anti")
    return rows if folders else rows.drop(DAY, BATCH)

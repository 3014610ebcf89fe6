"""Tables that a stream writes batch by batch, safely repeatable.

Every batch writes under its own number. When a batch is run again after a
failure, it overwrites exactly what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.sources.eventlog import drop_folder

BATCH = "batch_id"


def write_batch(
    rows: DataFrame, path: str, batch_id: int, by: list[str] | None = None, options: dict[str, object] | None = None
) -> None:
    (
        rows.withColumn(BATCH, F.lit(batch_id))
        .write.mode("overwrite")
        .options(**(options or {}))
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*(by or []), BATCH)
        .parquet(path)
    )


def write_state(rows: DataFrame, path: str, batch_id: int) -> None:
    """State as it is after a batch. The next batch reads it; a repeated batch
    reads the one before and so starts from the same state again. Older states
    are removed: a batch that is done is never repeated."""
    rows.write.mode("overwrite").parquet(f"{path}/after={batch_id}")
    if batch_id >= 2:
        drop_folder(rows.sparkSession, f"{path}/after={batch_id - 2}")


def read_state(spark: SparkSession, path: str, batch_id: int, schema: StructType) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/after={batch_id - 1}")


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What the stream has written so far, which may be nothing; without the
    partition columns."""
    written = spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(path)
    return written.drop(BATCH, "event_date")

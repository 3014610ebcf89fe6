"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that cross to Python at once; whole texts cross, so few of them.
BATCH_ROWS = 128


def read(spark: SparkSession, root: str, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return spark.read.parquet(f"{root}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def remainder(ident: F.Column, divisor: int) -> F.Column:
    """crc32 of an id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(ident.cast("string").cast("binary")) % divisor


def split_sizes(column: pa.Array) -> list[np.ndarray]:
    """The values of a list column, row by row."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = [0 if x is None else len(x) for x in column]
    return np.split(flat, np.cumsum(sizes)[:-1]) if sizes else []


def frames(schema: pa.Schema, rows: Iterator[tuple], size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

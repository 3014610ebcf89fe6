"""``format("arrow_files")``: a sink that writes Arrow IPC files of a bounded number of rows, and their reader.

A file is read by record batches: its footer tells where they are, so a file of any size is
spread over tasks, and a task holds one record batch at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    WriterCommitMessage,
)

SUFFIX = ".arrow"
ROWS_PER_FILE = 1_000_000


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    rows: int


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI as Spark writes it."""
    scheme, colon, rest = path.partition(":")
    if scheme == "file" and colon:
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if rest.startswith("//"):
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), path


class ArrowFileWriter(DataSourceArrowWriter):
    """A task writes under a name of its own in a staging folder; the commit moves
    the files of the successful attempts. A retried task leaves nothing behind."""

    def __init__(self, path: str, compression: str | None, overwrite: bool, rows_per_file: int):
        self.path = path.rstrip("/")
        self.compression = compression
        self.overwrite = overwrite
        self.rows_per_file = rows_per_file
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex[:12]}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, staging = open_fs(self.staging)
        files.create_dir(staging, recursive=True)
        task = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        names, rows, left, writer, sink = [], 0, 0, None, None
        options = pa.ipc.IpcWriteOptions(compression=self.compression)
        for batch in batches:
            rows += batch.num_rows
            while batch.num_rows:
                if writer is None:
                    names.append(f"{task}-{len(names):04d}{SUFFIX}")
                    sink = files.open_output_stream(f"{staging}/{names[-1]}")
                    writer, left = pa.ipc.new_file(sink, batch.schema, options=options), self.rows_per_file
                writer.write_batch(batch.slice(0, left))
                batch, left = batch.slice(left), left - min(left, batch.num_rows)
                if not left:
                    writer.close()
                    sink.close()
                    writer = None
        if writer is not None:
            writer.close()
            sink.close()
        return Written(names, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, target = open_fs(self.path)
        _, staging = open_fs(self.staging)
        files.create_dir(target, recursive=True)
        if self.overwrite:
            for info in files.get_file_info(pafs.FileSelector(target)):
                if info.base_name.endswith(SUFFIX):
                    files.delete_file(info.path)
        for message in messages:
            for name in message.names if message is not None else ():
                files.move(f"{staging}/{name}", f"{target}/{name}")
        self._drop_staging(files, staging)
        with files.open_output_stream(f"{target}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        files, staging = open_fs(self.staging)
        self._drop_staging(files, staging)

    @staticmethod
    def _drop_staging(files: pafs.FileSystem, staging: str) -> None:
        if files.get_file_info(staging).type == pafs.FileType.Directory:
            files.delete_dir(staging)


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def writer(self, schema, overwrite: bool) -> ArrowFileWriter:
        bound = int(self.options.get("maxRecordsPerFile", ROWS_PER_FILE))
        return ArrowFileWriter(self.options["path"], self.options.get("compression"), overwrite, bound)


def read_batches(files: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of Arrow files (``path``), with the columns of ``schema`` alone.

    Columns are found by name; one that a file lacks ends the job.
    """
    names = schema.fieldNames()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch["path"].to_pylist():
                system, name = open_fs(path)
                with system.open_input_file(name) as source:
                    found += [(path, i) for i in range(pa.ipc.open_file(source).num_record_batches)]
            paths, numbers = zip(*found) if found else ((), ())
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(numbers, pa.int32())], names=["path", "number"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number in zip(batch["path"].to_pylist(), batch["number"].to_pylist()):
                system, name = open_fs(path)
                with system.open_input_file(name) as source:
                    # Bytes of other columns and batches are not read.
                    kinds = pa.ipc.open_file(source).schema
                    chosen = pa.ipc.IpcReadOptions(included_fields=[kinds.get_field_index(n) for n in names])
                    yield pa.ipc.open_file(source, options=chosen).get_batch(number).select(names)

    listed = files.select("path").mapInArrow(places, "path string, number int")
    return listed.repartition("path", "number").mapInArrow(rows, schema)
